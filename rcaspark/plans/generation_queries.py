"""Queries over prompt tables, recorded calls and the verdicts read from them.

Answers come from offline stand-ins that depend on the prompt's SHA-256 only, so
a different prompt is seen as a different answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.operators import generate
from rcaspark.operators.edges import PAIR
from rcaspark.plans import graph_queries as gq
from rcaspark.plans import log_queries as lq
from rcaspark.plans.fixtures import case_by
from rcaspark.plans.registry import query, table
from rcaspark.session import scratch_path
from rcaspark.sources import sinks

THEME = "trade between nations"
PAIRS = "p AS (SELECT a.n_name AS cause, b.n_name AS effect, a.n_nationkey AS cp, b.n_nationkey AS ep FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)"
QUESTION = "'If ' || cause || ' is changed, does that have a direct effect on ' || effect || '? '"
YES_NO = "'Answer with <Yes> or <No> and nothing else.'"
NUMBER = "'Answer with one number from 0 to 1 and nothing else.'"
COIN = "CASE WHEN substr(sha256({}), 1, 1) < '8' THEN 1 ELSE 0 END"
NODE_TEXT = "(SELECT n_name AS entity, 'nation ' || n_name || ' of region ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _prompts_sql(a, b, said_of_first):
    edge = "EXISTS (SELECT 1 FROM e1 WHERE e1.cause = p.cause AND e1.effect = p.effect)"
    if said_of_first:
        edge = "EXISTS (SELECT 1 FROM e1 WHERE mark = '->' AND e1.cause = p.effect AND e1.effect = p.cause)"
    said = f"'It suggests that changes in ' || cause || CASE WHEN {edge} THEN ' directly affect ' ELSE ' do not directly affect ' END || effect || '.' || chr(10) || chr(10)"
    pick = "(SELECT said FROM w ORDER BY cp, ep LIMIT 1)" if said_of_first else "said"
    return f"""
    WITH {gq.FLOWS}, {PAIRS}, w AS (SELECT *, {said} AS said FROM p),
    n AS (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation),
    g AS (SELECT string_agg({a} || ' is the cause of ' || {b} || '.' || chr(10), '' ORDER BY ne.n_nationkey, nc.n_nationkey) AS t
          FROM e1 JOIN nation nc ON cause = nc.n_name JOIN nation ne ON effect = ne.n_name),
    q AS (SELECT cause, effect, 'Causal discovery on {THEME} with the variables ' || names || '. The pc algorithm found:' || chr(10) || t || chr(10) || {pick}
                 || 'Explain from domain knowledge whether ' || cause || ' is a cause of ' || effect || ', and whether the finding is plausible.' AS prompt FROM w, n, g)
    """


PLAIN = _prompts_sql("cause", "effect", False)


def _explanations(spark, d, compat="corrected"):
    nodes = gq._nations(spark, d)
    return generate.explanation_prompts(generate.ordered_pairs(nodes), gq._before(spark, d), nodes, THEME, "pc", compat)


def _node_texts(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.select(case_by("n_name").alias("case"), F.col("n_name").alias("entity"),
                    F.concat(F.lit("nation "), "n_name", F.lit(" of region "), "r_name").alias("text"))


@query("jn10_ordered_pairs", f"WITH {PAIRS} SELECT cause, effect FROM p")
def _(spark, d):
    return generate.ordered_pairs(gq._nations(spark, d)).select("cause", "effect")


@query("jn11_pair_texts", f"WITH {PAIRS} SELECT cause, effect, a.text AS cause_text, b.text AS effect_text FROM p JOIN {NODE_TEXT} a ON cause = a.entity JOIN {NODE_TEXT} b ON effect = b.entity")
def _(spark, d):
    pairs = generate.with_node_texts(generate.ordered_pairs(gq._nations(spark, d)), _node_texts(spark, d))
    return pairs.select("cause", "effect", "cause_text", "effect_text")


@query("fn16_explanation_prompts", PLAIN + "SELECT cause, effect, prompt FROM q")
def _(spark, d):
    return _explanations(spark, d).select("cause", "effect", "prompt")


@query("fn16_explanation_prompts_released", _prompts_sql("effect", "cause", True) + "SELECT cause, effect, prompt FROM q")
def _(spark, d):
    return _explanations(spark, d, "released").select("cause", "effect", "prompt")


@query("gn01_gn03_recorded_calls", """
    SELECT conv_id, turn, 'COMPLETE' AS status, 'digest ' || sha256(text) AS text, length(text) AS prompt_chars FROM conversations WHERE role = 'user'
""")
def _(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit("system").alias("system"), F.col("text").alias("prompt"))
    calls = generate.run_calls(q, ["conv_id", "turn"], generate.echo_client)
    return generate.complete_only(generate.record(calls)).select("conv_id", "turn", "status", "text", "prompt_chars")


@query("gn03_resumed_calls", """
    SELECT conv_id, turn, 'COMPLETE' AS status FROM conversations WHERE role = 'user' AND turn > 0
""")
def _(spark, d):
    # First turns are done already; the rest is asked for.
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit("system").alias("system"), F.col("text").alias("prompt"))
    done = q.where("turn = 0").select("conv_id", "turn")
    return generate.run_calls(q, ["conv_id", "turn"], generate.echo_client, done=done).select("conv_id", "turn", "status")


@query("gn03_call_store", """
    SELECT conv_id, turn, 'COMPLETE' AS status, 'digest ' || sha256(text) AS text FROM conversations WHERE role = 'user'
""")
def _(spark, d):
    # The first run asks for first turns only; the second one for everything, and finds those in the store.
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit("system").alias("system"), F.col("text").alias("prompt"))
    path = scratch_path(spark, "store")
    generate.stored_calls(q.where("turn = 0"), ["conv_id", "turn"], generate.echo_client, path)
    calls = generate.stored_calls(q, ["conv_id", "turn"], generate.echo_client, path)
    return generate.complete_only(calls).select("conv_id", "turn", "status", "text")


@query("gn02_fn23_admission", """
    SELECT conv_id, turn, length(text) AS tokens, length(text) + 101 AS required, length(text) + 101 <= 400 AS fits, greatest(0, 400 - length(text) - 1) AS max_output,
           CASE WHEN length(text) + 101 <= 400 THEN 'ADMITTED' ELSE 'BLOCKED_CAPACITY' END AS status FROM conversations WHERE role = 'user'
""")
def _(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return generate.admission(q, F.length("prompt").cast("bigint"), 400, 100).drop("prompt")


@query("ag28_capacity_curve", """
    WITH c AS (SELECT unnest([256, 512, 1024, 4096]) AS context)
    SELECT context, count(*) AS n, count(*) FILTER (length(text) + 129 <= context) AS fitting FROM c, documents GROUP BY 1
""")
def _(spark, d):
    return generate.capacity_curve(table(spark, d, "documents"), F.length("text"), [256, 512, 1024, 4096], 128)


def _calls(spark, d):
    """Assistant turns as recorded answers: words stand for tokens, characters for time."""
    return table(spark, d, "conversations").select(
        F.col("role").alias("phase"), "text", F.size(F.split("text", " ")).cast("bigint").alias("tokens"), (F.length("text") / 100).alias("seconds"))


@query("ag27_call_statistics", """
    WITH c AS (SELECT role AS phase, len(string_split(text, ' ')) AS tokens, length(text) / 100 AS seconds FROM conversations)
    SELECT phase, count(*) AS calls, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round(avg(tokens), 6) AS mean_tokens, CAST(sum(tokens) AS BIGINT) AS sum_tokens, round(sum(seconds), 6) AS seconds FROM c GROUP BY 1
""")
def _(spark, d):
    return gq._rounded(generate.call_statistics(_calls(spark, d), ["phase"]))


@query("ag27_answer_counts", "SELECT role AS phase, text, count(*) AS n FROM conversations GROUP BY 1, 2")
def _(spark, d):
    return generate.answer_counts(_calls(spark, d), ["phase"])


def _explained(spark, d):
    calls = generate.run_calls(_explanations(spark, d), PAIR, generate.echo_client)
    return generate.complete_only(generate.record(calls))


@query("gn04_pair_explanations", PLAIN + "SELECT cause, effect, 'digest ' || sha256(prompt) AS text FROM q")
def _(spark, d):
    return _explained(spark, d).select("cause", "effect", "text")


ASKED = f"""
    x AS (SELECT cause, effect, 'An expert in {THEME} explains how ' || cause || ' and ' || effect || ' are related:' || chr(10) || 'digest ' || sha256(prompt) || chr(10) || {QUESTION} || {YES_NO} AS ask FROM q)
"""


@query("gn05_pair_verdicts", PLAIN.rstrip() + f", {ASKED} SELECT cause, effect, {COIN.format('ask')} AS verdict FROM x")
def _(spark, d):
    asked = generate.verdict_prompts(_explained(spark, d), THEME)
    return generate.verdicts(generate.complete_only(generate.record(generate.run_calls(asked, PAIR, generate.coin_client, 0.8)))).drop("case")


@query("fn17_verdict_prompts", f"""
    WITH e AS (SELECT n_name AS cause, r_name AS effect FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT cause, effect, 'An expert in {THEME} explains how ' || cause || ' and ' || effect || ' are related:' || chr(10) || 'both' || chr(10) || {QUESTION}
           || 'Give 3 guesses with their probabilities as G1: guess <Yes> or <No>, a blank line, P1: probability, a line of ---, and so on.' AS prompt FROM e
""")
def _(spark, d):
    t = _node_texts(spark, d).select("case", F.col("entity").alias("cause"), F.substring_index("text", " of region ", -1).alias("effect"), F.lit("both").alias("text"))
    return generate.verdict_prompts(t, THEME, "guesses", 3).select("cause", "effect", "prompt")


JUDGED = f"""
    m1 AS (SELECT cause, effect, {QUESTION} AS q, 'Debate so far:' || chr(10) AS lead FROM p),
    s1 AS (SELECT *, 'digest ' || sha256(lead || q || 'Argue as the expert who supports it.') AS a FROM m1),
    t1 AS (SELECT *, 'The positive expert says: ' || a || chr(10) AS mem FROM s1),
    u1 AS (SELECT *, mem || 'The negative expert says: digest ' || sha256(lead || mem || q || 'Argue as the expert who opposes it.') || chr(10) AS mem2 FROM t1),
    j1 AS (SELECT *, round(CAST('0x' || substr(sha256(mem2 || q || {NUMBER}), 1, 2) AS INTEGER) / 255, 4) AS p1 FROM u1)
"""


@query("gn06_first_debate_round", f"WITH {PAIRS}, {JUDGED} SELECT cause, effect, CASE WHEN p1 > 0.8 THEN 1 ELSE 0 END AS verdict FROM j1 WHERE p1 > 0.8 OR p1 < 0.2")
def _(spark, d):
    decided, _turns = generate.debate(generate.ordered_pairs(gq._nations(spark, d)), THEME, generate.echo_client, generate.number_client)
    return decided.where("rounds = 1").select("cause", "effect", "verdict")


def _round_sql(i):
    """Round ``i`` of a debate among the pairs that are still open."""
    return f"""
    m{i} AS (SELECT cause, effect, q, mem2 AS mem0 FROM j{i - 1} WHERE p{i - 1} BETWEEN 0.2 AND 0.8),
    t{i} AS (SELECT *, mem0 || 'The positive expert says: digest ' || sha256('Debate so far:' || chr(10) || mem0 || q || 'Argue as the expert who supports it.') || chr(10) AS mem FROM m{i}),
    u{i} AS (SELECT *, mem || 'The negative expert says: digest ' || sha256('Debate so far:' || chr(10) || mem || q || 'Argue as the expert who opposes it.') || chr(10) AS mem2 FROM t{i}),
    j{i} AS (SELECT *, round(CAST('0x' || substr(sha256(mem2 || q || {NUMBER}), 1, 2) AS INTEGER) / 255, 4) AS p{i} FROM u{i})
    """


DEBATED = f"""
    WITH {PAIRS}, {JUDGED}, {_round_sql(2)}, {_round_sql(3)}
    SELECT cause, effect, CASE WHEN p1 > 0.8 THEN 1 ELSE 0 END AS verdict, 1 AS rounds FROM j1 WHERE p1 > 0.8 OR p1 < 0.2 UNION ALL
    SELECT cause, effect, CASE WHEN p2 > 0.8 THEN 1 ELSE 0 END, 2 FROM j2 WHERE p2 > 0.8 OR p2 < 0.2 UNION ALL
    SELECT cause, effect, CASE WHEN p3 > 0.5 THEN 1 WHEN p3 < 0.5 THEN 0 END, 3 FROM j3
"""


@query("gn06_debate", DEBATED)
def _(spark, d):
    decided, _turns = generate.debate(generate.ordered_pairs(gq._nations(spark, d)), THEME, generate.echo_client, generate.number_client)
    return decided.drop("case")


@query("gn06_replayed_debate", DEBATED)
def _(spark, d):
    # The judge reads the event log of a debate once more; nobody argues anew.
    _decided, turns = generate.debate(generate.ordered_pairs(gq._nations(spark, d)), THEME, generate.echo_client, generate.number_client)
    path = scratch_path(spark, "turns")
    turns.write.parquet(path)
    return generate.replay_debate(spark.read.parquet(path), generate.number_client).drop("case")


@query("gn07_direct_verdicts", f"""
    WITH {PAIRS}, q AS (SELECT cause, effect, {QUESTION} || {YES_NO} AS plain, a.text || chr(10) || b.text || chr(10) || {QUESTION} || {YES_NO} AS informed
                        FROM p JOIN {NODE_TEXT} a ON cause = a.entity JOIN {NODE_TEXT} b ON effect = b.entity)
    SELECT cause, effect, 'plain' AS variant, {COIN.format('plain')} AS verdict FROM q UNION ALL SELECT cause, effect, 'informed', {COIN.format('informed')} FROM q
""")
def _(spark, d):
    pairs = generate.with_node_texts(generate.ordered_pairs(gq._nations(spark, d)), _node_texts(spark, d))
    out = None
    for variant in ("plain", "informed"):
        q = generate.direct_prompts(pairs, THEME, with_texts=variant == "informed")
        v = generate.verdicts(generate.run_calls(q, PAIR, generate.coin_client), "any_case").withColumn("variant", F.lit(variant))
        out = v if out is None else out.unionByName(v)
    return out.drop("case")


def _log_plan(spark, d):
    """Pods of the event log; the KPI column comes last."""
    templates, lines = lq._log_tables(spark, d)
    pods = lines.select("case", "entity").distinct().withColumn("pos", F.substring("entity", 5, 9).cast("int")).withColumn("is_kpi", F.lit(False))
    kpi = pods.groupBy("case").agg((F.max("pos") + 1).alias("pos")).select("case", F.lit("Latency").alias("entity"), "pos", F.lit(True).alias("is_kpi"))
    have = pods.select("case", "entity", F.explode(F.array(F.lit("templates"), F.lit("structured"))).alias("kind"))
    from rcaspark.operators.evidence import evidence_plan

    return evidence_plan(pods.unionByName(kpi), have), templates, lines


LOG_PROMPT = f"""
    pods AS (SELECT string_agg(entity, ', ' ORDER BY entity) || {{tail}} AS names FROM (SELECT DISTINCT entity FROM l {{pick}})),
    q AS (SELECT entity, 'Entities of a shop:' || chr(10) || chr(10) || names || chr(10) || chr(10) || 'Log events of ' || entity || ', each with examples:' || chr(10) || chr(10)
          || log_text || chr(10) || 'Summarise the role, key events (frequent and rare), status and likely relations of ' || entity || '.' AS prompt FROM lt, pods)
"""
LOG_TEXT = lq._text_sql(lq.EVENT_LINES).rstrip().removeprefix("\n").replace("SELECT entity, string_agg(text, '' ORDER BY er) AS log_text, count(*) AS n_events FROM b GROUP BY 1", "lt AS (SELECT entity, string_agg(text, '' ORDER BY er) AS log_text FROM b GROUP BY 1)").replace("WHERE er <= er)", "WHERE er <= er),")


@query("gn08_entity_summaries", f"""
    {LOG_TEXT}, {LOG_PROMPT.format(tail="', Latency'", pick='')}
    SELECT entity, 'digest ' || sha256(prompt) AS text FROM q UNION ALL
    SELECT 'Latency', 'This is an input KPI column, not a pod. No pod event log is assigned to this column. Its column label alone does not establish its physical meaning.'
""")
def _(spark, d):
    plan, templates, lines = _log_plan(spark, d)
    return generate.entity_summaries(plan, templates, lines, "shop", generate.echo_client).select("entity", "text")


@query("gn09_narrowed_prompts", f"""
    {LOG_TEXT}, {LOG_PROMPT.format(tail="', Latency'", pick="WHERE entity < 'pod-3'")} SELECT entity, prompt FROM q WHERE entity < 'pod-3'
""")
def _(spark, d):
    from rcaspark.operators.logs import log_text

    plan, templates, lines = _log_plan(spark, d)
    nodes = plan.select("case", "entity", "pos")
    wide = generate.summary_prompts(log_text(templates, lines), nodes, "shop")
    return generate.narrowed_prompts(wide, nodes.where("entity < 'pod-3'"), "shop").select("entity", "prompt")


@query("src12_snk09_answer_cache", """
    SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role = 'assistant'
""")
def _(spark, d):
    path = scratch_path(spark, "answers")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", case_by("conv_id").alias("case"), F.lit("pc").alias("algorithm"), F.col("role").alias("variant"))
    sinks.write_answers(rows, path)
    return sinks.read_answers(spark, path, gq.CASE, "pc", "assistant").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("src13_call_records", """
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call_no, 'COMPLETE' AS status FROM conversations
""")
def _(spark, d):
    from rcaspark.operators.order import full_rank

    path = scratch_path(spark, "calls")
    table(spark, d, "conversations").select("conv_id", "turn", F.lit("COMPLETE").alias("status"), F.struct(F.col("text").alias("content")).alias("response")).write.json(path)
    calls = generate.complete_only(spark.read.schema("conv_id BIGINT, turn BIGINT, status STRING, response STRUCT<content: STRING>").json(path))
    return full_rank(calls.select("conv_id", "turn", "status"), ["conv_id"], [F.col("turn")], "call_no")


@query("tk07_query_rounds", """
    WITH q AS (SELECT conv_id, turn, md5(text) AS question FROM conversations WHERE role = 'user'),
    f AS (SELECT conv_id, question, min(turn) AS turn FROM q GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, question) AS round FROM f)
    SELECT conv_id, question, round FROM r WHERE round <= 3
""")
def _(spark, d):
    from rcaspark.plans.refine import query_rounds

    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("question"))
    return query_rounds(q, "conv_id", rounds=3).select("conv_id", "question", "round")


@query("rg03_cited_answers", """
    WITH a AS (SELECT page_id, url FROM pages)
    SELECT page_id, 'Found on page ' || page_id AS sentence, replace(url, 'http://', 'https://') AS url, 'page ' || page_id AS title FROM a
""")
def _(spark, d):
    from rcaspark.plans.refine import cited_answers

    def scribe():
        """Offline stand-in: cites the first page it is shown."""
        import re

        def ask(prompt, system, temperature):
            url = re.search(r"url: (\S+):\n", prompt)[1]
            page = re.search(r"Query: about (\d+)", prompt)[1]
            return f"Answer.\nFound on page {page} [1].\nReferences:\n[1] URL: {url}\nQuoted sentence: x\n", "stop"

        return ask

    p = table(spark, d, "pages").withColumn("url", F.replace("url", F.lit("http://"), F.lit("https://")))
    hits = p.select("page_id", "url", F.concat(F.lit("page "), "page_id").alias("title"), F.lit("s").alias("snippet"), F.lit(0).alias("rank"), F.md5("html").alias("content"))
    ask = p.select("page_id", F.concat(F.lit("about "), "page_id").alias("question"))
    return cited_answers(ask, hits, ["page_id"], scribe).select("page_id", "sentence", "url", "title")


@query("rg04_dataset_summary", """
    SELECT name, 'state of ' || name AS body, 'a shop' AS dataset FROM (SELECT DISTINCT 'pod-' || CAST(user_id % 5 AS VARCHAR) AS name FROM events)
""")
def _(spark, d):
    from rcaspark.plans.refine import dataset_summary

    def writer():
        """Offline stand-in: one section per entity named in the prompt."""
        import re

        def ask(prompt, system, temperature):
            names = re.search(r"Nodes: (.*)\n", prompt)[1].split(", ")
            return "Dataset Summary: a shop" + "".join(f"\n---\nSummary of the {n}: state of {n}" for n in names), "stop"

        return ask

    ev = table(spark, d, "events")
    texts = ev.groupBy(F.concat(F.lit("pod-"), F.col("user_id") % 5).alias("entity")).agg(
        F.concat(F.lit("rows: "), F.count("*")).alias("text")).withColumn("case", case_by("entity"))
    nodes = texts.select("case", "entity", F.substring("entity", 5, 9).cast("int").alias("pos"))
    return dataset_summary(texts, nodes, writer).select("name", "body", "dataset")
