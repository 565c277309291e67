"""Whole jobs: metric preprocessing, cited answers, data set summaries, discovery refined by verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rcaspark.functions import text as tx
from rcaspark.functions.vectors import letter_embedding
from rcaspark.operators import align, discover, edges, evaluate, generate, retrieve, walk
from rcaspark.operators.edges import PAIR
from rcaspark.operators.order import first_per_group
from rcaspark.operators.profile import GateError, require
from rcaspark.session import cut_lineage
from rcaspark.streaming.spot import alert_counts, spot_scores

#: Between case and stage in the key of a walk.
STAGE = "\x1f"


def preprocess(channels: DataFrame, kpi: DataFrame, **spot) -> dict[str, DataFrame]:
    """Channels to fused entity series: align, profile, score, keep alerting entities, fuse."""
    common = cut_lineage(align.common_timestamps(channels))
    rows = cut_lineage(align.align(channels, common))
    require(align.kpi_conflicts(kpi), {"same_kpi": F.lit(False)})
    stats = align.channel_stats(rows)
    usable = rows.join(stats.where("not constant").select("case", "entity", "metric"), ["case", "entity", "metric"], "left_semi")
    alerts = cut_lineage(alert_counts(spot_scores(usable, ["case", "entity", "metric"], "ts", "value", **spot), ["case", "entity", "metric"]))
    decisions = cut_lineage(align.entity_decisions(rows, alerts))
    kept = decisions.where("kept").select("case", "entity")
    fused = align.fuse(align.zscore(align.keep_entities(rows, kept)))
    return {"stats": stats, "alerts": alerts, "decisions": decisions, "fused": fused, "dropped": align.dropped_rows(channels, common)}


def query_rounds(questions: DataFrame, key: str, rounds: int) -> DataFrame:
    """At most ``rounds`` questions per key in the order proposed, none asked twice."""
    first = questions.groupBy(key, "question").agg(F.min("turn").alias("turn"))
    return first_per_group(first, [key], [F.col("turn"), F.col("question")], rounds, "round")


def cited_answers(questions: DataFrame, hits: DataFrame, keys: Sequence[str], factory: Callable[[], generate.Client], k: int = 10) -> DataFrame:
    """Answer each question from its own hits and say where each cited sentence comes from.

    ``hits`` holds (keys, url, title, snippet, rank, content); empty contents are left out.
    """
    shown = first_per_group(hits.where("content <> ''"), keys, [F.col("rank"), F.col("url")], k, "place")
    context = retrieve.render_context(shown, keys, "url", "content", "place")
    prompt = F.concat(F.lit("Web search result:"), F.col("context"), F.lit(
        "Cite results as [number] after what they support. End with References: and, for each number, its URL and the quoted sentence.\nQuery: "), F.col("question"))
    asked = questions.join(context, list(keys)).select(*keys, F.lit("You answer from search results.").alias("system"), prompt.alias("prompt"))
    calls = generate.complete_only(generate.record(generate.run_calls(asked, keys, factory)))
    cited = tx.match_references(tx.cited_sentences(calls, "text", keys), tx.references(calls, "text", keys), keys)
    return tx.locate_web_info(cited, hits, keys)


def dataset_summary(texts: DataFrame, nodes: DataFrame, factory: Callable[[], generate.Client], k: int = 2, embed=letter_embedding) -> DataFrame:
    """(case, name, body, dataset) from the entity texts nearest to the question about each case.

    Every entity must come back with a section; unknown or missing names are errors.
    """
    names = nodes.groupBy("case").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]), ", ").alias("_names"),
        F.array_agg("entity").alias("_labels"))
    question = F.concat(F.lit("Summarise the data set and every node.\nNodes: "), F.col("_names"), F.lit("\n"))
    asked = names.withColumn("question", question)
    queries = retrieve.embed(asked.select("case", F.col("case").alias("query_id"), "question"), "question", embed)
    chunks = retrieve.chunk_table(texts, "text", ["case", "entity"], tx.fixed_chunks(F.col("text"), 1024, 200))
    chunks = cut_lineage(retrieve.embed(chunks.withColumn("vec_id", F.concat_ws("#", "case", "entity", "chunk")), "text", embed))
    # A case's question is answered from the case's own chunks: k of each case, all queries in one pass.
    near = retrieve.nearest(queries, chunks, k, by=["case"]).join(chunks.select("case", "vec_id", "text"), ["case", "vec_id"])
    context = near.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("_context"))
    prompts = asked.join(context, "case").select("case", F.lit("You summarise a system.").alias("system"), F.concat("_context", F.lit("\n\n"), "question").alias("prompt"))
    calls = generate.complete_only(generate.record(generate.run_calls(prompts, ["case"], factory)))
    read = cut_lineage(calls.join(names.select("case", "_labels"), "case").withColumn("s", tx.canonical_summary(F.col("text"), F.col("_labels"))).select("case", "_labels", "s.*"))
    wrong = read.where(F.col("error").isNotNull() | (F.size(F.array_except("_labels", "names")) > 0)).limit(5).collect()
    if wrong:
        raise GateError("summary refused: " + ", ".join(f"{r['case']} ({r['error'] or 'missing node'})" for r in wrong))
    return read.select("case", "dataset", F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("bodies").alias("body"))))


def refine_cases(
    rows: DataFrame, nodes: DataFrame, theme: str,
    explain: Callable[[], generate.Client], decide: Callable[[], generate.Client],
    method: str = "pc", compat: str = "corrected", texts: DataFrame | None = None,
    form: str = "yes_no", debate_rounds: int = 0, store: str | None = None, **options,
) -> dict[str, DataFrame]:
    """Discover, explain each pair, decide, discover again under the verdicts, rank both graphs: all cases in one job.

    ``rows`` is a panel and ``nodes`` (case, entity, pos) its variables; the last
    one of a case is its KPI. ``texts`` (case, entity, text), such as log
    summaries and web pages, go into the explanations. Verdicts are asked as
    ``form``: "yes_no", "any_case" or "guesses"; with ``debate_rounds`` a debate
    between two experts is judged by ``decide`` instead. With ``store`` answers
    are kept in a call store there, and a broken run goes on from it. Every
    stage is stored before the next one reads it. The released protocol ranks
    the first constrained stage on the initial graph.
    """
    last = Window.partitionBy("case").orderBy(F.desc("pos"))
    kpi = nodes.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
    initial = cut_lineage(discover.discover_cases(rows, nodes, method, **options))

    def ask(prompts: DataFrame, step: str, factory: Callable[[], generate.Client], temperature: float) -> DataFrame:
        if store is None:
            return generate.complete_only(generate.record(generate.run_calls(prompts, PAIR, factory, temperature)))
        return generate.complete_only(generate.stored_calls(prompts, PAIR, factory, f"{store}/{step}", temperature))

    pairs = generate.ordered_pairs(nodes)
    if texts is not None:
        known = nodes.join(texts.select("case", "entity", "text"), ["case", "entity"], "left").select("case", "entity", F.coalesce("text", F.lit("")).alias("text"))
        pairs = generate.with_node_texts(pairs, known)
    asked = generate.explanation_prompts(pairs, initial, nodes, theme, method, compat)
    explained = ask(asked, "explain", explain, 0.5)
    turns = None
    if debate_rounds:
        constraints, turns = generate.debate(pairs, theme, explain, decide, rounds=debate_rounds, compat=compat)
        constraints = constraints.select(*PAIR, "verdict")
    else:
        prompts = generate.verdict_prompts(explained, theme, "guesses" if form == "guesses" else "yes_no")
        constraints = generate.verdicts(ask(prompts, "decide", decide, 0.8), form)
    constraints = cut_lineage(constraints)
    refined = cut_lineage(discover.discover_cases(rows, nodes, method, constraints=constraints, **options))
    graphs = initial.withColumn("graph_role", F.lit("initial")).unionByName(refined.withColumn("graph_role", F.lit("refined")))
    second = "initial" if compat == "released" else "refined"
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(g).alias("graph_role")) for s, g in (("discovered", "initial"), ("constrained", second))])
    routes = kpi.select("case", F.inline(stages))
    staged = cut_lineage(routes.join(graphs, ["case", "graph_role"]))
    # A stage of a case walks on its own; the walk's case key carries both. A graph without edges leaves the walk at the KPI.
    both = F.concat_ws(STAGE, "case", "stage")
    step = staged.withColumn("case", both)
    stage_nodes = cut_lineage(nodes.join(routes.select("case", "stage"), "case").withColumn("case", both))
    stage_kpi = kpi.join(routes.select("case", "stage"), "case").withColumn("case", both)
    moves = cut_lineage(walk.transitions(walk.walk_graph(step, stage_kpi)))
    ranking = walk.rank_nodes(walk.expected_visits(moves, stage_nodes, stage_kpi), stage_nodes, digits=9)
    ranking = ranking.select(
        F.substring_index("case", STAGE, 1).alias("case"), F.substring_index("case", STAGE, -1).alias("stage"), "node", "visits", "rank")
    out = {"initial": initial, "explained": explained, "constraints": constraints, "refined": refined, "ranking": cut_lineage(ranking), "nodes": nodes, "kpi": kpi}
    return out | ({} if turns is None else {"turns": turns})


def refine(
    wide: DataFrame, columns: Sequence[str], case: str, theme: str,
    explain: Callable[[], generate.Client], decide: Callable[[], generate.Client], **options,
) -> dict[str, DataFrame]:
    """The same for one case's wide table, whose last column is the KPI."""
    rows, nodes = discover.panel(wide, columns, case)
    return refine_cases(rows, nodes, theme, explain, decide, **options)


def evaluate_ranking(ranking: DataFrame, truth: DataFrame, kpi: DataFrame | str) -> DataFrame:
    """Rank of the true node per case and stage, with and without the KPI."""
    return evaluate.truth_report(ranking, truth, kpi, ("case", "stage"))


def compare_graphs(initial: DataFrame, refined: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges.graph_difference(initial, refined), edges.verdicts_against_edges(constraints, refined)
