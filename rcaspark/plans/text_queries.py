"""Queries over names, answers, citations, pages, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.functions import html, names, text, vectors
from rcaspark.operators import retrieve
from rcaspark.plans.registry import query, table
from rcaspark.session import cut_lineage

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


# -- names -----------------------------------------------------------------------

@query("fn01_normal_names", """
    SELECT conv_id, turn, replace(lower(trim(nfc_normalize(split_part(text, ' ', 1)))), 'ß', 'ss') AS name FROM conversations
""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", names.normal_name(F.substring_index("text", " ", 1)).alias("name"))


@query("fn01_normal_words", """
    SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, replace(lower(trim(nfc_normalize(word))), 'ß', 'ss') AS name
    FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations)
""")
def _(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.select("conv_id", "turn", "pos", names.normal_name(F.col("word")).alias("name"))


POD = "replace(p_name, ' ', '-') || CASE WHEN p_size > 10 THEN '-' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 5) ELSE '' END"


def _pods(spark, d):
    tail = F.when(F.col("p_size") > 10, F.concat(F.lit("-"), F.left(F.md5(F.col("p_partkey").cast("string")), F.lit(5)))).otherwise("")
    return table(spark, d, "part").select("p_partkey", "p_type", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), tail).alias("name"))


@query("fn02_workload_stem", f"SELECT p_partkey, {POD} AS name, regexp_replace({POD}, '-[a-z0-9]{{5}}$', '') AS stem FROM part")
def _(spark, d):
    return _pods(spark, d).select("p_partkey", "name", names.workload_stem(F.col("name")).alias("stem"))


@query("fn03_language_tag", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh-cn' ELSE 'en-us' END AS language FROM documents
""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", names.language_tag(F.col("text")).alias("language"))


@query("fn04_case_key", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'orders-' || o_orderstatus || '/' || strftime(o_orderdate, '%Y%m%d') END AS "case" FROM orders
""")
def _(spark, d):
    day = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", names.case_key(F.concat(F.lit("orders-"), "o_orderstatus"), day).alias("case"))


@query("prj14_active_cases", """
    SELECT lang || '/20240101' AS "case", count(*) AS n_docs, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS ord FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang
""")
def _(spark, d):
    cases = table(spark, d, "documents").groupBy(names.case_key(F.col("lang"), F.lit("20240101")).alias("case")).agg(F.count("*").alias("n_docs"))
    return names.select_active(cases, spark.createDataFrame([("en/20240101", 0), ("fr/20240101", 1)], "case string, ord int"))


@query("jn17_alias_counts", f"""
    WITH n AS (SELECT DISTINCT {POD} AS name FROM part), k AS (SELECT DISTINCT {POD} AS name FROM part WHERE p_type <> 'ECONOMY'),
    w AS (SELECT name, lower(name) AS normal, regexp_replace(name, '-[a-z0-9]{{5}}$', '') AS stem FROM n),
    g AS (SELECT regexp_replace(name, '-[a-z0-9]{{5}}$', '') AS stem, count(*) AS c FROM k GROUP BY 1)
    SELECT w.name, normal, w.stem, (SELECT count(*) FROM k WHERE lower(k.name) = normal) AS same_normal,
           coalesce(g.c, 0) - CASE WHEN w.name IN (SELECT name FROM k) THEN 1 ELSE 0 END AS other_same_stem
    FROM w LEFT JOIN g ON w.stem = g.stem
""")
def _(spark, d):
    pods = _pods(spark, d)
    return names.alias_counts(pods, pods.where("p_type <> 'ECONOMY'"))


@query("jn17_files_naming", """
    WITH f AS (SELECT DISTINCT 'log_' || p_brand || '_' || p_name || '_' || p_type || '.csv' AS file FROM part), n AS (SELECT DISTINCT p_name AS name FROM part)
    SELECT file AS found_in, name FROM f JOIN n ON contains(file, name)
""")
def _(spark, d):
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lit("log_"), "p_brand", F.lit("_"), "p_name", F.lit("_"), "p_type", F.lit(".csv")).alias("file")).distinct()
    return names.files_naming(p.select(F.col("p_name").alias("name")), files)


# -- answers -----------------------------------------------------------------------

def _answers(spark, d, yes="Yes", no="No"):
    """Two guesses per event; some lack a part, some hold no number, some lack a blank line."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = _k()
    first = F.concat(F.lit("G1: Step from "), "event_type", F.lit(f" <{yes}>"), F.when(k >= 90, "\n").otherwise("\n\n"),
                     F.lit("P1: "), F.when((k >= 5) & (k < 10), "maybe").otherwise(F.concat(F.lit("0."), two(k))))
    second = F.when(k < 5, F.lit(f"G2: Otherwise <{no}>")).otherwise(F.concat(F.lit(f"G2: Otherwise <{no}>\n\nP2: 0."), two(99 - k)))
    return table(spark, d, "events").select("event_id", F.concat(first, F.lit("\n\n---"), second).alias("text"))


BEST = f"""
    a AS (SELECT event_id, {K} AS k, event_type FROM events),
    b AS (SELECT event_id, CASE WHEN k < 5 THEN k / 100.0 WHEN k < 10 OR k >= 90 THEN (99 - k) / 100.0 ELSE greatest(k, 99 - k) / 100.0 END AS prob,
                 CASE WHEN k < 5 OR (k >= 10 AND k < 90 AND k > 99 - k) THEN 'Step from ' || event_type || ' <Yes>' ELSE 'Otherwise <No>' END AS guess FROM a)
"""


@query("fn07_verdict", f"WITH {BEST} SELECT event_id, CASE WHEN guess LIKE '%Yes%' THEN 1 ELSE 0 END AS verdict FROM b")
def _(spark, d):
    return _answers(spark, d).select("event_id", text.verdict(text.best_guess(F.col("text"))["guess"]).alias("verdict"))


@query("fn07_any_case_verdict", """
    SELECT doc_id, CASE WHEN contains(lower(text), 'yes') THEN 1 WHEN contains(lower(text), 'no') THEN 0 END AS verdict FROM documents
""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.any_case_verdict(F.col("text")).alias("verdict"))


@query("fn08_guesses", f"""
    WITH a AS (SELECT event_id, {K} AS k, event_type FROM events)
    SELECT event_id, 'Step from ' || event_type || ' <Yes>' AS guess, CASE WHEN k >= 5 AND k < 10 THEN 0.0 ELSE round(k / 100.0, 6) END AS prob FROM a WHERE k < 90
    UNION ALL SELECT event_id, 'Otherwise <No>', round((99 - k) / 100.0, 6) FROM a WHERE k >= 5
""")
def _(spark, d):
    found = _answers(spark, d).select("event_id", F.inline(text.guesses(F.col("text"))))
    return found.select("event_id", "guess", F.round("prob", 6).alias("prob"))


@query("wn10_best_guess", f"WITH {BEST} SELECT event_id, guess, round(prob, 6) AS prob FROM b")
def _(spark, d):
    best = text.best_guess(F.col("text"))
    return _answers(spark, d).select("event_id", best["guess"].alias("guess"), F.round(best["prob"], 6).alias("prob"))


@query("fn09_strict_guesses", f"""
    WITH a AS (SELECT event_id, {K} AS k FROM events)
    SELECT event_id, CASE WHEN k < 10 THEN 'rejected' WHEN k >= 90 THEN 'normalised' ELSE 'unchanged' END AS status,
           CASE WHEN k < 5 THEN 'labels' WHEN k < 10 THEN 'probability' END AS error, CASE WHEN k >= 10 THEN round(k / 100.0, 6) END AS first_prob FROM a
""")
def _(spark, d):
    out = _answers(spark, d, "yes", "no").withColumn("s", text.strict_guesses(F.col("text")))
    return out.select("event_id", "s.status", "s.error", F.round(F.get("s.records", 0)["probability"], 6).alias("first_prob"))


@query("fn10_probability", """
    SELECT event_id, CASE WHEN value / 50 <= 1 AND event_id % 7 > 1 THEN round(value / 50, 6) END AS p FROM events
""")
def _(spark, d):
    reply = F.concat(F.lit(" "), (F.col("value") / 50).cast("string"), F.when(F.col("event_id") % 7 == 0, "f").when(F.col("event_id") % 7 == 1, "d").otherwise("\n"))
    return table(spark, d, "events").select("event_id", F.round(text.probability(reply), 6).alias("p"))


@query("fn11_debate_verdict", """
    SELECT event_id, CASE WHEN value > 60 THEN 1 WHEN value < 10 THEN 0 END AS early, CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN 0 END AS final FROM events WHERE value <= 100
""")
def _(spark, d):
    p = F.col("value") / 100
    return table(spark, d, "events").where("value <= 100").select(
        "event_id", text.debate_verdict(p, 0.1, 0.6, False).alias("early"), text.debate_verdict(p, 0.1, 0.6, True).alias("final"))


@query("fn11_debate_verdict_any_value", """
    SELECT event_id, CASE WHEN value > 100 THEN NULL WHEN value > 60 THEN 1 WHEN value < 10 THEN 0 END AS early,
           CASE WHEN value > 100 THEN NULL WHEN value > 50 THEN 1 WHEN value < 50 THEN 0 END AS final FROM events
""")
def _(spark, d):
    p = F.when(F.col("value") <= 100, F.col("value") / 100)  # no probability: no verdict
    return table(spark, d, "events").select(
        "event_id", text.debate_verdict(p, 0.1, 0.6, False).alias("early"), text.debate_verdict(p, 0.1, 0.6, True).alias("final"))


@query("wn11_debate_sides", """
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'positive' ELSE 'negative' END AS side FROM conversations
""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "positive").otherwise("negative").alias("side"))


# -- sections ------------------------------------------------------------------------

def _summaries(spark, d):
    """Every line of a document as a section named by its first word."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.concat(F.lit("---\nSummary of the "), F.substring_index(x, " ", 1), F.lit(": "), x, F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("Dataset Summary: all about "), "source", F.lit("\n"), F.array_join(parts, "")).alias("text"))


SECTIONS = """
    s AS (SELECT doc_id, 'Dataset Summary: all about ' || source || chr(10) || list_aggregate(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
                 lambda x: '---' || chr(10) || 'Summary of the ' || split_part(x, ' ', 1) || ': ' || x || chr(10)), 'string_agg', '') AS text FROM documents),
    p AS (SELECT doc_id, unnest(string_split(text, '---')) AS part, generate_subscripts(string_split(text, '---'), 1) - 1 AS pos FROM s),
    r AS (SELECT doc_id, pos, substr(part, strpos(part, 'Summary of the ') + 15) AS rest FROM p WHERE pos > 0 AND contains(part, 'Summary of the ')),
    n AS (SELECT doc_id, pos, split_part(rest, ':', 1) AS name, substr(rest, strpos(rest, ':') + 1) AS body, split_part(split_part(rest, 'Summary of the ', 1), ':', 2) AS cut FROM r WHERE contains(rest, ':'))
"""


@query("fn05_sections", f"WITH {SECTIONS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, name, body FROM n")
def _(spark, d):
    return text.node_sections(_summaries(spark, d), "text", ["doc_id"])


@query("fn05_sections_released", f"WITH {SECTIONS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, name, cut AS body FROM n WHERE contains(split_part(rest, 'Summary of the ', 1), ':')".replace("FROM n WHERE contains(split_part(rest, 'Summary of the ', 1), ':')", "FROM n"))
def _(spark, d):
    return text.node_sections(_summaries(spark, d), "text", ["doc_id"], compat="released")


@query("wn12_last_section", f"WITH {SECTIONS} SELECT doc_id, name, arg_max(body, pos) AS body FROM n GROUP BY 1, 2")
def _(spark, d):
    return text.last_section(text.node_sections(_summaries(spark, d), "text", ["doc_id"]), ["doc_id"])


@query("fn06_canonical_summary", f"""
    WITH a AS (SELECT event_id, {K} AS k, event_type FROM events)
    SELECT event_id, CASE WHEN k < 10 THEN 'dataset heading' WHEN k < 20 THEN 'repeated node' WHEN k >= 90 THEN 'unknown node' END AS error,
           CASE WHEN k >= 20 AND k < 90 THEN 'Dataset Summary: events of a shop' || CASE WHEN k >= 50 THEN chr(10) || chr(10) || 'Relationships between Nodes:' || chr(10) || 'one, two' ELSE '' END
                || chr(10) || '---' || chr(10) || 'Summary of the one: type ' || event_type || chr(10) || '---' || chr(10) || 'Summary of the two: k is ' || k END AS canonical
    FROM a
""")
def _(spark, d):
    k = _k()
    whole = F.concat(
        F.when(k < 10, "Summary: events of a shop").otherwise("Dataset Summary: events of a shop"), F.lit("\n---\nSummary of the one: type "), "event_type",
        F.lit("\n---\nSummary of "), F.when(k < 20, "one").when(k >= 90, "nobody").otherwise("two"), F.lit(": k is "), k.cast("string"), F.lit(" "),
        F.when((k >= 50) & (k < 90), "\n---\nRelationships between Nodes:\none, two").otherwise(""))
    out = table(spark, d, "events").select("event_id", text.canonical_summary(whole, F.array(F.lit("one"), F.lit("two"))).alias("s"))
    return out.select("event_id", "s.error", "s.canonical")


@query("rg05_sections_by_position", f"""
    WITH a AS (SELECT event_id, {K} AS k, event_type FROM events), l(pos, label) AS (VALUES (0, 'click'), (1, 'view'))
    SELECT event_id, pos, label, label = CASE pos WHEN 0 THEN event_type ELSE 'view' END AS mentions FROM a, l
""")
def _(spark, d):
    answer = F.concat(F.lit("all--- first about "), "event_type", F.lit("--- then about view---"))
    labels = spark.createDataFrame([(0, "click"), (1, "view")], "pos int, label string")
    return text.sections_by_position(table(spark, d, "events").select("event_id", answer.alias("text")), "text", ["event_id"], labels).drop("part")


# -- citations -----------------------------------------------------------------------

def _cited(spark, d):
    c = table(spark, d, "conversations")
    answer = F.format_string(
        "Intro.\nClaim one of %d [1]. More! Claim two [2].%s[1] URL: https://a.example/%d\nQuoted sentence: alpha %d\n[2] URL: https://b.example/%d\nQuoted sentence: beta\n",
        "conv_id", F.when(F.col("role") == "system", "\nSources:").otherwise("\nReferences:\n"), "conv_id", "turn", "turn")
    return c.select("conv_id", "turn", answer.alias("text"))


@query("fn12_cited_sentences", """
    SELECT conv_id, turn, 0 AS pos, 'Claim one of ' || conv_id AS sentence, 1 AS "index" FROM conversations WHERE role <> 'system'
    UNION ALL SELECT conv_id, turn, 1, ' More! Claim two', 2 FROM conversations WHERE role <> 'system'
""")
def _(spark, d):
    return text.cited_sentences(_cited(spark, d), "text", ["conv_id", "turn"])


REFS = """
    r AS (SELECT conv_id, turn, 0 AS pos, 1 AS "index", 'https://a.example/' || conv_id AS url, 'alpha ' || turn AS source FROM conversations WHERE role <> 'system'
          UNION ALL SELECT conv_id, turn, 1, 2, 'https://b.example/' || turn, 'beta' FROM conversations WHERE role <> 'system')
"""


@query("fn13_references", f"WITH {REFS} SELECT * FROM r")
def _(spark, d):
    return text.references(_cited(spark, d), "text", ["conv_id", "turn"])


@query("jn13_match_references", f"""
    WITH {REFS} SELECT conv_id, turn, pos, CASE "index" WHEN 1 THEN 'Claim one of ' || conv_id ELSE ' More! Claim two' END AS sentence, "index", url, source FROM r
""")
def _(spark, d):
    rows, keys = _cited(spark, d), ["conv_id", "turn"]
    return text.match_references(text.cited_sentences(rows, "text", keys), text.references(rows, "text", keys), keys)


@query("jn14_first_hit_wins", """
    SELECT p.url, arg_min(page_id, page_id) AS rank, 'page ' || min(page_id) AS title FROM pages p GROUP BY 1
""")
def _(spark, d):
    hits = table(spark, d, "pages").select("url", F.concat(F.lit("page "), "page_id").alias("title"), F.lit("").alias("snippet"), F.col("page_id").alias("rank"))
    return text.first_hits(hits, []).select("url", "rank", "title")


# -- search results and pages ----------------------------------------------------------

def _responses(spark, d):
    """A search response per page with two hits; the second has no title."""
    one = F.struct(F.concat(F.lit("t"), "page_id").alias("title"), F.col("url").alias("link"), F.lit(None).cast("string").alias("snippet"))
    two = F.struct(F.lit(None).cast("string").alias("title"), F.concat("url", F.lit(".pdf")).alias("link"), F.lit("s").alias("snippet"))
    body = F.struct(F.struct(F.when(F.length("html") > 9000, "查询").otherwise("query").alias("q")).alias("searchParameters"), F.array(one, two).alias("organic"))
    return table(spark, d, "pages").select("page_id", F.to_json(body).alias("response"))


HITS = """
    h AS (SELECT page_id, CASE WHEN length(html) > 9000 THEN '查询' ELSE 'query' END AS query, CASE WHEN length(html) > 9000 THEN 'zh-cn' ELSE 'en-us' END AS language, 2 AS n_hits,
                 0 AS rank, 't' || page_id AS title, url, '' AS snippet FROM pages
          UNION ALL SELECT page_id, CASE WHEN length(html) > 9000 THEN '查询' ELSE 'query' END, CASE WHEN length(html) > 9000 THEN 'zh-cn' ELSE 'en-us' END, 2, 1, '', url || '.pdf', 's' FROM pages)
"""


@query("src10_search_hits", f"WITH {HITS} SELECT * FROM h")
def _(spark, d):
    return text.search_hits(_responses(spark, d), "response", ["page_id"])


@query("prj13_skip_pdf", f"WITH {HITS} SELECT page_id, url FROM h WHERE NOT ends_with(url, '.pdf')")
def _(spark, d):
    hits = text.search_hits(_responses(spark, d), "response", ["page_id"])
    return hits.where(text.not_pdf(F.col("url"))).select("page_id", "url")


@query("fn14_main_content")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", html.main_contents(F.col("html")).alias("c")).select("page_id", "c.narrow", "c.wide")


@query("prj12_accepted_pages")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", html.main_contents(F.col("html")).alias("c"))
    return p.select("page_id", "url", text.accept_content(F.col("c.narrow"), F.col("c.wide")).alias("content")).where("content is not null")


@query("prj12_accept_rule", """
    WITH c AS (SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 799 THEN text || text ELSE text END AS content FROM documents)
    SELECT doc_id, length(content) AS n FROM c WHERE length(content) > 300
""")
def _(spark, d):
    c = table(spark, d, "documents").select("doc_id", text.accept_content(F.col("text"), F.concat("text", "text")).alias("content"))
    return c.where("content is not null").select("doc_id", F.length("content").cast("bigint").alias("n"))


@query("fn20_word_count", """
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS words,
           len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) > 10 AS over FROM documents
""")
def _(spark, d):
    n = text.word_count(F.col("text")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("words"), (n > 10).alias("over"))


@query("jn15_restore_order", """
    SELECT page_id, url, CASE WHEN length(html) > 5000 THEN md5(html) ELSE '' END AS content FROM pages
""")
def _(spark, d):
    p = table(spark, d, "pages")
    kept = p.where(F.length("html") > 5000).select("page_id", "url", F.md5("html").alias("content"))
    return retrieve.restore_order(p.select("page_id", "url"), kept, ["page_id"])


# -- chunks and vectors ------------------------------------------------------------------

@query("fn22_fixed_chunks", """
    SELECT doc_id, chunk, md5(substr(text, chunk * 1000 + 1, 1000)) AS digest
    FROM (SELECT doc_id, text, CAST(unnest(range((length(text) + 999) // 1000)) AS INTEGER) AS chunk FROM documents)
""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 1000)).alias("chunk", "t"))
    return docs.select("doc_id", "chunk", F.md5("t").alias("digest"))


@query("fn22_overlapping_chunks", """
    WITH c AS (SELECT doc_id, chunk, substr(text, chunk * 824 + 1, 1024) AS t
               FROM (SELECT doc_id, text, CAST(unnest(range((length(text) + 823) // 824)) AS INTEGER) AS chunk FROM documents))
    SELECT doc_id, chunk, md5(t) AS digest FROM c WHERE chunk = 0 OR length(t) > 200
""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 1024, 200)).alias("chunk", "t"))
    return docs.select("doc_id", "chunk", F.md5("t").alias("digest"))


@query("fn22_separator_chunks")
def _(spark, d):
    docs = table(spark, d, "documents")
    return retrieve.chunk_table(docs, "text", ["doc_id"], text.separator_chunks(F.col("text"), 1000))


@query("fn19_text_digest", """
    SELECT doc_id, sha256(text) AS digest, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS record FROM documents
""")
def _(spark, d):
    from rcaspark.sources.sinks import canonical_json

    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(canonical_json("source", "n_chars", "lang"), 256).alias("record"))


def _centroids(spark, d):
    """One query per label: the mean of its vectors."""
    dims = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")).select(F.col("label").alias("query_id"), "embedding")


CENTROIDS = """
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY 1, 2),
    q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM m GROUP BY 1)
"""


@query("tk03_nearest_vectors", f"""
    WITH {CENTROIDS}, d AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM q, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
    SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10
""")
def _(spark, d):
    near = retrieve.nearest(_centroids(spark, d), table(spark, d, "embeddings"), 10)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("fn21_vector_functions", f"""
    WITH {CENTROIDS}
    SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)), 6) AS cosine,
           round(list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance,
           round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_unit FROM e JOIN q ON label = query_id
""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    both = e.join(_centroids(spark, d).select(F.col("query_id").alias("label"), F.col("embedding").alias("q")), "label")
    v, q = F.col("v"), F.col("q")
    return both.select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.cosine(v, q), 6).alias("cosine"),
                       F.round(vectors.squared_distance(v, q), 6).alias("distance"), F.round(F.get(vectors.unit(v), 0), 6).alias("first_unit"))


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length({t}) - length(replace({t}, c, '')))::DOUBLE)"


def _letters(t):
    return LETTERS.format(t=t)


CHUNKS = f"""
    c AS (SELECT doc_id, chunk, doc_id * 1000 + chunk AS vec_id, source AS url, substr(text, chunk * 1000 + 1, 1000) AS t
          FROM (SELECT doc_id, source, text, CAST(unnest(range((length(text) + 999) // 1000)) AS INTEGER) AS chunk FROM documents)),
    cl AS (SELECT vec_id, doc_id, url, t, {_letters('lower(t)')} AS w FROM c WHERE trim(t, ' ') <> ''),
    cs AS (SELECT *, sqrt(list_dot_product(w, w)) AS s FROM cl),
    ce AS (SELECT vec_id, doc_id, url, t, list_transform(w, lambda x: CASE WHEN s > 0 THEN x / s ELSE 0 END) AS v FROM cs),
    ql AS (SELECT item_id AS query_id, {_letters('lower(text)')} AS w FROM benchmark),
    qe AS (SELECT query_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS qv FROM ql),
    nd AS (SELECT query_id, vec_id, url, t, round(list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM qe, ce),
    nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM nd),
    top AS (SELECT * FROM nr WHERE rank <= 10)
"""


def chunk_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("url"), "text")
    chunks = retrieve.chunk_table(docs, "text", ["doc_id", "url"], text.fixed_chunks(F.col("text"), 1000))
    vecs = retrieve.embed(chunks.withColumn("vec_id", F.col("doc_id") * 1000 + F.col("chunk")), "text", vectors.letter_embedding)
    return cut_lineage(vecs)  # embeddings are stored, then searched


def question_vectors(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.embed(q, "text", vectors.letter_embedding)


@query("rg01_chunk_embeddings", f"WITH {CHUNKS.split('    ql AS')[0].rstrip().rstrip(',')} SELECT vec_id, url, round(v[1], 6) AS a, round(v[5], 6) AS e FROM ce")
def _(spark, d):
    v = chunk_vectors(spark, d)
    return v.select("vec_id", "url", F.round(F.get("embedding", 0), 6).alias("a"), F.round(F.get("embedding", 4), 6).alias("e"))


@query("rg02_nearest_chunks", f"WITH {CHUNKS} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM top")
def _(spark, d):
    near = retrieve.nearest(question_vectors(spark, d), chunk_vectors(spark, d), 10)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def _retrieved(spark, d):
    v = chunk_vectors(spark, d)
    return retrieve.nearest(question_vectors(spark, d), v, 10).join(v.select("vec_id", "url", "text"), "vec_id")


SHOWN = "f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, url) AS fr FROM top), g AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY fr) AS shown FROM f)"


@query("wn06_rearranged_index", f"WITH {CHUNKS}, {SHOWN} SELECT query_id, rank, url, CAST(shown AS INTEGER) AS shown FROM g")
def _(spark, d):
    return retrieve.rearranged_index(_retrieved(spark, d), ["query_id"], "url", "rank").select("query_id", "rank", "url", "shown")


@query("fn18_render_context", f"""
    WITH {CHUNKS}, {SHOWN}
    SELECT query_id, md5(chr(10) || string_agg('Webpage[' || shown || '], url: ' || url || ':' || chr(10) || t || chr(10) || chr(10) || chr(10), '' ORDER BY rank)) AS digest FROM g GROUP BY 1
""")
def _(spark, d):
    return retrieve.render_context(_retrieved(spark, d), ["query_id"]).select("query_id", F.md5("context").alias("digest"))
