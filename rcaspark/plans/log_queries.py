"""Queries over log templates, lines, file catalogs and evidence plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.operators import evidence, logs
from rcaspark.operators.contains import contains_join
from rcaspark.operators.order import first_per_group
from rcaspark.plans.fixtures import case_by
from rcaspark.plans.registry import query, table
from rcaspark.session import scratch_path
from rcaspark.sources import logs as src


def _log_tables(spark, d):
    """Events as log lines: one template per event type, one line per event."""
    lines = table(spark, d, "events").select(
        case_by("user_id").alias("case"), F.concat(F.lit("pod-"), F.col("user_id") % 5).alias("entity"),
        F.col("event_type").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("props").alias("content"), F.col("event_id").alias("pos"))
    return _templates(lines), lines


def _templates(lines):
    return lines.groupBy("case", "entity", "event_id").agg(
        F.concat(F.lit("type "), F.first("event_id")).alias("template"),
        F.count("*").alias("occurrence"), F.min("pos").alias("pos"))


def _order_log(spark, d):
    """Orders as log lines: many templates per entity, one per customer."""
    lines = table(spark, d, "orders").select(
        case_by("o_orderkey").alias("case"), F.col("o_orderstatus").alias("entity"),
        F.col("o_custkey").cast("string").alias("event_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("content"), F.col("o_orderkey").alias("pos"))
    return _templates(lines), lines


EVENT_LINES = """
    l AS (SELECT 'pod-' || CAST(user_id % 5 AS VARCHAR) AS entity, event_type AS ev, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time,
                 props AS content, event_id AS pos FROM events)
"""
ORDER_LINES = """
    l AS (SELECT o_orderstatus AS entity, CAST(o_custkey AS VARCHAR) AS ev, strftime(o_orderdate, '%Y-%m-%d') AS time,
                 CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS content, o_orderkey AS pos FROM orders)
"""
SAMPLED = """
    t AS (SELECT entity, ev, count(*) AS occ, min(pos) AS first_pos FROM l GROUP BY 1, 2),
    r AS (SELECT l.*, occ, first_pos, greatest(1, occ // 10) AS k,
                 row_number() OVER (PARTITION BY l.entity, l.ev ORDER BY pos) - 1 AS rn
          FROM l JOIN t ON l.entity = t.entity AND l.ev = t.ev),
    s AS (SELECT *, rn // k + 1 AS sample FROM r WHERE rn % k = 0 AND rn // k < 10)
"""


@query("wn01_strided_sample", f"""
    WITH {EVENT_LINES}, {SAMPLED}
    SELECT entity, ev AS event_id, pos, time, content, CAST(sample AS BIGINT) AS sample FROM s
""")
def _(spark, d):
    templates, lines = _log_tables(spark, d)
    picked = logs.strided_sample(lines, logs.first_templates(templates), block=997)
    return picked.select("entity", "event_id", "pos", "time", "content", "sample")


@query("wn02_first_template", """
    SELECT event_type AS event_id, min(user_id) FILTER (event_id = lo) AS user_id, min(props) FILTER (event_id = lo) AS props, min(lo) AS first_pos
    FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS lo FROM events) GROUP BY 1
""")
def _(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("event_type").agg(F.min_by(F.struct("user_id", "props"), "event_id").alias("f"), F.min("event_id").alias("first_pos")).select(
        F.col("event_type").alias("event_id"), "f.user_id", "f.props", "first_pos")


@query("wn03_template_cap", f"""
    WITH {ORDER_LINES}, t AS (SELECT entity, ev, min(pos) AS first_pos, count(*) AS occurrence FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_pos) AS event_rank FROM t)
    SELECT entity, ev AS event_id, first_pos, occurrence, event_rank FROM r WHERE event_rank <= 52
""")
def _(spark, d):
    templates, _lines = _order_log(spark, d)
    return logs.cap_templates(logs.first_templates(templates)).select("entity", "event_id", "first_pos", "occurrence", "event_rank")


@query("ag31_first_seen_events", """
    SELECT o_orderstatus AS entity, o_custkey AS event_id, min(o_orderkey) AS first_pos FROM orders GROUP BY 1, 2
""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("entity"), F.col("o_custkey").alias("event_id"), "o_orderkey")
    return logs.first_seen_events(o, ["entity"], "event_id", "o_orderkey")


@query("tk04_head_per_group", """
    SELECT user_id, event_id, rank FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 10
""")
def _(spark, d):
    return first_per_group(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 10).select("user_id", "event_id", "rank")


@query("jn07_template_lines", f"""
    WITH {EVENT_LINES}, t AS (SELECT entity, ev, 'type ' || ev AS template, count(*) AS occurrence FROM l GROUP BY 1, 2)
    SELECT t.entity, t.ev AS event_id, template, occurrence, pos, content
    FROM t LEFT JOIN (SELECT * FROM l WHERE content LIKE '%7%') m ON t.entity = m.entity AND t.ev = m.ev
""")
def _(spark, d):
    templates, lines = _log_tables(spark, d)
    joined = logs.join_templates(logs.first_templates(templates), lines.where(F.contains("content", F.lit("7"))))
    return joined.select("entity", "event_id", "template", "occurrence", "pos", "content")


@query("jn07_all_template_lines", f"""
    WITH {EVENT_LINES}, t AS (SELECT entity, ev, 'type ' || ev AS template, count(*) AS occurrence FROM l GROUP BY 1, 2)
    SELECT t.entity, t.ev AS event_id, template, occurrence, pos, content FROM t LEFT JOIN l ON t.entity = l.entity AND t.ev = l.ev
""")
def _(spark, d):
    templates, lines = _log_tables(spark, d)
    return logs.join_templates(logs.first_templates(templates), lines).select("entity", "event_id", "template", "occurrence", "pos", "content")


def _text_sql(lines, last="er"):
    return f"""
    WITH {lines}, {SAMPLED},
    c AS (SELECT entity, ev, occ, row_number() OVER (PARTITION BY entity ORDER BY first_pos) AS er FROM t),
    e AS (SELECT s.entity, s.ev, string_agg('* The event occurred at ' || time || ', and its content was ' || content || '.', chr(10) ORDER BY sample) AS examples
          FROM s GROUP BY 1, 2),
    b AS (SELECT c.entity, er, '---' || chr(10) || 'Event template: type ' || c.ev || ', with event ID ' || c.ev || ', occurred ' || CAST(occ AS VARCHAR)
                 || ' times.' || chr(10) || chr(10) || 'Here are some examples of this template:' || chr(10) || chr(10) || examples || chr(10) || '---' || chr(10) || chr(10) AS text
          FROM c JOIN e ON c.entity = e.entity AND c.ev = e.ev WHERE er <= {last})
    SELECT entity, string_agg(text, '' ORDER BY er) AS log_text, count(*) AS n_events FROM b GROUP BY 1
    """


@query("fn15_log_text", _text_sql(EVENT_LINES))
def _(spark, d):
    return logs.log_text(*_log_tables(spark, d), block=997).select("entity", "log_text", "n_events")


@query("fn15_log_text_many_templates", _text_sql(ORDER_LINES))
def _(spark, d):
    return logs.log_text(*_order_log(spark, d), block=997).select("entity", "log_text", "n_events")


@query("fn15_log_text_many_templates_released", _text_sql(ORDER_LINES, logs.RELEASED_TEMPLATE_CAP))
def _(spark, d):
    return logs.log_text(*_order_log(spark, d), compat="released", block=997).select("entity", "log_text", "n_events")


# -- sources -------------------------------------------------------------------

@query("src03_src04_log_files", """
    SELECT 'pod-' || CAST(user_id % 5 AS VARCHAR) AS entity, event_type AS event_id, count(*) AS n_lines, min(event_id) AS first_pos, max(event_id) AS last_pos,
           min(count(*)) OVER (PARTITION BY 'pod-' || CAST(user_id % 5 AS VARCHAR), event_type) AS occurrence
    FROM events GROUP BY 1, 2
""")
def _(spark, d):
    # Both tables are written as the per-entity CSV layout and scanned back in one read each.
    templates, lines = _log_tables(spark, d)
    root = scratch_path(spark, "logfiles")
    structured = lines.select(
        F.concat("entity", F.lit(src.STRUCTURED_SUFFIX)).alias("file"), F.col("pos").alias("LineId"), F.col("time").alias("Time"),
        F.col("content").alias("Content"), F.col("event_id").alias("EventId"), F.lit("type").alias("EventTemplate"), F.lit("[]").alias("ParameterList"))
    template = templates.select(
        F.concat("entity", F.lit(src.TEMPLATE_SUFFIX)).alias("file"), F.col("event_id").alias("EventId"),
        F.col("template").alias("EventTemplate"), F.col("occurrence").alias("Occurrence"))
    structured.write.partitionBy("file").option("escape", '"').csv(f"{root}/structured", header=True)
    template.write.partitionBy("file").option("escape", '"').csv(f"{root}/templates", header=True)
    n = src.read_structured(spark, f"{root}/structured/*").groupBy("entity", "event_id").agg(
        F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return n.join(src.read_templates(spark, f"{root}/templates/*").select("entity", "event_id", "occurrence"), ["entity", "event_id"])


@query("src06_json_hits", """
    SELECT 'pod-' || CAST(user_id AS VARCHAR) AS pod, CASE WHEN value > 20 THEN event_type END AS namespace,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time FROM events
""")
def _(spark, d):
    hit = F.struct(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("@timestamp"),
        F.struct(F.concat(F.lit("pod-"), F.col("user_id")).alias("pod_name"),
                 F.when(F.col("value") > 20, F.col("event_type")).alias("namespace_name")).alias("kubernetes")).alias("_source"))
    pages = table(spark, d, "events").groupBy(F.expr("event_id div 500")).agg(F.collect_list(hit).alias("hits")).select(F.struct("hits").alias("hits"))
    path = scratch_path(spark, "hits")
    pages.write.json(path)
    return src.read_hits(spark, path)


@query("src07_compressed_lines", """
    SELECT source, count(*) AS records, CAST(sum(octet_length(encode(replace(replace(text, chr(10), ' '), chr(13), ' '))) + 1) AS BIGINT) AS bytes
    FROM documents GROUP BY 1
""")
def _(spark, d):
    path = scratch_path(spark, "lines")
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    table(spark, d, "documents").select("source", flat.alias("value")).write.partitionBy("source").text(path, compression="gzip")
    return src.line_volume(src.read_lines(spark, f"{path}/source=*/*.gz"), F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"))


@query("src08_inventory_rows", """
    WITH f AS (SELECT conv_id, turn, regexp_split_to_array(trim(text, ' '), '\\s+') AS fields FROM conversations)
    SELECT conv_id, turn, fields[1] AS namespace, fields[2] AS pod, len(fields) AS n_fields FROM f WHERE len(fields) > 2
""")
def _(spark, d):
    rows = src.inventory_rows(table(spark, d, "conversations"), "text")
    return rows.select("conv_id", "turn", F.get("fields", 0).alias("namespace"), F.get("fields", 1).alias("pod"), F.size("fields").cast("bigint").alias("n_fields"))


CATALOG = """
    c AS (SELECT '/logs/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '_messages_templates.csv' AS path, n_chars AS bytes FROM documents WHERE n_chars > 400
          UNION ALL SELECT '/logs/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '_messages_structured.csv', n_chars * 2 FROM documents WHERE lang <> 'fr'
          UNION ALL SELECT '/logs/' || source || '/notes-' || CAST(doc_id AS VARCHAR) || '.txt', 1 FROM documents WHERE lang = 'en')
"""


def _catalog(spark, d):
    """File names of log pairs, one entity per document."""
    docs = table(spark, d, "documents")
    name = lambda prefix, suffix: F.concat(F.lit("/logs/"), F.col("source"), F.lit(prefix), F.col("doc_id"), F.lit(suffix)).alias("path")
    t = docs.where("n_chars > 400").select(name("/doc-", src.TEMPLATE_SUFFIX), F.col("n_chars").alias("bytes"))
    s = docs.where("lang <> 'fr'").select(name("/doc-", src.STRUCTURED_SUFFIX), (F.col("n_chars") * 2).alias("bytes"))
    o = docs.where("lang = 'en'").select(name("/notes-", ".txt"), F.lit(1).cast("bigint").alias("bytes"))
    return t.unionByName(s).unionByName(o)


@query("src11_file_catalog", f"""
    WITH {CATALOG}
    SELECT regexp_extract(path, '([^/]*)_messages_', 1) AS entity, regexp_extract(path, '_messages_(templates|structured)', 1) AS kind, bytes
    FROM c WHERE path LIKE '%!_messages!_%' ESCAPE '!'
""")
def _(spark, d):
    return src.log_files(_catalog(spark, d)).select("entity", "kind", "bytes")


@query("ag23_files_per_folder", f"""
    WITH {CATALOG} SELECT split_part(path, '/', 3) AS folder, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY 1
""")
def _(spark, d):
    return _catalog(spark, d).groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


@query("fn26_path_parts", f"""
    WITH {CATALOG}
    SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]+)$', 1) AS base,
           regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]+$', '') AS stem FROM c
""")
def _(spark, d):
    p = F.col("path")
    return _catalog(spark, d).select("path", src.parent_path(p).alias("parent"), src.base_name(p).alias("base"), src.stem(p).alias("stem"))


def _entities(spark, d):
    docs = table(spark, d, "documents").select(
        case_by("doc_id").alias("case"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("entity"), F.col("doc_id").alias("pos"), F.lit(False).alias("is_kpi"))
    last = docs.groupBy("case").agg((F.max("pos") + 1).alias("pos")).select("case", F.lit("Latency").alias("entity"), "pos", F.lit(True).alias("is_kpi"))
    return docs.unionByName(last)


STATUS = """
    s AS (SELECT doc_id, n_chars > 400 AS t, lang <> 'fr' AS s FROM documents),
    p AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS entity, doc_id AS pos, CASE WHEN t AND s THEN 'exact_unique_pair' WHEN NOT t AND NOT s THEN 'both_absent' ELSE 'partial_or_duplicate' END AS status FROM s)
"""


def _files(spark, d):
    return src.log_files(_catalog(spark, d)).withColumn("case", case_by("path"))


@query("jn06_pair_status", f"WITH {STATUS} SELECT entity, status FROM p UNION ALL SELECT 'Latency', 'both_absent'")
def _(spark, d):
    return evidence.pair_status(_entities(spark, d), _files(spark, d)).select("entity", "status")


@query("jn08_evidence_plan", f"""
    WITH {STATUS}
    SELECT entity, pos, 'pod' AS kind, status = 'exact_unique_pair' AS available,
           CASE WHEN status = 'both_absent' THEN 'No matching log evidence is available for this pod in this case.' || chr(10) || 'This does not imply normal operation or absence of causal influence.' END AS fixed_text
    FROM p UNION ALL
    SELECT 'Latency', (SELECT max(pos) + 1 FROM p), 'kpi', NULL,
           'This is an input KPI column, not a pod. No pod event log is assigned to this column. Its column label alone does not establish its physical meaning.'
""")
def _(spark, d):
    return evidence.evidence_plan(_entities(spark, d), _files(spark, d), allow_partial=True).drop("case", "status")


@query("jn09_merge_summaries", f"""
    WITH {STATUS}
    SELECT entity, 'pod' AS kind, status = 'exact_unique_pair' AS available,
           CASE WHEN status = 'exact_unique_pair' THEN sha256(entity)
                ELSE 'No matching log evidence is available for this pod in this case.' || chr(10) || 'This does not imply normal operation or absence of causal influence.' END AS text
    FROM p WHERE status <> 'partial_or_duplicate' UNION ALL
    SELECT 'Latency', 'kpi', NULL,
           'This is an input KPI column, not a pod. No pod event log is assigned to this column. Its column label alone does not establish its physical meaning.'
""")
def _(spark, d):
    plan = evidence.evidence_plan(_entities(spark, d), _files(spark, d), allow_partial=True).where("kind = 'kpi' or status <> 'partial_or_duplicate'")
    texts = plan.where("available").select("case", "entity", F.sha2("entity", 256).alias("text"))
    return evidence.merge_summaries(plan, texts).select("entity", "kind", "available", "text")


@query("prj15_entities_to_summarise", f"WITH {STATUS} SELECT entity FROM p WHERE status = 'exact_unique_pair'")
def _(spark, d):
    # The KPI is no pod: its availability is null, so it never reaches the generator.
    return evidence.evidence_plan(_entities(spark, d), _files(spark, d), allow_partial=True).where("available").select("entity")


@query("ag25_coverage", f"""
    WITH {STATUS}, c AS (SELECT count(*) AS pods, count(*) FILTER (status = 'exact_unique_pair') AS available,
                         count(*) FILTER (status <> 'exact_unique_pair') AS missing, 1 AS kpis FROM p)
    SELECT pods, available, missing, CAST(kpis AS BIGINT) AS kpis,
           'Log evidence covers ' || available || ' of ' || pods || ' pods; ' || missing || ' pods have none.' AS sentence FROM c
""")
def _(spark, d):
    return evidence.coverage(evidence.evidence_plan(_entities(spark, d), _files(spark, d), allow_partial=True)).drop("case")


@query("ag25_status_histogram", f"WITH {STATUS} SELECT status, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    return evidence.pair_status(_entities(spark, d), _files(spark, d)).where("not is_kpi").groupBy("status").agg(F.count("*").alias("n"))


@query("jn22_file_drift", f"""
    WITH {CATALOG}, old AS (SELECT * FROM c WHERE bytes > 700 OR path LIKE '%notes%'), now AS (SELECT path, CASE WHEN bytes > 9000 THEN bytes + 1 ELSE bytes END AS bytes FROM c WHERE bytes < 20000),
    f AS (SELECT coalesce(o.path, n.path) AS path, o.bytes AS b0, n.bytes AS b1 FROM old o FULL JOIN now n ON o.path = n.path),
    e AS (SELECT regexp_extract(path, '([^/]*)_messages_', 1) AS entity, path, b0, b1 FROM f WHERE path LIKE '%!_messages!_%' ESCAPE '!'),
    ab AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS entity FROM documents WHERE n_chars <= 400)
    SELECT entity, path, CASE WHEN b1 IS NULL THEN 'missing' WHEN b0 IS NULL THEN 'appeared' ELSE 'resized' END AS finding
    FROM e WHERE b1 IS NULL OR (b0 IS NULL AND entity IN (SELECT entity FROM ab)) OR b0 <> b1
""")
def _(spark, d):
    c = src.log_files(_catalog(spark, d))
    old = c.where("bytes > 700")
    now = c.where("bytes < 20000").withColumn("bytes", F.when(F.col("bytes") > 9000, F.col("bytes") + 1).otherwise(F.col("bytes")))
    absent = table(spark, d, "documents").where("n_chars <= 400").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("entity"))
    return evidence.drift(old, now, absent)


@query("jn21_hash_gate", """
    WITH a AS (SELECT source, md5(string_agg(lang, ',' ORDER BY doc_id)) AS x FROM documents GROUP BY 1),
    i AS (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY 1, 2)
    SELECT lang || '/' || source AS "case", sha256(CAST(n AS VARCHAR)) AS input_digest, sha256(CAST(n AS VARCHAR)) AS manifest_digest,
           sha256(CAST(CASE WHEN c > 100000 THEN c ELSE n END AS VARCHAR)) AS connection_digest FROM i WHERE c > 100000 AND c <> n
""")
def _(spark, d):
    g = table(spark, d, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("case")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    digest = lambda c: g.select("case", F.sha2(c.cast("string"), 256).alias("digest"))
    return evidence.hash_gate(digest(F.col("n")), digest(F.col("n")), digest(F.when(F.col("c") > 100000, F.col("c")).otherwise(F.col("n"))))


@query("so04_set_equality", """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer)
    SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def _(spark, d):
    return evidence.set_differences(
        table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("so04_differing_sets", """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
    SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def _(spark, d):
    return evidence.set_differences(
        table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")),
        table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("so05_containment", """
    SELECT DISTINCT doc_id FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels)
""")
def _(spark, d):
    return evidence.not_contained(table(spark, d, "documents").where("n_chars > 3000"), table(spark, d, "labels"), "doc_id")


@query("so06_distinct_tokens", """
    SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*'))) AS n_tokens FROM conversations
""")
def _(spark, d):
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9_.-]*"), F.lit(0)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tokens).cast("bigint").alias("n_tokens"))


# -- names ----------------------------------------------------------------------

@query("jn18_mentions", """
    WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
    names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*')) AS name FROM benchmark),
    t AS (SELECT source, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9_.-]*'))) AS name FROM lines)
    SELECT source, name, count(*) AS n_lines FROM t WHERE name IN (SELECT name FROM names) GROUP BY 1, 2
""")
def _(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9_.-]*"), F.lit(0))).alias("name"))
    return logs.mentions(lines, "line", names, "name", ["source"])


@query("ag29_evidence_trace", """
    WITH s AS (SELECT 'document' AS stage, lower(text) AS t FROM documents UNION ALL SELECT 'page', lower(html) FROM pages
               UNION ALL SELECT role, lower(text) FROM conversations)
    SELECT stage, item_id, count(*) AS n_texts FROM s JOIN benchmark b ON contains(t, lower(b.text)) GROUP BY 1, 2
""")
def _(spark, d):

    docs = table(spark, d, "documents").select(F.lit("document").alias("stage"), F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("stage"), F.col("page_id").alias("text_id"), F.lower("html").alias("text"))
    talk = table(spark, d, "conversations").select(F.col("role").alias("stage"), (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.lower("text").alias("text"))
    markers = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("marker"))
    found = contains_join(docs.unionByName(pages).unionByName(talk), "text", markers, "marker")
    return found.join(markers, "marker").groupBy("stage", "item_id").agg(F.count("*").alias("n_texts"))


# -- bytes ----------------------------------------------------------------------

def _bad_lines(spark, d):
    """Stored text lines, some with one or two bytes that are not UTF-8."""
    path = scratch_path(spark, "bytes")
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    raw = F.concat(F.col("doc_id").cast("string").cast("binary"), F.lit("\t").cast("binary"), text.cast("binary"),
                   F.when(F.col("n_chars") > 2000, F.lit(b"\xc3")).otherwise(F.lit(b"")),
                   F.when(F.col("n_chars") > 4000, F.lit(b" \xff.")).otherwise(F.lit(b"")))
    docs = table(spark, d, "documents").select("source", raw.cast("string").alias("value"))
    docs.write.partitionBy("source").text(path)
    # Regular expressions would replace bad bytes, so the key is cut off by position.
    return spark.read.text(path).select("source", F.substring_index("value", "\t", 1).cast("bigint").alias("doc_id"), F.col("value").alias("content"))


@query("src14_decode_safe_scan", """
    SELECT doc_id, source, n_chars <= 2000 AS valid FROM documents
""")
def _(spark, d):
    return _bad_lines(spark, d).select("doc_id", "source", F.is_valid_utf8("content").alias("valid"))


@query("ag24_invalid_bytes", """
    SELECT source, 'content' AS column_name, CAST(sum(CASE WHEN n_chars > 4000 THEN 2 ELSE 1 END) AS BIGINT) AS bad_bytes, count(*) AS bad_rows
    FROM documents WHERE n_chars > 2000 GROUP BY 1
""")
def _(spark, d):
    return logs.byte_report(_bad_lines(spark, d), ["source"], ["content"])


@query("tk06_bad_row_samples", """
    SELECT source, doc_id, sample FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample
    FROM documents WHERE n_chars > 2000) WHERE sample <= 12
""")
def _(spark, d):
    return logs.bad_byte_samples(_bad_lines(spark, d), ["source"], "doc_id", "content").select("source", "doc_id", "sample")


@query("fn24_byte_gate", """
    SELECT conv_id, turn, true AS valid, octet_length(encode(text)) AS bytes FROM conversations
""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.is_valid_utf8("text").alias("valid"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("ag22_log_counters", """
    SELECT event_type AS namespace, array_to_string(list_sort(json_keys(props)), ',') AS variant, count(*) AS n,
           strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_time, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_time
    FROM events GROUP BY 1, 2
""")
def _(spark, d):
    hits = table(spark, d, "events").select(
        F.col("event_type").alias("namespace"), logs.schema_variant(F.col("props")).alias("variant"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"))
    return logs.log_counters(hits, ["namespace", "variant"], "time")
