"""Queries over anomaly scores in batch and stream, the whole jobs, and the writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.operators import align, edges, generate
from rcaspark.operators.order import full_rank
from rcaspark.plans import discovery_queries as dq
from rcaspark.plans import fixtures as fx
from rcaspark.plans import refine
from rcaspark.plans.graph_queries import _metrics_sql
from rcaspark.plans.registry import query, table
from rcaspark.session import scratch_path
from rcaspark.sources import metrics, sinks
from rcaspark.streaming import spot, stream


@query("st01_channel_scores")
def _(spark, d):
    return spot.spot_scores(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_type", "event_id", "idx", "score")


@query("st01_alert_counts")
def _(spark, d):
    scores = spot.spot_scores(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return spot.alert_counts(scores, ["event_type"])


def _stream_rows(rows):
    seq = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 19, "0"))
    return rows.select(F.col("event_type").alias("channel"), seq.alias("seq"), "value")


@query("st02_stream_scores")
def _(spark, d):
    rows = stream.read_stream(spark, f"{d}/events*.parquet")
    done = stream.run_available(stream.score_stream(_stream_rows(rows)), "scores")
    scored, _aside = stream.split_quarantine(done)
    return scored.select("channel", "seq", "idx", "score")


@query("st01_numbered_scores", """
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
           CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 100 THEN 0.0::DOUBLE END AS warm_up_score, true AS in_range FROM events
""")
def _(spark, d):
    scores = spot.spot_scores(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return scores.select("event_type", "event_id", "idx", F.when(F.col("idx") < 100, F.col("score")).alias("warm_up_score"), F.col("score").between(0, 1).alias("in_range"))


@query("st02_stream_equals_batch", """
    SELECT event_type AS channel, count(*) AS n, CAST(0 AS BIGINT) AS other FROM events GROUP BY 1
""")
def _(spark, d):
    # Every row of the stream has the place and the score that the batch gives it.
    rows = stream.read_stream(spark, f"{d}/events*.parquet")
    done, _aside = stream.split_quarantine(stream.run_available(stream.score_stream(_stream_rows(rows)), "scores"))
    batch = spot.spot_scores(_stream_rows(table(spark, d, "events")), ["channel"], "seq", "value").select("channel", "seq", F.col("idx").alias("b_idx"), F.col("score").alias("b_score"))
    both = done.join(batch, ["channel", "seq"], "full_outer")
    same = F.col("idx").eqNullSafe(F.col("b_idx")) & F.col("score").eqNullSafe(F.col("b_score"))
    return both.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(~same).alias("other"))


@query("st03_repeats_and_quarantine", """
    WITH e AS (SELECT event_type, event_id, ts, event_id % 10 = 0 AS second, value > 100 AS bad FROM events),
    m AS (SELECT event_type, max((ts, event_id)) AS last FROM e WHERE NOT second AND NOT bad GROUP BY 1),
    s AS (SELECT event_type, unnest(CASE WHEN bad THEN ['nonfinite', 'nonfinite'] WHEN second AND (ts, event_id) <= last THEN ['late', 'late'] ELSE ['scored', 'repeated'] END) AS status
          FROM e LEFT JOIN m USING (event_type))
    SELECT event_type AS channel, status, count(*) AS n FROM s GROUP BY 1, 2
""")
def _(spark, d):
    # Every row comes twice, values over 100 are not finite, and every tenth event comes in a second file, mostly too late.
    ev = table(spark, d, "events").withColumn("value", F.when(F.col("value") > 100, float("nan")).otherwise(F.col("value")))
    twice = _stream_rows(ev).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    path = scratch_path(spark, "arrivals")
    for late in (False, True):
        twice.where((F.substring_index("seq", "-", -1).cast("bigint") % 10 == 0) == late).coalesce(1).write.mode("append").parquet(path)
    done = stream.run_available(stream.score_stream(stream.read_stream(spark, path, files_per_batch=1)), "repeats")
    return done.groupBy("channel", "status").agg(F.count("*").alias("n"))


@query("st03_dropped_repeats", "SELECT event_id, event_type FROM events")
def _(spark, d):
    rows = stream.read_stream(spark, f"{d}/events*.parquet")
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy").withColumn("ts", F.col("ts").cast("timestamp"))
    once = stream.drop_repeats(twice, "ts", "1 hour", ["event_id"])
    return stream.run_available(once.select("event_id", "event_type"), "once")


@query("ag02_alert_counts", """
    WITH r AS (SELECT event_type, greatest(value - 30, 0) AS score, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events)
    SELECT event_type, count(*) AS n_rows, count(*) FILTER (idx >= 100 AND score > 0) AS positives, min(idx) FILTER (idx >= 100 AND score > 0) AS first_positive,
           round(max(score) FILTER (idx >= 100), 6) AS max_score FROM r GROUP BY 1
""")
def _(spark, d):
    rows = full_rank(table(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], "idx")
    scores = rows.select("event_type", (F.col("idx") - 1).alias("idx"), F.greatest(F.col("value") - 30, F.lit(0.0)).alias("score"))
    return spot.alert_counts(scores, ["event_type"]).withColumn("max_score", F.round("max_score", 6))


@query("ag03_entity_retention", """
    SELECT 'u' || CAST(user_id AS VARCHAR) AS entity, bool_or(value > 60) AS kept FROM events GROUP BY 1
""")
def _(spark, d):
    counts = table(spark, d, "events").groupBy(fx.case_by("user_id").alias("case"), F.concat(F.lit("u"), F.col("user_id")).alias("entity"), "event_type").agg(
        F.count_if(F.col("value") > 60).alias("positives"))
    return spot.alerting_entities(counts).drop("case")


@query("wn09_moving_deviation", """
    WITH w AS (SELECT event_type, event_id, value, avg(value) OVER x AS before, count(*) OVER x AS n FROM events
               WINDOW x AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT event_type, event_id, CASE WHEN n = 10 THEN round(value - before, 4) END AS deviation FROM w
""")
def _(spark, d):
    ev = table(spark, d, "events").select("event_type", "event_id", "ts", "value")
    return spot.moving_deviation(ev, ["event_type"], ["ts", "event_id"], "value", block=701).select("event_type", "event_id", F.round("deviation", 4).alias("deviation"))


# -- whole jobs --------------------------------------------------------------------

@query("preprocess_decisions", """
    WITH m AS (SELECT event_type AS metric, user_id % 5 AS u, date_trunc('hour', ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2, 3),
    hours AS (SELECT h FROM m GROUP BY 1 HAVING count(DISTINCT metric) = (SELECT count(DISTINCT metric) FROM m)),
    st AS (SELECT u, metric, min(value) <> max(value) AS usable FROM m WHERE h IN (SELECT h FROM hours) GROUP BY 1, 2)
    SELECT 'pod-' || CAST(u AS VARCHAR) AS entity, CAST(count(*) FILTER (usable) AS BIGINT) AS usable FROM st GROUP BY 1
""")
def _(spark, d):
    # Entities share the event times, as pods share the scrape times of a system.
    ev = table(spark, d, "events")
    ch = ev.groupBy(F.concat(F.lit("pod-"), F.col("user_id") % 5).alias("entity"), F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg("value").alias("value")).withColumn("case", fx.case_by("ts"))
    kpi = ev.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value")).withColumn("case", fx.case_by("ts"))
    return refine.preprocess(ch, kpi)["decisions"].select("entity", "usable")


def _alphabet():
    """Offline stand-in for a model's verdict: causes come in front of their effects in the alphabet."""
    import re

    def ask(prompt, system, temperature):
        cause, effect = re.search(r"explains how (.*) and (.*) are related", prompt).groups()
        return ("<Yes>" if cause < effect else "<No>"), "stop"

    return ask


def _refined(spark, d):
    """Three cases in one job."""
    rows, nodes = dq.derived_cases(spark, d)
    return refine.refine_cases(rows, nodes, "order lines", generate.echo_client, _alphabet, alpha=dq.CASES_ALPHA)


@query("gr11_refined_ranking", f'WITH RECURSIVE {dq.CASE_RANKING} SELECT "case", stage, node, round(v, 6) AS visits, rank FROM ranking')
def _(spark, d):
    return _refined(spark, d)["ranking"].withColumn("visits", F.round("visits", 6))


@query("gr11_refined_evaluation", f"""
    WITH RECURSIVE {dq.CASE_RANKING},
    t AS (SELECT *, (SELECT rank FROM ranking q WHERE q."case" = r."case" AND q.stage = r.stage AND q.node = 'V') AS kr FROM ranking r WHERE node = 'X'),
    e AS (SELECT "case", stage, rank AS rank_all, rank - CASE WHEN kr < rank THEN 1 ELSE 0 END AS rank_entities,
                 (SELECT count(*) FROM ranking q WHERE q."case" = t."case" AND q.stage = t.stage AND q.node <> 'V' AND q.v = t.v) AS tied FROM t)
    SELECT *, rank_all <= 1 AS rank_all_hit_1, rank_all <= 3 AS rank_all_hit_3, rank_all <= 5 AS rank_all_hit_5, round(1 / rank_all, 6) AS rank_all_rr,
           rank_entities <= 1 AS rank_entities_hit_1, rank_entities <= 3 AS rank_entities_hit_3, rank_entities <= 5 AS rank_entities_hit_5, round(1 / rank_entities, 6) AS rank_entities_rr
    FROM e
""")
def _(spark, d):
    out = _refined(spark, d)
    truth = out["kpi"].select("case", F.explode(F.array(F.lit("discovered"), F.lit("constrained"))).alias("stage"), F.lit("X").alias("node"))
    found = refine.evaluate_ranking(out["ranking"], truth, out["kpi"])
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


@query("gr12_refinement_difference", f"""
    WITH {dq.CASES}, a AS (SELECT k, least(cause, effect) AS lo, greatest(cause, effect) AS hi, min(CASE WHEN mark = '->' AND cause > effect THEN '<-' ELSE mark END) AS x FROM g1 GROUP BY 1, 2, 3),
    b AS (SELECT k, cause AS lo, effect AS hi, mark AS y FROM g2)
    SELECT k AS "case", count(*) FILTER (x IN ('->', '<-')) AS before_directed, count(*) FILTER (x = '--') AS before_undirected, count(*) FILTER (x = '<->') AS before_bidirected,
           count(y) AS after_directed, 0::BIGINT AS after_undirected, 0::BIGINT AS after_bidirected,
           count(*) FILTER (x = '->' AND y = '->') AS directed_shared, count(*) FILTER (x = '<-' OR x = '->' AND y IS NULL) AS directed_lost,
           count(*) FILTER (y = '->' AND (x IS NULL OR x <> '->')) AS directed_new,
           count(*) FILTER (x = y) AS shared, count(*) FILTER (x <> y) AS changed, count(*) FILTER (y IS NULL) AS only_before, count(*) FILTER (x IS NULL) AS only_after
    FROM a FULL JOIN b USING (k, lo, hi) GROUP BY 1
""")
def _(spark, d):
    out = _refined(spark, d)
    return edges.graph_difference(out["initial"], out["refined"])


# -- panels and wide tables ----------------------------------------------------------

def _panel(spark, d):
    """Weekly panel rows per metric: pods, days, one vector per day with the KPI last."""
    ch = fx.channels(spark, d)
    day = ch.groupBy("case", "metric", "ts").agg(F.array_sort(F.collect_list(F.struct("entity", "value"))).alias("v")).where("size(v) = 5")
    rows = day.join(fx.kpi(spark, d).select("ts", F.col("value").alias("kpi")), "ts").select(
        "case", "metric", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"),
        F.transform("v", lambda s: s["entity"]).alias("pods"), F.concat(F.transform("v", lambda s: s["value"]), F.array("kpi")).alias("row"))
    week = rows.groupBy("case", "metric", "pods", F.floor(F.col("t") / 604800).alias("w")).agg(F.array_sort(F.collect_list(F.struct("t", "row"))).alias("s"))
    return week.select("case", "metric", "pods", F.transform("s", lambda s: s["t"]).alias("time"), F.transform("s", lambda s: s["row"]).alias("seq"))


@query("src05_panel_to_long", f"""
    WITH ch AS ({fx.CHANNELS_SQL}), kp AS ({fx.KPI_SQL}), full_days AS (SELECT metric, day FROM ch GROUP BY 1, 2 HAVING count(*) = 5)
    SELECT metric, epoch(day)::DOUBLE AS ts, entity, false AS is_kpi, round(value, 6) AS value FROM ch JOIN full_days USING (metric, day)
    UNION ALL SELECT metric, epoch(day)::DOUBLE, 'Latency', true, round(kpi, 6) FROM full_days JOIN kp USING (day)
""")
def _(spark, d):
    from rcaspark.operators.profile import require

    panel = require(_panel(spark, d), metrics.panel_rules())
    return metrics.panel_to_long(panel).select("metric", "ts", "entity", "is_kpi", F.round("value", 6).alias("value"))


def _wide(spark, d):
    from rcaspark.session import bounded_rows

    ch = fx.channels(spark, d).groupBy("case", "entity", "ts").agg(F.avg("value").alias("value"))
    names = sorted(r["entity"] for r in bounded_rows(ch.select("entity").distinct(), 5000, "entity list"))
    return metrics.to_wide(ch, fx.kpi(spark, d), names), [*names, metrics.KPI_COLUMN]


@query("src01_snk01_wide_csv", f"""
    WITH ch AS ({fx.CHANNELS_SQL}), kp AS ({fx.KPI_SQL}), e AS (SELECT p.entity, kp.day, avg(value) AS v FROM (SELECT DISTINCT entity FROM ch) p CROSS JOIN kp LEFT JOIN ch ON ch.entity = p.entity AND ch.day = kp.day GROUP BY 1, 2)
    SELECT row_number() OVER (PARTITION BY entity ORDER BY day) AS step, entity, CAST(substr(entity, 5) AS INTEGER) AS pos, false AS is_kpi, round(v, 6) AS value FROM e
    UNION ALL SELECT row_number() OVER (ORDER BY day), 'Latency', 5, true, round(kpi, 6) FROM kp
""")
def _(spark, d):
    wide, columns = _wide(spark, d)
    path = scratch_path(spark, "wide")
    sinks.write_wide_csv(wide, path, columns)
    steps = full_rank(metrics.read_wide(spark, f"{path}/values", columns), ["entity"], [F.col("file"), F.col("row")], "step")
    return steps.select("step", "entity", "pos", "is_kpi", F.round("value", 6).alias("value"))


@query("src02_truth_matrix", f"WITH {dq.SKELETON} SELECT cause, effect FROM g")
def _(spark, d):
    # The oriented graph written as a 0/1 matrix file without a header (row = effect), and read back.
    g = dq.graph(spark, d)
    cells = [F.max(F.when(F.col("cause") == c, 1).otherwise(0)).alias(c) for c in dq.COLUMNS]
    place = F.array_position(F.array(*[F.lit(c) for c in dq.COLUMNS]), F.col("entity"))
    every = spark.createDataFrame([(c,) for c in dq.COLUMNS], "entity string").join(g.select(F.col("effect").alias("entity"), "cause"), "entity", "left")
    path = scratch_path(spark, "matrix")
    every.groupBy("entity").agg(*cells).coalesce(1).sortWithinPartitions(place).select(*dq.COLUMNS).write.csv(path)
    return metrics.read_truth_matrix(spark, metrics.read_matrix(spark, path), dq.COLUMNS)


@query("src02_scored_matrix", """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
    SELECT round((l_quantity - mq) / sq, 6) AS quantity, round((l_tax - mt) / st, 6) AS tax, CAST(NULL AS DOUBLE) AS fixed, count(*) AS n FROM lineitem, s GROUP BY ALL
""")
def _(spark, d):
    path = scratch_path(spark, "numbers")
    table(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(3.0)).write.csv(path)
    v = metrics.scored_matrix(metrics.read_matrix(spark, path))
    at = lambda i, name: F.round(F.get("cells", i), 6).alias(name)
    return v.select(at(0, "quantity"), at(1, "tax"), at(2, "fixed")).groupBy("quantity", "tax", "fixed").agg(F.count("*").alias("n"))


@query("snk02_snk03_write_once", "SELECT n_name, r_name, false AS rewritten FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name")
    path = scratch_path(spark, "once")
    sinks.write_same(rows, path)
    return spark.read.parquet(path).withColumn("rewritten", F.lit(sinks.write_same(rows, path)))


@query("snk04_manifest", f"""
    WITH ch AS ({fx.CHANNELS_SQL})
    SELECT 'channel' AS kind, count(*) AS n FROM (SELECT DISTINCT entity, metric FROM ch) UNION ALL SELECT 'entity', count(DISTINCT entity) FROM ch UNION ALL SELECT 'run', 1
""")
def _(spark, d):
    ch = fx.channels(spark, d)
    path = scratch_path(spark, "manifest")
    sinks.write_new(sinks.manifest(align.channel_stats(ch), align.entity_decisions(ch), {"recipe": "daily"}), path, partition_by=["kind"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("snk05_metric_report", """
    SELECT event_type AS method, round(avg(1.0 / (CAST(json_extract_string(props, '$.k') AS BIGINT) % 15 + 1)), 6) AS mrr FROM events GROUP BY 1
""")
def _(spark, d):
    from rcaspark.operators.evaluate import rank_metrics
    from rcaspark.plans.graph_queries import _ranks

    path = scratch_path(spark, "report")
    report = rank_metrics(_ranks(spark, d), ["method"])
    sinks.write_new(report, path, "csv", header="true")
    return spark.read.csv(path, header=True, schema=report.schema).select("method", F.round("mrr", 6).alias("mrr"))


@query("snk05_whole_report", _metrics_sql("<", 0))
def _(spark, d):
    # Every metric of the report goes through the written file.
    from rcaspark.operators.evaluate import rank_metrics
    from rcaspark.plans.graph_queries import _ranks, _rounded

    path = scratch_path(spark, "report")
    report = rank_metrics(_ranks(spark, d), ["method"])
    sinks.write_new(report, path, "csv", header="true")
    return _rounded(spark.read.csv(path, header=True, schema=report.schema))


@query("snk06_rankings_by_stage", """
    SELECT lang AS stage, source AS node, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1, 2
""")
def _(spark, d):
    n = table(spark, d, "documents").groupBy(F.col("lang").alias("stage"), F.col("source").alias("node")).agg(F.count("*").alias("visits")).withColumn("case", fx.case_by("stage"))
    path = scratch_path(spark, "rankings")
    sinks.write_new(full_rank(n, ["case", "stage"], [F.desc("visits"), F.col("node")]), path, partition_by=["case", "stage"])
    return spark.read.parquet(path).select("stage", "node", "rank")


@query("snk07_entity_texts", """
    SELECT source, count(*) AS n FROM documents GROUP BY 1
""")
def _(spark, d):
    path = scratch_path(spark, "texts")
    flat = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("text"))
    sinks.write_texts(flat, path, "source", "text")
    return spark.read.text(path).groupBy("source").agg(F.count("*").alias("n"))


@query("snk08_event_log", """
    SELECT user_id, max(ts)::DATE::VARCHAR AS last_day, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1
""")
def _(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"))
    path = scratch_path(spark, "progress")
    sinks.append_log(ev.where("event_type in ('click', 'view')"), path)
    sinks.append_log(ev.where("event_type not in ('click', 'view')"), path)
    log = spark.read.schema(ev.schema).json(path)
    return sinks.latest_state(log, ["user_id"], "event_id").select("user_id", F.col("day").cast("string").alias("last_day"), F.col("event_type").alias("last_type"))


@query("snk10_identified_table", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    path = scratch_path(spark, "vectors")
    sinks.write_identified(table(spark, d, "embeddings"), path, "model-a")
    return sinks.read_identified(spark, path, "model-a").select("vec_id", "label")


@query("src09_corpus", "SELECT doc_id, length(text) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
