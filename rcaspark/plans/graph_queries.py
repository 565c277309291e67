"""Queries over edge tables, walks, rankings and their evaluation.

The graph is the trade between nations: suppliers' nations are causes,
customers' nations effects, and a pair is an edge when it trades more than the
average pair. Two measures of trade give the two graphs that are compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.operators import edges, evaluate, walk
from rcaspark.operators.order import full_rank
from rcaspark.plans.fixtures import CASE, case_by  # noqa: F401
from rcaspark.plans.registry import query, table
from rcaspark.session import cut_lineage

FLOWS = """
    f AS (SELECT ns.n_name AS cause, nc.n_name AS effect, sum(l_quantity) AS q, count(*) AS n
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
          GROUP BY 1, 2),
    g1 AS (SELECT cause, effect FROM f WHERE cause <> effect AND q > (SELECT avg(q) FROM f)),
    g2 AS (SELECT cause, effect FROM f WHERE cause <> effect AND n > (SELECT avg(n) FROM f)),
    e1 AS (SELECT a.cause, a.effect, CASE WHEN b.cause IS NULL THEN '->' ELSE '--' END AS mark FROM g1 a LEFT JOIN g1 b ON a.cause = b.effect AND a.effect = b.cause),
    e2 AS (SELECT a.cause, a.effect, CASE WHEN b.cause IS NULL THEN '->' ELSE '<->' END AS mark FROM g2 a LEFT JOIN g2 b ON a.cause = b.effect AND a.effect = b.cause),
    v AS (SELECT cause, effect, CASE WHEN n > 1.1 * (SELECT avg(n) FROM f) THEN 1 WHEN n < 0.9 * (SELECT avg(n) FROM f) THEN 0 END AS verdict FROM f WHERE cause <> effect)
"""


def _nations(spark, d):
    return table(spark, d, "nation").select(case_by("n_name").alias("case"), F.col("n_name").alias("entity"), F.col("n_nationkey").alias("pos"))


def _kpi(spark, d):
    """The last node in column order."""
    return _nations(spark, d).groupBy("case").agg(F.max_by("entity", "pos").alias("entity"))


def _flows(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey"))
    buyer = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(
        table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    # Volumes are summed by nation key first; the names join 625 rows, not the lines.
    by_key = lines.join(supplier, "l_suppkey").join(buyer, "l_orderkey").groupBy("s_nationkey", "c_nationkey").agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    name = table(spark, d, "nation").select("n_nationkey", "n_name")
    # Stored once: the graphs below read these rows many times.
    return cut_lineage(by_key.join(name.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_name": "cause"}), "s_nationkey").join(
        name.withColumnsRenamed({"n_nationkey": "c_nationkey", "n_name": "effect"}), "c_nationkey"
    ).select(case_by("cause").alias("case"), "cause", "effect", "q", "n"))


def _graph(flows, measure, both_ways):
    mean = flows.groupBy("case").agg(F.avg(measure).alias("_mean"))
    g = flows.join(mean, "case").where((F.col(measure) > F.col("_mean")) & (F.col("cause") != F.col("effect"))).select(*edges.PAIR)
    back = edges.reverse(g).withColumn("_back", F.lit(True))
    return cut_lineage(g.join(back, edges.PAIR, "left").select(*edges.PAIR, F.when(F.col("_back"), both_ways).otherwise("->").alias("mark")))


def _before(spark, d):
    return _graph(_flows(spark, d), "q", "--")


def _after(spark, d):
    return _graph(_flows(spark, d), "n", "<->")


def _both(spark, d):
    """Both graphs from one trade join."""
    f = _flows(spark, d)
    return _graph(f, "q", "--"), _graph(f, "n", "<->")


def _verdicts(spark, d):
    f = _flows(spark, d)
    mean = f.groupBy("case").agg(F.avg("n").alias("_mean"))
    v = F.when(F.col("n") > 1.1 * F.col("_mean"), 1).when(F.col("n") < 0.9 * F.col("_mean"), 0)
    return f.join(mean, "case").where("cause <> effect").select(*edges.PAIR, v.alias("verdict"))


@query("prj04_binarise_edges", f"WITH {FLOWS} SELECT DISTINCT cause, effect FROM e1")
def _(spark, d):
    return edges.binarise(_before(spark, d)).drop("case")


@query("prj05_edge_marks", f"WITH {FLOWS} SELECT cause, effect, mark FROM e1 UNION ALL SELECT cause, effect, mark FROM e2 WHERE mark = '<->'")
def _(spark, d):
    # Endpoint cells of both graphs, then marks read back from them.
    def cells(e):
        here = F.when(F.col("mark") == "<->", 1).otherwise(-1)
        there = F.when(F.col("mark") == "--", -1).otherwise(1)
        a = e.select("case", F.col("cause").alias("a"), F.col("effect").alias("b"), here.alias("mark"))
        b = e.select("case", F.col("effect").alias("a"), F.col("cause").alias("b"), there.alias("mark"))
        return a.unionByName(b).distinct()
    before, after = _both(spark, d)
    one = edges.marks_from_endpoints(cells(before))
    two = edges.marks_from_endpoints(cells(after)).where("mark = '<->'")
    return one.unionByName(two).drop("case")


for _name, _compat, _rule in (
    ("prj06_edges_text", "corrected", "mark = '->' OR nr.n_nationkey < nc.n_nationkey"),
    ("prj06_edges_text_released", "released", "mark <> '--' OR nr.n_nationkey < nc.n_nationkey"),
):
    @query(_name, f"""
        WITH {FLOWS} SELECT string_agg(cause || ' ' || mark || ' ' || effect, ', ' ORDER BY nr.n_nationkey, nc.n_nationkey) AS text
        FROM e2 JOIN nation nc ON cause = nc.n_name JOIN nation nr ON effect = nr.n_name WHERE {_rule}
    """)
    def _(spark, d, compat=_compat):
        return edges.edges_text(_after(spark, d), _nations(spark, d), compat).select("text")


@query("prj07_required_forbidden", f"WITH {FLOWS} SELECT cause, effect, verdict FROM v WHERE verdict IS NOT NULL")
def _(spark, d):
    v = _verdicts(spark, d)
    return edges.known_pairs(v, 1).withColumn("verdict", F.lit(1)).unionByName(edges.known_pairs(v, 0).withColumn("verdict", F.lit(0))).drop("case")


@query("prj08_unknown_is_forbidden", f"WITH {FLOWS} SELECT cause, effect, coalesce(verdict, 0) AS verdict FROM v")
def _(spark, d):
    return edges.unknown_is_forbidden(_verdicts(spark, d)).drop("case")


@query("prj08_drop_mutual_required", f"""
    WITH {FLOWS} SELECT a.cause, a.effect, CASE WHEN a.verdict = 1 AND b.verdict = 1 THEN NULL ELSE a.verdict END AS verdict
    FROM v a LEFT JOIN v b ON a.cause = b.effect AND a.effect = b.cause
""")
def _(spark, d):
    return edges.drop_mutual_required(_verdicts(spark, d)).drop("case")


@query("jn12_reversed_edges", f"WITH {FLOWS} SELECT a.cause, a.effect, a.mark FROM e1 a JOIN e1 b ON a.cause = b.effect AND a.effect = b.cause")
def _(spark, d):
    e = _before(spark, d)
    return e.join(edges.reverse(e.select(*edges.PAIR)), edges.PAIR, "left_semi").drop("case")


@query("jn20_verdicts_against_edges", f"""
    WITH {FLOWS}, b AS (SELECT v.*, e2.mark FROM v LEFT JOIN e2 ON v.cause = e2.cause AND v.effect = e2.effect)
    SELECT count(*) FILTER (verdict = 1 AND mark IS NOT NULL) AS required_kept, count(*) FILTER (verdict = 1 AND mark IS NULL) AS required_lost,
           count(*) FILTER (verdict = 0 AND mark IS NOT NULL) AS forbidden_present,
           (SELECT count(*) FROM v a JOIN v b ON a.cause = b.effect AND a.effect = b.cause WHERE a.verdict = 1 AND b.verdict = 1 AND a.cause < a.effect) AS required_both_ways
    FROM b
""")
def _(spark, d):
    counts = edges.verdicts_against_edges(_verdicts(spark, d), _after(spark, d)).drop("case")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])  # one row even without trade


@query("jn20_conflicting_pairs", f"""
    WITH {FLOWS} SELECT a.cause, a.effect FROM v a JOIN v b ON a.cause = b.effect AND a.effect = b.cause WHERE a.verdict = 1 AND b.verdict = 1 AND a.cause < a.effect
""")
def _(spark, d):
    return edges.conflicts(_verdicts(spark, d)).drop("case")


@query("ag12_ag13_ag14_graph_metrics", f"""
    WITH {FLOWS}, n AS (SELECT a.n_name AS cause, b.n_name AS effect FROM nation a, nation b),
    c AS (SELECT n.cause, n.effect, p.cause IS NOT NULL AS p, pr.cause IS NOT NULL AS pb, t.cause IS NOT NULL AS t, tr.cause IS NOT NULL AS tb
          FROM n LEFT JOIN g1 p ON n.cause = p.cause AND n.effect = p.effect LEFT JOIN g1 pr ON n.cause = pr.effect AND n.effect = pr.cause
          LEFT JOIN g2 t ON n.cause = t.cause AND n.effect = t.effect LEFT JOIN g2 tr ON n.cause = tr.effect AND n.effect = tr.cause),
    k AS (SELECT count(*) AS cells, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn,
                 count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t AND NOT tb) AS extra,
                 count(*) FILTER (t AND NOT p AND NOT pb) AS missing, count(*) FILTER (t AND NOT tb AND NOT p AND pb) AS reversed FROM c)
    SELECT tp, fp, fn, tn, round(fp / (tn + fp), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr, round(tp / (tp + fp), 6) AS precision,
           round(2 * tp / (2 * tp + fn + fp), 6) AS f1, extra, missing, reversed, extra + missing + reversed AS shd,
           round((extra + missing + reversed) / cells, 6) AS nhd FROM k
""")
def _(spark, d):
    m = edges.graph_metrics(*_both(spark, d), _nations(spark, d)).drop("case")
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


@query("ag26_graph_difference", f"""
    WITH {FLOWS}, a AS (SELECT least(cause, effect) AS lo, greatest(cause, effect) AS hi, min(CASE WHEN mark = '->' AND cause > effect THEN '<-' ELSE mark END) AS x FROM e1 GROUP BY 1, 2),
    b AS (SELECT least(cause, effect) AS lo, greatest(cause, effect) AS hi, min(CASE WHEN mark = '->' AND cause > effect THEN '<-' ELSE mark END) AS y FROM e2 GROUP BY 1, 2),
    d1 AS (SELECT cause, effect FROM e1 WHERE mark = '->'), d2 AS (SELECT cause, effect FROM e2 WHERE mark = '->')
    SELECT (SELECT count(*) FROM d1) AS before_directed, count(*) FILTER (x = '--') AS before_undirected, count(*) FILTER (x = '<->') AS before_bidirected,
           (SELECT count(*) FROM d2) AS after_directed, count(*) FILTER (y = '--') AS after_undirected, count(*) FILTER (y = '<->') AS after_bidirected,
           (SELECT count(*) FROM (FROM d1 INTERSECT FROM d2)) AS directed_shared, (SELECT count(*) FROM (FROM d1 EXCEPT FROM d2)) AS directed_lost,
           (SELECT count(*) FROM (FROM d2 EXCEPT FROM d1)) AS directed_new,
           count(*) FILTER (x = y) AS shared, count(*) FILTER (x <> y) AS changed, count(*) FILTER (y IS NULL) AS only_before, count(*) FILTER (x IS NULL) AS only_after
    FROM a FULL JOIN b USING (lo, hi)
""")
def _(spark, d):
    return edges.graph_difference(*_both(spark, d)).drop("case")


# -- walk -----------------------------------------------------------------------

STEPS_SQL = f"""
    {FLOWS}, kpi AS (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1),
    d AS (SELECT effect AS node, cause AS next FROM e1 UNION SELECT cause, effect FROM e1 WHERE mark <> '->'),
    s AS (SELECT node, next FROM d UNION SELECT next, node FROM d WHERE node IN (FROM kpi) OR next IN (FROM kpi)),
    tr AS (SELECT node, next, 1.0::DOUBLE / count(*) OVER (PARTITION BY node) AS p FROM s),
    chain AS (SELECT node, next, p * 0.95 AS w, 1.0 AS arrives FROM tr
              UNION ALL SELECT n_name, (SELECT n_name FROM kpi), CASE WHEN n_name IN (SELECT node FROM tr) THEN 0.05 ELSE 1.0 END, 0.0 FROM nation)
"""


def _visits_sql(n):
    return f"""
    {STEPS_SQL.replace('    f AS', 'f AS', 1)},
    r(i, node, prob, arrived) AS (
        SELECT 0, n_name, 1.0::DOUBLE, 0.0::DOUBLE FROM kpi
        UNION ALL
        SELECT r.i + 1, c.next, sum(r.prob * c.w), sum(r.prob * c.w * c.arrives) FROM r JOIN chain c ON r.node = c.node WHERE r.i < {n} GROUP BY r.i, c.next),
    vis AS (SELECT n_name AS node, n_nationkey AS pos, round(coalesce(sum(arrived), 0), 6) AS visits FROM nation LEFT JOIN r ON r.node = n_name GROUP BY 1, 2)
    """


def _moves(spark, d):
    return cut_lineage(walk.transitions(walk.walk_graph(_before(spark, d), _kpi(spark, d))))


@query("gr06_walk_graph", f"WITH {STEPS_SQL} SELECT node, next FROM s")
def _(spark, d):
    return walk.walk_graph(_before(spark, d), _kpi(spark, d)).drop("case")


@query("gr07_transitions", f"WITH {STEPS_SQL} SELECT node, next, round(p, 6) AS p FROM tr")
def _(spark, d):
    return _moves(spark, d).select("node", "next", F.round("p", 6).alias("p"))


@query("gr09_expected_visits", f"WITH RECURSIVE {_visits_sql(1000)} SELECT node, visits FROM vis")
def _(spark, d):
    return walk.expected_visits(_moves(spark, d), _nations(spark, d), _kpi(spark, d)).select("node", F.round("visits", 6).alias("visits"))


@query("gr09_expected_visits_by_joins", f"WITH RECURSIVE {_visits_sql(12)} SELECT node, visits FROM vis")
def _(spark, d):
    v = walk.visits_by_joins(_moves(spark, d), _nations(spark, d), _kpi(spark, d), n_steps=12, per_cut=4)
    return v.select("node", F.round("visits", 6).alias("visits"))


@query("wn04_visit_ranking", f"""
    WITH RECURSIVE {_visits_sql(1000)} SELECT node, visits, row_number() OVER (ORDER BY visits DESC, pos) AS rank FROM vis
""")
def _(spark, d):
    v = walk.expected_visits(_moves(spark, d), _nations(spark, d), _kpi(spark, d))
    return walk.rank_nodes(v, _nations(spark, d), digits=6).select("node", "visits", "rank")


@query("wn05_prj10_entity_ranking", f"""
    WITH RECURSIVE {_visits_sql(1000)}
    SELECT node, row_number() OVER (ORDER BY visits DESC, pos) AS rank FROM vis WHERE node NOT IN (FROM kpi)
""")
def _(spark, d):
    v = walk.expected_visits(_moves(spark, d), _nations(spark, d), _kpi(spark, d))
    pods = _nations(spark, d).join(_kpi(spark, d), ["case", "entity"], "left_anti")
    return walk.rank_nodes(v, pods, digits=6).select("node", "rank")


@query("tk01_sorted_visits", f"WITH {STEPS_SQL} SELECT node, count(*) AS ways FROM s GROUP BY 1 ORDER BY ways DESC, node")
def _(spark, d):
    s = walk.walk_graph(_before(spark, d), _kpi(spark, d))
    return s.groupBy("node").agg(F.count("*").alias("ways")).orderBy(F.desc("ways"), "node")


@query("gr10_stage_routes", f"""
    WITH {FLOWS} SELECT 'first' AS stage, cause, effect FROM e1 UNION ALL SELECT 'explained', cause, effect FROM e1 UNION ALL SELECT 'refined', cause, effect FROM e2
""")
def _(spark, d):
    before, after = _both(spark, d)
    graphs = before.withColumn("graph_role", F.lit("initial")).unionByName(after.withColumn("graph_role", F.lit("refined")))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(r).alias("graph_role")) for s, r in (("first", "initial"), ("explained", "initial"), ("refined", "refined"))])
    routes = _kpi(spark, d).select("case", F.inline(stages))
    return walk.route_stages(graphs, routes).select("stage", "cause", "effect")


# -- evaluation -------------------------------------------------------------------

RANKS = "r AS (SELECT event_type AS method, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 15 + 1 AS rank FROM events)"


def _ranks(spark, d):
    """One rank from 1 to 15 per event, grouped by a method."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(F.col("event_type").alias("method"), F.col("event_id").cast("string").alias("case"), (k % 15 + 1).alias("rank"))


def _metrics_sql(op, plus):
    cols = ", ".join(
        f"round(avg(CASE WHEN rank {op} {k} THEN 1.0 ELSE 0.0 END), 6) AS pr_{k}, round(avg(greatest({k} - rank + {plus}, 0) / {k}), 6) AS map_{k}" for k in (3, 5, 10))
    return f"WITH {RANKS} SELECT method, count(*) AS n_cases, round(avg(1.0 / rank), 6) AS mrr, {cols} FROM r GROUP BY 1"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("ag15_ag16_ag17_rank_metrics", _metrics_sql("<", 0))
def _(spark, d):
    return _rounded(evaluate.rank_metrics(_ranks(spark, d), ["method"]))


@query("ag18_inclusive_rank_metrics", _metrics_sql("<=", 1))
def _(spark, d):
    return _rounded(evaluate.rank_metrics(_ranks(spark, d), ["method"], inclusive=True))


@query("ag20_method_report", f"""
    WITH {RANKS}, k AS (SELECT unnest([3, 5, 10]) AS k)
    SELECT method, 'mrr' AS metric, NULL::INTEGER AS k, round(avg(1.0 / rank), 6) AS value FROM r GROUP BY 1
    UNION ALL SELECT method, 'pr', k, round(avg(CASE WHEN rank < k THEN 1.0 ELSE 0.0 END), 6) FROM r, k GROUP BY 1, 3
    UNION ALL SELECT method, 'map', k, round(avg(greatest(k - rank, 0) / k), 6) FROM r, k GROUP BY 1, 3
""")
def _(spark, d):
    return _rounded(evaluate.long_report(evaluate.check_ranks(_ranks(spark, d)), ["method"]))


SCORES = """
    a AS (SELECT user_id, event_type, count(*) FILTER (value > 30) AS pos, count(*) AS n FROM events GROUP BY 1, 2),
    sc AS (SELECT user_id % 7 AS c, 'u' || CAST(user_id AS VARCHAR) AS entity, round(max(pos / n), 6) AS score FROM a GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, entity) AS rank, count(*) OVER (PARTITION BY c) AS size FROM sc),
    truth AS (SELECT c, min(entity) AS entity FROM sc GROUP BY 1)
"""


def _alerts(spark, d):
    """Rows over a fixed level stand for alerts; seven cases by user."""
    return table(spark, d, "events").groupBy(
        (F.col("user_id") % 7).cast("string").alias("case"), F.concat(F.lit("u"), F.col("user_id")).alias("entity"), F.col("event_type").alias("metric")
    ).agg(F.count_if(F.col("value") > 30).alias("positives"), F.count("*").alias("n_rows"))


def _scores(spark, d):
    a = _alerts(spark, d)
    return evaluate.anomaly_score(a, a).withColumn("score", F.round("score", 6))


def _ranked(spark, d):
    return full_rank(_scores(spark, d), ["case"], [F.desc("score"), F.col("entity")])


def _truth(spark, d):
    return _scores(spark, d).groupBy("case").agg(F.min("entity").alias("entity"))


@query("ag09_anomaly_score", f"WITH {SCORES} SELECT CAST(c AS VARCHAR) AS \"case\", entity, score FROM sc")
def _(spark, d):
    return _scores(spark, d)


@query("ag10_score_saturation", f"""
    WITH {SCORES}
    SELECT CAST(c AS VARCHAR) AS "case", count(*) AS entities, count(*) FILTER (score > 0.4) AS saturated, max(score) AS first_score,
           max(score) FILTER (rank = 10) AS nth_score, round(median(score), 6) AS median_score FROM rk GROUP BY 1
""")
def _(spark, d):
    return _rounded(evaluate.saturation(_scores(spark, d), high=0.4, nth=10))


@query("ag11_candidate_recall", f"""
    WITH {SCORES}
    SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, max(rank) AS smallest_k FROM truth JOIN rk USING (c, entity)
""")
def _(spark, d):
    return _rounded(evaluate.candidate_recall(_ranked(spark, d), _truth(spark, d), 10))


@query("tk02_forced_shortlist", f"""
    WITH {SCORES}, z AS (SELECT rk.*, truth.entity IS NOT NULL AS forced FROM rk LEFT JOIN truth USING (c, entity)),
    p AS (SELECT *, row_number() OVER (PARTITION BY c, forced ORDER BY score DESC, entity) AS place FROM z)
    SELECT CAST(c AS VARCHAR) AS "case", entity, score, forced, rank AS natural_rank, rank <= 6 AS would_be_natural FROM p WHERE forced OR place <= 5
""")
def _(spark, d):
    return evaluate.shortlist(_scores(spark, d), _truth(spark, d), 6)


@query("ag19_truth_report", f"""
    WITH {SCORES}, t AS (SELECT truth.c, rk.rank, rk.score FROM truth LEFT JOIN rk USING (c, entity)),
    kp AS (SELECT c, max(rank) AS kr FROM rk WHERE entity = 'u12' GROUP BY 1),
    x AS (SELECT t.c, t.rank AS a, t.rank - CASE WHEN kr < t.rank THEN 1 ELSE 0 END AS e, (SELECT count(*) FROM rk WHERE rk.c = t.c AND rk.score = t.score AND rk.entity <> 'u12') AS tied FROM t LEFT JOIN kp USING (c))
    SELECT CAST(c AS VARCHAR) AS "case", a AS rank_all, CAST(e AS BIGINT) AS rank_entities, tied, a <= 1 AS rank_all_hit_1, a <= 3 AS rank_all_hit_3, a <= 5 AS rank_all_hit_5, round(1.0 / a, 6) AS rank_all_rr,
           e <= 1 AS rank_entities_hit_1, e <= 3 AS rank_entities_hit_3, e <= 5 AS rank_entities_hit_5, round(1.0 / e, 6) AS rank_entities_rr FROM x
""")
def _(spark, d):
    r = _ranked(spark, d).select("case", F.col("entity").alias("node"), F.col("score").alias("visits"), "rank")
    t = _truth(spark, d).select("case", F.col("entity").alias("node"))
    return _rounded(evaluate.truth_report(r, t, "u12"))


@query("ag33_multi_truth", f"""
    WITH {SCORES}, t AS (SELECT c, entity FROM sc WHERE entity LIKE '%1%'),
    p AS (SELECT t.c, count(*) FILTER (rank <= 5) / least(5, count(*)) AS pr, 1.0 / min(rank) AS rr FROM t JOIN rk ON t.c = rk.c AND t.entity = rk.entity GROUP BY 1)
    SELECT count(*) AS cases, round(avg(pr), 6) AS pr_5, round(avg(rr), 6) AS mrr FROM p
""")
def _(spark, d):
    many = _scores(spark, d).where(F.contains("entity", F.lit("1")))
    return _rounded(evaluate.multi_truth(_ranked(spark, d), many, 5))


@query("ag21_all_or_nothing", f"""
    WITH {SCORES}, t AS (SELECT c, min(entity) AS e, count(*) FILTER (entity LIKE '%4') AS m FROM sc GROUP BY 1),
    q AS (SELECT t.c, c < 5 AS early, CASE WHEN c <> 6 THEN (SELECT rank FROM rk WHERE rk.c = t.c AND rk.entity = t.e) END AS rank FROM t)
    SELECT early, count(*) AS cases, count(rank) AS resolved, CASE WHEN bool_and(rank IS NOT NULL) THEN round(avg(1.0 / rank), 6) END AS mrr,
           CASE WHEN bool_and(rank IS NOT NULL) THEN round(avg(greatest(10 - rank, 0) / 10), 6) END AS map_10 FROM q GROUP BY 1
""")
def _(spark, d):
    r = _truth(spark, d).join(_ranked(spark, d), ["case", "entity"]).select(
        "case", F.lit("first").alias("stage"), F.when(F.col("case") != "6", F.col("rank")).alias("rank"), (F.col("case") < "5").alias("early"))
    return _rounded(evaluate.all_or_nothing(r, ["early"]))


@query("jn16_prj09_match_service", """
    WITH e AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || CAST(p_size AS VARCHAR) || '-' || lower(p_type) AS entity, p_brand AS c FROM part),
    t AS (SELECT p_brand AS c, min(replace(p_name, ' ', '-')) AS label FROM part GROUP BY 1
          UNION ALL SELECT DISTINCT p_brand || '-none', 'absent' FROM part),
    m AS (SELECT t.c, label, e.entity FROM t LEFT JOIN e ON t.c = e.c AND (e.entity = label OR starts_with(e.entity, label || '-')))
    SELECT c AS "case", label, entity, count(entity) OVER (PARTITION BY c) AS n_matches, count(entity) OVER (PARTITION BY c) = 1 AS scorable FROM m
""")
def _(spark, d):
    p = table(spark, d, "part").withColumn("case", F.col("p_brand")).withColumn("label", F.replace("p_name", F.lit(" "), F.lit("-")))
    ents = p.select("case", F.concat_ws("-", "label", F.col("p_size").cast("string"), F.lower("p_type")).alias("entity"))
    labels = p.groupBy("case").agg(F.min("label").alias("label"))
    absent = labels.select(F.concat("case", F.lit("-none")).alias("case"), F.lit("absent").alias("label"))
    return evaluate.match_service(labels.unionByName(absent), ents)


@query("jn19_published_metrics", f"""
    WITH {RANKS}, p(method, published) AS (VALUES ('click', 0.25), ('view', 0.5), ('absent', 0.1)),
    m AS (SELECT method, avg(1.0 / rank) AS computed FROM r GROUP BY 1)
    SELECT coalesce(m.method, p.method) AS method, round(computed, 6) AS computed, CAST(published AS DOUBLE) AS published, coalesce(abs(computed - published) < 0.05, false) AS agrees FROM m FULL JOIN p ON m.method = p.method
""")
def _(spark, d):
    published = spark.createDataFrame([("click", 0.25), ("view", 0.5), ("absent", 0.1)], "method string, mrr double")
    return _rounded(evaluate.compare_published(evaluate.rank_metrics(_ranks(spark, d), ["method"]), published, ["method"], "mrr", 0.05))
