"""Queries that discover a graph among columns derived from the order lines.

X = z(quantity), Y = X + z(price), W = X + z(discount), V = Y + W + z(tax): the
true graph is X -> Y, X -> W, Y -> V, W -> V.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rcaspark.operators import discover, edges
from rcaspark.plans.fixtures import CASE
from rcaspark.plans.registry import query, table

COLUMNS = ["X", "Y", "W", "V"]
RAW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALPHA = 0.01

DERIVED = """
    s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp,
                 avg(l_discount) AS md, stddev_pop(l_discount) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem),
    z AS (SELECT (l_quantity - mq) / sq AS q, (l_extendedprice - mp) / sp AS p, (l_discount - md) / sd AS dd, (l_tax - mt) / st AS t FROM lineitem, s),
    x AS (SELECT q AS X, q + p AS Y, q + dd AS W, q + p + q + dd + t AS V FROM z),
    pairs AS (SELECT a, b, count(*) AS n, corr(va, vb) AS r FROM (
        SELECT unnest(['X', 'X', 'X', 'Y', 'Y', 'W']) AS a, unnest(['Y', 'W', 'V', 'W', 'V', 'V']) AS b,
               unnest([X, X, X, Y, Y, W]) AS va, unnest([Y, W, V, W, V, V]) AS vb FROM x) GROUP BY 1, 2)
"""


# Skeleton and colliders of four variables by partial correlations of order 0, 1 and 2.
SKELETON = f"""
    {DERIVED},
    r AS (SELECT a, b, n, r FROM pairs UNION ALL SELECT b, a, n, r FROM pairs),
    p1 AS (SELECT ab.a, ab.b, ak.b AS k, ab.n, (ab.r - ak.r * bk.r) / sqrt((1 - ak.r * ak.r) * (1 - bk.r * bk.r)) AS r
           FROM r ab JOIN r ak ON ak.a = ab.a AND ak.b <> ab.b JOIN r bk ON bk.a = ab.b AND bk.b = ak.b),
    p2 AS (SELECT ab.a, ab.b, ab.k, al.b AS l, ab.n, (ab.r - al.r * bl.r) / sqrt((1 - al.r * al.r) * (1 - bl.r * bl.r)) AS r
           FROM p1 ab JOIN p1 al ON al.a = ab.a AND al.k = ab.k AND al.b <> ab.b JOIN p1 bl ON bl.a = ab.b AND bl.k = ab.k AND bl.b = al.b),
    cut AS (SELECT a, b, 0 AS s, '' AS given FROM r WHERE sqrt(n - 3) * abs(atanh(r)) <= 2.5758293
            UNION ALL SELECT a, b, 1, k FROM p1 WHERE sqrt(n - 4) * abs(atanh(r)) <= 2.5758293
            UNION ALL SELECT a, b, 2, k || l FROM p2 WHERE sqrt(n - 5) * abs(atanh(r)) <= 2.5758293),
    sep AS (SELECT a, b, arg_min(given, s) AS given FROM cut GROUP BY 1, 2),
    adj AS (SELECT a, b FROM r EXCEPT SELECT a, b FROM sep),
    heads AS (SELECT DISTINCT x.a AS cause, x.b AS effect FROM adj x JOIN adj y ON x.b = y.b AND x.a <> y.a
              JOIN sep ON sep.a = x.a AND sep.b = y.a AND NOT contains(given, x.b)),
    g AS (SELECT a AS cause, b AS effect, CASE WHEN heads.cause IS NULL THEN '--' ELSE '->' END AS mark FROM adj LEFT JOIN heads ON a = cause AND b = effect
          WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.cause = b AND h.effect = a))
"""


# The same for every return flag as a case of its own.
CASES = """
    s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp,
                 avg(l_discount) AS md, stddev_pop(l_discount) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem),
    z AS (SELECT l_returnflag AS k, (l_quantity - mq) / sq AS q, (l_extendedprice - mp) / sp AS p, (l_discount - md) / sd AS dd, (l_tax - mt) / st AS t FROM lineitem, s),
    x AS (SELECT k, q AS X, q + p AS Y, q + dd AS W, q + p + q + dd + t AS V FROM z),
    pairs AS (SELECT k, a, b, count(*) AS n, corr(va, vb) AS r FROM (
        SELECT k, unnest(['X', 'X', 'X', 'Y', 'Y', 'W']) AS a, unnest(['Y', 'W', 'V', 'W', 'V', 'V']) AS b,
               unnest([X, X, X, Y, Y, W]) AS va, unnest([Y, W, V, W, V, V]) AS vb FROM x) GROUP BY 1, 2, 3),
    r AS (SELECT k, a, b, n, r FROM pairs UNION ALL SELECT k, b, a, n, r FROM pairs),
    p1 AS (SELECT ab.k, ab.a, ab.b, ag.b AS g, ab.n, (ab.r - ag.r * bg.r) / sqrt((1 - ag.r * ag.r) * (1 - bg.r * bg.r)) AS r
           FROM r ab JOIN r ag ON ag.k = ab.k AND ag.a = ab.a AND ag.b <> ab.b JOIN r bg ON bg.k = ab.k AND bg.a = ab.b AND bg.b = ag.b),
    p2 AS (SELECT ab.k, ab.a, ab.b, ab.g, ah.b AS h, ab.n, (ab.r - ah.r * bh.r) / sqrt((1 - ah.r * ah.r) * (1 - bh.r * bh.r)) AS r
           FROM p1 ab JOIN p1 ah ON ah.k = ab.k AND ah.a = ab.a AND ah.g = ab.g AND ah.b <> ab.b JOIN p1 bh ON bh.k = ab.k AND bh.a = ab.b AND bh.g = ab.g AND bh.b = ah.b),
    cut AS (SELECT k, a, b, 0 AS s, '' AS given FROM r WHERE sqrt(n - 3) * abs(atanh(r)) <= 3.2905267
            UNION ALL SELECT k, a, b, 1, g FROM p1 WHERE sqrt(n - 4) * abs(atanh(r)) <= 3.2905267
            UNION ALL SELECT k, a, b, 2, g || h FROM p2 WHERE sqrt(n - 5) * abs(atanh(r)) <= 3.2905267),
    sep AS (SELECT k, a, b, arg_min(given, s) AS given FROM cut GROUP BY 1, 2, 3),
    adj AS (SELECT k, a, b FROM r EXCEPT SELECT k, a, b FROM sep),
    heads AS (SELECT DISTINCT x.k, x.a AS cause, x.b AS effect FROM adj x JOIN adj y ON x.k = y.k AND x.b = y.b AND x.a <> y.a
              JOIN sep ON sep.k = x.k AND sep.a = x.a AND sep.b = y.a AND NOT contains(given, x.b)),
    g1 AS (SELECT adj.k, a AS cause, b AS effect, CASE WHEN heads.cause IS NULL THEN '--' ELSE '->' END AS mark
           FROM adj LEFT JOIN heads ON adj.k = heads.k AND a = cause AND b = effect
           WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.k = adj.k AND h.cause = b AND h.effect = a)),
    -- The verdicts want every cause in front of its effect in the alphabet.
    g2 AS (SELECT k, a AS cause, b AS effect, '->' AS mark FROM adj WHERE a < b)
"""
CASES_ALPHA = 0.001

# The walk over both graphs of every case, and its ranking.
CASE_RANKING = f"""
    {CASES},
    st AS (SELECT 'discovered' AS stage, * FROM g1 UNION ALL SELECT 'constrained', * FROM g2),
    nd(node, pos) AS (VALUES ('X', 0), ('Y', 1), ('W', 2), ('V', 3)),
    ks AS (SELECT DISTINCT l_returnflag AS k, unnest(['discovered', 'constrained']) AS stage FROM lineitem),
    d AS (SELECT k, stage, effect AS node, cause AS next FROM st UNION SELECT k, stage, cause, effect FROM st WHERE mark <> '->'),
    s2 AS (FROM d UNION SELECT k, stage, next, node FROM d WHERE node = 'V' OR next = 'V'),
    tr AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY k, stage, node) AS p FROM s2),
    chain AS (SELECT k, stage, node, next, p * 0.95 AS w, 1.0 AS arrives FROM tr
              UNION ALL SELECT k, stage, node, 'V', CASE WHEN (k, stage, node) IN (SELECT (k, stage, node) FROM tr) THEN 0.05 ELSE 1.0 END, 0.0 FROM ks, nd),
    steps(i, k, stage, node, prob, arrived) AS (
        SELECT 0, k, stage, 'V', 1.0::DOUBLE, 0.0::DOUBLE FROM ks
        UNION ALL
        SELECT t.i + 1, t.k, t.stage, c.next, sum(t.prob * c.w), sum(t.prob * c.w * c.arrives) FROM steps t
        JOIN chain c ON t.k = c.k AND t.stage = c.stage AND t.node = c.node WHERE t.i < 1000 GROUP BY t.i, t.k, t.stage, c.next),
    vis AS (SELECT ks.k, ks.stage, nd.node, nd.pos, round(coalesce(sum(arrived), 0), 9) AS v FROM ks, nd
            LEFT JOIN steps t ON t.k = ks.k AND t.stage = ks.stage AND t.node = nd.node GROUP BY ALL),
    ranking AS (SELECT k AS "case", stage, node, v, row_number() OVER (PARTITION BY k, stage ORDER BY v DESC, pos) AS rank FROM vis)
"""


def derived_cases(spark, d):
    """The derived columns beside the return flag, as one panel of several cases."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), *RAW)
    return discover.case_panel(_derived(lines, "flag"), COLUMNS, "flag")


def derived(spark, d):
    return _derived(table(spark, d, "lineitem").select(*RAW))


def _derived(lines, *keys):
    s = lines.agg(*[F.avg(c).alias(f"m_{c}") for c in RAW], *[F.stddev_pop(c).alias(f"s_{c}") for c in RAW]).first()
    q, p, dd, t = [(F.col(c) - s[f"m_{c}"]) / s[f"s_{c}"] for c in RAW]
    return lines.select(*keys, q.alias("X"), (q + p).alias("Y"), (q + dd).alias("W"), (q + p + q + dd + t).alias("V"))


def truth(spark):
    return spark.createDataFrame([(CASE, "X", "Y"), (CASE, "X", "W"), (CASE, "Y", "V"), (CASE, "W", "V")], "case string, cause string, effect string")


def graph(spark, d, **options):
    return discover.discover(derived(spark, d), COLUMNS, CASE, "pc", alpha=ALPHA, **options)


@query("ag30_correlations", f"WITH {DERIVED} SELECT a, b, n, round(r, 6) AS r FROM pairs")
def _(spark, d):
    return discover.correlations(derived(spark, d), COLUMNS).where("a <> b").select("a", "b", "n", F.round("r", 6).alias("r"))


@query("fn25_fisher_decisions", f"""
    WITH {DERIVED} SELECT a, b, round(sqrt(n - 3) * abs(atanh(r)), 4) AS z, sqrt(n - 3) * abs(atanh(r)) > 1.959964 AS dependent FROM pairs
""")
def _(spark, d):
    c = discover.correlations(derived(spark, d), COLUMNS).where("a <> b")
    z = F.sqrt(F.col("n") - 3) * F.abs(F.atanh("r"))
    return c.select("a", "b", F.round(z, 4).alias("z"), (z > 1.959964).alias("dependent"))


@query("gr01_skeleton", f"WITH {SKELETON} SELECT a, b FROM adj WHERE strpos('XYWV', a) < strpos('XYWV', b)")
def _(spark, d):
    rows, _nodes = discover.panel(derived(spark, d), COLUMNS, CASE)
    found, _cuts = discover.skeleton(discover.cross_moments(rows), discover.fisher_test(ALPHA))
    names = F.array(*[F.lit(c) for c in COLUMNS])
    return found.select(F.get(names, F.col("x")).alias("a"), F.get(names, F.col("y")).alias("b"))


@query("gr02_oriented_graph", f"WITH {SKELETON} SELECT cause, effect, mark FROM g")
def _(spark, d):
    return graph(spark, d).drop("case")


# Both edges of X are known to leave it.
@query("gr03_constrained_graph", f"WITH {SKELETON} SELECT cause, effect, '->' AS mark FROM g WHERE mark = '->' OR cause = 'X'")
def _(spark, d):
    known = spark.createDataFrame([(CASE, "X", "Y", 1), (CASE, "W", "X", 0)], "case string, cause string, effect string, verdict int")
    return graph(spark, d, constraints=known).drop("case")


@query("gr04_single_parent_scores", f"""
    WITH {DERIVED}, o AS (SELECT a AS cause, b AS effect, n, r FROM pairs UNION ALL SELECT b, a, n, r FROM pairs),
    sc AS (SELECT cause, effect, n * ln(1 - r * r) + ln(n) AS score FROM o)
    SELECT cause, effect, round(score, 2) AS score, score = min(score) OVER (PARTITION BY effect) AND score < 0 AS chosen FROM sc
""")
def _(spark, d):
    return discover.single_parent_scores(*discover.panel(derived(spark, d), COLUMNS, CASE)).select("cause", "effect", F.round("score", 2).alias("score"), "chosen")


@query("gr05_linear_non_gaussian", """
    SELECT 'X' AS cause, 'Y' AS effect, '->' AS mark UNION ALL SELECT 'X', 'W', '->' UNION ALL SELECT 'Y', 'V', '->' UNION ALL SELECT 'W', 'V', '->'
""")
def _(spark, d):
    return discover.discover(derived(spark, d), COLUMNS, CASE, "lingam", alpha=0.001).drop("case")


@query("gr12_discovery_metrics", f"""
    WITH {SKELETON}, t(cause, effect) AS (VALUES ('X', 'Y'), ('X', 'W'), ('Y', 'V'), ('W', 'V')), v(x) AS (VALUES ('X'), ('Y'), ('W'), ('V')),
    c AS (SELECT (c.x, e.x) IN (SELECT (cause, effect) FROM g) AS p, (e.x, c.x) IN (SELECT (cause, effect) FROM g) AS pb,
                 (c.x, e.x) IN (SELECT (cause, effect) FROM t) AS t, (e.x, c.x) IN (SELECT (cause, effect) FROM t) AS tb FROM v c, v e),
    k AS (SELECT count(*) AS cells, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn,
                 count(*) FILTER (p AND NOT t AND NOT tb) AS extra, count(*) FILTER (t AND NOT p AND NOT pb) AS missing, count(*) FILTER (t AND NOT tb AND NOT p AND pb) AS reversed FROM c)
    SELECT tp, fp, fn, tn, round(fp / (tn + fp), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fn + fp), 6) AS f1,
           extra, missing, reversed, extra + missing + reversed AS shd, round((extra + missing + reversed) / cells, 6) AS nhd FROM k
""")
def _(spark, d):
    nodes = spark.createDataFrame([(CASE, c) for c in COLUMNS], "case string, entity string")
    m = edges.graph_metrics(graph(spark, d), truth(spark), nodes).drop("case")
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])
