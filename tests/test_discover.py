"""Discovery on graphs with known answers, and the channel scorer's properties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rcaspark.operators import discover, edges, profile
from rcaspark.streaming import spot, stream


def test_subsets_in_ranges_are_all_subsets():
    whole = list(itertools.combinations(range(9), 4))
    cut = [c for first in range(0, len(whole), 7) for c in discover._subsets(9, 4, first, 7)]
    assert cut == whole


def test_partial_correlation_matches_regression():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4)) @ r.normal(size=(4, 4))
    corr = np.corrcoef(x.T)
    z = np.c_[np.ones(500), x[:, 2:]]
    res = x[:, :2] - z @ np.linalg.lstsq(z, x[:, :2], rcond=None)[0]
    assert discover.partial_correlations(corr[None])[0] == pytest.approx(np.corrcoef(res.T)[0, 1])


@pytest.fixture(scope="module")
def wide(spark):
    r = np.random.default_rng(5)
    n = 4000
    a, b = r.uniform(-1, 1, n), r.uniform(-1, 1, n)
    c = a + b + 0.5 * r.uniform(-1, 1, n)
    d = c + 0.5 * r.uniform(-1, 1, n)
    return spark.createDataFrame([tuple(map(float, t)) for t in zip(d, a, c, b)], "d double, a double, c double, b double").repartition(6)


def moments(rows):
    return {(r["case"], r["i"], r["j"]): (r["n"], r["cov"], r["r"]) for r in discover.cross_moments(rows).collect()}


def test_moments_do_not_depend_on_partitions_or_tiles(spark, wide, monkeypatch):
    columns = ["d", "a", "c", "b"]
    x = np.array(wide.select(*columns).collect())
    want, corr = np.cov(x.T, bias=True), np.corrcoef(x.T)
    monkeypatch.setattr(discover, "TILE", 3)
    monkeypatch.setattr(discover, "CHUNK_BYTES", 20_000)
    for parts in (1, 9):
        got = moments(discover.panel(wide.repartition(parts), columns, "k")[0])
        assert set(got) == {("k", i, j) for i in range(4) for j in range(i, 4)}
        assert all(n == 4000 and cov == pytest.approx(want[i, j]) and r == pytest.approx(corr[i, j]) for (_, i, j), (n, cov, r) in got.items())


def test_moments_of_several_cases_and_odd_rows(spark):
    rows = [("a", [1.0, 2.0, 7.0]), ("a", [2.0, 1.0, 7.0]), ("a", [4.0, 9.0, 7.0]), ("a", [None, 1.0, 7.0]), ("a", [1.0, float("nan"), 7.0]),
            ("b", [1.0, 5.0]), ("b", [2.0, 6.0]), (None, [1.0]), ("c", None)]
    got = moments(spark.createDataFrame(rows, "case string, values array<double>").repartition(4))
    assert got["a", 0, 1][:2] == (3, pytest.approx(np.cov([1, 2, 4], [2, 1, 9], bias=True)[0, 1]))
    assert got["a", 0, 2][2] is None and got["b", 0, 1][2] == pytest.approx(1.0) and {k[0] for k in got} == {"a", "b"}
    with pytest.raises(Exception, match="different lengths"):
        moments(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "case string, values array<double>").coalesce(1))


def test_five_thousand_columns(spark):
    width = 5000
    rows = spark.range(40, numPartitions=4).select(F.lit("w").alias("case"), F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.hash("id", i) / 2.0**31).alias("values"))
    found = discover.cross_moments(rows)
    assert found.count() == width * (width + 1) // 2
    some = found.where("i % 997 = 0 and j % 1009 = 0").collect()
    x = np.array([r["values"] for r in rows.collect()])
    assert some and all(r["r"] == pytest.approx(np.corrcoef(x[:, r["i"]], x[:, r["j"]])[0, 1]) for r in some if r["i"] < r["j"])


def test_waves_keep_the_first_set_in_order(spark, monkeypatch):
    """Eight variables: the separating sets are those of a plain loop, however the subsets are handed out."""
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 8))
    for j in range(2, 8):
        x[:, j] += 0.7 * x[:, j - 1] + 0.5 * x[:, j - 2]
    corr, test = np.corrcoef(x.T), discover.fisher_test(0.05)
    near = {i: set(range(8)) - {i} for i in range(8)}
    want = {}
    for s in range(7):
        held = {i: sorted(near[i]) for i in near}
        for i, j in itertools.combinations(range(8), 2):
            if j not in held[i]:
                continue
            for a, b in ((i, j), (j, i)):
                hit = next((g for g in itertools.combinations([k for k in held[a] if k != b], s)
                            if test(corr[np.ix_([i, j, *g], [i, j, *g])][None], np.array([3000]))[0]), None)
                if hit is not None:
                    want[i, j] = list(hit)
                    near[i].discard(j), near[j].discard(i)
                    break
    wide = spark.createDataFrame([tuple(map(float, t)) for t in x], ", ".join(f"c{i} double" for i in range(8)))
    found = discover.cross_moments(discover.panel(wide, wide.columns, "k")[0])
    for size in (2,):
        monkeypatch.setattr(discover, "TESTS_PER_ROW", size)
        monkeypatch.setattr(discover, "FIRST_WAVE", 1)
        monkeypatch.setattr(discover, "GROWTH", 2)
        edges, cuts = discover.skeleton(found, test)
        assert {(c["x"], c["y"]): c["sepset"] for c in cuts.collect()} == want
        assert {(e["x"], e["y"]) for e in edges.collect()} == {p for p in itertools.combinations(range(8), 2) if p not in want}


def test_cases_in_one_job_equal_cases_alone(spark, wide):
    turned = wide.select(F.col("a").alias("d"), F.col("c").alias("a"), F.col("d").alias("c"), "b")
    both = wide.withColumn("k", F.lit("one")).unionByName(turned.withColumn("k", F.lit("two")))
    for method, alpha in (("pc", 0.01), ("lingam", 0.001)):
        options = {"alpha": alpha}
        got = discover.discover_cases(*discover.case_panel(both, ["d", "a", "c", "b"], "k"), method, **options)
        want = [discover.discover(t, ["d", "a", "c", "b"], c, method, **options) for t, c in ((wide, "one"), (turned, "two"))]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want[0].unionByName(want[1]).collect()))


def test_collider_and_propagation(wide):
    got = {(r["cause"], r["effect"], r["mark"]) for r in discover.discover(wide, ["d", "a", "c", "b"], "k", alpha=0.01).collect()}
    assert got == {("a", "c", "->"), ("b", "c", "->"), ("c", "d", "->")}


def test_forbidden_both_ways_is_no_edge(wide, spark):
    ban = spark.createDataFrame([("k", "c", "d", 0), ("k", "d", "c", 0)], "case string, cause string, effect string, verdict int")
    got = {(r["cause"], r["effect"]) for r in discover.discover(wide, ["d", "a", "c", "b"], "k", alpha=0.01, constraints=ban).collect()}
    assert not got & {("c", "d"), ("d", "c")}


def test_non_gaussian_order(wide):
    got = {(r["cause"], r["effect"]) for r in discover.discover(wide, ["d", "a", "c", "b"], "k", "lingam", alpha=0.001).collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "d")}


def test_non_gaussian_order_follows_verdicts(wide, spark):
    def found(*verdicts):
        known = spark.createDataFrame([("k", *v) for v in verdicts], "case string, cause string, effect string, verdict int")
        return {(r["cause"], r["effect"]) for r in discover.discover(wide, ["d", "a", "c", "b"], "k", "lingam", constraints=known, alpha=0.001).collect()}

    free = {("a", "c"), ("b", "c"), ("c", "d")}
    assert ("c", "d") not in found(("c", "d", 0)) and ("a", "c") in found(("c", "d", 0))
    assert found(("a", "c", 1), ("c", "a", 1)) == free  # required both ways: no verdict
    assert ("d", "c") in found(("d", "c", 1))


def test_single_parents_respect_allowed(wide, spark):
    only = spark.createDataFrame([("k", "c", "d", 1)], "case string, cause string, effect string, verdict int")
    got = discover.discover(wide, ["d", "a", "c", "b"], "k", "exact", constraints=only).collect()
    assert [(r["cause"], r["effect"]) for r in got] == [("c", "d")]


# -- channel scorer ------------------------------------------------------------------

def series(spark):
    rows = []
    for t in range(3000):
        spike = 1e6 * (1 if t == 1500 else -1) if t in (500, 1500, 2500) else 0.0
        rows.append(("x", t, 100 + math.sin(t / 7) + 0.3 * math.cos(t / 3) + spike))
        rows.append(("y", t, 20 + math.cos(t / 11) + 0.2 * math.sin(t / 5) + spike))
    return spark.createDataFrame(rows, "c string, t int, v double").repartition(5)


def test_scores_fire_repeat_and_stay_finite(spark):
    rows = series(spark)
    key = lambda df: sorted((r["c"], r["t"], r["score"]) for r in df.collect())
    both = key(spot.spot_scores(rows, ["c"], "t", "v"))
    assert both == key(spot.spot_scores(rows.repartition(3), ["c"], "t", "v"))
    assert [x for x in both if x[0] == "x"] == key(spot.spot_scores(rows.where("c = 'x'"), ["c"], "t", "v"))
    assert all(math.isfinite(s) and 0 <= s <= 1 for _, _, s in both)
    assert all(s == 0 for _, t, s in both if t < 100)
    fired = {(c, t) for c, t, s in both if s > 0}
    assert {(c, t) for c in "xy" for t in (500, 1500, 2500)} <= fired


def test_stretches_score_as_single_points():
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(size=3000) ** 3, np.cumsum(r.normal(size=3000)), np.full(300, 2.0), r.normal(size=6000)])
    values[r.integers(0, len(values), 40)] *= 50
    one, many = spot.Scorer(), spot.Scorer()
    want = [one.step(float(x)) for x in values]
    got, at = [], 0
    while at < len(values):
        n = int(r.integers(1, 5000))
        got += many.steps(values[at : at + n]).tolist()
        at += n
    assert got == want and sum(x > 0 for x in want) > 10 and one.pack() == many.pack()


def test_bad_points_are_errors(spark):
    for rows in ([("x", 1, 1.0), ("x", 1, 2.0)], [("x", 1, float("nan"))]):
        with pytest.raises(Exception, match="two points|non-finite"):
            spot.spot_scores(spark.createDataFrame(rows, "c string, t int, v double"), ["c"], "t", "v").collect()


def test_state_survives_packing():
    r = np.random.default_rng(1)
    whole, parts, out = spot.Scorer(), spot.Scorer(), []
    for i, x in enumerate(r.normal(size=2000) ** 3):
        if i % 37 == 0:
            parts = spot.Scorer().unpack(parts.pack())
        out.append((whole.step(float(x)), parts.step(float(x))))
    assert all(a == b for a, b in out) and any(a > 0 for a, _ in out)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = series(spark).where("t < 900")
    seq = F.lpad(F.col("t").cast("string"), 8, "0")
    keyed = rows.select(F.col("c").alias("channel"), seq.alias("seq"), F.col("v").alias("value"), "t")
    source = str(tmp_path / "in")
    for lo in (0, 300, 600):
        keyed.where((F.col("t") >= lo) & (F.col("t") < lo + 300)).drop("t").coalesce(1).write.mode("append").parquet(source)
        if lo == 0:
            # A late and a broken row come with a later file.
            extra = spark.createDataFrame([("x", "00000007", 1.0), ("x", "00000007x", 1.0), ("x", "00000650", float("nan"))], "channel string, seq string, value double")
    done = stream.score_stream(stream.read_stream(spark, source, files_per_batch=1))
    extra.coalesce(1).write.mode("append").parquet(source)
    got = stream.run_available(done)
    scored, aside = stream.split_quarantine(got)
    want = sorted((r["c"], f"{r['t']:08d}", r["idx"], r["score"]) for r in spot.spot_scores(rows, ["c"], "t", "v").collect())
    assert sorted((r["channel"], r["seq"], r["idx"], r["score"]) for r in scored.collect()) == want
    assert sorted((r["seq"], r["status"]) for r in aside.collect()) == [("00000007", "repeated"), ("00000007x", "late"), ("00000650", "nonfinite")]


# -- differences of graphs ------------------------------------------------------------

def test_difference_sees_turned_and_changed_edges(spark):
    def graph(*rows):
        both = [r for c, e, m in rows for r in ([(c, e, m)] if m == "->" else [(c, e, m), (e, c, m)])]
        return spark.createDataFrame([("k", *r) for r in both], "case string, cause string, effect string, mark string")

    before = graph(("a", "b", "--"), ("c", "d", "->"), ("e", "f", "->"), ("g", "h", "->"), ("i", "j", "<->"))
    after = graph(("b", "a", "->"), ("c", "d", "->"), ("f", "e", "->"), ("k", "l", "->"), ("i", "j", "<->"))
    got = edges.graph_difference(before, after).first().asDict()
    assert (got["directed_shared"], got["directed_lost"], got["directed_new"]) == (1, 2, 3)
    assert (got["shared"], got["changed"], got["only_before"], got["only_after"]) == (2, 2, 1, 1)
    assert [got[f"before_{k}"] for k in ("directed", "undirected", "bidirected")] == [3, 1, 1]
    assert [got[f"after_{k}"] for k in ("directed", "undirected", "bidirected")] == [4, 0, 1]


def test_gaps_keep_fractions_of_seconds(spark):
    rows = spark.createDataFrame([("x", 0.0), ("x", 0.25), ("x", 0.5), ("x", 2.0)], "c string, t double").select("c", F.timestamp_seconds("t").alias("ts"))
    got = profile.interval_histogram(rows, ["c"], F.unix_seconds("ts")).collect()
    assert sorted((r["seconds"], r["n"]) for r in got) == [(0.25, 2), (1.5, 1)]
