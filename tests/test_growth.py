"""What shows on larger or evener tables only: results against the SQL, and shares of the work of one task."""

import re
import types

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rcaspark.functions import text
from rcaspark.operators import edges, retrieve
from rcaspark.streaming import spot, stream
from tools.check import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def matches(spark, tmp_path):
    """Whether a query equals its SQL over the given tables."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        return compare(spark, con, entry_points.queries()[name], entry_points.oracle_sql()[name], str(tmp_path))

    return check


@pytest.mark.parametrize("name", ["ag32_content_digest", "ag32_whole_content_digest"])
@pytest.mark.parametrize("n", [0, 500, 513, 600_000])
def test_digest_of_few_and_of_many_events(spark, matches, name, n):
    # 600,000 rows are three blocks of 512 x 512.
    events = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 1000 / 8).alias("value"))
    ok, note = matches(name, events=events)
    assert ok, note


@pytest.mark.parametrize("first,last", [(300, 800), (-700_000, 600_000), (5_000_000, 5_000_700)])
def test_digest_of_events_that_do_not_start_at_zero(spark, matches, first, last):
    ok, note = matches("ag32_content_digest", events=spark.range(first, last).select(F.col("id").alias("event_id"), F.lit(1.5).alias("value")))
    assert ok, note


def test_digest_sees_every_block_of_events(spark, tmp_path):
    def digest(changed):
        events = spark.range(800_000).select(F.col("id").alias("event_id"), F.when(F.col("id") == changed, 2.5).otherwise(1.5).alias("value"))
        events.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        return entry_points.queries()["ag32_content_digest"](spark, str(tmp_path)).first().digest

    # Four blocks of 512 x 512 rows: a row of any of them counts.
    assert len({digest(x) for x in (-1, 0, 262_144, 524_288, 799_999)}) == 5


def even_trade(spark, per_pair):
    """Tables in which every pair of three nations trades ``per_pair(supplier, customer)`` lines."""
    pairs = [(s, c) for s in range(3) for c in range(3) for _ in range(per_pair(s, c))]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "nation": make([(i, f"N{i}") for i in range(3)], "n_nationkey int, n_name string"),
        "supplier": make([(i, i) for i in range(3)], "s_suppkey long, s_nationkey int"),
        "customer": make([(i, i) for i in range(3)], "c_custkey long, c_nationkey int"),
        "orders": make([(c, c) for c in range(3)], "o_orderkey long, o_custkey long"),
        "lineitem": make([(c, s, 1.0) for s, c in pairs], "l_orderkey long, l_suppkey long, l_quantity double"),
    }


@pytest.mark.parametrize("per_pair", [lambda s, c: 40 + (s < c), lambda s, c: 40, lambda s, c: 40 + 20 * (s != c), lambda s, c: 0], ids=["even", "equal", "wide", "none"])
def test_verdicts_that_are_all_unknown_are_a_row_of_zeros(spark, matches, per_pair):
    ok, note = matches("jn20_verdicts_against_edges", **even_trade(spark, per_pair))
    assert ok, note


def test_every_case_gets_its_counts(spark):
    v = spark.createDataFrame([("a", "x", "y", None), ("b", "x", "y", 1), ("b", "y", "x", 1)], "case string, cause string, effect string, verdict int")
    e = spark.createDataFrame([("b", "x", "y", "->"), ("c", "x", "y", "->")], "case string, cause string, effect string, mark string")
    assert sorted(tuple(r) for r in edges.verdicts_against_edges(v, e).collect()) == [("a", 0, 0, 0, 0), ("b", 1, 1, 0, 1), ("c", 0, 0, 0, 0)]


# -- channel scorer --------------------------------------------------------------


def test_a_channel_is_read_frame_by_frame():
    held, taken = {}, []
    scorer = stream.ChannelScorer()
    scorer.state = types.SimpleNamespace(exists=lambda: bool(held), get=lambda: held["s"], update=lambda s: held.update(s=s))
    value = np.sin(np.arange(900) / 7)

    def frames():
        for at in range(0, 900, 100):
            taken.append(at)
            yield pd.DataFrame({"seq": [f"{i:05d}" for i in range(at, at + 100)], "value": value[at : at + 100]})

    out = []
    for pdf in scorer.handleInputRows(("x",), frames(), None):
        out.append(pdf)
        assert len(taken) == len(out)
    got = pd.concat(out)
    assert got["idx"].tolist() == list(range(900)) and got["score"].tolist() == spot.Scorer().steps(value).tolist() and held["s"][-2] == "00899"


def test_frames_of_a_micro_batch_come_in_order(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("channel"), F.lpad(F.col("id").cast("string"), 6, "0").alias("seq"), F.sin(F.col("id") / 7).alias("value"))
    rows.orderBy(F.xxhash64("seq")).repartition(4).write.parquet(f"{tmp_path}/in")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        got = stream.run_available(stream.score_stream(stream.read_stream(spark, f"{tmp_path}/in"))).collect()
    finally:
        spark.conf.set(key, usual)
    want = spot.spot_scores(rows, ["channel"], "seq", "value").collect()
    assert {r["status"] for r in got} == {"scored"}
    assert sorted((r["channel"], r["seq"], r["idx"], r["score"]) for r in got) == sorted((r["channel"], r["seq"], r["idx"], r["score"]) for r in want)


# -- nearest vectors ---------------------------------------------------------------


def test_a_large_group_is_not_dealt_by_its_key(spark):
    vectors = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 + 0.5, F.col("id") % 11 + 0.5).alias("embedding"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = retrieve.nearest(vectors.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), vectors, 8)
        plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    dealt = [by for columns, by in re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", plan) if "_items" in columns]
    assert dealt and all("block" in by or "cell" in by for by in dealt), dealt


def test_sections_with_few_labels_are_many_tasks_work(spark):
    rows = spark.range(4000).select("id", F.lit("all---first on a---then on b---").alias("answer"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = text.sections_by_position(rows, "answer", ["id"], spark.createDataFrame([(0, "a"), (1, "x")], "pos int, label string"))
        shares = [(r["task"], r["n"], r["m"]) for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if("mentions").alias("m")).collect()]
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert sum(n for _, n, _ in shares) == 8000 and sum(m for *_, m in shares) == 4000
    assert len(shares) >= 6 and max(n for _, n, _ in shares) < 3000
