"""Distributed order against plain windows, with one key holding a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rcaspark.operators import contains, logs, order, profile
from rcaspark.operators.contains import contains_join
from rcaspark.streaming.spot import moving_deviation


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{r.randrange(40)}", i, r.randrange(50) / 10) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, pos bigint, v double").repartition(7).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_full_rank_equals_row_number(skewed):
    got = order.full_rank(skewed, ["k"], [F.desc("v"), F.col("pos")]).select("k", "pos", "rank")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "pos")
    assert rows(got) == rows(skewed.select("k", "pos", F.row_number().over(w).cast("bigint")))


def test_full_rank_without_keys(skewed):
    got = order.full_rank(skewed, [], [F.col("pos")]).select("pos", "rank")
    assert rows(got) == [(i, i + 1) for i in range(6000)]


def test_previous_crosses_blocks(skewed):
    got = order.with_previous(skewed, ["k"], "pos", F.expr("pos div 37")).select("k", "pos", "previous")
    w = Window.partitionBy("k").orderBy("pos")
    assert rows(got.fillna(-1)) == rows(skewed.select("k", "pos", F.lag("pos").over(w).alias("previous")).fillna(-1))


def test_dense_code(skewed):
    got = order.dense_code(skewed, ["k"], "v").select("k", "pos", "code")
    w = Window.partitionBy("k").orderBy("v")
    assert rows(got) == rows(skewed.select("k", "pos", (F.dense_rank().over(w) - 1).cast("bigint")))


def test_strided_sample_against_brute_force(spark, skewed):
    lines = skewed.select(F.lit("c").alias("case"), F.lit("e").alias("entity"), F.col("k").alias("event_id"), F.col("v").cast("string").alias("time"), F.col("v").cast("string").alias("content"), "pos")
    firsts = lines.groupBy("case", "entity", "event_id").agg(F.count("*").alias("occurrence"))
    got = logs.strided_sample(lines, firsts, n=10, block=97).select("event_id", "pos", "sample")
    by_event = {}
    for k, pos in sorted((r["k"], r["pos"]) for r in skewed.collect()):
        by_event.setdefault(k, []).append(pos)
    want = [(k, p, i + 1) for k, ps in by_event.items() for i, p in enumerate(ps[::max(1, len(ps) // 10)][:10])]
    assert rows(got) == sorted(want)


def test_stride_follows_the_template_not_the_lines(spark):
    lines = spark.createDataFrame([("c", "e", "E1", str(i), f"x{i}", i) for i in range(21)], "case string, entity string, event_id string, time string, content string, pos bigint")
    firsts = lambda n: spark.createDataFrame([("c", "e", "E1", "t", n)], "case string, entity string, event_id string, template string, occurrence bigint")
    kept = lambda n: [r["pos"] for r in logs.strided_sample(lines, firsts(n)).orderBy("pos").collect()]
    assert kept(21) == list(range(0, 20, 2))
    assert kept(5) == list(range(10))
    assert kept(100) == [0, 10, 20]


def test_moving_deviation_does_not_depend_on_blocks(skewed):
    got = [rows(moving_deviation(skewed, ["k"], ["pos"], "v", depth=10, block=b).select("k", "pos", F.round("deviation", 9))
                .fillna(-99)) for b in (11, 1000, 10**6)]
    assert got[0] == got[1] == got[2]


def test_content_digest_sees_order_and_blocks(spark):
    a = spark.range(1000).withColumn("t", F.col("id").cast("string"))
    digest = lambda df, fan: profile.content_digest(df, "id", F.col("t"), fan).first()[0]
    swapped = a.withColumn("t", F.when(F.col("id") == 3, "4").when(F.col("id") == 4, "3").otherwise(F.col("t")))
    assert digest(a, 10) == digest(a.repartition(5), 10)
    assert digest(a, 10) != digest(swapped, 10)


def test_contains_join_equals_every_pair(spark, monkeypatch):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    texts = [(i, word(r.randrange(5, 400))) for i in range(60)] + [(60, None), (61, ""), (62, "ein grüßchen 😀 für alle"), (63, "aaaaaaaa" * 3000)]
    patterns = list({word(r.randrange(1, 14)) for _ in range(80)} | {texts[0][1][3:40], "ü", "zz", "grüßchen 😀", "😀"})
    t = spark.createDataFrame(texts, "i int, text string").repartition(4)
    p = spark.createDataFrame([(x,) for x in [*patterns, "", None, patterns[0]]], "pattern string")
    want = sorted((i, x) for i, s in texts for x in patterns if s and x in s)
    assert rows(contains_join(t, "text", p, "pattern")) == want
    # With a filter that is far too small it only costs more.
    monkeypatch.setattr(contains, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(contains, "BITS_PER_GRAM", 1)
    assert rows(contains_join(t, "text", p, "pattern", gram=3)) == want
    assert rows(contains_join(t, "text", p.where("false"), "pattern")) == rows(contains_join(t.where("false"), "text", p, "pattern")) == []
