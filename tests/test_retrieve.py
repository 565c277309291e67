"""Exact nearest vectors against plain numpy, within groups, at large norms and of several lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rcaspark.functions.vectors import letter_embedding
from rcaspark.operators import generate, retrieve
from rcaspark.operators.profile import GateError
from rcaspark.plans import refine


def brute(queries, vectors, k):
    """[(group, query, vector, rank)] by the definition."""
    out = []
    for g, q, x in queries:
        if None in (g, q, x):
            continue
        near = sorted((round(float(((np.array(x) - np.array(v)) ** 2).sum()), 9), i) for h, i, v in vectors
                      if h == g and i is not None and v is not None and len(v) == len(x) and None not in v)
        out += [(g, q, i, r + 1) for r, (_, i) in enumerate(near[:k])]
    return sorted(out)


KIND = "g string, {} int, embedding array<double>"


def found(spark, queries, vectors, k, **more):
    near = retrieve.nearest(spark.createDataFrame(queries, KIND.format("query_id")), spark.createDataFrame(vectors, KIND.format("vec_id")).repartition(5), k, by=["g"], **more)
    return sorted((r["g"], r["query_id"], r["vec_id"], r["rank"]) for r in near.collect())


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_nearest_within_groups(spark, monkeypatch, scale):
    rng = np.random.default_rng(2)
    group = lambda i: "hot" if i % 3 else f"g{i % 30}"
    vectors = [(group(i), i, [float(x) for x in scale + rng.integers(-4, 5, 6)]) for i in range(900)]
    queries = [(group(i), i, [float(x) for x in scale + rng.integers(-4, 5, 6)]) for i in range(120)]
    vectors += [("hot", 5000, [1.0, 2.0]), ("hot", 5001, None), (None, 5002, [scale] * 6), ("hot", None, [scale] * 6), ("hot", 5003, [None] * 6), ("lone", 5004, [scale] * 6)]
    queries += [("hot", 7000, [1.0, 2.5]), ("nowhere", 7001, [scale] * 6), (None, 7002, [scale] * 6), ("lone", 7003, [scale] * 6), ("lone", 7004, [scale])]
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 64)
    assert found(spark, queries, vectors, 4, block=16) == brute(queries, vectors, 4)


def test_nearest_of_nothing(spark):
    one = [("a", 1, [1.0])]
    assert found(spark, [], one, 3) == found(spark, one, [], 3) == []


def test_large_norms_lose_no_neighbour(spark):
    rng = np.random.default_rng(0)
    vectors = [("g", i, [float(x) for x in 1e5 + rng.normal(size=64)]) for i in range(600)]
    queries = [("g", i, [float(x) for x in 1e5 + rng.normal(size=64)]) for i in range(60)]
    assert found(spark, queries, vectors, 5) == brute(queries, vectors, 5)


def test_summaries_of_several_cases_see_their_own_texts_only(spark):
    texts = spark.createDataFrame([(c, f"pod-{i}", f"{c} writes line {i} " * 40) for c in ("one", "two") for i in range(4)], "case string, entity string, text string")
    nodes = texts.select("case", "entity", F.substring("entity", 5, 9).cast("int").alias("pos"))

    def writer():
        def ask(prompt, system, temperature):
            names = prompt.split("Nodes: ")[1].split("\n")[0].split(", ")
            own = "one" if "one writes" in prompt else "two"
            assert not ("one writes" in prompt and "two writes" in prompt)
            return f"Dataset Summary: {own}" + "".join(f"\n---\nSummary of the {n}: part of {own}" for n in names), "stop"
        return ask

    got = refine.dataset_summary(texts, nodes, writer, k=3).collect()
    assert {(r["case"], r["dataset"], r["body"]) for r in got} == {(c, c, f"part of {c}") for c in ("one", "two")} and len(got) == 8
    with pytest.raises(GateError):
        refine.dataset_summary(texts, nodes, generate.echo_client, embed=letter_embedding)
