"""Strassen's products and mined negatives against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rcaspark.llm import negatives

KIND = "vec_id long, label int, embedding array<double>, row string, score int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 64, 33), (130, 70, 40), (3, 200, 90), (64, 64, 64)])
def test_product_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = (rng.integers(-(1 << 20), 1 << 20, (shape[i], shape[1])) for i in (0, 2))
    assert (negatives.product(a, b) == a.astype(object) @ b.astype(object).T).all()


def test_product_of_large_components():
    rng = np.random.default_rng(1)
    a = np.array([[1 << 40, -(1 << 40), 3]] * 20, dtype=np.int64)
    b = np.concatenate([np.array([[1 << 40, 1 << 40, 5]] * 20, dtype=np.int64), rng.integers(-9, 9, (20, 3))])
    got = negatives.product(a, b)
    assert (got == np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1)).all() and got[0, 0] == 15
    assert negatives.integers(np.array([[1e30, -0.3, 2.0**60]]), 256).tolist() == [[int(1e30) * 256, -77, 1 << 68]]
    assert negatives.product(np.array([[2]]), np.array([[3, 4]])).tolist() == [[6]]


def brute(rows):
    held = []
    for i, (v, label, x, *_) in enumerate(rows):
        if None in (v, label, x) or not all(c is not None and math.isfinite(c) for c in x):
            continue
        held.append((i, v, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for i, v, label, x in held:
        if v % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), w, j, other) for j, w, other, y in held if j != i]
        for s, w, _, _ in sorted(t for t in scores if t[3] == label)[:5]:
            inside = sorted(t for t in scores if t[3] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)[:5]
            out += [(v, w, r + 1, n[1], -s, -n[0]) for r, n in enumerate(inside)]
    return Counter(out)


def mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = spark.createDataFrame(rows, KIND).withColumn("label", label)
    return Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 100 == 0).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(negatives, "PACK_ROWS", 4)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "TILE_ROWS", 20)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 9]), [rng.choice([0.5, 1.0, 1.25, -0.5, 2.0, 0.3]) for _ in range(40)], "x", 1) for i in range(700)]
    rows += [rng.choice(rows) for _ in range(100)] + [rows[100], rows[300]]
    rows += [(None, 1, [1.0], "x", 1), (800, None, [1.0], "x", 1), (900, 1, None, "x", 1), (1000, 0, [1.0, None], "x", 1),
             (1100, 0, [float("nan")], "x", 1), (1200, 0, [float("-inf")], "x", 1), (1300, 0, [], "x", None), (1400, 2, [3.0], None, 1)]
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows) == want


def test_negatives_of_large_vectors(spark):
    big = 2.0**30
    rows = [(100, 1, [big, big, 1.0], "x", 1), (1, 1, [big + 9, -big, 1.0], "x", 1), (2, 2, [big + 8, -big, 0.0], "x", 1), (3, 2, [big, -big, 1.0], "x", 1)]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_few_and_no_rows(spark):
    assert not mined(spark, [(0, 1, [1.0], "x", 1)])
    assert not mined(spark, [(0, 1, [1.0], "x", 1), (1, 2, [1.0], "x", 1)])
    assert not mined(spark, [(3, 1, [1.0], "x", 1)])
    assert not mined(spark, [])
