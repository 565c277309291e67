"""Exact top-k and the n-gram Jaccard join against brute force."""

import glob
import math
import random
import re
import time

import pytest

from rcaspark.llm import bloom, ngram_join, topk
from rcaspark.llm.graph import components
from rcaspark.session import cut_lineage

from .conftest import SF


def brute_top_k(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(vectors):
        if q % 100 == 0:
            held = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for j, (i, w) in enumerate(vectors) if j != at]
            scores = sorted((-s, i) for s, i in held)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run_top_k(spark, rows, k):
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return sorted(tuple(r) for r in topk.top_k(table.where("vec_id % 100 = 0"), table, k).collect())


def test_top_k_is_exact_with_sparse_rows_and_ties(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, 0.25, -0.5, rng.randint(-8, 8) / 8]) for _ in range(6)], 1) for i in range(450)]
    rows += [(7, None, 1), (9, [1.0, None], 1), (None, [1.0], 1), (800, [float("nan")], 1), (900, [], 1), (1000, [float("inf")], 1)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "PACK_QUERIES", 3)
    want = brute_top_k([(i, v) for i, v, _ in rows], 10)
    assert run_top_k(spark, rows, 10) == want


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(0, [3e6], 1), (1, [1.0], 1), (2, [4e6], 1), (100, [2.0**30, 2.0**30], 1), (5, [2.0**33, 3.0 - 2.0**33], 1), (5, [2.0**33, -(2.0**33)], 1),
            (100, [2.0**30, 2.0**30], 1), (100, [-7.25], 1), (0, [3e6], 1)]
    assert run_top_k(spark, rows, 8) == brute_top_k([(i, v) for i, v, _ in rows], 8)
    assert run_top_k(spark, rows[:3], 10) == [(0, 1, 2, (1 << 63) - 1), (0, 2, 1, 3145728000000)]


def test_top_k_ignores_clashing_columns(spark):
    table = topk.quantised(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    more = table.selectExpr("*", "'x' as score", "1 as rank", "2 as query_id", "3 as q_ids", "4 as pack", "5 as cell")
    assert [tuple(r) for r in topk.top_k(more.where("vec_id = 0"), more, 3).collect()] == [(0, 1, 1, 2 << 20)]


def test_top_k_with_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [3.0], 1)]
    assert run_top_k(spark, rows, 10) == [(0, 1, 1, 3 * 1024 * 1024)]
    assert run_top_k(spark, rows[:1], 10) == []
    assert run_top_k(spark, [(1, [1.0], 0)], 10) == []


def test_top_k_holds_large_sums(spark):
    rows = [(0, [3e30, 3e30, 3e30], 1), (5, [3e30, 3e30, 3e30], 1), (6, [-1.0, 0.0, 0.0], 1)]
    got = run_top_k(spark, rows, 10)
    assert [r[2] for r in got] == [5, 6] and got[0][3] == (1 << 63) - 1


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_groups(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return sorted(((i, len(x), top(i)) for i, x in sets), key=str)


def groups(documents, n, num, den):
    return sorted((tuple(r) for r in ngram_join.jaccard_groups(documents, n, num, den).collect()), key=str)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_groups_match_brute_force(spark, monkeypatch, n, num):
    monkeypatch.setattr(ngram_join, "CELL_DOCS", 3)
    monkeypatch.setattr(ngram_join, "WIDE_CELL_DOCS", 4)
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(40)]
    rows, doc = [], 0
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 160))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 3, 14])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new"], [f"n{rng.randint(0, 9)}", "x"]])
            rows.append((doc, " ".join(words)))
            doc += 3
    rows += [(1, None), (2, ""), (4, "a b"), (5, "A  b"), (7, "a"), (8, " \n ")]
    rng.shuffle(rows)
    got = groups(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100)
    want = brute_groups(rows, n, num, 100)
    assert len({c for _, _, c in want}) < len(want)
    assert got == want


def test_groups_on_odd_and_empty_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert groups(odd_documents, 3, 90, 100) == brute_groups(rows, 3, 90, 100)
    assert groups(no_documents, 3, 90, 100) == []


def test_texts_that_share_an_id_are_one_document(spark):
    one, two = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, one), (5, one), (5, two), (9, two)]
    assert {r[2] for r in groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)} == {1}


def test_search_probes_long_lists(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: rng.integers(40, 60)], rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(80)]
    lists = ngram_join.Lists(sets)
    for x in sets:
        want = [i for i, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
        assert lists.search(x, 80, 100).tolist() == want
        assert [ngram_join.Lists([y]).search(x, 80, 100).tolist() == [0] for y in sets] == [i in want for i in range(len(sets))]


def test_components_of_a_path_a_hub_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 600)] + [(499, 555)]
    edges = spark.createDataFrame(path + hub + [(7, 7), (8, 9), (9, 8)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 499 for i in range(499, 600)}, 8: 8, 9: 8}
    assert components(edges.where("false")).count() == 0


def test_a_filter_of_numbers_keeps_all_that_are_asked_for(spark, monkeypatch):
    rows = spark.range(-20_000, 20_000).selectExpr("if(id % 1000 = 7, null, id) as doc", "cast(id as string) as text")
    asked = spark.range(-300, 300, 3).select("id")
    for most in (bloom.MOST_BITS, 1 << 15):
        monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 15)
        monkeypatch.setattr(bloom, "MOST_BITS", most)
        sent = spark.sparkContext.broadcast(bloom.number_filter(asked))
        kept = {r.doc for r in ngram_join._asked(rows, "doc", sent).collect()}
        assert set(range(-300, 300, 3)) <= kept
        assert None not in kept and len(kept) < 300
    assert not bloom.number_filter(asked.where("false")).any()


def test_groups_leave_no_sets_and_no_shuffles_on_disk(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut_lineage(spark.range(1))
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:").rstrip("/").rsplit("/", 1)[0]
    tables = lambda: set(glob.glob(f"{root}/**/cut-*", recursive=True))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle_" in files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size()))
    before, held = tables(), shuffles()
    found = cut_lineage(ngram_join.jaccard_groups(documents, 5, 80, 100))
    assert found.count() == documents.count()
    left = tables() - before
    assert len(left) > 20 and not [p for p in left if "items" in spark.read.parquet(p).columns]
    for _ in range(50):  # files go in the background
        if shuffles() <= held + 30:
            break
        time.sleep(0.2)
    assert shuffles() <= held + 30
