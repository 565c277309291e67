"""Runs against the definition, checked on every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rcaspark.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            size = end - at + q
            if size >= max(least, times * q):
                part = words[at : at + size]
                if all(any(part[k] != part[k + d] for k in range(size - d)) for d in range(1, q)):
                    out.append((at, size, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """The contract's row, by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{size},{q}\n" for s, size, q in found), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def searched(docs):
    codes, starts = runs._numbered([[str(w).encode() for w in words] for words in docs])
    out = [[] for _ in docs]
    for start, size, period in runs.find_runs(codes):
        doc = int(np.searchsorted(starts, start, side="right")) - 1
        out[doc].append((start - int(starts[doc]), size, period))
    return out


def test_runs_equal_the_definition():
    rng = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 45), rng.randint(1, 4)
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                words = [words[i] if i < a + p else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        assert searched(docs) == [brute(words) for words in docs]


def test_nested_and_overlapping_runs():
    inner = ["a"] * 6 + ["b"]
    assert searched([inner * 5]) == [brute(inner * 5)]
    assert len(searched([["x", "y"] * 4 + ["x"] * 9])[0]) == 2


@pytest.mark.parametrize("words", [["a"] * 60000, [i % 9000 for i in range(60000)], [0, 1, 1] * 20000])
def test_long_texts(words):
    assert len(searched([words])[0]) >= 1


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_row(*r) for r in rows)
    assert sum(r[1] for r in want) > 5
    assert sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()) == want


def test_odd_documents(spark, tmp_path, odd_documents, no_documents):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    short = [r for r in odd_documents.select("doc_id", "text").collect() if r[0] != 6]
    assert [r for r in got if r[0] != 6] == sorted((brute_row(*r) for r in short), key=str)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 30000, 1, 30000000)]
    no_documents.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_own_limits_and_texts(spark):
    rows = spark.createDataFrame([(1, "to be to be to be or not"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.collapse(rows, least=4, times=3).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 6, 2)] and got[1]["collapsed"] == "to be or not"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""
