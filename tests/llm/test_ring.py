"""The ring with bounded loads against a walk over rows, one at a time."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rcaspark.llm import queries, ring

SF = "/root/testdata/sf0.001"


def walked(places, nodes, n, shards, size):
    """The shard of every row (place, row): rounds of the named walk, by plain loops over single rows."""
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    left = [(place, place, row) for place, row in places]
    out = {}
    while left:
        offers = defaultdict(list)
        for home, at, row in left:
            turns = [((p - at) % size, s, p) for p, s in nodes if room[s] > 0]
            ahead, s, p = min(turns)
            offers[s].append((p if at <= p else p + size, -at, home, row, p))
        left = []
        for s, rows in offers.items():
            rows.sort()
            for i, (_, _, home, row, p) in enumerate(rows):
                if i < room[s]:
                    out[row] = s
                else:
                    left.append((home, p, row))
            room[s] = max(0, room[s] - len(rows))
    return out


def placed(spark, ids, shards, **more):
    rows = spark.createDataFrame([(i, j) for j, i in enumerate(ids)], "doc_id long, slot long").coalesce(1)
    return [tuple(r) for r in ring.shard(rows.withColumn("j", F.col("slot")), F.col("doc_id"), shards, **more).select("doc_id", "j", "shard", "slot", "hop").collect()]


@pytest.mark.parametrize("ids", [list(range(120)), [7] * 60 + list(range(50)), [None] * 30 + [1, 2], [5], []], ids=["plain", "hot", "null", "one", "none"])
def test_ring_equals_the_walk_of_single_rows(spark, ids):
    shards, nodes, size = 5, 3, 64
    points = [tuple(r) for r in ring.ring(spark, shards, nodes, size).collect()]
    places = spark.createDataFrame([(i, j) for j, i in enumerate(ids)], "doc_id long, j long").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(size)), "j").collect()
    want = Counter((ids[row], s) for row, s in walked([tuple(r) for r in places], points, len(ids), shards, size).items())
    got = placed(spark, ids, shards, nodes=nodes, places=size)
    assert Counter((i, s) for i, _, s, _, _ in got) == want
    assert sorted(j for _, j, *_ in got) == list(range(len(ids)))
    counts = Counter(s for _, _, s, _, _ in got)
    assert max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(slot for *_, t, slot, _ in got if t == s) == list(range(counts[s]))


def test_loads_by_size_stay_within_their_room(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 97 + 1).alias("size"))
    got = ring.shard(rows, F.col("id"), 8, load=F.col("size"), slack=0.05)
    loads = {r[0]: (r[1], r[2], r[3]) for r in got.groupBy("shard").agg(F.sum("size"), F.count("*"), F.max("slot")).collect()}
    mean = sum(x[0] for x in loads.values()) / 8
    # Every cut may add less than one row.
    assert all(x[0] <= 1.05 * mean + 97 * 8 and x[2] == x[1] - 1 for x in loads.values())
    assert sum(x[1] for x in loads.values()) == 3000


def test_one_more_shard_moves_little(spark):
    rows = spark.range(20000).select("id")
    eight = ring.shard(rows, F.col("id"), 8).select("id", F.col("shard").alias("eight"))
    nine = ring.shard(rows, F.col("id"), 9).select("id", F.col("shard").alias("nine"))
    moved = eight.join(nine, "id").where("eight <> nine").count() / 20000
    # A ninth must move; dealing by remainder would move eight ninths.
    assert 1 / 9 - 0.01 <= moved < 0.25


def test_contract_columns(spark, tmp_path, odd_documents, no_documents):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_hash_ring(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == sorted((r[0] is None, r[0]) for r in odd_documents.select("doc_id").collect())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["size"] == 1 and by_id[1]["text_crc32"] == 0 and by_id[4]["size"] == 8
    assert by_id[7]["size"] == len("ünï 12 çödé 😀 text".encode()) + 1
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    no_documents.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_hash_ring(spark, f"{tmp_path}/none").count() == 0
