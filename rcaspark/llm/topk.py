"""Exact top-k search by inner product: term-at-a-time accumulation over blocks of rows.

Rows become postings: for each component (term) the rows of a block in which it is not zero, with their weights. A
query row scatters weight * weight of its own non-zero terms into one dense array of scores for the block, term by
term; partition selection takes the k best of the array, and the best of all blocks are merged.

Queries travel in packs and candidates in blocks. Each candidate block meets each pack once, in a grid whose cells
are spread over tasks; a task holds one pack, one block and the best k so far. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a candidate block and queries of a pack; scores are held for this many queries of a pack at once.
BLOCK_ROWS, PACK_QUERIES, QUERIES_AT_ONCE = 8192, 2048, 64
#: Candidate blocks that search one pack in one task before their results are merged by a shuffle.
BLOCKS_PER_CELL = 16
_FIELDS = ("keys", "ids", "at", "items")


def _packed(prefix: str, rows: int):
    """Rows (row, vec_id, items) into packs of at most ``rows``: keys, ids, row starts and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                items = part.column("items")
                lengths = items.value_lengths().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (
                        part.column("row").to_numpy(zero_copy_only=False).astype(np.int64),
                        part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64),
                        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                        items.flatten().to_numpy(zero_copy_only=False).astype(np.float64))],
                    [f"{prefix}_{x}" for x in _FIELDS])

    return run


class Block:
    """A pack of vectors; ``terms`` yields each term's rows and weights."""

    def __init__(self, keys: bytes, ids: bytes, at: bytes, items: bytes):
        self.keys, self.ids, self.at = (np.frombuffer(x, np.int64) for x in (keys, ids, at))
        items = np.frombuffer(items, np.float64)
        self.peak = float(np.abs(items).max()) if len(items) else 0.0
        # Whole numbers of any size: 64 bits where all fit.
        self.items = items.astype(np.int64) if self.peak < 2.0**62 else np.array([int(x) for x in items], dtype=object)
        lengths = np.diff(self.at)
        row = np.repeat(np.arange(len(self.ids)), lengths)
        term = np.arange(len(self.items)) - np.repeat(self.at[:-1], lengths)
        held = np.flatnonzero(items)
        held = held[np.argsort(term[held], kind="stable")]
        self.row, self.weight = row[held], self.items[held]
        self.first = np.searchsorted(term[held], np.arange((int(lengths.max()) if len(lengths) else 0) + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term + 1 >= len(self.first):
            return self.row[:0], self.weight[:0]
        span = slice(self.first[term], self.first[term + 1])
        return self.row[span], self.weight[span]

    def width(self) -> int:
        return len(self.first) - 1


def _scores(queries: Block, at: slice, block: Block) -> np.ndarray:
    """Scores of some queries against a block, one term after the other."""
    exact = queries.peak * block.peak * max(1, min(queries.width(), block.width())) < 2.0**62
    kind = np.int64 if exact else object
    ids = range(at.start, at.stop)
    total = np.zeros((len(ids), len(block.ids)), dtype=kind)
    for term in range(min(queries.width(), block.width())):
        asked, weights = queries.postings(term)
        some = slice(*np.searchsorted(asked, (at.start, at.stop)))
        rows, held = block.postings(term)
        if some.start == some.stop or not len(rows):
            continue
        added = weights[some].astype(kind)[:, None] * held.astype(kind)[None, :]
        lines = asked[some] - at.start
        if len(lines) == len(ids) and len(rows) == len(block.ids):
            total += added
        else:
            total[np.ix_(lines, rows)] += added
    if not exact:
        total = np.clip(total, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return total


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id): selection by partition, then the ties at the edge."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= edge)
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], ~score[kept]))[:k]]


def _search(k: int):
    """Cells come sorted; the best of a pack are kept while its blocks pass by."""

    def result(pack: Block, best: list):
        rows = [(int(key), int(q), *pair) for key, q, found in zip(pack.keys, pack.ids, best) for pair in zip(*(x.tolist() for x in found))]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pack, best = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["pack"], row["part"], row["cell"]) != key:
                    if pack is not None:
                        yield result(pack, best)
                    key = (row["pack"], row["part"], row["cell"])
                    pack = Block(*(row[f"q_{x}"] for x in _FIELDS))
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(pack.ids)
                block = Block(*(row[f"c_{x}"] for x in _FIELDS))
                for at in range(0, len(pack.ids), QUERIES_AT_ONCE):
                    span = slice(at, min(at + QUERIES_AT_ONCE, len(pack.ids)))
                    for i, score in zip(range(span.start, span.stop), _scores(pack, span, block)):
                        other = block.keys != pack.keys[i]
                        ids, score = block.ids[other], score[other]
                        top = _best(score, ids, k)
                        ids = np.concatenate([best[i][0], ids[top]])
                        score = np.concatenate([best[i][1], score[top]])
                        top = _best(score, ids, k)
                        best[i] = ids[top], score[top]
        if pack is not None:
            yield result(pack, best)

    return run


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(row, vec_id, items) of floor(scale * x), stored; rows with nulls, NaN or infinite components are left out.

    ``row`` tells rows apart. ``items`` are whole numbers as doubles, exact where ``scale`` is a power of two.
    """
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        "vec_id is not null and embedding is not null").where(
        ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    # Beyond 2^53 a double is a whole number already, and its floor might not fit in 64 bits.
    items = F.transform("embedding", lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return cut_lineage(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", items.alias("items")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product, exactly.

    Both tables hold (row, vec_id, items: array<double> of whole numbers of any
    size). A candidate with the query's own ``row`` does not count; another row
    with the same vec_id does. Ties go to the smaller vec_id; fewer candidates
    give fewer rows. Vectors of different lengths meet on their common terms,
    and an empty vector scores 0. Repeated queries and candidates stand each for
    themselves. Null ids or vectors take no part; other columns are ignored.
    Scores are exact; those beyond 64 bits are held at the ends of the range
    and tie there. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    asked = cut_lineage(queries.where("vec_id is not null and items is not null").select("row", "vec_id", "items"))
    total = asked.count()
    packs = max(1, -(-total // PACK_QUERIES))
    packed = asked.repartition(packs).mapInArrow(
        _packed("q", PACK_QUERIES), ", ".join(f"q_{x} binary" for x in _FIELDS))
    packed = cut_lineage(packed.select(
        "*", F.spark_partition_id().cast("long").alias("pack"), F.monotonically_increasing_id().alias("part")))
    blocks = candidates.where("vec_id is not null and items is not null").select("row", "vec_id", "items").mapInArrow(
        _packed("c", BLOCK_ROWS), ", ".join(f"c_{x} binary" for x in _FIELDS))
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    # The grid: a block goes to one cell of each pack, a pack to its cells.
    cells = max(1, -(-blocks.count() // BLOCKS_PER_CELL), int(spark.sparkContext.defaultParallelism) // packs)
    grid = blocks.select(
        "*", F.expr(f"pmod(xxhash64(block), {cells})").alias("cell"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))).alias("pack")).drop("block")
    spread = packed.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    found = (
        grid.join(spread, ["pack", "cell"]).sortWithinPartitions("pack", "part", "cell")
        .mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
