"""Hard negatives by exact products of anchor and candidate tiles, multiplied by Strassen's recursion.

Vectors become integer matrices. A tile of anchors times a tile of candidates is padded with zeros to sides that halve
evenly and multiplied by seven products of half size, level by level; all products of a level are one stacked array.
The recursion only adds, subtracts and multiplies, so int64 is exact whenever the scores themselves fit, whatever its
intermediate sums do; where a bound says that scores may not fit, the same recursion runs over integers of any size.

Two passes over the tiles keep bounded heaps. The first keeps each anchor's best rows of its own label; rows are laid
out by label, so only tiles that share a label are multiplied. With the merged positives known, each has a window of
scores, and the second pass keeps the best rows of other labels in each window. Heaps of several tasks are merged by
rank, as the best of a union are among the best of its parts.

Anchors travel in packs and candidates in blocks, both of bounded size. Each block meets each pack once, in a grid
whose cells are spread over tasks. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a pack of anchors, of a block of candidates, and of a tile of either.
PACK_ROWS, BLOCK_ROWS, TILE_ROWS = 4096, 2048, 512
#: The side up to which matrices are multiplied without further division.
LEAF = 16
#: Blocks that meet a pack in one task before their heaps are merged by a shuffle.
BLOCKS_PER_CELL = 16
_FIELDS = ("keys", "ids", "labels", "at", "items", "window_at", "windows")


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: int64 where all fit, else Python integers. ``scale`` is a power of two."""
    if not values.size or np.abs(values).max() < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, dtype=object)
    # Beyond 2^53 a double is a whole number.
    out.flat = [int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale for x in values.flat]
    return out


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.full((rows, columns), 0, dtype=a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def _quarters(a: np.ndarray) -> tuple[np.ndarray, ...]:
    m, n = a.shape[1] // 2, a.shape[2] // 2
    return a[:, :m, :n], a[:, :m, n:], a[:, m:, :n], a[:, m:, n:]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """Products of stacked matrices whose sides halve evenly ``levels`` times."""
    if not levels:
        return np.matmul(a, b)
    a11, a12, a21, a22 = _quarters(a)
    b11, b12, b21, b22 = _quarters(b)
    left = np.concatenate([a11 + a22, a21 + a22, a11, a22, a11 + a12, a21 - a11, a12 - a22])
    right = np.concatenate([b11 + b22, b11, b12 - b22, b21 - b11, b22, b11 + b12, b21 + b22])
    p1, p2, p3, p4, p5, p6, p7 = np.split(_strassen(left, right, levels - 1), 7)
    upper = np.concatenate([p1 + p4 - p5 + p7, p3 + p5], axis=2)
    lower = np.concatenate([p2 + p4, p1 - p2 + p3 + p6], axis=2)
    return np.concatenate([upper, lower], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a`` times the transpose of ``b``: exact, as int64, or held at the ends of its range.

    Where widths differ, the narrower side counts as padded with zeros.
    """
    width = max(a.shape[1], b.shape[1], 1)
    kind = np.int64
    if object in (a.dtype, b.dtype) or np.prod([float(np.abs(x).max()) if x.size else 0.0 for x in (a, b)]) * width >= 2.0**62:
        kind = object
    sides = a.shape[0], width, b.shape[0]
    levels = 0
    while min(sides) > LEAF << levels:
        levels += 1
    m, k, n = (-(-side >> levels) << levels for side in sides)
    whole = _strassen(_padded(a.astype(kind), m, k)[None], _padded(b.astype(kind), n, k).T[None], levels)
    whole = whole[0, : sides[0], : sides[2]]
    return whole if kind is np.int64 else np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Rows:
    """Some rows: keys, ids, labels, the integer matrix of their vectors, and the score windows of anchors."""

    def __init__(self, row: dict, prefix: str, scale: int):
        self.key, self.id, self.label, at, items, window_at, windows = (
            np.frombuffer(row[f"{prefix}_{x}"], np.float64 if x == "items" else np.int64) for x in _FIELDS)
        line = np.repeat(np.arange(len(self.key)), np.diff(at))
        values = np.zeros((len(self.key), int(np.diff(at).max())))
        values[line, np.arange(len(items)) - at[line]] = items
        self.vectors = integers(values, scale)
        self.windows = [windows[window_at[i] : window_at[i + 1]].tolist() for i in range(len(self.key))]

    def tiles(self) -> Iterator[slice]:
        for at in range(0, len(self.key), TILE_ROWS):
            yield slice(at, min(at + TILE_ROWS, len(self.key)))


def _packed(prefix: str, size: int):
    """Rows (row, vec_id, label, items, windows) into some at a time: fields as bytes, and the range of their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                arrays = [part.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("row", "vec_id", "label")]
                for x, kind in (("items", np.float64), ("windows", np.int64)):
                    lengths = part.column(x).value_lengths().to_numpy(zero_copy_only=False)
                    arrays.append(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
                    arrays.append(part.column(x).flatten().to_numpy(zero_copy_only=False).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in arrays]
                    + [pa.array([int(x)], pa.int64()) for x in (arrays[2].min(), arrays[2].max())],
                    [f"{prefix}_{x}" for x in (*_FIELDS, "least", "most")])

    return run


def _kind(prefix: str) -> str:
    return ", ".join([f"{prefix}_{x} binary" for x in _FIELDS] + [f"{prefix}_least long, {prefix}_most long"])


class Heap:
    """The k first rows seen so far, by (score descending, id, key)."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.empty((3, 0), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if len(score) > self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, keys = score[near], ids[near], keys[near]
        if len(score):
            rows = np.concatenate([self.rows, np.stack([score, ids, keys])], axis=1)
            self.rows = rows[:, np.lexsort((rows[2], rows[1], ~rows[0]))[: self.k]]


class Positives:
    """For each anchor its best rows of the same label."""

    def __init__(self, anchors: Rows, k: int):
        self.anchors, self.heaps = anchors, [Heap(k) for _ in anchors.key]

    def wanted(self, some: slice, block: Rows, part: slice) -> bool:
        asked, held = self.anchors.label[some], block.label[part]
        return bool(np.isin(asked, held).any())

    def add(self, some: slice, block: Rows, part: slice, scores: np.ndarray) -> None:
        label, ids, keys = block.label[part], block.id[part], block.key[part]
        for i, score in zip(range(some.start, some.stop), scores):
            same = (label == self.anchors.label[i]) & (keys != self.anchors.key[i])
            self.heaps[i].add(score[same], ids[same], keys[same])

    def found(self) -> Iterator[tuple[int, int, int, Heap]]:
        for key, own, heap in zip(self.anchors.key.tolist(), self.anchors.id.tolist(), self.heaps):
            yield key, own, 0, heap


class Negatives:
    """For each anchor and each score of a positive, the best rows of other labels in its window."""

    def __init__(self, anchors: Rows, k: int, low: int, high: int):
        self.anchors = anchors
        # The whole scores s with low * p <= 100 * s <= high * p; windows over the ends of the range are empty or held there.
        self.heaps = [[(-(-low * p // 100), high * p // 100, p, Heap(k)) for p in windows] for windows in anchors.windows]

    def wanted(self, some: slice, block: Rows, part: slice) -> bool:
        asked, held = self.anchors.label[some], block.label[part]
        return asked.min() != asked.max() or held.min() != held.max() or asked[0] != held[0]

    def add(self, some: slice, block: Rows, part: slice, scores: np.ndarray) -> None:
        label, ids, keys = block.label[part], block.id[part], block.key[part]
        for i, score in zip(range(some.start, some.stop), scores):
            other = label != self.anchors.label[i]
            for least, most, _, heap in self.heaps[i]:
                if least <= most:
                    inside = other & (score >= max(least, -(1 << 63))) & (score <= min(most, (1 << 63) - 1))
                    heap.add(score[inside], ids[inside], keys[inside])

    def found(self) -> Iterator[tuple[int, int, int, Heap]]:
        for key, own, windows in zip(self.anchors.key.tolist(), self.anchors.id.tolist(), self.heaps):
            for *_, p, heap in windows:
                yield key, own, p, heap


def _searched(scale: int, begin):
    """Cells come sorted: a pack's heaps are kept while its blocks pass by."""
    names = ["anchor", "anchor_id", "of_score", "score", "vec_id", "row"]

    def result(heaps) -> pa.RecordBatch:
        rows = [(key, own, p, *row) for key, own, p, heap in heaps.found() for row in heap.rows.T.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * len(names)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchors, heaps = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["pack"], row["part"], row["cell"]) != held:
                    if held is not None:
                        yield result(heaps)
                    held = row["pack"], row["part"], row["cell"]
                    anchors = Rows(row, "a", scale)
                    heaps = begin(anchors)
                block = Rows(row, "c", scale)
                for some in anchors.tiles():
                    for part in block.tiles():
                        if heaps.wanted(some, block, part):
                            heaps.add(some, block, part, product(anchors.vectors[some], block.vectors[part]))
        if held is not None:
            yield result(heaps)

    return run


def _packs(anchors: DataFrame) -> DataFrame:
    """Anchors in packs of similar labels; ``pack`` is dense, and a pack may have several parts."""
    few = max(1, -(-anchors.count() // PACK_ROWS))
    laid = anchors.repartitionByRange(few, "label", "vec_id", "row").sortWithinPartitions("label", "vec_id", "row")
    packed = laid.mapInArrow(_packed("a", PACK_ROWS), _kind("a"))
    return cut_lineage(packed.select("*", F.spark_partition_id().cast("long").alias("pack"), F.monotonically_increasing_id().alias("part")))


def _grid(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each pack beside its blocks, dealt to cells of bounded size and sorted by cell."""
    last = packs.agg(F.max("pack")).first()[0] or 0
    cores = int(blocks.sparkSession.sparkContext.defaultParallelism)
    cells = max(1, -(-blocks.count() // BLOCKS_PER_CELL), cores // (last + 1))
    spread = packs.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    dealt = blocks.select("*", F.expr(f"pmod(xxhash64(block), {cells})").alias("cell"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("pack")).drop("block")
    return dealt.join(spread, ["pack", "cell"])


def _merged(grid: DataFrame, scale: int, begin, k: int) -> DataFrame:
    found = grid.sortWithinPartitions("pack", "part", "cell").mapInArrow(
        _searched(scale, begin), "anchor long, anchor_id long, of_score long, score long, vec_id long, row long")
    order = Window.partitionBy("anchor", "of_score").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``vectors`` holds (vec_id, label, embedding), labels being integers; rows
    for which ``anchor`` holds are anchors. Components become
    floor(scale * x), ``scale`` a power of two. An anchor's positives are its
    ``n_positives`` first other rows of the same label; the negatives of a
    positive are the ``n_negatives`` first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite
    component, take no part. Rows are told apart, not ids: a row with the
    anchor's vec_id is another row, and repeated anchors or positives have
    results each. Vectors of different lengths meet on their common
    components; an empty vector scores 0. Components are exact at any size;
    scores beyond 64 bits are held at the ends of the range. Other columns
    are ignored. Fewer rows give fewer results; empty tables give none.
    """
    spark = vectors.sparkSession
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("items"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    ).where("vec_id is not null and label is not null and items is not null").where(
        ~F.exists("items", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = cut_lineage(whole.withColumn("row", F.monotonically_increasing_id()))
    # Blocks of few labels; a label of any size is cut by id.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast("array<long>").alias("windows")
    laid = rows.repartitionByRange(parts, "label", "vec_id", "row").sortWithinPartitions("label", "vec_id", "row")
    blocks = laid.select("row", "vec_id", "label", "items", none).mapInArrow(_packed("c", BLOCK_ROWS), _kind("c"))
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    anchors = rows.where("is_anchor").select("row", "vec_id", "label", "items")

    share = (F.col("c_least") <= F.col("a_most")) & (F.col("c_most") >= F.col("a_least"))
    grid = _grid(_packs(anchors.select("*", none)), blocks).where(share)
    positives = cut_lineage(_merged(grid, scale, lambda rows: Positives(rows, n_positives), n_positives).select(
        "anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    grid = _grid(_packs(anchors.join(windows, "row")), blocks)
    negatives = _merged(grid, scale, lambda rows: Negatives(rows, n_negatives, low, high), n_negatives).select(
        "anchor", F.col("of_score").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
