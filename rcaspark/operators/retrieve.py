"""Chunks, embeddings, exact nearest chunks and context text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rcaspark.functions.vectors import doubles
from rcaspark.operators.order import first_per_group
from rcaspark.session import cut_lineage

QUERY_BLOCK, VECTOR_BLOCK = 256, 1024  # queries of a pack and vectors of a block
BLOCKS_PER_CELL = 4  # blocks, and packs, that meet in one task
DIGITS = 9  # distances equal to this many digits are ties
TIE = 2e-9

Embed = Callable[[Column], Column]


def chunk_table(docs: DataFrame, text: str, keys: Sequence[str], chunks: Column) -> DataFrame:
    """(keys, chunk, text) of non-empty chunks."""
    return docs.select(*keys, F.posexplode(chunks).alias("chunk", text)).where(F.trim(F.col(text)) != "")


def embed(rows: DataFrame, text: str, fn: Embed) -> DataFrame:
    """Adds ``embedding`` by a pluggable column function: SQL, or a pandas UDF around a model."""
    return rows.withColumn("embedding", fn(F.col(text)))


def _packed(rows: int):
    """Rows (keys, id, array of doubles), sorted by keys, as blocks of at most ``rows`` with the same keys: ids, and numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, ids, items = batch.columns
            turns = np.zeros(batch.num_rows, bool)
            for key in keys:
                turns[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            for first, last in zip([0, *np.flatnonzero(turns)], [*np.flatnonzero(turns), batch.num_rows]):
                for at in range(int(first), int(last), rows):
                    n = min(rows, int(last) - at)
                    numbers = items.slice(at, n).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    held = ids.slice(at, n)
                    yield pa.RecordBatch.from_arrays(
                        [*(key.slice(at, 1) for key in keys), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held), pa.array([numbers.tobytes()], pa.binary())],
                        [*batch.schema.names[:-2], "ids", "items"])

    return run


def _blocks(rows: DataFrame, by: Sequence[str], name: str, embedding: str, size: int, prefix: str) -> DataFrame:
    """(by, dim, ids, items, block): the rows in blocks whose vectors have one length and, with ``by``, one group."""
    kinds = dict(rows.dtypes)
    whole = rows.select(*by, name, doubles(F.col(embedding)).alias("_items")).dropna()
    whole = whole.where(~F.exists("_items", lambda x: x.isNull())).select(*by, F.size("_items").alias("dim"), name, "_items")
    if by:
        # A group lies in as few blocks as it fills; a large one is cut by id.
        whole = whole.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "dim", name)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    packed = whole.sortWithinPartitions(*by, "dim").mapInArrow(_packed(size), f"{kept}{', ' if by else ''}dim int, ids array<{kinds[name]}>, items binary")
    packed = packed.withColumnsRenamed({"ids": f"{prefix}_ids", "items": f"{prefix}_items"})
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def _meet(k: int, by: Sequence[str], query_id: str, vector_id: str):
    """The k nearest of a block of vectors, ties at the edge included, for each query of a pack.

    The short form of the distance is off by a multiple of the norms' rounding;
    what may be among the k by it is worked out exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, held = (batch.column(c)[row].values for c in ("q_ids", "v_ids"))
                dim = batch.column("dim")[row].as_py()
                q, v = (np.frombuffer(batch.column(c)[row].as_py(), "<f8").reshape(len(n), dim) for c, n in (("q_items", asked), ("v_items", held)))
                qq, vv = (q * q).sum(1), (v * v).sum(1)
                d = qq[:, None] - 2 * q @ v.T + vv[None, :]
                off = 4 * (dim + 2) * np.finfo(float).eps * (qq + vv.max())
                edge = np.partition(d, min(k, len(held)) - 1, axis=1)[:, min(k, len(held)) - 1]
                i, j = np.nonzero(d <= (edge + 2 * off + TIE)[:, None])
                exact = ((q[i] - v[j]) ** 2).sum(1)
                keys = [pa.array([batch.column(c)[row].as_py()] * len(i), batch.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, asked.take(pa.array(i)), held.take(pa.array(j)), pa.array(exact)], [*by, query_id, vector_id, "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", block: int = QUERY_BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest vectors of each query by squared L2 distance, ties by id: exact.

    With ``by``, a query's candidates are the vectors of its own group only.
    Both tables are read once and cut into blocks. Blocks of vectors meet packs
    of queries of the same group in one join; both are dealt to cells of
    bounded size, so a large group is many tasks' work. A block sends on the
    best k of each query with their distances, to ``DIGITS`` digits. A vector
    of another length than the query's is no candidate. Rows without an id, a
    group or a vector, or with a null in it, take no part.
    """
    by = list(by)
    keys = [*by, "dim"]
    asked = _blocks(queries, by, query_id, "embedding", block, "q")
    held = _blocks(vectors, by, vector_id, "embedding", VECTOR_BLOCK, "v")
    cells = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCKS_PER_CELL).alias(name))
    sizes = cells(asked, "packs").join(cells(held, "cells"), keys)
    # Blocks get the counts of their group by their own number: joined by group, a large group's blocks would be one task's.
    counted = lambda rows: rows.join(rows.select(*keys, "block").join(sizes, keys).select("block", "packs", "cells"), "block")
    own = lambda n: F.pmod(F.xxhash64("block"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spread = counted(asked).withColumn("pack", own("packs")).withColumn("cell", every("cells")).drop("block", "packs", "cells")
    grid = counted(held).withColumn("cell", own("cells")).withColumn("pack", every("packs")).drop("block", "packs", "cells")
    kinds = dict(queries.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"`{query_id}` {kinds[query_id]}, `{vector_id}` {dict(vectors.dtypes)[vector_id]}, distance double"
    found = grid.join(spread, [*keys, "pack", "cell"]).select(*keys, "q_ids", "q_items", "v_ids", "v_items").mapInArrow(_meet(k, by, query_id, vector_id), schema)
    found = found.withColumn("distance", F.round("distance", DIGITS))
    return first_per_group(found, [*by, query_id], [F.col("distance"), F.col(vector_id)], k)


def rearranged_index(rows: DataFrame, keys: Sequence[str], item: str, pos: str, name: str = "shown") -> DataFrame:
    """Dense number of each item in order of first appearance; groups are the k rows of one query."""
    first = F.min(pos).over(Window.partitionBy(*keys, item))
    return rows.withColumn("_first", first).withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")


def render_context(rows: DataFrame, keys: Sequence[str], url: str = "url", text: str = "text", pos: str = "rank") -> DataFrame:
    """The retrieved chunks of a query as one text, as many as there are."""
    numbered = rearranged_index(rows, keys, url, pos)
    piece = F.format_string("Webpage[%d], url: %s:\n%s\n\n\n", F.col("shown"), F.col(url), F.col(text))
    return numbered.groupBy(*keys).agg(F.concat(F.lit("\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(pos, piece.alias("piece")))), lambda x: x["piece"]), "")).alias("context"))


def restore_order(hits: DataFrame, contents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every hit in its place with its content, empty where none was kept."""
    return hits.join(contents.select(*keys, "url", "content"), [*keys, "url"], "left").withColumn("content", F.coalesce("content", F.lit("")))
