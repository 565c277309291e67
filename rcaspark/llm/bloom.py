"""Bloom filters of numbers: rows that no one asks for are dropped where they are read, before a join shuffles them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_released
from .words import mix

#: Bits of a filter for each number, and the least and most bits in all (the most are 16 MB in each task).
BITS_PER_NUMBER, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


def _places(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each number in a filter whose size is a power of two."""
    spread = mix(numbers.view(np.uint64))
    mask = np.uint64(bits - 1)
    return [spread & mask, (spread >> np.uint64(32)) & mask]


def number_filter(numbers: DataFrame) -> np.ndarray:
    """The filter of a table of one long column without nulls, built by partial bitmaps.

    Its size is bounded; with more numbers than it serves well, it only lets more through.
    """
    bits = min(max(1 << (numbers.count() * BITS_PER_NUMBER).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], ["at"])

    with shuffles_released(numbers.sparkSession):
        parts = numbers.mapInArrow(run, "at long").groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    # Buckets are numbered from 1, and each has 4096 bytes of places.
    for bucket, bitmap in zip(parts.column("bucket").to_pylist(), parts.column("bitmap").to_pylist()):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, np.uint8)
    return out


def kept(batch: pa.RecordBatch, column: str, bitmap: np.ndarray) -> pa.RecordBatch:
    """The rows whose number is in the filter, and a few others; a null goes."""
    held = batch.filter(batch.column(column).is_valid())
    numbers = held.column(column).to_numpy()
    keep = np.ones(len(numbers), bool)
    for at in _places(numbers, len(bitmap) * 8):
        keep &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held.filter(pa.array(keep))
