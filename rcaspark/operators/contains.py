"""Exact substring join between texts and patterns, without comparing every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rcaspark.session import cut_lineage

#: Bits of the filter for each gram of a pattern, and the least and most bits in all (the most are 16 MB in each task).
BITS_PER_GRAM, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` characters, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ points[i : i + n]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _places(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each gram in a filter whose size is a power of two."""
    mask = np.uint64(bits - 1)
    return [grams & mask, (grams >> np.uint64(32)) & mask]


def _grams_of_patterns(gram: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["_p"]:
                # A pattern shorter than a gram is its own gram.
                grams = np.unique(_hashes(p, min(len(p), gram)))
                yield pd.DataFrame({"_p": p, "_g": grams.view(np.int64), "_places": list(np.stack(_places(grams, bits), axis=1).astype(np.int64))})

    return run


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of a table of grams, built by partial bitmaps; its size depends on ``bits`` alone."""
    place = grams.select(F.explode("_places").alias("_place")).select((F.col("_place") + 1).alias("_at"))
    parts = place.groupBy(F.expr("bitmap_bucket_number(_at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        # Buckets are numbered from 1, and each has 4096 bytes of places.
        held = np.frombuffer(row["bitmap"], np.uint8)
        first = (row["bucket"] - 1) * 4096
        out[first : first + len(held)] = held
    return out


def _held(texts: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    keep = np.ones(len(texts), bool)
    for at in _places(texts, bits):
        keep &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return texts[keep]


def _hits(text: str, name: str, sizes: list[int], bitmap: np.ndarray, bits: int):
    """Adds the distinct grams of each whole text that the filter lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.unique(np.concatenate([_held(_hashes(t, s), bitmap, bits) for s in sizes])).view(np.int64) if t else [] for t in pdf[text]]
            yield pdf.assign(**{name: found})[[len(f) > 0 for f in found]]

    return run


def contains_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, gram: int = 8) -> DataFrame:
    """(text columns without the text, pattern) for every pattern found in a text.

    Texts are matched whole; their other columns must identify them. Texts and
    patterns meet on the hash of the rarest short gram of each pattern, and what
    meets is verified. Before anything of a text is shuffled, a Bloom filter of
    the patterns' grams drops the grams that no pattern has; it is of bounded
    size, and with more patterns than it serves well only more is shuffled.
    Null and empty texts and patterns meet nothing.
    """
    distinct = cut_lineage(patterns.select(F.col(pattern).cast("string").alias("_p")).where("length(_p) > 0").distinct())
    sizes = [r[0] for r in distinct.select(F.least(F.length("_p"), F.lit(gram))).distinct().collect()]  # at most ``gram`` numbers
    if not sizes:
        none = T.StructType([*[f for f in texts.schema.fields if f.name != text], T.StructField(pattern, T.StringType())])
        return texts.sparkSession.createDataFrame([], none)
    total = distinct.agg(F.sum(F.length("_p"))).first()[0]
    bits = min(max(1 << (int(total) * BITS_PER_GRAM - 1).bit_length(), LEAST_BITS), MOST_BITS)
    grams = cut_lineage(distinct.mapInPandas(_grams_of_patterns(gram, bits), "_p string, _g long, _places array<long>"))
    kept = T.StructType([*texts.schema.fields, T.StructField("_hits", T.ArrayType(T.LongType()))])
    bitmap = _filter(grams, bits)
    # How many texts have each gram of a pattern; a gram that no text has rules its pattern out.
    often = texts.mapInPandas(_hits(text, "_hits", sizes, bitmap, bits), kept).select(F.explode("_hits").alias("_g")).groupBy("_g").agg(F.count("*").alias("_n"))
    anchor = cut_lineage(grams.join(often, "_g", "left").groupBy("_p").agg(
        F.min_by(F.struct("_g", "_places"), F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_a"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"),
    ).where("_n > 0").select("_p", "_a.*"))
    near = _filter(anchor, bits)
    found = texts.mapInPandas(_hits(text, "_hits", sizes, near, bits), kept).withColumn("_g", F.explode("_hits")).drop("_hits")
    return (
        found.join(anchor.select("_p", "_g"), "_g").where(F.contains(F.col(text), F.col("_p")))
        .select(*[c for c in texts.columns if c != text], F.col("_p").alias(pattern)))
