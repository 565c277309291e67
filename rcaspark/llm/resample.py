"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams, one of target texts and one of all raw texts, give every
document a log importance weight: the sum over its n-grams of the log ratio of the two. A sample without replacement
with these weights is the top k by weight plus Gumbel noise; the noise is a hash of the id, so a rerun draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import mix, utf8_rows, word_hashes

#: Hash buckets of the n-gram models.
BUCKETS = 10_000
#: Labelled documents that the target model is fitted on at most, the smallest hashes of ids first.
TARGET_ROWS = 20_000
#: N-grams that weigh as one document of the prior: keeps the weight of rare buckets near 0.
SMOOTHING = 1.0


def buckets_of(raw: np.ndarray | None) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words."""
    if raw is None:
        return np.empty(0, np.int64)
    words = word_hashes(raw)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(documents: DataFrame) -> np.ndarray:
    """N-grams by bucket over all rows of (text): a sum per task, added up by Spark; ``BUCKETS`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in utf8_rows(batch.column("text")):
                total += np.bincount(buckets_of(raw), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS)
    for bucket, n in rows.collect():
        total[bucket] = n
    return total


def _score(documents: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(log_ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        for batch in batches:
            found = []
            for raw in utf8_rows(batch.column("text")):
                grams = buckets_of(raw)
                found.append((len(grams), float(ratio[grams].sum()) if len(grams) else None))
            n, weight = list(zip(*found)) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_grams long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of ``key``."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def threshold(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest number of a column, exactly, without sorting it whole.

    Each pass counts the rows of 4,096 equal spans between two bounds and goes
    on inside the span that holds the k-th; it ends when the bounds are
    neighbouring numbers or enclose one value. None if there are fewer rows.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    above, spans = 0, 4096  # above: rows over high
    while low < high:
        width = (high - low) / spans
        if not width or low + width == low:
            middle = np.nextafter(low, high)
            width = middle - low
        edges = F.floor((F.col(column) - low) / width)
        inside = keys.where(F.col(column).between(low, high))
        rows = inside.groupBy(F.least(edges, F.lit(spans - 1)).alias("span")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        rows.sort(key=lambda r: -r["span"])
        for row in rows:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        else:
            return None
    return low


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) for every row of ``documents`` (doc_id, text).

    Target texts are those that ``labels`` (doc_id, quality) call 1, at most
    ``TARGET_ROWS`` of them; raw texts are all rows. kept marks a sample of
    round(share * rows) rows without replacement; without a given ``share``
    it is the labels' own share of good texts. Null and wordless texts have no weight and are
    not drawn. Keys that tie at the edge are kept together. Repeated rows have
    equal keys and are drawn together; a null doc_id is a key of its own.
    Conflicting labels of one document count as bad. Without good labels all
    weights are 0. Other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select("doc_id", "text")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good, total = known.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    if share is None:
        share = (good or 0) / total if total else 1.0
    chosen = known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    target = _counts(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))  # at most TARGET_ROWS ids
    raw = _counts(docs)
    if target.sum():
        mean = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
        drawn = (target + SMOOTHING * BUCKETS * mean) / (target.sum() + SMOOTHING * BUCKETS)
        ratio = np.log(drawn) - np.log(mean)
    else:
        ratio = np.zeros(BUCKETS)
    scored = cut_lineage(_score(docs, ratio).withColumn(
        "gumbel_key", F.col("log_weight") + gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)))
    drawable = scored.where("gumbel_key is not null")
    rows = scored.count()
    k = min(int(share * rows + 0.5), drawable.count())
    edge = threshold(drawable, "gumbel_key", k)
    kept = F.lit(False) if edge is None else F.coalesce(F.col("gumbel_key") >= F.lit(edge), F.lit(False))
    return scored.withColumn("kept", kept)
