"""Language identification with error-correcting output codes.

Every language has a binary codeword. For each bit a binary classifier over letter n-grams says on which side a
text's language stands: its output is the mean log odds of the text's n-grams between the languages of either side,
whose distributions are counted over all training rows. Decoding adds up, for each codeword, the loss of every bit's
output, weighted by how well the bit is told apart in training, and takes the nearest word; if the second is nearly
as close, the text is flagged as ambiguous.

Up to seven languages use the exhaustive code, more a random one whose words lie far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, utf8_rows

#: Hash buckets of letter n-grams, and the lengths in bytes of the n-grams.
BUCKETS, GRAMS = 1 << 14, (1, 2, 3, 4)
#: Languages that are learned at most, the most frequent first: what the model's size grows with.
MOST_LANGUAGES = 512
#: Nearest codewords whose scores differ by less leave a text ambiguous.
AMBIGUOUS = 0.02
SMOOTHING = 0.5
# Bytes of ASCII that are no letters separate words.
_TABLE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:])


def gram_counts(text: str) -> np.ndarray:
    """Counts of a text's n-grams by bucket; digits and ASCII marks count as blanks."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_TABLE) + b" ", np.uint8).astype(np.uint64)
    counts = np.zeros(BUCKETS)
    blank = raw == 32
    for n in GRAMS:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, np.uint64)
        empty = np.ones(len(code), bool)
        for i in range(n):
            code = code * np.uint64(256) + raw[i : i + len(code)]
            empty &= blank[i : i + len(code)]
        bucket = (mix(code) >> np.uint64(40)) % np.uint64(BUCKETS)
        counts += np.bincount(bucket[~empty].astype(np.int64), minlength=BUCKETS)
    return counts


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per language: the exhaustive code, or the best spread of some random codes."""
    if languages <= 7:
        masks = np.arange(1, 1 << max(1, languages - 1))[:, None]
        bits = (masks >> np.arange(languages)) & 1
        return np.where(bits, -1.0, 1.0).T[:, : max(1, len(masks))]
    rng, width = np.random.default_rng(seed), int(np.ceil(15 * np.log2(languages)))
    tries = [np.where(rng.random((languages, width)) < 0.5, -1.0, 1.0) for _ in range(50)]
    tries = [t for t in tries if (np.abs(t.sum(0)) < languages).all()] or tries

    def closest(t):
        same = t @ t.T
        np.fill_diagonal(same, -width)
        return same.max()

    return min(tries, key=closest)


class Model:
    """Codewords, a row of n-gram weights per bit, and the weight of each bit's loss."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
        sides = [(share[bit > 0].mean(0), share[bit < 0].mean(0)) for bit in self.code.T if (bit > 0).any() and (bit < 0).any()]
        kept = [i for i, bit in enumerate(self.code.T) if (bit > 0).any() and (bit < 0).any()]
        self.code = self.code[:, kept]
        self.weights = np.array([np.log(a) - np.log(b) for a, b in sides]).reshape(len(kept), counts.shape[1])
        # How far a language's own texts stand from the border, on average: the scale and the weight of a bit.
        margin = np.array([(share @ w) for w in self.weights]).reshape(len(kept), len(names)).T * self.code
        self.scale = np.maximum(margin.mean(0), 1e-6) if len(kept) else np.empty(0)
        reliable = np.maximum(margin.min(0), 0) / self.scale if len(kept) else np.empty(0)
        self.bit_weight = (reliable + 0.1) / (reliable + 0.1).sum() if len(kept) else reliable

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, whether it is ambiguous."""
        if not self.names:
            return "und", 0.0, True
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        output = (self.weights @ counts) / max(1.0, counts.sum()) / self.scale
        loss = np.logaddexp(0, -4 * self.code * output) @ self.bit_weight
        closeness = np.exp(-4 * (loss - loss.min()))
        score = closeness / closeness.sum()
        order = np.argsort(-score, kind="stable")
        gap = score[order[0]] - score[order[1]]
        return self.names[order[0]], float(min(1.0, score[order[0]])), bool(gap < AMBIGUOUS)


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(labelled: DataFrame) -> Model:
    """A model from all rows of ``labelled`` (text, lang) that have both.

    Each task sends one row of counts per language and batch; what reaches the
    driver is one row per language, at most ``MOST_LANGUAGES`` by frequency
    (ties by name). No rows give a model that answers ``und``.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    names = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = gram_counts(text)
                held[lang] = held[lang] + found if lang in held else found
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([x.astype(np.int64).tobytes() for x in held.values()], pa.binary())],
                ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(raw, np.int64)
                held[lang] = held[lang] + found if lang in held else found
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["lang", "counts"])

    shape = "lang string, counts binary"
    partial = rows.join(names.select("lang"), "lang", "left_semi").mapInArrow(count, shape)
    # Two levels: tasks' sums meet in some tasks, and theirs in one per language.
    some = partial.repartition(8, F.col("lang"), F.expr("pmod(xxhash64(counts), 8)")).mapInArrow(add, shape)
    whole = some.repartition(8, "lang").mapInArrow(add, shape).collect()
    whole = sorted((r.lang, np.frombuffer(bytes(r.counts), np.int64).astype(float)) for r in whole) if whole else []
    return Model([x for x, _ in whole], np.array([c for _, c in whole]).reshape(len(whole), BUCKETS))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred, score and ambiguous, read from the text alone.

    A null text or one without a letter is ``und`` with score 0. Every row is
    predicted from its whole text; other columns stay, but for ones with these
    three names, which are replaced. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rest = documents.drop("lang_pred", "score", "ambiguous")
    columns = rest.columns
    held = spark.sparkContext.broadcast(model)  # bits x buckets, at most 135 x 16384 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = list(columns), held.value
        place = names.index("text")
        for batch in batches:
            found = []
            for text in batch.column(place).to_pylist():
                found.append(model.decode(gram_counts(text)) if text and has_letter(text) else ("und", 0.0, False))
            lang, score, ambiguous = list(zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                [*names, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*rest.schema.fields]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rest.mapInArrow(run, schema)


def identify(documents: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``documents`` with held_out, lang_pred, score and ambiguous.

    Learns from the rows whose fold is not ``held_out`` and predicts all. A
    null doc_id has no fold: it is not learned from and not held out.
    """
    part = fold(F.col("doc_id"), folds)
    model = learn(documents.where(part != held_out))
    return predict(documents.drop("held_out").withColumn("held_out", F.coalesce(part == held_out, F.lit(False))), model)
