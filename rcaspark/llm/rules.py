"""Quality rules by weak supervision.

Each rule reads a text's statistics and votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns estimates, without labels, how often good and bad texts get each vote; the posterior of a pattern is the
quality probability of its texts. A rule that is often wrong so loses its say, where an all-must-pass filter would
let it decide alone. Patterns are bounded by 3^rules, so what reaches the driver does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import gram_hashes, span_hashes, utf8_rows, word_bounds

# The characters that count as symbols.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[i for i in range(256) if i >= 128 or chr(i).isalpha()]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
              "n_digits", "n_stops", "n_distinct_words", "n_letter_words"]


def statistics(raw: np.ndarray | None) -> list[int]:
    """The numbers in ``STATISTICS`` for one text's UTF-8 bytes; all 0 for null."""
    if raw is None:
        return [0] * len(STATISTICS)
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return [0, 0, int(SYMBOLS[raw].sum())] + [0] * (len(STATISTICS) - 3)
    words = span_hashes(raw, starts, ends)
    begins_char = (raw & 0xC0) != 0x80
    running = np.concatenate([[0], np.cumsum(begins_char)])
    lettered = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    word_chars = int((running[ends] - running[starts]).sum())

    breaks = np.flatnonzero(raw == 10)
    line_start, line_end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    spoken = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    lines = span_hashes(raw, line_start[spoken], line_end[spoken])
    repeated_lines = len(lines) - len(np.unique(lines))

    grams = gram_hashes(words, 3)
    marked = np.zeros(n + 1, np.int64)
    if len(grams):
        _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[which] > 1)
        np.add.at(marked, twice, 1)
        np.add.at(marked, twice + 3, -1)
    return [n, word_chars, int(SYMBOLS[raw].sum()), repeated_lines, int((np.cumsum(marked)[:n] > 0).sum()), len(lines),
            int((_LETTER[raw] & begins_char).sum()), int(_UPPER[raw].sum()), int(_DIGIT[raw].sum()),
            int(_STOP[raw].sum()), len(np.unique(words)), int((np.diff(lettered[np.stack([starts, ends])], axis=0) > 0).sum())]


def text_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) with ``STATISTICS`` of the whole text; other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(raw) for raw in utf8_rows(batch.column("text"))]
            columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in columns)], ["doc_id", *STATISTICS])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{x} long" for x in STATISTICS)]))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""

    def rule(good: str, bad: str) -> Column:
        return F.expr(f"case when n_words = 0 then -1 when {bad} then -1 when {good} then 1 else 0 end").cast("int")

    return {
        "length": rule("n_words >= 80", "n_words < 20"),
        "word_length": rule("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
        "symbols": rule("n_symbols = 0", "20 * n_symbols > n_words"),
        "lettered_words": rule("20 * n_letter_words > 19 * n_words", "10 * n_letter_words < 8 * n_words"),
        "repeated_lines": rule("n_dup_lines = 0 and n_lines > 1", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
        "repeated_words": rule("20 * n_repeat_words < n_words", "10 * n_repeat_words > 3 * n_words"),
        "letters": rule("10 * n_letters > 9 * word_chars", "4 * n_letters < 3 * word_chars"),
        "upper_case": rule("10 * n_upper < n_letters", "3 * n_upper > n_letters"),
        "digits": rule("20 * n_digits < word_chars", "5 * n_digits > word_chars"),
        "sentences": rule("n_stops > 0 and n_words < 60 * n_stops", "n_words > 50 and n_words < 2 * n_stops"),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> np.ndarray:
    """Quality probability of each vote pattern, by expectation-maximisation.

    ``patterns`` holds a row per pattern and a column per rule. Every rule has,
    for either class, its chances to vote good, to vote bad and to abstain; so
    accuracy and coverage are both estimated. The start takes a text with bad
    votes for bad with odds that grow with their number. Pseudo-counts of
    ``strength`` rows per class say that bad votes are rarer among good texts,
    so that the classes cannot change sides.
    """
    if not len(patterns):
        return np.empty(0)
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)  # patterns x rules x votes
    belief = np.array([[0.01, 0.19, 0.8], [0.2, 0.3, 0.5]])  # good, bad: shares of votes -1, 0, 1
    good = np.select([(patterns < 0).sum(1) == i for i in (0, 1)], [0.98, 0.3], 0.05)
    for _ in range(rounds):
        weight = np.stack([good, 1 - good]) * counts
        share = (weight.sum(1) + strength / 2) / (weight.sum() + strength)
        chance = np.einsum("cp,prv->crv", weight, one_hot) + strength * belief[:, None, :]
        chance /= chance.sum(-1, keepdims=True)
        log = np.log(share)[:, None] + np.einsum("prv,crv->cp", one_hot, np.log(chance))
        new = np.exp(log[0] - np.logaddexp.reduce(log, 0))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good


def quality(documents: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Statistics, base verdict, quality probability and verdict for every row of ``documents`` (doc_id, text).

    base_failed: under 50 words, or more than half of the words stand in
    three-word windows that recur. kept: the base holds and the posterior is
    at least ``at_least``. Null and wordless texts have zero statistics and
    fail. Repeated rows each count; other columns are ignored; an empty table
    gives no rows.
    """
    rules = votes()
    stats = text_statistics(documents)
    voted = stats.select("*", *(v.alias(f"vote_{name}") for name, v in rules.items()))
    names = [f"vote_{name}" for name in rules]
    seen = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3^rules rows
    seen.sort(key=lambda r: tuple(r[:-1]))
    patterns = np.array([r[:-1] for r in seen], dtype=int).reshape(len(seen), len(names))
    posterior = fit(patterns, np.array([r[-1] for r in seen], dtype=float))
    spark = documents.sparkSession
    held = spark.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, posterior)], ", ".join([*(f"{x} int" for x in names), "quality double"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(held), names, "left")  # at most 3^rules rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("quality", F.lit(0.0)) >= at_least))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    )
