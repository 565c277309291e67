"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell: source, language and topic. Raking scales the cells to one set of target marginals after
the other until all hold. The weights are scaled to a budget of tokens; a cell's scaled weight over its tokens is its
rate, the copies that a document is expected to have. A rate's whole part are copies, the rest is drawn, so a small
cell with a high rate repeats its documents and does not shrink the others. Cells may be many, so raking runs on the
cell table in Spark.

Topics are vocabulary topics: every word of four letters or more votes for one of ``TOPICS`` topics by its hash, and
the topic with most votes wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .words import LOWER, span_hashes, utf8_rows, word_bounds

TOPICS = 8
MARGINS = ("source", "lang", "topic")
#: Default targets: each margin's own shares to this power, made to sum to 1.
TEMPERATURE = 0.5
ROUNDS, TOLERANCE = 20, 1e-3
#: Without a given budget: what can be drawn without a repeated document, but at least this share of the input's tokens.
LEAST_SHARE = 0.2


def _topic(raw: np.ndarray | None) -> tuple[int, int]:
    """Words of a text, and its topic; topic 0 without a long word."""
    if raw is None:
        return 0, 0
    low = LOWER[raw]
    starts, ends = word_bounds(low)
    long = ends - starts >= 4
    votes = np.bincount((span_hashes(low, starts[long], ends[long]) % np.uint64(TOPICS)).astype(np.int64), minlength=TOPICS)
    return len(starts), int(votes.argmax())


def with_topics(documents: DataFrame) -> DataFrame:
    """``documents`` with n_tokens (words) and topic; columns of these names are replaced, texts may be null."""
    rest = documents.drop("n_tokens", "topic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_topic(raw) for raw in utf8_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())],
                [*batch.schema.names, "n_tokens", "topic"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields]).add("n_tokens", "long").add("topic", "long"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def target_shares(cells: DataFrame, temperature: float = TEMPERATURE) -> dict[str, DataFrame]:
    """(value, share) for each margin: its shares of tokens, flattened by ``temperature``."""
    targets = {}
    for name in MARGINS:
        own = cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), temperature).alias("share"))
        total = own.agg(F.sum("share")).first()[0]
        targets[name] = own.withColumn("share", F.col("share") / F.lit(total or 1.0))
    return targets


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight, whose margins are the targets' shares.

    A value without a target, or one with a target of 0, gets weight 0; the
    others share what is left. Null values are values of their own. Stops when
    no margin was off by more than ``tolerance`` in a round, or after ``rounds``.
    """
    held = cut_lineage(cells.withColumn("weight", F.col("tokens").cast("double")))
    goals = {name: cut_lineage(goal.select(F.col("value").alias("_value"), "share")) for name, goal in targets.items()}
    for _ in range(rounds):
        step = held.withColumn("_off", F.lit(0.0))
        for name, goal in goals.items():
            sums = held if name == next(iter(goals)) else step
            sums = sums.groupBy(F.col(name).alias("_value")).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(goal.withColumnRenamed("_value", "_goal"), F.col("_value").eqNullSafe(F.col("_goal")), "left").select(
                "_value", F.when(F.col("_sum") > 0, F.coalesce("share", F.lit(0.0)) / F.col("_sum")).otherwise(0.0).alias("_factor"))
            step = step.join(factor, _same(name, "_value")).select(
                *cells.columns, (F.col("weight") * F.col("_factor")).alias("weight"),
                F.greatest("_off", F.when(F.col("weight") > 0, F.abs(F.col("_factor") - 1)).otherwise(0.0)).alias("_off"))
        before, held = held, cut_lineage(step)
        off = held.agg(F.max("_off")).first()[0]
        held = held.drop("_off")
        if off is None or off <= tolerance:
            break
    return held


def rates(
    documents: DataFrame, targets: Mapping[str, DataFrame] | None = None, budget: float | None = None, share: float | None = None,
) -> DataFrame:
    """(source, lang, topic, tokens, weight, rate) for each cell of ``with_topics`` documents.

    The rates draw ``budget`` tokens in expectation, in the targets' shares, or
    ``share`` of the tokens that there are. Without either the largest rate is 1, unless that draws less than
    ``LEAST_SHARE`` of the tokens; then they are the budget.
    """
    cells = cut_lineage(documents.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    raked = rake(cells, targets or target_shares(cells))
    each = F.col("weight") / F.col("tokens")
    largest, weight, tokens = raked.agg(F.max(each), F.sum("weight"), F.sum("tokens")).first()
    if not largest:
        return raked.withColumn("rate", F.lit(0.0))
    unrepeated = weight / largest
    if budget is None and share is not None:
        budget = share * tokens
    scale = max(1.0, LEAST_SHARE * tokens / unrepeated) if budget is None else budget / unrepeated
    return raked.withColumn("rate", each / F.lit(largest) * F.lit(float(scale)))


def mix(
    documents: DataFrame, targets: Mapping[str, DataFrame] | None = None, seed: int = 5, budget: float | None = None, share: float | None = None,
) -> DataFrame:
    """``with_topics`` documents with weight, rate, copies, probability and kept; a row each, ``repeated`` gives the sample.

    copies is the rate's whole part, and one more if a hash of doc_id is below
    its rest; kept says that there are any, and probability is the chance of it.
    ``budget`` is the sample's tokens, ``share`` those in the input's, see ``rates``. A document without words
    has no tokens to weigh: its rate is 1 if its cell's is unknown. Repeated
    rows are drawn together, as the draw is a hash of the id; a null id is one
    id. Columns named as the results are replaced, others stay; an empty table gives no rows.
    """
    clash = [c for c in ("weight", "rate", "copies", "probability", "kept", "_cell", "_source", "_lang", "_topic") if c in documents.columns]
    documents = documents.drop(*clash)
    cells = cut_lineage(rates(documents, targets, budget, share).select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), "weight", "rate"))
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 52)).cast("double") / float(1 << 52)
    same = _same("source", "_source") & _same("lang", "_lang") & _same("topic", "_topic")
    return (
        documents.join(cells, same, "left").drop("_source", "_lang", "_topic")
        .withColumn("rate", F.coalesce("rate", F.lit(1.0)))
        .withColumn("copies", F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("long"))
        .withColumn("probability", F.least("rate", F.lit(1.0)))
        .withColumn("kept", F.col("copies") > 0))


def repeated(mixed: DataFrame) -> DataFrame:
    """The sample: each row of ``mix`` as often as its copies say."""
    return mixed.where("kept").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy")
