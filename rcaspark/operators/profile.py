"""Column profiles, sampling intervals, consistency digests and quality gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rcaspark.operators.order import with_previous


class GateError(ValueError):
    """A named rule has violating rows."""


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def column_profile(channels: DataFrame, keys: Sequence[str] = ("case", "entity", "metric")) -> DataFrame:
    """Rows, non-finite values and constancy of each channel in one pass."""
    ok = finite(F.col("value"))
    good = F.when(ok, F.col("value"))
    return channels.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~ok).alias("nonfinite"),
        F.coalesce(F.min(good) == F.max(good), F.lit(False)).alias("constant"),
    )


def interval_histogram(times: DataFrame, keys: Sequence[str], block: Column, order: str = "ts") -> DataFrame:
    """How often each gap between neighbouring timestamps occurs; seconds, with their fractions."""
    gaps = with_previous(times, keys, order, block).where("previous is not null")
    seconds = (F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 1_000_000
    return gaps.select(*keys, seconds.alias("seconds")).groupBy(*keys, "seconds").agg(F.count("*").alias("n"))


def order_check(rows: DataFrame, keys: Sequence[str], ts: str, pos: str, block: Column) -> DataFrame:
    """Per group, whether ``ts`` strictly grows along ``pos``; ``block`` grows with ``pos``.

    The whole previous (pos, ts) pair is carried, so that a step down between
    two blocks is seen as well.
    """
    pair = rows.withColumn("_pair", F.struct(F.col(pos), F.col(ts)))
    seen = with_previous(pair, keys, "_pair", block, "_before")
    return seen.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.bool_and(F.col(ts) > F.col(f"_before.{ts}")), F.lit(True)).alias("increasing"),
        F.count_if(F.col(ts) <= F.col(f"_before.{ts}")).alias("steps_back"),
    )


def set_digest(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """An order-free digest of the distinct values of each group, by partial aggregation."""
    distinct = rows.select(*keys, value.alias("_v")).distinct()
    h = F.xxhash64("_v")
    return distinct.groupBy(*keys).agg(
        F.struct(
            F.count("*").alias("n"),
            F.bit_xor(h).alias("mix"),
            F.sum(h.cast("decimal(38,0)")).alias("total"),
            F.min("_v").alias("lowest"),
            F.max("_v").alias("highest"),
        ).alias("digest")
    )


def cross_metric_consistency(channels: DataFrame, kpi: DataFrame) -> DataFrame:
    """Per case: do the metrics share time axis, KPI series and entity set; common and all entities.

    Axes and entity lists are sets in a fixed order, so equal digests mean equal sequences.
    """
    def same(rows: DataFrame, value: Column, name: str) -> DataFrame:
        d = set_digest(rows, ["case", "metric"], value)
        return d.groupBy("case").agg((F.count_distinct("digest") == 1).alias(name))

    axis = same(channels, F.col("ts").cast("string"), "same_time_axis")
    entities = same(channels, F.col("entity"), "same_entities")
    series = same(kpi, F.concat_ws("|", F.col("ts").cast("string"), F.col("value").cast("string")), "same_kpi")
    have = channels.select("case", "entity", "metric").distinct()
    n_metrics = have.groupBy("case").agg(F.count_distinct("metric").alias("_m"))
    share = (
        have.groupBy("case", "entity").agg(F.count("*").alias("_k")).join(n_metrics, "case")
        .groupBy("case").agg(F.count("*").alias("union_entities"), F.count_if(F.col("_k") == F.col("_m")).alias("common_entities"))
    )
    return axis.join(entities, "case").join(series, "case").join(share, "case")


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it, from one pass over ``df``."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select("n_rows", F.inline(pairs))


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Raise when a rule is broken; returns ``df``."""
    broken = [r for r in check_rules(df, rules).collect() if r["violations"]]
    if broken:
        raise GateError("; ".join(f"{r['rule']}: {r['violations']} rows" for r in broken))
    return df


def observed(df: DataFrame, rules: Mapping[str, Column], name: str = "rules") -> tuple[DataFrame, Observation]:
    """The same counts gathered while ``df`` is written, without a pass of their own."""
    watch = Observation(name)
    return df.observe(watch, *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()]), watch


def _digest_rows(rows: DataFrame, pos: str, text: Column) -> DataFrame:
    return rows.select(F.col(pos).cast("bigint").alias("_pos"), F.sha2(text, 256).alias("_h"))


def _digest_blocks(level: DataFrame, fan: int) -> DataFrame:
    """The next level: a digest over each block of ``fan`` digests; rows without one count for nothing."""
    return level.where("_h is not null").groupBy(F.expr(f"_pos div {fan}").alias("_pos")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("_h"))


def content_digest(rows: DataFrame, pos: str, text: Column, fan: int = 4096) -> DataFrame:
    """SHA-256 over the rows in the order of ``pos``, as a tree of blocks of ``fan`` rows.

    ``pos`` must be 0, 1, 2, ... A block is bounded by ``fan``; each level is ``fan`` times shorter.
    """
    level = _digest_rows(rows, pos, text)
    longest = rows.agg(F.max(pos)).first()[0] or 0
    while True:
        level = _digest_blocks(level, fan)
        longest //= fan
        if longest == 0:
            return level.select(F.col("_h").alias("digest"))


def block_digests(rows: DataFrame, pos: str, text: Column, fan: int, levels: int) -> DataFrame:
    """(pos, digest) of every block of ``fan ** levels`` rows of the same tree."""
    level = _digest_rows(rows, pos, text)
    for _ in range(levels):
        level = _digest_blocks(level, fan)
    return level.select(F.col("_pos").alias("pos"), F.col("_h").alias("digest"))


def joined_digest(rows: DataFrame, pos: str, text: Column, fan: int, levels: int) -> DataFrame:
    """One digest over all rows with a text: the same tree, ``levels`` levels up and on until one block is left.

    Positions may have gaps and start anywhere; without rows the digest is null.
    """
    at = F.col(pos).cast("bigint")
    ends = rows.where(text.isNotNull()).agg(F.min(at), F.max(at)).first()
    # Toward zero, as ``div``; blocks grow with positions, so one is left where the first and the last row meet.
    low, high = ((abs(x or 0) // fan**levels) * (-1 if (x or 0) < 0 else 1) for x in ends)
    while low != high:
        levels += 1
        low, high = (abs(x) // fan * (-1 if x < 0 else 1) for x in (low, high))
    return block_digests(rows, pos, text, fan, levels).agg(F.min("digest").alias("digest"))
