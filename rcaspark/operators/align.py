"""Exact alignment of channels on shared timestamps.

A channel table is long: (case, entity, metric, ts, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_timestamps(channels: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Timestamps present in every metric of a case: one aggregation, not N joins."""
    axis = channels.select("case", "metric", "ts").distinct()
    if metrics is not None:
        axis = axis.where(F.col("metric").isin(list(metrics)))
        wanted = axis.select("case").distinct().withColumn("_want", F.lit(len(set(metrics))))
    else:
        wanted = axis.groupBy("case").agg(F.count_distinct("metric").alias("_want"))
    have = axis.groupBy("case", "ts").agg(F.count("*").alias("_have"))
    return have.join(wanted, "case").where("_have = _want").select("case", "ts")


def align(channels: DataFrame, common: DataFrame) -> DataFrame:
    """Only the rows on the common timestamps."""
    return channels.join(common, ["case", "ts"], "left_semi")


def dropped_rows(channels: DataFrame, common: DataFrame) -> DataFrame:
    """Timestamps of each metric that alignment removes."""
    return channels.select("case", "metric", "ts").distinct().join(common, ["case", "ts"], "left_anti")


def kpi_conflicts(kpi: DataFrame) -> DataFrame:
    """Timestamps at which the KPI differs between metrics; empty when the panel is sound."""
    return (
        kpi.groupBy("case", "ts")
        .agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
        .where("lowest <> highest")
    )


def metric_coverage(channels: DataFrame) -> DataFrame:
    """Metrics each entity has and lacks, of all the metrics of its case."""
    have = channels.select("case", "entity", "metric").distinct()
    by_entity = have.groupBy("case", "entity").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
    by_case = have.select("case", "metric").distinct().groupBy("case").agg(
        F.array_sort(F.collect_set("metric")).alias("_all"))
    return by_entity.join(by_case, "case").select(
        "case", "entity", "metrics", F.array_except("_all", "metrics").alias("missing"))


def channel_stats(channels: DataFrame, keys: Sequence[str] = ("case", "entity", "metric")) -> DataFrame:
    """Mean, population deviation, count, extremes and the exact constancy test."""
    return channels.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("n"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    ).withColumn("constant", F.col("lowest") == F.col("highest"))


def zscore(channels: DataFrame, keys: Sequence[str] = ("case", "entity", "metric")) -> DataFrame:
    """z of every value by population deviation; constant channels are left out.

    Statistics are aggregated and joined back, so that no window holds a channel.
    """
    stats = channel_stats(channels, keys).where("not constant").select(*keys, "mean", "std")
    return channels.join(stats, list(keys)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def fuse(scored: DataFrame) -> DataFrame:
    """Equal mean of an entity's channel z values at each timestamp."""
    return scored.groupBy("case", "entity", "ts").agg(F.avg("z").alias("fused"))


def entity_decisions(channels: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Per entity: usable channels, weight of each, absent metrics, kept or not and why.

    ``alerts`` may give (case, entity, metric, positives); without it every
    entity with a usable channel is kept.
    """
    stats = channel_stats(channels)
    if alerts is None:
        stats = stats.withColumn("positives", F.lit(1).cast("bigint"))
    else:
        stats = stats.join(alerts.select("case", "entity", "metric", "positives"), ["case", "entity", "metric"], "left")
    use = stats.groupBy("case", "entity").agg(
        F.count_if(~F.col("constant")).alias("usable"),
        F.bool_or(~F.col("constant") & (F.coalesce("positives", F.lit(0)) > 0)).alias("kept"),
    )
    return use.join(metric_coverage(channels), ["case", "entity"]).select(
        "case", "entity", "usable", "kept",
        F.when(F.col("usable") == 0, "all_constant").when(F.col("kept"), "kept").otherwise("no_alert").alias("reason"),
        F.when(F.col("usable") > 0, F.lit(1.0) / F.col("usable")).alias("weight"),
        "missing",
    )


def correlate(fused: DataFrame, kpi: DataFrame) -> DataFrame:
    """Correlation of each entity's fused channel with the KPI of its case."""
    both = fused.join(kpi.select("case", "ts", F.col("value").alias("kpi")), ["case", "ts"])
    return both.groupBy("case", "entity").agg(F.corr("fused", "kpi").alias("r"), F.count("*").alias("n"))


def keep_entities(channels: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Channels of the listed entities only; their columns, ``pos`` included, stay as they are."""
    return channels.join(shortlist.select("case", "entity").distinct(), ["case", "entity"], "left_semi")


def time_block(ts: Column, seconds: int = 3600 * 6) -> Column:
    """A block number that grows with a date or timestamp."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds))
