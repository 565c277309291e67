"""Metric panels and wide tables to the long channel table, and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rcaspark.operators.profile import finite
from rcaspark.session import cut_lineage

KPI_COLUMN = "Latency"  # fixed value: name of the KPI column in wide tables


def panel_rules() -> dict:
    """Named rules a panel row must meet."""
    width = F.size("pods") + 1
    return {
        "rows_match_time": F.size("seq") == F.size("time"),
        "row_width": F.forall("seq", lambda row: F.size(row) == width),
        "unique_pods": F.size(F.array_distinct("pods")) == F.size("pods"),
        "finite_values": F.forall("seq", lambda row: F.forall(row, finite)),
        "increasing_time": F.forall(
            F.sequence(F.lit(1), F.greatest(F.size("time") - 1, F.lit(1))),
            lambda i: (F.size("time") < 2) | (F.get("time", i) > F.get("time", i - 1))),
    }


def panel_to_long(panel: DataFrame) -> DataFrame:
    """Nested panel rows (case, metric, pods, time, seq) to one row per value.

    The last value of each vector is the KPI. A metric may come in several panel
    rows, each with its own stretch of time, so that no row grows without bound.
    """
    steps = panel.select("case", "metric", "pods", F.inline(F.arrays_zip("time", "seq")))
    values = steps.select("case", "metric", "pods", F.col("time").alias("ts"), F.posexplode("seq").alias("pos", "value"))
    return values.select(
        "case", "metric", "ts", "pos", "value",
        (F.col("pos") == F.size("pods")).alias("is_kpi"),
        F.coalesce(F.get("pods", F.col("pos")), F.lit(KPI_COLUMN)).alias("entity"),
    )


def read_wide(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """A wide CSV of doubles to (file, row, entity, pos, is_kpi, value); the last column is the KPI.

    The rows of a wide table are in time order: ``row`` grows with the lines of
    a file, and part files follow by name. It orders, but is no dense number.
    """
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in header])
    wide = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    # A split is read in order by one task, and splits follow by where they start.
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    cells = F.array(*[
        F.struct(F.lit(c).alias("entity"), F.lit(i).alias("pos"), F.lit(i == len(header) - 1).alias("is_kpi"),
                 F.col(f"`{c}`").alias("value"))
        for i, c in enumerate(header)])
    placed = wide.select(F.col("_metadata.file_path").alias("file"), line.alias("row"), cells.alias("cells"))
    return placed.select("file", "row", F.inline("cells"))


def read_matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, row, cells) of text files of numbers without a header; ``row`` counts the lines of a file from 0.

    Lines are split at ``separator`` or blanks, empty lines are left out, and
    what is no number is null. Splits of a large file are read by different
    tasks; the lines of each are counted, and the splits before shift the count.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.trim("value").alias("value")).where("value <> ''")
    cells = F.transform(F.split("value", rf"\s*{re.escape(separator)}\s*|\s+"), lambda x: x.try_cast("double"))
    lines = cut_lineage(lines.select("file", "block", "line", cells.alias("cells")))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    placed = lines.join(shift, ["file", "block"]).withColumn("row", F.row_number().over(inside) - 1 + F.col("shift"))
    return placed.select("file", F.col("row").cast("bigint").alias("row"), "cells")


def scored_matrix(matrix: DataFrame) -> DataFrame:
    """``matrix`` (file, row, cells) with each column's cells as z-scores over all rows; null for a constant column.

    Column statistics come from one pass and go back as one row of two arrays, as long as a line.
    """
    columns = matrix.select(F.posexplode("cells").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    stats = columns.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "spread"))).alias("_stats"))
    scored = F.transform("cells", lambda x, i: F.try_divide(x - F.get("_stats", i)["mean"], F.get("_stats", i)["spread"]))
    return matrix.join(F.broadcast(stats), F.lit(True)).select("file", "row", scored.alias("cells"))


def read_truth_matrix(spark: SparkSession, rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges of a 0/1 matrix given as (row, cells): row is the effect, column the cause."""
    cells = rows.select("row", F.posexplode("cells").alias("col", "mark")).where("mark = 1")
    names = F.array(*[F.lit(x) for x in labels])
    return cells.select(F.get(names, F.col("col").cast("int")).alias("cause"), F.get(names, F.col("row").cast("int")).alias("effect"))


def to_wide(channels: DataFrame, kpi: DataFrame, entities: Sequence[str]) -> DataFrame:
    """(ts, entity columns in code-point order, KPI); ``entities`` is the case's short list."""
    wide = channels.groupBy("ts").pivot("entity", sorted(entities)).agg(F.first("value"))
    return wide.join(kpi.select("ts", F.col("value").alias(KPI_COLUMN)), "ts")
