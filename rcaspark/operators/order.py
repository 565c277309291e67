"""Row order over groups of any size.

A plain window sorts a whole group in one task. The operators here cut a group
into ranges first, so that a group holding a third of the table is still spread
over many tasks, and only one short row per range is looked at as a sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rcaspark.session import cut_lineage


def full_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row of each group; ``order`` must be a total order.

    Rows are range partitioned on group and order, numbered inside each range and
    shifted by the rows of earlier ranges. The ranges are checkpointed, as both
    the counts and the rows must see the same cut.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(shift, [*keys, "_range"])
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint"))
        .drop("_inside", "_shift", "_range")
    )


def dense_code(df: DataFrame, keys: Sequence[str], value: str, name: str = "code") -> DataFrame:
    """0-based rank of each distinct value within its group, joined back to the rows."""
    codes = full_rank(df.select(*keys, value).distinct(), keys, [F.col(value)], name)
    codes = codes.withColumn(name, F.col(name) - 1)
    return df.join(codes, [*keys, value])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, name: str = "previous"
) -> DataFrame:
    """The value of ``order`` in the row before, per group.

    ``block`` must grow with ``order``. Lags are taken inside blocks; the first
    row of a block takes the maximum of the block before it.
    """
    cut = df.withColumn("_block", block)
    ends = cut.groupBy(*keys, "_block").agg(F.max(order).alias("_end"))
    ends = ends.select(
        *keys, "_block",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_end_before"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        cut.withColumn("_lag", F.lag(order).over(inside))
        .join(ends, [*keys, "_block"])
        .withColumn(name, F.coalesce("_lag", "_end_before"))
        .drop("_lag", "_end_before", "_block")
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    Spark limits every group in each input task before the shuffle, so a hot
    group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= n)
