"""The library's tables as Spark views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rcaspark.plans.registry import table

CASE = "events/20240101"

# The same tables for the checking SQL.
CHANNELS_SQL = """
    SELECT 'pod-' || CAST(user_id % 5 AS VARCHAR) AS entity, event_type AS metric,
           CAST(ts AS DATE) AS day, avg(value) AS value
    FROM events GROUP BY 1, 2, 3
"""
KPI_SQL = "SELECT CAST(ts AS DATE) AS day, avg(value) AS kpi FROM events GROUP BY 1"
ZSCORE_SQL = f"""
    ch AS ({CHANNELS_SQL}),
    days AS (SELECT day FROM ch GROUP BY day
             HAVING count(DISTINCT metric) = (SELECT count(DISTINCT metric) FROM ch)),
    al AS (SELECT ch.* FROM ch JOIN days USING (day)),
    st AS (SELECT entity, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n
           FROM al GROUP BY 1, 2 HAVING min(value) <> max(value)),
    zs AS (SELECT al.entity, al.metric, al.day, (value - mean) / std AS z
           FROM al JOIN st ON al.entity = st.entity AND al.metric = st.metric)
"""


def case_by(column: str) -> Column:
    """The case key as a value of each row, so that joins on it stay equi-joins and never fold to a product."""
    return F.when(F.col(column).isNotNull(), F.lit(CASE))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of each (entity, metric); five entities, five metrics."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.concat(F.lit("pod-"), (F.col("user_id") % 5).cast("string")).alias("entity"),
        F.col("event_type").alias("metric"),
        F.to_date("ts").alias("ts"),
    ).agg(F.avg("value").alias("value")).withColumn("case", case_by("ts"))


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.to_date("ts").alias("ts")).agg(F.avg("value").alias("value")).withColumn("case", case_by("ts"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean of each metric, without entities: alignment loses rows here."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("ts")
    ).agg(F.avg("value").alias("value")).withColumn("case", case_by("ts"))
