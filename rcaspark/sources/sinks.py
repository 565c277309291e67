"""Writers: create-only, idempotent, append-only and partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rcaspark.operators.profile import GateError


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    """An output that exists already is an error."""
    df.write.mode("errorifexists").options(**options).partitionBy(*partition_by).format(fmt).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def write_same(df: DataFrame, path: str) -> bool:
    """Write once; writing the same rows again is accepted, other rows are an error. True if written."""
    spark = df.sparkSession
    if not _exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return True
    old = spark.read.schema(df.schema).parquet(path)
    if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise GateError(f"{path} holds other rows")
    return False


def write_wide_csv(wide: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Wide table in time order with its timestamps beside it; doubles keep all their digits."""
    ordered = wide.orderBy("ts")
    ordered.select(*[F.col(f"`{c}`") for c in columns]).write.mode("errorifexists").csv(f"{path}/values", header=True)
    ordered.select("ts").write.mode("errorifexists").csv(f"{path}/timestamps", header=True)


def write_texts(df: DataFrame, path: str, entity: str, text: str) -> None:
    """One folder of text per entity."""
    df.select(entity, F.col(text).alias("value")).write.mode("errorifexists").partitionBy(entity).text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_state(log: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in log.columns if c not in keys and c != at]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_s"), F.max(at).alias(at)).select(*keys, at, "_s.*")


def write_identified(df: DataFrame, path: str, identity: str) -> None:
    """A table stored under the identity of what made it."""
    df.withColumn("profile_sha", F.lit(identity)).write.mode("errorifexists").partitionBy("profile_sha").parquet(path)


def read_identified(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """Refuses a table made under another identity."""
    df = spark.read.parquet(path)
    others = df.select("profile_sha").distinct().where(F.col("profile_sha") != identity).limit(1).collect()
    if others:
        raise GateError("table was made under another identity")
    return df.where(F.col("profile_sha") == identity).drop("profile_sha")


def write_answers(df: DataFrame, path: str) -> None:
    """Pair answers by case, algorithm and variant; a variant written again takes the place of its older answers."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case", "algorithm", "variant").parquet(path)


def read_answers(spark: SparkSession, path: str, case: str, algorithm: str, variant: str) -> DataFrame:
    """One variant of one case; other folders are not read."""
    return spark.read.parquet(path).where((F.col("case") == case) & (F.col("algorithm") == algorithm) & (F.col("variant") == variant))


def manifest(channel_stats: DataFrame, decisions: DataFrame, run: dict[str, str]) -> DataFrame:
    """One JSON record per channel, per entity and for the run."""
    def rec(df: DataFrame, kind: str, body: Column):
        return df.select("case", F.lit(kind).alias("kind"), F.to_json(body).alias("record"))

    cases = channel_stats.select("case").distinct()
    settings = F.struct(*[F.lit(v).alias(k) for k, v in sorted(run.items())])
    return rec(channel_stats, "channel", F.struct(*[c for c in channel_stats.columns if c != "case"])).unionByName(
        rec(decisions, "entity", F.struct(*[c for c in decisions.columns if c != "case"]))).unionByName(rec(cases, "run", settings))


def canonical_json(*columns: str) -> Column:
    """JSON with sorted keys, for digests."""
    names = sorted(columns)
    return F.to_json(F.struct(*names))
