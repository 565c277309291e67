"""Names of entities and cases."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rcaspark.operators.contains import contains_join


@F.pandas_udf(StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def normal_name(name: Column) -> Column:
    """Compatibility-composed, trimmed and case-folded; plain ASCII never leaves the JVM."""
    return F.when(name.rlike(r"^[\x20-\x7e]*$"), F.lower(F.trim(name))).otherwise(_fold(name))


def workload_stem(name: Column) -> Column:
    """Name without a trailing dash and five lower-case letters or digits."""
    return F.regexp_replace(name, "-[a-z0-9]{5}$", "")


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def language_tag(text: Column) -> Column:
    return F.when(has_cjk(text), "zh-cn").otherwise("en-us")


def case_key(system: Column, day: Column) -> Column:
    """``system/day``; null where the system is empty or the day is not eight digits."""
    ok = (F.trim(system) != "") & ~F.contains(system, F.lit("/")) & day.rlike(r"^\d{8}$")
    return F.when(ok, F.concat_ws("/", system, day))


def select_active(records: DataFrame, scope: DataFrame) -> DataFrame:
    """Records of the cases in scope with their declared order; missing or repeated cases are errors."""
    from rcaspark.operators.profile import GateError

    n = records.groupBy("case").agg(F.count("*").alias("_n"))
    wrong = scope.groupBy("case").agg(F.count("*").alias("_k")).join(n, "case", "left").where("_k > 1 or _n is null or _n > 1").limit(5).collect()
    if wrong:
        raise GateError("missing or repeated case: " + ", ".join(r["case"] for r in wrong))
    return records.join(scope.select("case", "ord"), "case")


def alias_counts(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Per wanted name, how many known names share its normal form or, being other names, its stem.

    Groups are counted once and joined by key, so that a stem held by many names
    does not produce all pairs; ``name_groups`` lists the members of each group.
    """
    have = names.select("name").distinct()
    by_normal = have.groupBy(normal_name(F.col("name")).alias("normal")).agg(F.count("*").alias("same_normal"))
    by_stem = have.groupBy(workload_stem(F.col("name")).alias("stem")).agg(F.count("*").alias("_stem"))
    rows = wanted.select("name").distinct().withColumn("normal", normal_name(F.col("name"))).withColumn("stem", workload_stem(F.col("name")))
    itself = have.withColumn("_known", F.lit(1))
    out = rows.join(by_normal, "normal", "left").join(by_stem, "stem", "left").join(itself, "name", "left")
    return out.select(
        "name", "normal", "stem", F.coalesce("same_normal", F.lit(0)).alias("same_normal"),
        (F.coalesce("_stem", F.lit(0)) - F.coalesce("_known", F.lit(0))).alias("other_same_stem"))


def name_groups(names: DataFrame) -> DataFrame:
    return names.select("name", normal_name(F.col("name")).alias("normal"), workload_stem(F.col("name")).alias("stem")).distinct()


def files_naming(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose name contains a wanted name."""
    return contains_join(files.select(F.col("file").alias("found_in"), "file"), "file", wanted.select("name"), "name")
