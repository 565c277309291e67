"""Which entity has log evidence, and what text stands for it.

Entities: (case, entity, pos, is_kpi). Files: (case, entity, kind) with kind
``templates`` or ``structured``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rcaspark.operators.profile import GateError

# The notices shown where no log evidence exists.
ABSENT_NOTICE = (
    "No matching log evidence is available for this pod in this case.\n"
    "This does not imply normal operation or absence of causal influence."
)
KPI_NOTICE = (
    "This is an input KPI column, not a pod. No pod event log is assigned to this column. "
    "Its column label alone does not establish its physical meaning."
)


def pair_status(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Exact-name match of entities to their two log files."""
    have = files.groupBy("case", "entity").agg(
        F.count_if(F.col("kind") == "templates").alias("n_templates"),
        F.count_if(F.col("kind") == "structured").alias("n_structured"))
    both = entities.join(have, ["case", "entity"], "left").fillna(0, ["n_templates", "n_structured"])
    status = (
        F.when((F.col("n_templates") == 1) & (F.col("n_structured") == 1), "exact_unique_pair")
        .when((F.col("n_templates") == 0) & (F.col("n_structured") == 0), "both_absent")
        .otherwise("partial_or_duplicate"))
    return both.withColumn("status", status)


def evidence_plan(entities: DataFrame, files: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Every entity in order: evidence present, absent with a notice, or the KPI with its own.

    ``available`` is true, false, or null for the KPI. An entity with half a pair
    is an error unless ``allow_partial`` keeps it visible as its own status.
    """
    plan = pair_status(entities, files)
    if not allow_partial:
        broken = plan.where("not is_kpi and status = 'partial_or_duplicate'").limit(5).collect()
        if broken:
            raise GateError("partial or duplicate log pair: " + ", ".join(r["entity"] for r in broken))
    return plan.select(
        "case", "entity", "pos",
        F.when(F.col("is_kpi"), "kpi").otherwise("pod").alias("kind"),
        F.when(~F.col("is_kpi"), F.col("status") == "exact_unique_pair").alias("available"),
        F.when(F.col("is_kpi"), KPI_NOTICE).when(F.col("status") == "both_absent", ABSENT_NOTICE).alias("fixed_text"),
        "status",
    )


def merge_summaries(plan: DataFrame, summaries: DataFrame) -> DataFrame:
    """Plan with generated texts filled in; the generated set must equal the available set."""
    both = plan.join(
        summaries.select("case", "entity", F.col("text").alias("summary"), F.lit(True).alias("_made")), ["case", "entity"], "full_outer")
    wrong = both.where(
        F.col("kind").isNull()
        | (F.col("_made") & ~F.coalesce("available", F.lit(False)))
        | (F.col("available") & (F.col("_made").isNull() | (F.trim(F.coalesce("summary", F.lit(""))) == "")))
    ).limit(5).collect()
    if wrong:
        raise GateError("summaries do not match the plan: " + ", ".join(r["entity"] for r in wrong))
    return both.select("case", "entity", "pos", "kind", "available", F.coalesce("summary", "fixed_text").alias("text"))


def coverage(plan: DataFrame) -> DataFrame:
    """Counts of pods with and without evidence, and a sentence made of them."""
    counts = plan.groupBy("case").agg(
        F.count_if(F.col("kind") == "pod").alias("pods"),
        F.count_if(F.coalesce("available", F.lit(False))).alias("available"),
        F.count_if((F.col("kind") == "pod") & ~F.col("available")).alias("missing"),
        F.count_if(F.col("kind") == "kpi").alias("kpis"))
    return counts.withColumn("sentence", F.format_string(
        "Log evidence covers %d of %d pods; %d pods have none.", F.col("available"), F.col("pods"), F.col("missing")))


def drift(recorded: DataFrame, current: DataFrame, absent: DataFrame) -> DataFrame:
    """Files that vanished, changed size, or appeared for an entity recorded as absent."""
    old = recorded.select("entity", "path", F.col("bytes").alias("bytes_then"))
    new = current.select("entity", "path", F.col("bytes").alias("bytes_now"))
    both = old.join(new, ["entity", "path"], "full_outer").join(
        absent.select("entity", F.lit(True).alias("_absent")).distinct(), "entity", "left")
    finding = (
        F.when(F.col("bytes_now").isNull(), "missing")
        .when(F.col("bytes_then").isNull() & F.col("_absent"), "appeared")
        .when(F.col("bytes_then") != F.col("bytes_now"), "resized"))
    return both.withColumn("finding", finding).where("finding is not null").select("entity", "path", "finding")


def hash_gate(inputs: DataFrame, manifest: DataFrame, connection: DataFrame) -> DataFrame:
    """Cases whose three recorded digests do not agree, or that lack one of the records."""
    a = inputs.select("case", F.col("digest").alias("input_digest"))
    b = manifest.select("case", F.col("digest").alias("manifest_digest"))
    c = connection.select("case", F.col("digest").alias("connection_digest"))
    joined = a.join(b, "case", "full_outer").join(c, "case", "full_outer")
    ok = (F.col("input_digest") == F.col("manifest_digest")) & (F.col("input_digest") == F.col("connection_digest"))
    return joined.where(~F.coalesce(ok, F.lit(False)))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, as (side, ...); empty when the sets are equal."""
    l, r = left.distinct(), right.distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right")))


def not_contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Keys of ``inner`` that ``outer`` lacks; empty when inner is contained."""
    return inner.select(key).distinct().join(outer.select(key).distinct(), key, "left_anti")
