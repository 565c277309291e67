"""Rank metrics, candidate recall, truth matching and all-or-nothing aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rcaspark.functions.vectors import let
from rcaspark.operators.order import first_per_group, full_rank
from rcaspark.operators.profile import GateError, require

CUTS = (3, 5, 10)


def hit(rank: Column, k: Column | int, inclusive: bool = False) -> Column:
    """Released metrics count a hit when rank < K; the inclusive form counts rank <= K."""
    return rank <= k if inclusive else rank < k


def map_at(rank: Column, k: Column | int, inclusive: bool = False) -> Column:
    """One case's share of MAP@K: the mean of its hits at 1..K in closed form."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.greatest(k - rank + (1 if inclusive else 0), F.lit(0)) / k


def check_ranks(ranks: DataFrame) -> DataFrame:
    """Ranks must be whole numbers from 1 and at least one must exist."""
    if dict(ranks.dtypes)["rank"] not in ("int", "bigint", "smallint", "tinyint"):
        raise GateError("ranks must be whole numbers")
    if ranks.isEmpty():
        raise GateError("no ranks")
    return require(ranks, {"rank_from_one": F.col("rank") >= 1})


def rank_metrics(ranks: DataFrame, keys: Sequence[str], cuts: Sequence[int] = CUTS, inclusive: bool = False) -> DataFrame:
    """PR@K and MAP@K for each cut, and MRR, in one aggregation."""
    r = F.col("rank")
    parts = [F.count("*").alias("n_cases"), F.avg(F.lit(1.0) / r).alias("mrr")]
    for k in cuts:
        parts.append(F.avg(hit(r, k, inclusive).cast("double")).alias(f"pr_{k}"))
        parts.append(F.avg(map_at(r, k, inclusive)).alias(f"map_{k}"))
    return ranks.groupBy(*keys).agg(*parts)


def long_report(ranks: DataFrame, keys: Sequence[str], cuts: Sequence[int] = CUTS, inclusive: bool = False) -> DataFrame:
    """The same metrics as rows (keys, metric, k, value)."""
    wide = rank_metrics(ranks, keys, cuts, inclusive)
    cells = [F.struct(F.lit("mrr").alias("metric"), F.lit(None).cast("int").alias("k"), F.col("mrr").alias("value"))]
    for k in cuts:
        cells.append(F.struct(F.lit("pr").alias("metric"), F.lit(k).alias("k"), F.col(f"pr_{k}").alias("value")))
        cells.append(F.struct(F.lit("map").alias("metric"), F.lit(k).alias("k"), F.col(f"map_{k}").alias("value")))
    return wide.select(*keys, F.inline(F.array(*cells)))


def truth_report(ranking: DataFrame, truth: DataFrame, kpi: DataFrame | str, keys: Sequence[str] = ("case",)) -> DataFrame:
    """Hits and reciprocal rank of the true node, with and without the KPI, and ties at its score.

    ``ranking`` holds (keys, node, visits, rank). No window is needed: dropping the
    KPI moves the truth up by one exactly when the KPI stands before it. Ties are
    counted among entities. A truth that is not ranked stays, without a rank.
    ``kpi`` is one name, or (case, entity) where cases have their own.
    """
    keys = list(keys)
    if isinstance(kpi, str):
        ranking = ranking.withColumn("_is_kpi", F.col("node") == kpi)
    else:
        own = kpi.select("case", F.col("entity").alias("node"), F.lit(True).alias("_is_kpi")).distinct()
        ranking = ranking.join(own, ["case", "node"], "left").fillna(False, ["_is_kpi"])
    at = truth.select(*keys, "node").distinct().join(ranking, [*keys, "node"], "left").select(
        *keys, "node", F.col("rank").alias("rank_all"), F.col("visits").alias("_v"))
    ahead = ranking.where("_is_kpi").select(*keys, F.col("rank").alias("_kpi_rank"))
    others = ranking.where("not _is_kpi").select(*keys, "visits")
    ties = others.join(at.drop("node"), keys).where(F.col("visits") == F.col("_v")).groupBy(*keys, "rank_all").agg(F.count("*").alias("tied"))
    out = at.join(ahead, keys, "left").join(ties, [*keys, "rank_all"], "left").fillna(0, ["tied"]).withColumn(
        "rank_entities", F.col("rank_all") - F.coalesce((F.col("_kpi_rank") < F.col("rank_all")).cast("bigint"), F.lit(0)))
    hits = []
    for name in ("rank_all", "rank_entities"):
        hits += [(F.col(name) <= k).alias(f"{name}_hit_{k}") for k in (1, 3, 5)]
        hits.append((F.lit(1.0) / F.col(name)).alias(f"{name}_rr"))
    return out.select(*keys, "rank_all", "rank_entities", "tied", *hits)


def anomaly_score(channel_alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """Largest share of alerting rows over an entity's channels; 0 without channels."""
    best = channel_alerts.groupBy("case", "entity").agg(F.max(F.col("positives") / F.col("n_rows")).alias("score"))
    return entities.select("case", "entity").distinct().join(best, ["case", "entity"], "left").fillna(0.0, ["score"])


def saturation(scores: DataFrame, high: float = 0.99, nth: int = 30) -> DataFrame:
    """How saturated a case's scores are: count over ``high``, first, n-th and median score."""
    ranked = full_rank(scores, ["case"], [F.desc("score"), F.col("entity")])
    sized = ranked.join(scores.groupBy("case").agg(F.count("*").alias("_n")), "case")
    low, up = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    return sized.groupBy("case").agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("score") > high).alias("saturated"),
        F.max("score").alias("first_score"),
        F.max(F.when(F.col("rank") == nth, F.col("score"))).alias("nth_score"),
        ((F.max(F.when(F.col("rank") == low, F.col("score"))) + F.max(F.when(F.col("rank") == up, F.col("score")))) / 2).alias("median_score"),
    )


def shortlist(scores: DataFrame, forced: DataFrame, k: int) -> DataFrame:
    """The k-1 best entities by (score, name) besides one forced entity, and that entity.

    ``natural_rank`` is the rank before forcing.
    """
    order = [F.desc("score"), F.col("entity")]
    flagged = scores.join(forced.select("case", "entity", F.lit(True).alias("forced")).distinct(), ["case", "entity"], "left").fillna(False, ["forced"])
    best = first_per_group(flagged.where("not forced"), ["case"], order, k - 1, "_at").drop("_at")
    natural = full_rank(scores, ["case"], order, "natural_rank").select("case", "entity", "natural_rank")
    return best.unionByName(flagged.where("forced")).join(natural, ["case", "entity"]).withColumn("would_be_natural", F.col("natural_rank") <= k)


def candidate_recall(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of cases whose truth is among the first k, and the k that covers all cases."""
    at = truth.select("case", "entity").join(ranked.select("case", "entity", "rank"), ["case", "entity"], "left")
    return at.agg(
        F.count("*").alias("cases"),
        F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias("recall"),
        F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("smallest_k"))


def match_service(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities equal to a service label or starting with it and a dash; all matches are kept.

    Each name is cut at its dashes and joined on equality, so no label is compared
    with every name. ``scorable`` holds for a case with exactly one match; a label
    without a match stays, with a null entity, and is not scorable.
    """
    prefixes = let(F.split("entity", "-", -1), lambda words: F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), "-")))
    cut = entities.select("case", "entity", F.explode(prefixes).alias("label"))
    found = truth.select("case", "label").join(cut, ["case", "label"], "left")
    n = found.groupBy("case").agg(F.count("entity").alias("n_matches"))
    return found.join(n, "case").withColumn("scorable", F.col("n_matches") == 1)


def all_or_nothing(cases: DataFrame, keys: Sequence[str], cut: int = 10) -> DataFrame:
    """Aggregate only when every case is resolved; otherwise no value at all.

    ``cases`` holds (keys, case, stage, rank) with a null rank for an unresolved
    case. More than one stage in a group is an error.
    """
    mixed = cases.groupBy(*keys).agg(F.count_distinct("stage").alias("_s")).where("_s > 1").limit(1).collect()
    if mixed:
        raise GateError("stages are mixed in one aggregate")
    r, whole = F.col("rank"), F.bool_and(F.col("rank").isNotNull())
    return cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count("rank").alias("resolved"),
        F.when(whole, F.avg(F.lit(1.0) / r)).alias("mrr"),
        F.when(whole, F.avg(map_at(r, cut))).alias(f"map_{cut}"))


def multi_truth(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Hits in the top k over min(k, truths), reciprocal rank of the first hit; per case, then averaged."""
    n = truth.select("case", "entity").distinct()
    at = n.join(ranking.select("case", "entity", "rank"), ["case", "entity"], "left")
    per = at.groupBy("case").agg(
        (F.count_if(F.col("rank") <= k) / F.least(F.lit(k), F.count("*"))).alias("pr"),
        F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("cases"), F.avg("pr").alias(f"pr_{k}"), F.avg("rr").alias("mrr"))


def compare_published(computed: DataFrame, published: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Published against computed values; a key on one side only does not agree."""
    both = computed.select(*keys, F.col(value).alias("computed")).join(published.select(*keys, F.col(value).alias("published")), list(keys), "full_outer")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("computed") - F.col("published")) < tolerance, F.lit(False)))
