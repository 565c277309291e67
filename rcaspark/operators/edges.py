"""Edge tables: marks, text, constraints, graph metrics and differences.

Edges are (case, cause, effect, mark) with marks ``->``, ``--`` and ``<->``; the
last two are stored in both directions. Constraints are (case, cause, effect,
verdict): 1 required, 0 forbidden, null unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["case", "cause", "effect"]


def reverse(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("cause", "effect")]
    return pairs.select(*rest, F.col("effect").alias("cause"), F.col("cause").alias("effect"))


def binarise(edges: DataFrame) -> DataFrame:
    """Every stored direction of every mark as one plain pair."""
    return edges.select(*PAIR).distinct()


def marks_from_endpoints(endpoints: DataFrame) -> DataFrame:
    """(case, a, b, mark) endpoint cells to edges, by joining a pair to its reverse.

    The cell (a, b) holds the mark at a's end: a tail (-1) there and an arrow (1)
    at b's end make a -> b.
    """
    there = endpoints.where("mark <> 0").select("case", F.col("a").alias("cause"), F.col("b").alias("effect"), F.col("mark").alias("_here"))
    back = endpoints.where("mark <> 0").select("case", F.col("b").alias("cause"), F.col("a").alias("effect"), F.col("mark").alias("_there"))
    kind = (
        F.when((F.col("_here") == -1) & (F.col("_there") == 1), "->")
        .when((F.col("_here") == -1) & (F.col("_there") == -1), "--")
        .when((F.col("_here") == 1) & (F.col("_there") == 1), "<->"))
    return there.join(back, PAIR).withColumn("mark", kind).where("mark is not null").select(*PAIR, "mark")


def edges_text(edges: DataFrame, nodes: DataFrame, compat: str = "corrected") -> DataFrame:
    """A case's edges as one line of text, ordered by position of effect, then cause.

    Undirected edges are printed once. Bidirected ones are printed once as well,
    but twice with ``compat='released'``.
    """
    at = nodes.select("case", "entity", "pos")
    e = (
        edges.join(at.withColumnsRenamed({"entity": "cause", "pos": "cause_pos"}), ["case", "cause"])
        .join(at.withColumnsRenamed({"entity": "effect", "pos": "effect_pos"}), ["case", "effect"]))
    once = F.col("mark") == "--" if compat == "released" else F.col("mark") != "->"
    shown = e.where(~once | (F.col("effect_pos") < F.col("cause_pos")))
    piece = F.concat_ws(" ", "cause", "mark", "effect")
    return shown.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("effect_pos", "cause_pos", piece.alias("piece")))), lambda x: x["piece"]), ", ").alias("text"))


def known_pairs(constraints: DataFrame, verdict: int) -> DataFrame:
    """Required (1) or forbidden (0) ordered pairs."""
    return constraints.where((F.col("verdict") == verdict) & (F.col("cause") != F.col("effect"))).select(*PAIR)


def unknown_is_forbidden(constraints: DataFrame) -> DataFrame:
    """The rewrite that score-based search uses: no verdict counts as forbidden."""
    return constraints.withColumn("verdict", F.coalesce("verdict", F.lit(0)))


def drop_mutual_required(constraints: DataFrame) -> DataFrame:
    """Pairs required in both directions lose both verdicts."""
    need = known_pairs(constraints, 1)
    mutual = need.join(reverse(need), PAIR, "left_semi").withColumn("_mutual", F.lit(True))
    return constraints.join(mutual, PAIR, "left").withColumn(
        "verdict", F.when(F.col("_mutual").isNull(), F.col("verdict"))).drop("_mutual")


def conflicts(constraints: DataFrame) -> DataFrame:
    """Unordered pairs required in both directions."""
    need = known_pairs(constraints, 1)
    return need.join(reverse(need), PAIR, "left_semi").where("cause < effect")


def _cells(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Which of prediction and truth hold a pair or its reverse, by one aggregation."""
    def flag(pairs, name):
        names = ["p", "p_back", "t", "t_back"]
        return pairs.select(*PAIR, *[F.lit(n == name).alias(n) for n in names])

    p, t = binarise(predicted), truth.select(*PAIR).distinct()
    rows = flag(p, "p").unionByName(flag(reverse(p), "p_back")).unionByName(flag(t, "t")).unionByName(flag(reverse(t), "t_back"))
    return rows.groupBy(*PAIR).agg(*[F.bool_or(n).alias(n) for n in ("p", "p_back", "t", "t_back")])


def graph_metrics(predicted: DataFrame, truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """FPR, FNR, precision, F1, SHD and NHD over all n x n cells.

    Only cells with an edge are looked at; the empty rest follows from n.
    """
    c = _cells(predicted, truth).groupBy("case").agg(
        F.count_if(F.col("p") & F.col("t")).alias("tp"),
        F.count_if(F.col("p") & ~F.col("t")).alias("fp"),
        F.count_if(~F.col("p") & F.col("t")).alias("fn"),
        F.count_if(F.col("p") & ~F.col("t") & ~F.col("t_back")).alias("extra"),
        F.count_if(F.col("t") & ~F.col("p") & ~F.col("p_back")).alias("missing"),
        F.count_if(F.col("t") & ~F.col("t_back") & ~F.col("p") & F.col("p_back")).alias("reversed"))
    n = nodes.groupBy("case").agg(F.count_distinct("entity").alias("_n"))
    filled = n.join(c, "case", "left").fillna(0)
    cells = F.col("_n") * F.col("_n")
    out = filled.withColumn("tn", cells - F.col("tp") - F.col("fp") - F.col("fn")).withColumn(
        "shd", F.col("extra") + F.col("missing") + F.col("reversed"))
    return out.select(
        "case", "tp", "fp", "fn", "tn",
        F.try_divide("fp", F.col("tn") + F.col("fp")).alias("fpr"),
        F.try_divide("fn", F.col("tp") + F.col("fn")).alias("fnr"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp")).alias("f1"),
        "extra", "missing", "reversed", "shd", (F.col("shd") / cells).alias("nhd"))


def _marks_by_pair(edges: DataFrame, name: str) -> DataFrame:
    """(case, low, high, name): the marks between two nodes, of at most four kinds, read from the lower name."""
    forward = F.col("cause") < F.col("effect")
    mark = F.when((F.col("mark") == "->") & ~forward, "<-").otherwise(F.col("mark"))
    return edges.where("cause <> effect").groupBy(
        "case", F.least("cause", "effect").alias("low"), F.greatest("cause", "effect").alias("high")
    ).agg(F.array_sort(F.collect_set(mark)).alias(name))


def graph_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges by mark in both stages; directed edges and linked pairs that are shared, lost and new.

    ``directed_*`` compares ordered pairs with ``->`` and nothing else. The other
    counts are on unordered pairs: the same marks in both stages, other marks
    (turned round or of another kind), linked in one stage only.
    """
    pairs = _marks_by_pair(before, "_before").join(_marks_by_pair(after, "_after"), ["case", "low", "high"], "full_outer")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("_before", "_after"))
    kinds = {"directed": ("->", "<-"), "undirected": ("--",), "bidirected": ("<->",)}

    def held(marks, kind):
        return F.array_intersect(marks, F.array(*[F.lit(m) for m in kinds[kind]]))

    by_mark = [F.sum(F.size(held(c, k))).alias(f"{s}_{k}") for s, c in (("before", x), ("after", y)) for k in kinds]
    a, b = held(x, "directed"), held(y, "directed")
    return pairs.groupBy("case").agg(
        *by_mark,
        F.sum(F.size(F.array_intersect(a, b))).alias("directed_shared"),
        F.sum(F.size(F.array_except(a, b))).alias("directed_lost"),
        F.sum(F.size(F.array_except(b, a))).alias("directed_new"),
        F.count_if(x == y).alias("shared"),
        F.count_if((F.size(x) > 0) & (F.size(y) > 0) & (x != y)).alias("changed"),
        F.count_if(F.size(y) == 0).alias("only_before"),
        F.count_if(F.size(x) == 0).alias("only_after"))


def verdicts_against_edges(constraints: DataFrame, edges: DataFrame) -> DataFrame:
    """How the final graph treats the verdicts: kept, lost, present though forbidden, required both ways.

    A case whose verdicts are all unknown, or that has edges only, is a row of zeros.
    """
    e = binarise(edges).withColumn("_edge", F.lit(True))
    v = constraints.select(*PAIR, "verdict")
    both = v.join(e, PAIR, "left")
    has = F.col("_edge").isNotNull()
    counts = both.groupBy("case").agg(
        F.count_if((F.col("verdict") == 1) & has).alias("required_kept"),
        F.count_if((F.col("verdict") == 1) & ~has).alias("required_lost"),
        F.count_if((F.col("verdict") == 0) & has).alias("forbidden_present"))
    twice = conflicts(constraints).groupBy("case").agg(F.count("*").alias("required_both_ways"))
    cases = constraints.select("case").union(edges.select("case")).distinct()
    return cases.join(counts, "case", "left").join(twice, "case", "left").fillna(0, [*counts.columns[1:], "required_both_ways"])
