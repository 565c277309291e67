"""Random walk with restart over an edge table, from effects to causes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rcaspark.operators.edges import PAIR, reverse
from rcaspark.operators.order import full_rank
from rcaspark.operators.profile import GateError
from rcaspark.session import cut_lineage

# Length of the walk and restart probability.
STEPS = 1000
RESTART = 0.05

# A case up to this many nodes is solved inside one task; a larger one by joins.
SMALL_GRAPH = 2000


def walk_graph(edges: DataFrame, kpi: DataFrame) -> DataFrame:
    """Steps (case, node, next): effect to cause, both ways for symmetric marks and at the KPI."""
    pairs = edges.select(*PAIR, "mark")
    pairs = pairs.unionByName(reverse(pairs).where("mark <> '->'"))
    ends = kpi.select("case", F.col("entity").alias("_kpi"))
    touching = pairs.join(ends, "case").where((F.col("cause") == F.col("_kpi")) | (F.col("effect") == F.col("_kpi"))).drop("_kpi")
    return pairs.unionByName(reverse(touching)).select("case", F.col("effect").alias("node"), F.col("cause").alias("next")).distinct()


def transitions(steps: DataFrame) -> DataFrame:
    """Uniform probability over the causes of each node."""
    degree = steps.groupBy("case", "node").agg(F.count("*").alias("_d"))
    return steps.join(degree, ["case", "node"]).select("case", "node", "next", (F.lit(1.0) / F.col("_d")).alias("p"))


def _chain(moves: DataFrame, nodes: DataFrame, kpi: DataFrame, restart: float) -> DataFrame:
    """The whole chain as rows (case, node, next, w, arrives); restarts do not count as arrivals."""
    ends = kpi.select("case", F.col("entity").alias("_kpi"))
    stuck = nodes.select("case", F.col("entity").alias("node")).join(
        moves.select("case", "node", F.lit(True).alias("_moves")).distinct(), ["case", "node"], "left")
    back = stuck.join(ends, "case").select(
        "case", "node", F.col("_kpi").alias("next"),
        F.when(F.col("_moves"), F.lit(restart)).otherwise(F.lit(1.0)).alias("w"), F.lit(0.0).alias("arrives"))
    go = moves.select("case", "node", "next", (F.col("p") * (1 - restart)).alias("w"), F.lit(1.0).alias("arrives"))
    return go.unionByName(back)


def visits_by_joins(moves: DataFrame, nodes: DataFrame, kpi: DataFrame, n_steps: int = STEPS, restart: float = RESTART, per_cut: int = 10, tolerance: float = 1e-12) -> DataFrame:
    """Expected arrivals per node by repeated joins; one shuffle per step, lineage cut every few steps.

    Once a step changes no probability by more than ``tolerance``, the remaining
    steps all add the same arrivals.
    """
    # A row of each node to itself carries what a step keeps, so that a step reads the state once.
    same = nodes.select("case", F.col("entity").alias("node"), F.col("entity").alias("next"), F.lit(0.0).alias("w"), F.lit(0.0).alias("arrives"), F.lit(1.0).alias("keep"))
    chain = _chain(moves, nodes, kpi, restart).withColumn("keep", F.lit(0.0)).unionByName(same)
    chain = cut_lineage(chain.withColumnsRenamed({"node": "_from", "next": "node"}))
    state = nodes.select("case", F.col("entity").alias("node")).join(
        kpi.select("case", F.col("entity").alias("node"), F.lit(1.0).alias("prob")), ["case", "node"], "left"
    ).select("case", "node", F.coalesce("prob", F.lit(0.0)).alias("prob"), F.lit(0.0).alias("last"), F.lit(0.0).alias("visits"), F.lit(0.0).alias("arrived"))
    done = 0
    while done < n_steps:
        for _ in range(min(per_cut, n_steps - done)):
            moved = F.col("prob") * F.col("w")
            state = state.withColumnRenamed("node", "_from").join(chain, ["case", "_from"]).groupBy("case", "node").agg(
                F.sum(moved).alias("prob"), F.sum(F.col("prob") * F.col("keep")).alias("last"),
                F.sum((F.col("visits") + F.col("arrived")) * F.col("keep")).alias("visits"), F.sum(moved * F.col("arrives")).alias("arrived"))
            done += 1
        state = cut_lineage(state)
        change = state.agg(F.max(F.abs(F.col("prob") - F.col("last")))).first()[0]
        if change is None or change < tolerance:
            break
    left = n_steps - done
    return state.select("case", "node", (F.col("visits") + F.col("arrived") * (1 + left)).alias("visits"))


def expected_visits(moves: DataFrame, nodes: DataFrame, kpi: DataFrame, n_steps: int = STEPS, restart: float = RESTART, small: int = SMALL_GRAPH) -> DataFrame:
    """Exact expected arrivals per node over ``n_steps`` steps from the KPI.

    Cases of at most ``small`` nodes are solved one per group; larger ones go
    through the joins. Both give the same numbers.
    """
    size = nodes.groupBy("case").agg(F.count_distinct("entity").alias("_n"))
    large = size.where(F.col("_n") > small).select("case")
    little = size.where(F.col("_n") <= small).select("case")
    chain = _chain(moves, nodes, kpi, restart).join(little, "case", "left_semi")
    starts = kpi.select("case", F.col("entity").alias("_start"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(sorted(set(pdf["node"]) | set(pdf["next"])))
        i, j = names.get_indexer(pdf["node"]), names.get_indexer(pdf["next"])
        whole, arrive = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        np.add.at(whole, (i, j), pdf["w"].to_numpy())
        np.add.at(arrive, (i, j), (pdf["w"] * pdf["arrives"]).to_numpy())
        prob = (names == pdf["_start"].iloc[0]).astype(float)
        visits = np.zeros(len(names))
        for _ in range(n_steps):
            visits += prob @ arrive
            prob = prob @ whole
        return pd.DataFrame({"case": pdf["case"].iloc[0], "node": names, "visits": visits})

    out = chain.join(starts, "case").groupBy("case").applyInPandas(solve, "case string, node string, visits double")
    if large.limit(1).count():
        pick = lambda t: t.join(large, "case", "left_semi")
        out = out.unionByName(visits_by_joins(pick(moves), pick(nodes), pick(kpi), n_steps, restart))
    return out


def rank_nodes(visits: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("case",), digits: int | None = None) -> DataFrame:
    """Most visited first; equal visits keep the column order."""
    v = F.col("visits") if digits is None else F.round("visits", digits)
    rows = visits.withColumn("visits", v).join(nodes.select("case", F.col("entity").alias("node"), "pos"), ["case", "node"])
    return full_rank(rows, list(keys), [F.desc("visits"), F.col("pos")])


def route_stages(graphs: DataFrame, routes: DataFrame) -> DataFrame:
    """The graph each stage walks on; a stage whose graph is missing is an error.

    ``graphs`` holds edges with a ``graph_role``; ``routes`` is (case, stage, graph_role).
    """
    have = graphs.select("case", "graph_role").distinct()
    lost = routes.join(have, ["case", "graph_role"], "left_anti").limit(5).collect()
    if lost:
        raise GateError("no graph for stage " + ", ".join(f"{r['case']}:{r['stage']}" for r in lost))
    return routes.join(graphs, ["case", "graph_role"])
