"""Causal discovery for many cases in one job, from rows of values keyed by case.

A panel is (case, values): one row per moment, the values in the order of the case's ``nodes`` (case, entity, pos), with
positions from 0. Rows are reduced to tiles of centred cross products; edges, tests and orientations are DataFrames
keyed by case. No statistic is held whole by the driver or a closure: a test gets the correlations of its own variables.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rcaspark.operators.edges import PAIR, drop_mutual_required, known_pairs
from rcaspark.session import cut_lineage

TILE = 256  # variables of a tile's side
CHUNK_BYTES = 16 << 20  # values of a case that are reduced at a time
TESTS_PER_ROW = 2048  # subsets of one edge that are one row's work
FIRST_WAVE, GROWTH = 8, 8  # such rows an edge gets at first, and how much more each time nothing was found


def panel(wide: DataFrame, columns: Sequence[str], case: str) -> tuple[DataFrame, DataFrame]:
    """One case's wide table as (panel, nodes)."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    nodes = wide.sparkSession.createDataFrame([(case, c, i) for i, c in enumerate(columns)], "case string, entity string, pos int")
    return wide.select(F.lit(case).alias("case"), values.alias("values")), nodes


def case_panel(wide: DataFrame, columns: Sequence[str], case: str) -> tuple[DataFrame, DataFrame]:
    """A wide table whose column ``case`` tells its cases apart as (panel, nodes); all cases have the same columns."""
    rows = wide.select(F.col(case).cast("string").alias("case"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("values"))
    names = F.array(*[F.struct(F.lit(c).alias("entity"), F.lit(i).alias("pos")) for i, c in enumerate(columns)])
    return rows, rows.select("case").distinct().select("case", F.inline(names))


# -- sufficient statistics -----------------------------------------------------

def _by_case(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray]]:
    """The complete rows of each case as matrices, with ``most`` bytes held at a time."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for case, parts in held.items():
            yield case, np.concatenate(parts)
        held.clear()

    for batch in batches:
        cases, values = batch.column("case"), batch.column("values")
        width = values.value_lengths().to_numpy(zero_copy_only=False)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        starts = np.concatenate([[0], np.cumsum(width)])
        names, of = np.unique(np.array(cases.to_pylist(), dtype=object), return_inverse=True)
        order = np.argsort(of, kind="stable")
        for case, at in zip(names, np.split(order, np.flatnonzero(np.diff(of[order])) + 1)):
            if len(set(width[at].tolist())) != 1:
                raise ValueError(f"case {case} has rows of different lengths")
            rows = flat[starts[at][:, None] + np.arange(width[at[0]])]
            rows = rows[np.isfinite(rows).all(axis=1)]
            if len(rows):
                held.setdefault(case, []).append(rows)
                size += rows.nbytes
            if size > most:
                yield from flush()
                size = 0
    yield from flush()


_TILE_COLUMNS = ["n", "mean_i", "mean_j", "own_i", "own_j", "cross"]
_TILE_SCHEMA = "case string, bi int, bj int, n long, mean_i binary, mean_j binary, own_i binary, own_j binary, cross binary"


def _tiles(side: int, most: int):
    """Tiles of centred cross products of each case's rows, with the means and squares of both sides."""
    names = ["case", "bi", "bj", *_TILE_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for case, x in _by_case(batches, most):
            mean = x.mean(axis=0)
            c = x - mean
            own = (c * c).sum(axis=0)
            blocks = [slice(at, at + side) for at in range(0, x.shape[1], side)]
            for bi, i in enumerate(blocks):
                for bj, j in enumerate(blocks[bi:], bi):
                    parts = [y.tobytes() for y in (mean[i], mean[j], own[i], own[j], c[:, i].T @ c[:, j])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([case], pa.string()), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([len(x)], pa.int64()),
                         *(pa.array([p], pa.binary()) for p in parts)], names)

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile of several, each with its own centre."""
    n, mean_i, mean_j, own_i, own_j, cross = 0, 0.0, 0.0, 0.0, 0.0, 0.0
    for m, *parts in pdf.sort_values("mean_i")[_TILE_COLUMNS].itertuples(index=False):
        a, b, aa, bb, ab = (np.frombuffer(p) for p in parts)
        ab = ab.reshape(len(a), len(b))
        di, dj, w = a - mean_i, b - mean_j, n * m / (n + m)
        own_i, own_j, cross = own_i + aa + di * di * w, own_j + bb + dj * dj * w, cross + ab + np.outer(di, dj) * w
        n, mean_i, mean_j = n + m, mean_i + di * (m / (n + m)), mean_j + dj * (m / (n + m))
    first = pdf.iloc[0]
    return pd.DataFrame([[first["case"], first["bi"], first["bj"], n, *(np.asarray(x).tobytes() for x in (mean_i, mean_j, own_i, own_j, cross))]],
                        columns=["case", "bi", "bj", *_TILE_COLUMNS])


def moment_tiles(rows: DataFrame) -> DataFrame:
    """(case, bi, bj, n, ...) for bi <= bj: the tiles of each case's cross products.

    A task sends its sums tile by tile; tiles of one place are joined in two
    steps, so that no task gets those of all tasks.
    """
    parts = rows.select("case", "values").where("case is not null and values is not null").mapInArrow(_tiles(TILE, CHUNK_BYTES), _TILE_SCHEMA).withColumn("part", F.spark_partition_id() % 64)
    some = parts.groupBy("case", "bi", "bj", "part").applyInPandas(_joined, _TILE_SCHEMA)
    return some.groupBy("case", "bi", "bj").applyInPandas(_joined, _TILE_SCHEMA)


def _cells(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own_i, own_j = np.frombuffer(row["own_i"]), np.frombuffer(row["own_j"])
                cross = np.frombuffer(row["cross"]).reshape(len(own_i), len(own_j))
                with np.errstate(all="ignore"):
                    r = cross / np.sqrt(np.outer(own_i, own_j))
                i, j = np.indices(cross.shape)
                i, j = i + row["bi"] * side, j + row["bj"] * side
                kept = i <= j
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["case"]] * int(kept.sum()), pa.string()), pa.array(i[kept], pa.int32()), pa.array(j[kept], pa.int32()),
                    pa.array(np.full(int(kept.sum()), row["n"]), pa.int64()), pa.array(cross[kept] / row["n"]), pa.array(r[kept], from_pandas=True),
                ], ["case", "i", "j", "n", "cov", "r"])

    return run


def cross_moments(rows: DataFrame) -> DataFrame:
    """(case, i, j, n, cov, r) for i <= j, of any number of variables.

    Rows that hold a null or a value that is not finite are left out; all rows of
    a case have one length. Of a constant variable r is null.
    """
    return moment_tiles(rows).mapInArrow(_cells(TILE), "case string, i int, j int, n long, cov double, r double")


def named_moments(moments: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by entity: (case, a, b, n, cov, r)."""
    at = nodes.select("case", "entity", "pos")
    return moments.join(at.withColumnsRenamed({"entity": "a", "pos": "i"}), ["case", "i"]).join(
        at.withColumnsRenamed({"entity": "b", "pos": "j"}), ["case", "j"]).select("case", "a", "b", "n", "cov", "r")


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, cov, r) of a wide table's columns, each pair once."""
    names = F.array(*[F.lit(c) for c in columns])
    rows, _ = panel(wide, columns, "")
    return cross_moments(rows).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n", "cov", "r")


# -- independence tests --------------------------------------------------------

def partial_correlations(corr: np.ndarray) -> np.ndarray:
    """For each matrix of a stack, the partial correlation of its first two variables given the others."""
    if corr.shape[1] == 2:
        return corr[:, 0, 1]
    inv = np.linalg.pinv(corr, hermitian=True)
    return -inv[:, 0, 1] / np.sqrt(np.abs(inv[:, 0, 0] * inv[:, 1, 1]))


def fisher_z(r: np.ndarray, n, s: int) -> np.ndarray:
    """Test statistic of (partial) correlations given s variables; large means dependent."""
    r = np.clip(r, -1 + 1e-12, 1 - 1e-12)
    return np.sqrt(np.maximum(np.asarray(n) - s - 3, 0)) * np.abs(np.arctanh(r))


# A test maps a stack of correlation matrices (the pair first, then the given variables) and the row counts to whether
# the given variables separate the pair.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def fisher_test(alpha: float) -> Test:
    limit = NormalDist().inv_cdf(1 - alpha / 2)

    def separates(corr, n):
        return fisher_z(partial_correlations(corr), n, corr.shape[1] - 2) <= limit

    return separates


TESTS: dict[str, Callable[[float], Test]] = {"fisherz": fisher_test}


def _combination(m: int, s: int, index: int) -> list[int]:
    """The subset of size s of range(m) at a place in lexicographic order."""
    out, low = [], 0
    for left in range(s, 0, -1):
        while (skip := math.comb(m - low - 1, left - 1)) <= index:
            index -= skip
            low += 1
        out.append(low)
        low += 1
    return out


def _subsets(m: int, s: int, first: int, count: int) -> Iterator[tuple[int, ...]]:
    """``count`` subsets in lexicographic order from place ``first``."""
    at = _combination(m, s, first)
    for _ in range(min(count, math.comb(m, s) - first)):
        yield tuple(at)
        i = s - 1
        while i >= 0 and at[i] == m - s + i:
            i -= 1
        if i < 0:
            return
        at[i:] = range(at[i] + 1, at[i] + 1 + s - i)


def _ranges(m: int, s: int, size: int) -> int:
    return -(-math.comb(m, s) // size)


# -- skeleton --------------------------------------------------------------------

_CUT = "case string, x int, y int, side int, place long, sepset array<int>"


def skeleton(moments: DataFrame, test: Test, banned: DataFrame | None = None, max_level: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges (case, x, y) with x < y, separating sets (case, x, y, sepset)), level by level for all cases at once.

    Within a level all tests of a case see the same neighbours, so their order
    does not matter. The subsets of one edge are cut into ranges that are tested
    in different tasks, wave by wave: an edge that is separated gets no more
    ranges. The first separating subset in order is kept. ``banned`` pairs
    (case, x, y) are never tested and give no separating set. A variable without
    a correlation (a constant) is independent of all others.
    """
    moments = cut_lineage(moments.where("i < j").select("case", F.col("i").alias("x"), F.col("j").alias("y"), "n", F.coalesce("r", F.lit(0.0)).alias("r")))
    every = moments
    if banned is not None:
        every = every.join(banned.select("case", "x", "y").distinct(), ["case", "x", "y"], "left_anti")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            corr = np.ones((len(pdf), 2, 2))
            corr[:, 0, 1] = corr[:, 1, 0] = pdf["r"]
            cut = pdf[test(corr, pdf["n"].to_numpy())] if len(pdf) else pdf
            yield cut[["case", "x", "y"]].assign(sepset=pd.Series([[]] * len(cut), dtype=object, index=cut.index))

    cuts = cut_lineage(every.mapInPandas(alone, "case string, x int, y int, sepset array<int>"))
    level = 1
    while True:
        edges = every.join(cuts.select("case", "x", "y"), ["case", "x", "y"], "left_anti").select("case", "x", "y")
        near = cut_lineage(_both(edges).groupBy("case", "x").agg(F.array_sort(F.collect_list("y")).alias("near")))
        widest = near.agg(F.max(F.size("near"))).first()[0] or 0
        if widest - 1 < level or (max_level is not None and level > max_level):
            return edges, cuts
        # Every level is stored; what is left follows from the stored levels.
        cuts = cuts.unionByName(_level(near.where(F.size("near") > level), moments, level, widest - 1, test))
        level += 1


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("case", "x", "y").unionByName(edges.select("case", F.col("y").alias("x"), F.col("x").alias("y")))


def _level(near: DataFrame, moments: DataFrame, s: int, widest: int, test: Test) -> DataFrame:
    """(case, x, y, sepset) of the edges that s of a node's neighbours separate."""
    # The correlations among a node and its neighbours, each as often as nodes have both.
    hood = near.select("case", "x", F.array_sort(F.concat("near", F.array("x"))).alias("hood"))
    pairs = hood.select("case", "x", F.posexplode("hood").alias("at", "i"), "hood").select(
        "case", "x", "i", F.explode(F.slice("hood", F.col("at") + 2, F.size("hood"))).alias("j"))
    held = pairs.join(moments.withColumnsRenamed({"x": "i", "y": "j"}), ["case", "i", "j"]).groupBy("case", "x").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "j", "r"))).alias("cells"))
    held = cut_lineage(held.join(hood, ["case", "x"]).select("case", F.col("x").alias("owner"), "n", "hood", F.col("cells.r").alias("r")))
    items = cut_lineage(near.select("case", F.col("x").alias("owner"), F.explode("near").alias("other"), F.size("near").alias("m")))
    hits, first, wave, last = None, 0, FIRST_WAVE, _ranges(widest, s, TESTS_PER_ROW)
    while first < last:
        left = items if hits is None else items.join(_closed(hits), ["case", "owner", "other"], "left_anti")
        work = left.mapInPandas(_handed(s, first, first + wave, TESTS_PER_ROW), "case string, owner int, other int, part long")
        # Ranges are spread after the join, as they are the work and one node may have most of them.
        found = work.join(held, ["case", "owner"]).repartition("case", "owner", "other", "part").mapInPandas(_tested(s, test, TESTS_PER_ROW), _CUT)
        found = cut_lineage(found.groupBy("case", "x", "y", "side").agg(F.min_by("sepset", "place").alias("sepset")))
        hits = found if hits is None else cut_lineage(hits.unionByName(found))
        first, wave = first + wave, wave * GROWTH
    return hits.groupBy("case", "x", "y").agg(F.min_by("sepset", "side").alias("sepset"))


def _closed(hits: DataFrame) -> DataFrame:
    """(case, owner, other) that need no more ranges: a hit of the first side settles both, one of the second its own."""
    settled = hits.where("side = 0").select("case", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
    own = hits.where("side = 1").select("case", F.col("y").alias("owner"), F.col("x").alias("other"))
    return settled.select("case", F.col("e.x").alias("owner"), F.col("e.y").alias("other")).unionByName(own).distinct()


def _handed(s: int, first: int, last: int, size: int):
    """A row for each range of this wave; counts are exact whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for case, owner, other, m in pdf[["case", "owner", "other", "m"]].itertuples(index=False):
                parts = range(first, min(last, _ranges(int(m) - 1, s, size)))
                for at in range(0, len(parts), 4096):
                    some = parts[at : at + 4096]
                    yield pd.DataFrame({"case": case, "owner": owner, "other": other, "part": some})

    return run


def _tested(s: int, test: Test, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for case, owner, other, part, n, hood, r in pdf[["case", "owner", "other", "part", "n", "hood", "r"]].itertuples(index=False):
                hood = np.asarray(hood)
                corr = np.zeros((len(hood), len(hood)))
                corr[np.triu_indices(len(hood), 1)] = r
                corr += corr.T + np.eye(len(hood))
                ends = np.searchsorted(hood, [min(owner, other), max(owner, other)])
                pool = np.setdiff1d(np.arange(len(hood)), ends)
                at = int(part) * size
                todo = _subsets(len(pool), s, at, size)
                while chunk := list(itertools.islice(todo, 256)):
                    which = np.concatenate([np.tile(ends, (len(chunk), 1)), pool[np.array(chunk)]], axis=1)
                    found = np.flatnonzero(test(corr[which[:, :, None], which[:, None, :]], np.full(len(chunk), n)))
                    if found.size:
                        given = hood[pool[list(chunk[found[0]])]]
                        out.append((case, min(owner, other), max(owner, other), int(owner > other), at + int(found[0]), given.tolist()))
                        break
                    at += len(chunk)
            yield pd.DataFrame(out, columns=["case", "x", "y", "side", "place", "sepset"])

    return run


# -- orientation -------------------------------------------------------------------

def orient(edges: DataFrame, cuts: DataFrame, required: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """(case, cause, effect, mark) from skeletons and their separating sets, by position.

    Known pairs come first, then unshielded colliders, then the propagation rules
    until nothing changes in any case. A pair that two colliders point both ways
    becomes ``<->``; a pair required both ways stays undirected. All steps are
    joins keyed by case.
    """
    both = _both(edges).select("case", F.col("x").alias("cause"), F.col("y").alias("effect"))
    ban = known = None
    if forbidden is not None or required is not None:
        both = cut_lineage(both)
        none = both.where("false")
        ban = none if forbidden is None else both.join(forbidden.distinct(), PAIR, "left_semi")
        need = none if required is None else both.join(required.distinct(), PAIR, "left_semi")
        need = need.join(_swap(need), PAIR, "left_anti")
        one_way = _swap(ban).join(ban, PAIR, "left_anti")
        known = cut_lineage(need.unionByName(one_way.join(_swap(need), PAIR, "left_anti")).distinct())
        ban = cut_lineage(ban)

    # x - z - y with x, y separated by a set without z.
    left = both.select("case", F.col("cause").alias("x"), F.col("effect").alias("z"))
    right = both.select("case", F.col("cause").alias("y"), F.col("effect").alias("z"))
    vees = cuts.join(left, ["case", "x"]).join(right, ["case", "y", "z"]).where(~F.array_contains("sepset", F.col("z")))
    heads = vees.select("case", F.col("x").alias("cause"), F.col("z").alias("effect")).unionByName(
        vees.select("case", F.col("y").alias("cause"), F.col("z").alias("effect"))).distinct()
    if known is not None:
        heads = heads.join(known.unionByName(_swap(known)), PAIR, "left_anti")
    heads = cut_lineage(heads)
    clash = heads.join(_swap(heads), PAIR, "left_semi")
    directed = heads.join(clash, PAIR, "left_anti")
    if known is not None:
        directed = known.unionByName(directed)
    loose = both.join(directed.unionByName(_swap(directed)).unionByName(clash), PAIR, "left_anti")

    rounds = 0
    while True:
        new = _propagate(directed, loose, both)
        if ban is not None:
            new = new.join(ban, PAIR, "left_anti")
        # Where two rules ask for both ways at once, the way from the earlier column holds.
        new = new.groupBy("case", F.least("cause", "effect").alias("_a"), F.greatest("cause", "effect").alias("_b")).agg(
            F.min(F.struct("cause", "effect")).alias("_e")).select("case", "_e.*")
        new = cut_lineage(new)
        if new.isEmpty():
            break
        directed = directed.unionByName(new)
        loose = loose.join(new.unionByName(_swap(new)), PAIR, "left_anti")
        rounds += 1
        if rounds % 4 == 0:
            directed, loose = cut_lineage(directed), cut_lineage(loose)
    mark = lambda t, m: t.withColumn("mark", F.lit(m))
    return mark(directed, "->").unionByName(mark(loose, "--")).unionByName(mark(clash, "<->"))


def _swap(pairs: DataFrame) -> DataFrame:
    return pairs.select("case", F.col("effect").alias("cause"), F.col("cause").alias("effect"))


def _propagate(directed: DataFrame, loose: DataFrame, both: DataFrame) -> DataFrame:
    """Loose pairs that the published propagation rules direct, as (case, cause, effect)."""
    ends = lambda t, a, b: t.select("case", F.col("cause").alias(a), F.col("effect").alias(b))
    go = ends(directed, "a", "b")
    # a -> b - c without a - c: b -> c.
    onward = go.join(ends(loose, "b", "c"), ["case", "b"]).join(ends(both, "a", "c"), ["case", "a", "c"], "left_anti")
    r1 = onward.select("case", F.col("b").alias("cause"), F.col("c").alias("effect"))
    # a -> b -> c with a - c: a -> c.
    two = go.join(ends(directed, "b", "c"), ["case", "b"]).select("case", F.col("a").alias("cause"), F.col("c").alias("effect"))
    r2 = loose.join(two.distinct(), PAIR, "left_semi")
    # a - b, a - c -> b, a - d -> b, without c - d: a -> b.
    kite = ends(loose, "a", "b").join(ends(loose, "a", "c"), ["case", "a"]).join(ends(directed, "c", "b"), ["case", "b", "c"])
    pair = kite.join(kite.withColumnRenamed("c", "d"), ["case", "a", "b"]).where("c < d").join(ends(both, "c", "d"), ["case", "c", "d"], "left_anti")
    r3 = pair.select("case", F.col("a").alias("cause"), F.col("b").alias("effect"))
    return r1.unionByName(r2.select(*PAIR)).unionByName(r3)


# -- methods -----------------------------------------------------------------------

def _positions(constraints: DataFrame | None, nodes: DataFrame, verdict: int) -> DataFrame | None:
    """Constraint pairs by position, names matched exactly."""
    if constraints is None:
        return None
    at = nodes.select("case", "entity", "pos")
    pairs = known_pairs(constraints, verdict).join(at.withColumnsRenamed({"entity": "cause", "pos": "_c"}), ["case", "cause"]).join(
        at.withColumnsRenamed({"entity": "effect", "pos": "_e"}), ["case", "effect"])
    return pairs.select("case", F.col("_c").alias("cause"), F.col("_e").alias("effect")).distinct()


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    at = nodes.select("case", "entity", "pos")
    rest = [c for c in edges.columns if c not in PAIR]
    edges = edges.withColumnsRenamed({"cause": "_c", "effect": "_e"})
    return edges.join(at.withColumnsRenamed({"entity": "cause", "pos": "_c"}), ["case", "_c"]).join(
        at.withColumnsRenamed({"entity": "effect", "pos": "_e"}), ["case", "_e"]).select(*PAIR, *rest)


def constraint_based(rows: DataFrame, nodes: DataFrame, constraints: DataFrame | None = None, alpha: float = 0.05, test: str | Test = "fisherz", max_level: int | None = None) -> DataFrame:
    """Skeleton by conditional independence, then orientation: (case, cause, effect, mark)."""
    test = TESTS[test](alpha) if isinstance(test, str) else test
    required, forbidden = _positions(constraints, nodes, 1), _positions(constraints, nodes, 0)
    banned = None
    if forbidden is not None:
        required, forbidden = cut_lineage(required), cut_lineage(forbidden)
        banned = forbidden.join(_swap(forbidden), PAIR, "left_semi").where("cause < effect").select("case", F.col("cause").alias("x"), F.col("effect").alias("y"))
    edges, cuts = skeleton(cross_moments(rows), test, banned, max_level)
    # Symmetric marks are stored both ways already: both orders of the pair are present.
    return _named(orient(edges, cuts, required, forbidden), nodes)


def single_parent_scores(rows: DataFrame, nodes: DataFrame, allowed: DataFrame | None = None, k: float = 1.0) -> DataFrame:
    """BIC of each (child, parent) and whether it is the child's best choice.

    A parent must beat having none, whose score is 0.
    """
    c = named_moments(cross_moments(rows).where("i <> j"), nodes)
    pairs = c.select("case", F.col("a").alias("cause"), F.col("b").alias("effect"), "n", "r").unionByName(
        c.select("case", F.col("b").alias("cause"), F.col("a").alias("effect"), "n", "r"))
    scored = pairs.select(*PAIR, (F.col("n") * F.log(F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300))) + k * F.log("n")).alias("score"))
    if allowed is not None:
        scored = scored.join(allowed.select(*PAIR).distinct(), PAIR, "left_semi")
    best = scored.groupBy("case", "effect").agg(F.min_by("cause", F.struct("score", "cause")).alias("_best"), F.min("score").alias("_low"))
    return scored.join(best, ["case", "effect"]).select(
        *PAIR, "score", ((F.col("cause") == F.col("_best")) & (F.col("_low") < 0)).alias("chosen"))


# Constants of the published maximum entropy approximation.
ENTROPY_K1, ENTROPY_K2, ENTROPY_GAMMA = 79.047, 7.4129, 0.37457

_STATE = "case string, p int, mean binary, cov binary, basis binary, heard binary, waits binary, taken array<int>"


def _begun(pdf: pd.DataFrame) -> pd.DataFrame:
    """A case's state before the first step, from its tiles and verdicts."""
    mean, parts = {}, {}
    for bi, bj, n, mean_i, mean_j, cross in pdf[["bi", "bj", "n", "mean_i", "mean_j", "cross"]].itertuples(index=False):
        mean[bi], mean[bj] = np.frombuffer(mean_i), np.frombuffer(mean_j)
        parts[bi, bj] = np.frombuffer(cross).reshape(len(mean[bi]), len(mean[bj])) / n
    k = len(mean)
    cov = np.block([[parts[i, j] if i <= j else parts[j, i].T for j in range(k)] for i in range(k)])
    p = len(cov)
    heard, waits = np.ones((p, p), bool), np.zeros((p, p), bool)
    first = pdf.iloc[0]
    for pairs, into, value in ((first["forbidden"], heard, False), (first["required"], waits, True)):
        for pair in pairs if pairs is not None else []:
            into[pair["effect"], pair["cause"]] = value
    return pd.DataFrame([[first["case"], p, np.concatenate([mean[i] for i in range(k)]).tobytes(), cov.tobytes(), np.eye(p).tobytes(), heard.tobytes(), waits.tobytes(), []]],
                        columns=["case", "p", "mean", "cov", "basis", "heard", "waits", "taken"])


def _opened(row) -> tuple:
    p = int(row["p"])
    square = lambda name, kind=float: np.frombuffer(row[name], kind).reshape(p, p)
    taken = list(row["taken"])
    left = [i for i in range(p) if i not in set(taken)]
    return p, np.frombuffer(row["mean"]), square("cov"), square("basis"), square("heard", bool), square("waits", bool), taken, left


def _units(cov: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit forms of the current variables, and slope and spread of each one's residual on each other."""
    inner = basis @ cov @ basis.T
    scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    rho = np.clip(inner / np.outer(scale, scale), -1, 1)
    rest = np.sqrt(np.maximum(1 - rho ** 2, 1e-300))
    np.fill_diagonal(rest, 1.0)
    np.fill_diagonal(rho, 0.0)  # the diagonal holds the variables themselves
    return basis / scale[:, None], rho, rest


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For chunks of rows beside their case's state: sums of both averages that the entropy approximation needs."""
    for batch in batches:
        for row in batch.to_pylist():
            p, mean, cov, basis, _, _, _, left = _opened(row)
            unit, slope, rest = _units(cov, basis[left])
            u = (np.frombuffer(row["rows"]).reshape(-1, p) - mean) @ unit.T
            k = len(left)
            sums = np.zeros((2, k, k))
            for j in range(k):
                e = (u - u[:, [j]] * slope[:, j]) / rest[:, j]
                big = np.abs(e)
                sums[0, :, j] = (big + np.log1p(np.exp(-2 * big)) - math.log(2)).sum(axis=0)
                sums[1, :, j] = (e * np.exp(-e * e / 2)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([row["case"]], pa.string()), pa.array([len(u)], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["case", "n", "sums"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([[pdf["case"].iloc[0], pdf["n"].sum(), sum(np.frombuffer(x) for x in sorted(pdf["sums"])).tobytes()]], columns=["case", "n", "sums"])


def _stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each case's state with one more variable taken: the most independent of its residuals."""
    for pdf in batches:
        out = []
        for _, row in pdf.iterrows():
            p, _, cov, basis, heard, waits, taken, left = _opened(row)
            if len(left) > 1:
                k = len(left)
                cosh, gauss = np.frombuffer(row["sums"]).reshape(2, k, k) / row["n"]
                h = (1 + math.log(2 * math.pi)) / 2 - ENTROPY_K1 * (cosh - ENTROPY_GAMMA) ** 2 - ENTROPY_K2 * gauss ** 2
                own = np.diag(h)
                gain = (own[None, :] + h) - (own[:, None] + h.T)  # for i as cause of j
                np.fill_diagonal(gain, 0.0)
                loss = np.where(heard[np.ix_(left, left)], np.minimum(gain, 0.0) ** 2, 0.0).sum(axis=1)
                free = [i for i in left if not waits[i, left].any()] or left
                best = min(free, key=lambda i: (loss[left.index(i)], i))
                basis = basis.copy()
                chosen = basis[best].copy()
                for i in set(left) - {best}:
                    basis[i] -= (basis[i] @ cov @ chosen) / max(chosen @ cov @ chosen, 1e-300) * chosen
                taken = [*taken, best]
            if p - len(taken) == 1:
                taken = [*taken, *(set(range(p)) - set(taken))]
            out.append([row["case"], p, row["mean"], row["cov"], basis.tobytes(), row["heard"], row["waits"], taken])
        yield pd.DataFrame(out, columns=["case", "p", "mean", "cov", "basis", "heard", "waits", "taken"])


def exogenous_order(rows: DataFrame, tiles: DataFrame, required: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """(case, p, cov, taken, ...): causal orders by repeatedly taking the variable most independent of its residuals.

    A step is one pass over the rows of all cases and gathers, for all pairs at
    once, the two averages the entropy approximation needs. Residuals are kept
    as coefficients of the original variables, so no intermediate table is
    written; a case's state is a row, and tasks work out its next step. A variable
    with a required cause still waiting is not taken, unless all have one; signs
    that a forbidden cause comes first are ignored.
    """
    most = CHUNK_BYTES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for case, x in _by_case(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array([case], pa.string()), pa.array([x.tobytes()], pa.binary())], ["case", "rows"])

    chunks = cut_lineage(rows.select("case", "values").where("case is not null and values is not null").mapInArrow(packed, "case string, rows binary"))
    begun = tiles
    for name, pairs in (("required", required), ("forbidden", forbidden)):
        none = F.lit(None).cast("array<struct<cause:int,effect:int>>").alias(name)
        if pairs is None:
            begun = begun.select("*", none)
        else:
            begun = begun.join(pairs.groupBy("case").agg(F.collect_list(F.struct("cause", "effect")).alias(name)), "case", "left")
    state = cut_lineage(begun.groupBy("case").applyInPandas(_begun, _STATE))
    steps = (state.agg(F.max("p")).first()[0] or 0) - 1
    for _ in range(steps):
        open_ = state.where(F.size("taken") < F.col("p"))
        sums = chunks.join(open_, "case").mapInArrow(_scanned, "case string, n long, sums binary").withColumn("part", F.spark_partition_id() % 64)
        sums = sums.groupBy("case", "part").applyInPandas(_added, "case string, n long, sums binary").groupBy("case").applyInPandas(
            _added, "case string, n long, sums binary")
        state = cut_lineage(state.join(sums, "case", "left").mapInPandas(_stepped, _STATE))
    return state


def _regressed(alpha: float):
    """For a case's effect, its causes among the earlier variables, from one inverse."""
    limit = NormalDist().inv_cdf(1 - alpha / 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                _, _, cov, _, heard, _, taken, _ = _opened(row)
                effect = taken[row["place"]]
                causes = [c for c in taken[: row["place"]] if heard[effect, c]]
                if not causes:
                    continue
                scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
                corr = cov / np.outer(scale, scale)
                # The last row of one inverse holds the partial correlations of the effect with all its causes.
                inv = np.linalg.pinv(corr[np.ix_([*causes, effect], [*causes, effect])], hermitian=True)
                partial = -inv[-1, :-1] / np.sqrt(np.abs(inv[-1, -1] * np.diag(inv)[:-1]))
                weights = np.linalg.pinv(cov[np.ix_(causes, causes)], hermitian=True) @ cov[causes, effect]
                kept = fisher_z(partial, row["n"], len(causes) - 1) > limit
                out += [(row["case"], c, effect, float(w)) for c, w, k in zip(causes, weights, kept) if k]
            yield pd.DataFrame(out, columns=["case", "cause", "effect", "weight"])

    return run


def linear_non_gaussian(rows: DataFrame, nodes: DataFrame, constraints: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Order, then each variable regressed on those before it: (case, cause, effect, mark, weight).

    Weights follow from the covariance alone; a cause is kept where its partial
    correlation given the other earlier variables is significant. Pairs required
    both ways lose both verdicts first. A forbidden cause is left out of the
    regression, so it is no edge and takes no weight from others; a required
    cause comes earlier, yet must be significant as well.
    """
    constraints = None if constraints is None else drop_mutual_required(constraints)
    tiles = cut_lineage(moment_tiles(rows))
    state = exogenous_order(rows, tiles, _positions(constraints, nodes, 1), _positions(constraints, nodes, 0))
    counts = tiles.groupBy("case").agg(F.max("n").alias("n"))
    effects = state.where("p > 1").join(counts, "case").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("p") - 1)))
    # One effect is one row's work; they are dealt to tasks apart from each other.
    found = effects.repartition("case", "place").mapInPandas(_regressed(alpha), "case string, cause int, effect int, weight double")
    return _named(found, nodes).select(*PAIR, F.lit("->").alias("mark"), "weight")


def best_single_parents(rows: DataFrame, nodes: DataFrame, constraints: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Single-parent graph over the pairs that constraints allow; unknown counts as forbidden."""
    allowed = None if constraints is None else known_pairs(constraints, 1)
    chosen = single_parent_scores(rows, nodes, allowed).where("chosen")
    return chosen.select(*PAIR, F.lit("->").alias("mark"))


METHODS: dict[str, Callable[..., DataFrame]] = {
    "pc": constraint_based,
    "exact": best_single_parents,
    "lingam": linear_non_gaussian,
}


def discover_cases(rows: DataFrame, nodes: DataFrame, method: str = "pc", **options) -> DataFrame:
    """(case, cause, effect, mark) of all cases of a panel by a named method; more may be added to ``METHODS``."""
    return METHODS[method](rows, nodes, **options).select(*PAIR, "mark")


def discover(wide: DataFrame, columns: Sequence[str], case: str, method: str = "pc", **options) -> DataFrame:
    """The same for one case's wide table."""
    rows, nodes = panel(wide, columns, case)
    return discover_cases(rows, nodes, method, **options)
