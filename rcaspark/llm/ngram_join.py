"""N-gram Jaccard join: documents whose shingle sets overlap enough, grouped by reachability.

Four steps, all exact:

1. Candidates. Sets at similarity num/den differ in at most H = n * (den - num) // num shingles. Each set is cut
   by hash ranges into more than H parts, so a linked pair agrees in whole parts; a part's hash is its signature.
   With p parts at least p - H agree, hence of the H + 1 fullest parts of either side one is shared. Sharing a
   part of several shingles is rare for unrelated texts, also for those that quote one passage.
2. Blocks. A linked pair hangs together by signatures; also by finer signatures, with narrower size classes and hence
   fuller parts; and by rare shingles: with all shingles in one order, rare ones first by a fixed table of counters,
   it shares one of either side's first n - T + 1 (the short lists). Documents that hang together in all three ways
   form a block. Texts that only quote one passage differ in one of them, as a rule.
3. Cells. A block is dealt to cells of bounded size; its first cell
   is the anchor, which every other cell of the block searches.
4. T-occurrence search in each cell (DivideSkip): the L longest inverted lists of a query are set aside, the short
   ones are merged into occurrence counts, and what occurs T - L times is probed by binary search in the long ones.
   Pairs that are already connected need no search. In blocks of several cells, documents that did not join the
   block's largest component then search the remaining cells.

Hot groups: equal sets become one representative; equal signatures are reduced inside each task before the
shuffle, so a group sends a row per task; a hot block is spread over its cells.

Disk: texts and sets pass a Bloom filter of the documents still asked for before a join shuffles them or a signature
is worked out, and tables of sets go as soon as they have been read for the last time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut, shuffles_released
from .bloom import kept, number_filter
from .graph import components
from .words import mix, shingle_set, utf8_rows

#: Spare parts beyond the number that similarity asks for; the emptiest parts give no signature.
SPARE_PARTS = 2
#: Documents and shingles that one side of a cell holds on average.
CELL_DOCS, CELL_SHINGLES = 64, 1 << 18
WIDE_CELL_DOCS, WIDE_CELL_SHINGLES = 2048, 1 << 20
#: Growth of size classes: for all documents, and for the candidates among them.
WIDE_CLASSES, NARROW_CLASSES = 2.0, 1.1
#: Counters of shingles that order them by frequency; any order is exact, a better one only makes smaller blocks.
COUNTERS = 1 << 18


def max_difference(n: int, num: int, den: int) -> int:
    """How many shingles a set of n and a linked set can differ in: |x ^ y| <= (1 - t) |x u y| <= (1 - t) n / t."""
    return n * (den - num) // num


@lru_cache(maxsize=4)
def _class_bounds(growth: float) -> np.ndarray:
    """Least sizes of the size classes, each about ``growth`` times the one before."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * growth)))
    return np.array(bounds, np.int64)


def signatures(items: np.ndarray, num: int, den: int, growth: float = WIDE_CLASSES) -> np.ndarray:
    """Hashes of the fullest parts of a sorted set, for its own size class and those a larger partner may be in.

    Narrower classes give fuller parts, hence fewer chance meetings, but more signatures.
    """
    n = len(items)
    differ = max_difference(n, num, den)
    if not differ:
        return np.empty(0, np.uint64)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(items), out=running[1:])
    bounds, found = _class_bounds(growth), []
    size_class = int(np.searchsorted(bounds, n, "right")) - 1
    while int(bounds[size_class]) * num <= n * den:
        parts = max_difference(int(bounds[size_class + 1]) - 1, num, den) + 1 + SPARE_PARTS
        ids = np.arange(parts, dtype=np.uint64)
        part_of = ((items >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        at = np.searchsorted(part_of, np.arange(parts + 1, dtype=np.uint64))
        held = np.diff(at)
        fullest = np.argsort(-held, kind="stable")[: differ + 1]
        content = (running[at[1:]] - running[at[:-1]])[fullest]
        name = mix(ids[fullest] * np.uint64(1 << 10) + np.uint64(size_class))
        found.append(mix(content + name + held[fullest].astype(np.uint64)))
        size_class += 1
    return np.concatenate(found)


def _digest(items: np.ndarray) -> tuple[int, int]:
    signed = items.view(np.int64)
    return int(np.sum(mix(items)).astype(np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(signed))


def _set_digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in utf8_rows(batch.column("text")):
                items = shingle_set(raw, n)
                rows.append((len(items), *(_digest(items) if len(items) else (0, 0))))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "k1", "k2"])

    return run


def _signature_rows(found_in):
    """(sig, doc, link): a signature's smallest document here, and an edge for every other document that has it.

    ``found_in(batch)`` yields each document with its signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc, found in found_in(batch):
                sigs.append(found)
                docs.append(np.full(len(found), doc, np.int64))
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            smallest = doc[first][np.cumsum(first) - 1] if len(sig) else doc
            edges = np.unique(np.stack([doc, smallest], 1)[~first], axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            spread = mix(mix(edges[:, 0].view(np.uint64)) + edges[:, 1].view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sig[first], spread]).view(np.int64)),
                 pa.array(np.concatenate([doc[first], edges[:, 0]])), pa.array(np.concatenate([doc[first], edges[:, 1]]))],
                ["sig", "doc", "link"])

    return run


def _sent_filter(numbers: DataFrame):
    return numbers.sparkSession.sparkContext.broadcast(number_filter(numbers))


def _asked(rows: DataFrame, column: str, sent) -> DataFrame:
    """The rows whose number is in the filter, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kept(batch, column, sent.value)

    return rows.mapInArrow(run, rows.schema)


def _linked(rows: DataFrame, found_in) -> DataFrame:
    """(doc, other): edges by which all documents that share a signature hang together."""
    rows = rows.mapInArrow(_signature_rows(found_in), "sig long, doc long, link long")
    rows = rows.withColumn("root", F.min("doc").over(Window.partitionBy("sig")))
    pairs = rows.where("root <> doc or link <> doc").select("doc", F.explode(F.array("root", "link")).alias("other"))
    return pairs.where("doc <> other").distinct()


def _items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for raw in utf8_rows(batch.column("items")):
        yield np.frombuffer(raw.tobytes(), np.uint64)


def _frequencies(held: DataFrame) -> np.ndarray:
    """Shingles per counter over all rows (items): sums per task, added by Spark; ``COUNTERS`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for items in _items(batch):
                np.add.at(total, (items % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    with shuffles_released(held.sparkSession):
        sums = held.select("items").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[sums.column("counter").to_numpy()] = sums.column("n").to_numpy()
    return total


def _rarest(sent, num: int, den: int):
    def found_in(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        often = sent.value
        for doc, items in zip(batch.column("node").to_pylist(), _items(batch)):
            short = len(items) - -(-num * len(items) // den) + 1
            order = np.lexsort((items, often[(items % np.uint64(COUNTERS)).astype(np.int64)]))
            yield doc, items[order[:short]]

    return found_in


def _sizes(sent):
    """(node, n, typical): the size of a set and the mean log frequency of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.log1p(sent.value)
        for batch in batches:
            rows = [(len(x), float(log[(x % np.uint64(COUNTERS)).astype(np.int64)].mean()) if len(x) else 0.0) for x in _items(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.float64())],
                ["node", "n", "typical"])

    return run


def _shingle_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, n).tobytes() for raw in utf8_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "items"])

    return run


class Lists:
    """Inverted lists of a cell's documents: for each shingle the ascending positions of the documents with it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        self.tokens, self.start = np.unique(tokens, return_index=True)
        self.end = np.append(self.start[1:], len(tokens))

    def search(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Positions of all documents y with den * |x & y| >= num * |x u y|, by DivideSkip."""
        need = -(-num * len(query) // den)  # T: the least overlap that any linked document has
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == query[inside]]
        if not len(query) or len(at) < need:
            return np.empty(0, np.int64)
        at = at[np.argsort(self.end[at] - self.start[at], kind="stable")]
        longest = int(self.end[at[-1]] - self.start[at[-1]])
        skip = min(need - 1, int(need / (0.0085 * np.log2(max(2, longest)) + 1)))  # the published rule for L
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        lengths = self.end[short] - self.start[short]
        offsets = np.repeat(self.start[short] - np.cumsum(lengths) + lengths, lengths)
        seen = np.bincount(self.owner[offsets + np.arange(int(lengths.sum()))], minlength=len(self.sizes))
        found = np.flatnonzero(seen >= need - skip)
        # Overlap that the two sizes ask for: (num + den) * overlap >= num * (|x| + |y|).
        asked = -(-num * (len(query) + self.sizes[found]) // (num + den))
        overlap = seen[found]
        for left, token in enumerate(long[::-1]):
            able = overlap + (len(long) - left) >= asked
            if not able.all():
                found, overlap, asked = found[able], overlap[able], asked[able]
            if not len(found):
                break
            held = self.owner[self.start[token] : self.end[token]]
            place = np.minimum(np.searchsorted(held, found), len(held) - 1)
            overlap = overlap + (held[place] == found)
        return found[overlap >= asked]


def _search_cell(rows: list[tuple], num: int, den: int) -> set[tuple[int, int]]:
    """Links of a cell that connect what was not connected. Rows: (node, is_index, is_query, component, items)."""
    index = [r for r in rows if r[1]]
    queries = [r for r in rows if r[2]]
    if not index or not queries:
        return set()
    parent: dict = {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    lists, links = Lists([r[4] for r in index]), set()
    for node, _, _, component, items in queries:
        for i in lists.search(items, num, den):
            a, b = top(component), top(index[i][3])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.add((node, index[i][0]))
    return links


def _search_cells(num: int, den: int):
    """Rows come sorted by cell; a cell is searched as soon as its last row is read."""

    def links_of(rows):
        links = sorted(_search_cell(rows, num, den))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            names = ["block", "cell", "node", "is_index", "is_query", "component"]
            columns = [batch.column(x).to_pylist() for x in names]
            for *key, node, is_index, is_query, component, raw in zip(*columns, utf8_rows(batch.column("items"))):
                if key != cell:
                    if len(rows) > 1:
                        yield links_of(rows)
                    cell, rows = key, []
                rows.append((node, is_index, is_query, component, np.frombuffer(raw.tobytes(), np.uint64)))
        if len(rows) > 1:
            yield links_of(rows)

    return run


def _searched(cells: DataFrame, num: int, den: int) -> DataFrame:
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "block", "cell").sortWithinPartitions("block", "cell", "node")
    return cut_lineage(dealt.mapInArrow(_search_cells(num, den), "a long, b long"))


def jaccard_groups(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text).

    Two documents link when den * |x & y| >= num * |x u y| over their distinct
    n-word shingles (A-Z lower-cased; words are runs of anything but blank and
    \\x09 to \\x0D); component_id is the smallest doc_id reachable by links.
    A text with fewer than n words is one shingle. Null, empty and wordless
    texts have no shingles and stand alone. Rows with one doc_id are one
    document for links, each with its own n_shingles; a null doc_id links with
    nothing and has a null component. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    profile = cut_lineage(docs.mapInArrow(_set_digests(n), "doc_id long, n long, k1 long, k2 long"))
    named = docs.where("doc_id is not null and text is not null")

    # Equal sets: the smallest doc_id stands for all.
    sets = profile.where("doc_id is not null and n > 0")
    classes = cut_lineage(sets.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")))
    members = cut_lineage(sets.join(classes, ["k1", "k2", "n"]).select("doc_id", "n", "rep"))

    # Candidates: documents that share a signature with another set. Of equal sets the representative's are enough.
    reps = _sent_filter(classes.select("rep").distinct())

    def signed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        batch = kept(batch, "doc_id", reps.value)
        for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8_rows(batch.column("text"))):
            yield doc, signatures(shingle_set(raw, n), num, den)

    pairs = _linked(named, signed)
    rep = members.select("doc_id", "rep").distinct()
    pairs = (
        pairs.join(rep.withColumnsRenamed({"doc_id": "doc", "rep": "a"}), "doc")
        .join(rep.withColumnsRenamed({"doc_id": "other", "rep": "b"}), "other").where("a <> b"))
    wide_blocks = components(pairs.select("a", "b"))
    reps.destroy()
    sent = _sent_filter(wide_blocks.select("node"))
    # One plan at every size: what passes the filter is shuffled.
    texts = _asked(named.withColumnRenamed("doc_id", "node"), "node", sent).join(wide_blocks.select("node").hint("merge"), "node")
    sets = cut_lineage(texts.mapInArrow(_shingle_rows(n), "node long, items binary"))
    sent.destroy()

    # Blocks: linked documents hang together by each of three kinds of signatures, so they agree in all three.
    # A document that is alone in its block has no partner; it is not looked at again.
    def narrow(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        batch = kept(batch, "node", left.value)
        for doc, items in zip(batch.column("node").to_pylist(), _items(batch)):
            yield doc, signatures(items, num, den, NARROW_CLASSES)

    sent = documents.sparkSession.sparkContext.broadcast(_frequencies(sets))  # COUNTERS numbers
    blocks = wide_blocks.withColumnRenamed("component", "block")
    left = None
    for found_in in (_rarest(sent, num, den), narrow):
        finer = components(_linked(sets, found_in).select(F.col("doc").alias("a"), F.col("other").alias("b")))
        blocks = cut_lineage(blocks.join(finer, "node").select("node", F.xxhash64("block", "component").alias("block")))
        shared = cut_lineage(blocks.groupBy("block").agg(F.count("*").alias("docs")).where("docs > 1")).drop("docs")
        blocks = cut_lineage(blocks.join(shared, "block"))
        if left is not None:
            left.destroy()
        left = _sent_filter(blocks.select("node"))
    size = sets.mapInArrow(_sizes(sent), "node long, n long, typical double").groupBy("node").agg(
        F.max("n").alias("n"), F.max("typical").alias("typical"))
    sized = cut_lineage(blocks.join(size, "node"))
    whole = sized.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n").alias("items"))
    whole = cut_lineage(whole.select(
        "block", F.greatest(F.ceil(F.col("docs") / CELL_DOCS), F.ceil(F.col("items") / CELL_SHINGLES)).alias("cells"),
        F.greatest(F.ceil(F.col("docs") / WIDE_CELL_DOCS), F.ceil(F.col("items") / WIDE_CELL_SHINGLES)).alias("wide")))
    # The anchor holds the block's most typical documents: those that most others are close to, if to any.
    typical = Window.partitionBy("block").orderBy(F.desc("typical"), "node")
    several_cells = sized.join(whole.where("cells > 1").select("block"), "block")
    anchor = several_cells.withColumn("place", F.row_number().over(typical)).where(F.col("place") <= CELL_DOCS).select(
        "node", F.lit(True).alias("anchor"))
    place = sized.join(whole, "block").join(cut_lineage(anchor), "node", "left").withColumn(
        "own", F.expr("case when cells = 1 or anchor then 0 else 1 + pmod(xxhash64(node), cells - 1) end"))
    place = cut_lineage(place.select("node", "block", "cells", "wide", "own")).hint("merge")
    held = cut_lineage(_asked(sets, "node", left).join(place, "node").select("node", "block", "cells", "wide", "own", "items"))
    # All that is read from here on is written.
    sent.destroy()
    left.destroy()
    drop_cut(sets)
    asking = held.select(
        "block", F.col("own").alias("cell"), "node", (F.col("own") == 0).alias("is_index"), F.lit(True).alias("is_query"),
        F.col("node").alias("component"), "items")
    anchors = held.where("own = 0 and cells > 1").select(
        "block", F.explode(F.sequence(F.lit(1), F.col("cells") - 1)).alias("cell"), "node", F.lit(True).alias("is_index"),
        F.lit(False).alias("is_query"), F.col("node").alias("component"), "items")
    links = _searched(asking.union(anchors), num, den)

    # Blocks of several cells: who is not in the largest component searches the rest.
    found = components(links)
    spread = held.where("cells > 1").join(found, "node", "left")
    spread = cut_lineage(spread.withColumn("component", F.coalesce("component", "node")))
    drop_cut(held)
    largest = spread.groupBy("block", "component").agg(F.count("*").alias("docs")).groupBy("block").agg(
        F.max(F.struct("docs", -F.col("component"))).alias("most"))
    largest = cut_lineage(largest.select("block", (-F.col("most.col2")).alias("main")))
    apart = spread.join(largest, "block").where("component <> main").drop("main")
    asked = cut_lineage(apart.groupBy("block").agg(F.ceil(F.count("*") / WIDE_CELL_DOCS).alias("chunks")))
    grid = spread.join(asked, "block")
    index = grid.select(
        "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.expr("pmod(xxhash64(node, 7), wide)").alias("side"), "node", F.lit(True).alias("is_index"),
        F.lit(False).alias("is_query"), "component", "items")
    query = apart.join(asked, "block").select(
        "block", F.expr("pmod(xxhash64(node, 11), chunks)").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("side"), "node", F.lit(False).alias("is_index"),
        F.lit(True).alias("is_query"), "component", "items")
    wide = index.unionByName(query).withColumn("cell", F.xxhash64("chunk", "side"))
    rest = _searched(wide.drop("chunk", "side"), num, den)
    drop_cut(spread)

    # One doc_id with several texts has several representatives, which belong together.
    first = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    several = rep.join(first.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    groups = components(links.union(rest).union(several)).withColumnsRenamed({"node": "rep"})
    placed = members.join(groups, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    placed = cut_lineage(placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    return (
        profile.join(placed, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
