"""Periodic runs of words by maximal pairs, and texts with their repetitions collapsed.

A run of period q and length L is a pair of places q apart whose common continuation has L - q words and whose left
words differ: a maximal pair. Maximal pairs are read off a tree of LCP intervals, built bottom up from the suffix array
of the words: an interval of depth l holds the places where one sequence of l words starts, and two places that meet
first in it have exactly l words in common. With l >= (times - 1) * q the places of one sequence that are less than a
period apart would give the run a shorter period, so a run's pair is adjacent among the places of its interval, and an
adjacent pair of other left words at an allowed distance is a run: nothing is extended or compared again.

Suffix array and LCP come from prefix doubling over exact word numbers of a bundle of documents; documents share no
number, so no sequence spans two. Sequences below the depth that a run needs are never refined. An interval keeps its
places as one list in order with their left-word class: where both sides of a merger are of one class, there is no
maximal pair to look for.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run, and least number of periods in it.
LEAST, TIMES = 6, 4
#: Words of the documents that are looked at together; a longer document is alone.
BUNDLE_WORDS = 1 << 18
RUNS = "array<struct<start:long,length:long,period:long>>"


def _refined(rank: np.ndarray, other: np.ndarray, alive: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the sequence of ``rank`` and then of ``other`` ``step`` words on, and the places not yet unique.

    A rank is the number of places in front, so places that are unique keep theirs.
    """
    key = rank[alive] * np.int64(len(rank)) + other[alive + step]
    order = np.argsort(key, kind="stable")
    key, at = key[order], alive[order]
    n = np.arange(len(at))
    fresh = np.diff(key, prepend=-1) != 0
    outer = np.diff(rank[at], prepend=-1) != 0
    rank = rank.copy()
    rank[at] += np.maximum.accumulate(np.where(fresh, n, 0)) - np.maximum.accumulate(np.where(outer, n, 0))
    sizes = np.diff(np.flatnonzero(np.append(fresh, True)))
    return rank, np.sort(at[np.repeat(sizes > 1, sizes)])


def suffix_order(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, common, group): the places whose next ``least`` words occur more than once, in the order of their suffixes.

    ``common`` is the number of words shared with the place before, 0 for the
    first of a group of places with the same ``least`` words. ``codes`` must
    hold numbers from 0 and end in one that is unique.
    """
    counts = np.bincount(codes)
    rank = (np.cumsum(counts) - counts)[codes].astype(np.int64)
    alive = np.flatnonzero(counts[codes] > 1)
    levels = [(1, rank)]
    while levels[-1][0] * 2 <= least:
        rank, alive = _refined(rank, rank, alive, levels[-1][0])
        levels.append((levels[-1][0] * 2, rank))
    for step, short in reversed(levels[:-1]):
        if levels[-1][0] + step <= least:
            rank, alive = _refined(rank, short, alive, levels[-1][0])
            levels.append((levels[-1][0] + step, rank))
    places, seed = alive, rank
    while len(alive):
        depth = levels[-1][0]
        rank, alive = _refined(rank, rank, alive, depth)
        levels.append((depth * 2, rank))
    places = places[np.argsort(rank[places], kind="stable")]
    group = seed[places]
    common = np.zeros(len(places), np.int64)
    same = np.flatnonzero(np.diff(group, prepend=-1) == 0)
    if len(same):
        left, right = places[same - 1], places[same]
        for depth, rank in reversed(levels):
            ahead = np.where(rank[left] == rank[right], depth, 0)
            left, right = left + ahead, right + ahead
        common[same] = right - places[same]
    return places, common, group


def _allowed(distance: int, depth: int, least: int, times: int) -> bool:
    return depth >= (times - 1) * distance and depth + distance >= least


class Interval:
    """An LCP interval: its depth, its places in order, and their left-word class (None if there are several)."""

    __slots__ = ("depth", "places", "kind")

    def __init__(self, depth: int, places: list[int], kind: int | None):
        self.depth, self.places, self.kind = depth, places, kind


def _merged(node: Interval, child: Interval, codes: np.ndarray, least: int, times: int, found: list) -> None:
    """Take the places of ``child`` into ``node``; maximal pairs between the two go to ``found``."""
    small, large = sorted((node.places, child.places), key=len)
    if len(small) * 8 > len(large):
        whole = sorted(large + small)
    else:
        whole = large
        for place in small:
            insort(whole, place)
    mixed = node.kind is None or node.kind != child.kind
    if mixed:
        own = set(small)
        for place in small:
            at = bisect_left(whole, place)
            for near in (at - 1, at + 1):
                if 0 <= near < len(whole) and whole[near] not in own and codes[whole[near] - 1] != codes[place - 1]:
                    distance = abs(whole[near] - place)
                    if _allowed(distance, node.depth, least, times):
                        found.append((min(whole[near], place), distance + node.depth, distance))
    node.places, node.kind = whole, None if mixed else node.kind


def _tree(places: list[int], common: list[int], codes: np.ndarray, least: int, times: int, found: list) -> None:
    """One bottom-up pass over the suffixes of a group: intervals are open on a stack while they get members."""
    stack: list[Interval] = []
    for i, place in enumerate(places):
        depth = common[i + 1] if i + 1 < len(places) else -1
        done = Interval(depth, [place], int(codes[place - 1]))
        while stack and stack[-1].depth >= depth:
            top = stack.pop()
            _merged(top, done, codes, least, times, found)
            done = top
            if top.depth == depth:
                break
        if depth >= 0:
            stack.append(done if done.depth == depth else Interval(depth, done.places, done.kind))


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    ``codes`` are word numbers from 0, and its first and last number occur once
    (what stands before and after documents). Places count from the first number.
    """
    if times < 3:
        raise ValueError("a run needs at least three periods")
    # The least common continuation of a pair: of period q it is max((times - 1) * q, least - q).
    deep = min(max((times - 1) * q, least - q) for q in range(1, least + 1))
    places, common, group = suffix_order(codes, deep)
    if not len(places):
        return []
    # A group holds no run if all its left words are the same, or if no two places are as close as its depth allows.
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, len(places)))
    of = np.repeat(np.arange(len(first)), sizes)
    before = codes[places - 1]
    several = np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)
    order = np.lexsort((places, of))
    gaps = np.diff(places[order], prepend=0)
    gaps[first] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gaps, first) * (times - 1) <= np.maximum.reduceat(common, first)
    found: list[tuple[int, int, int]] = []
    for g in np.flatnonzero(several & near):
        span = slice(first[g], first[g] + sizes[g])
        _tree(places[span].tolist(), common[span].tolist(), codes, least, times, found)
    return sorted(found, key=lambda run: (run[0], run[2]))


def _bundles(texts: list[str | None], ids: list, change) -> Iterator[list[list[bytes]]]:
    """The words of some documents at a time."""
    bundle, held = [], 0
    for text, key in zip(texts, ids):
        # Without arguments, bytes are split at blanks and \x09 to \x0D.
        words = (text or "").encode().split()
        if change is not None and words:
            words = change(key, words)
        if bundle and held + len(words) > BUNDLE_WORDS:
            yield bundle
            bundle, held = [], 0
        bundle.append(words)
        held += len(words)
    if bundle:
        yield bundle


def _numbered(bundle: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the documents one after another, each with numbers of its own and a mark behind; their first places."""
    parts, starts, at, number = [np.zeros(1, np.int64)], [], 1, 1
    for words in bundle:
        table = {word: i for i, word in enumerate(dict.fromkeys(words), number)}
        number += len(table) + 1
        codes = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        parts += [codes, np.array([number - 1])]
        starts.append(at)
        at += len(words) + 1
    return np.concatenate(parts), np.array(starts)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        turns = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            turns[start + period] += 1
            turns[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0)]
    return b" ".join(words).decode()


def _searched(least: int, times: int, change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
        for batch in batches:
            done = 0
            ids = batch.column("doc_id")
            for bundle in _bundles(batch.column("text").to_pylist(), ids.to_pylist(), change):
                codes, starts = _numbered(bundle)
                runs: list[list] = [[] for _ in bundle]
                for start, length, period in find_runs(codes, least, times):
                    doc = int(np.searchsorted(starts, start, side="right")) - 1
                    runs[doc].append((start - int(starts[doc]), length, period))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(done, len(bundle)), pa.array([len(words) for words in bundle], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in runs], pa.list_(struct)),
                    pa.array([_collapsed(words, rows) for words, rows in zip(bundle, runs)], pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
                done += len(bundle)

    return run


def collapse(
    documents: DataFrame, least: int = LEAST, times: int = TIMES,
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``documents`` (doc_id, text).

    A run is a stretch of words with smallest period q, of at least ``least``
    words and ``times`` periods, that no neighbouring word extends; ``runs``
    holds them by start and period, in word numbers from 0. ``collapsed`` is
    the text without the words that a run holds after its first q, joined by
    blanks. ``change`` may replace a document's words before the search, given
    its id. Null and empty texts have no words, no runs and an empty collapsed
    text. Rows with null or repeated ids each stand for themselves; other
    columns are ignored; an empty table gives no rows. Memory goes with the
    longest single text, time about linearly with the text.
    """
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _searched(least, times, change), f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties: smallest start, then period. Null without runs."""
    def better(held: Column, run: Column) -> Column:
        return F.when(run["length"] * held["period"] > held["length"] * run["period"], run).otherwise(held)

    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run, in the order given."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
