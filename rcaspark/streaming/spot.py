"""Drift-aware extreme value scores per channel, in batch and as a stream.

After the published streaming peaks-over-threshold method with drift: a point's
deviation from the mean of the last normal points is compared, on both sides,
with a threshold of risk q from a generalised Pareto tail. The tail is fitted by
moments. The score is 1 - p / q where p is the tail probability of an alert, and
0 otherwise; the first points calibrate and score 0.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rcaspark.operators.order import full_rank

# Calibration length, tail level, risk, drift depth and excesses kept.
N_INIT, LEVEL, RISK, DEPTH, MAX_EXCESS = 100, 0.95, 1e-4, 10, 200
STRETCH = 4096  # points whose deviations are worked out together


@dataclass
class Tail:
    """Excesses over one threshold and the alert level that follows from them."""

    limit: float = math.inf
    alert: float = math.inf
    shape: float = 0.0
    scale: float = 0.0
    seen: int = 0
    peaks: deque = field(default_factory=deque)
    total: float = 0.0
    square: float = 0.0

    def add(self, excess: float, keep: int) -> None:
        self.seen += 1
        self.peaks.append(excess)
        self.total += excess
        self.square += excess * excess
        if len(self.peaks) > keep:
            old = self.peaks.popleft()
            self.total -= old
            self.square -= old * old

    def fit(self, n: int, risk: float) -> None:
        k = len(self.peaks)
        if not k:
            self.alert = self.limit
            return
        mean = self.total / k
        var = self.square / k - mean * mean
        if var <= 1e-12 * mean * mean:
            self.shape, self.scale = 0.0, mean
        else:
            ratio = mean * mean / var
            self.shape, self.scale = (1 - ratio) / 2, mean * (1 + ratio) / 2
        share = risk * n / self.seen
        if abs(self.shape) < 1e-9:
            self.alert = self.limit - self.scale * math.log(share)
        else:
            self.alert = self.limit + self.scale / self.shape * (share ** -self.shape - 1)
        self.alert = max(self.alert, self.limit)

    def score(self, x: float, n: int, risk: float) -> float:
        if self.scale <= 0:
            return 1.0
        z = (x - self.limit) / self.scale
        if abs(self.shape) < 1e-9:
            p = math.exp(-z)
        else:
            base = 1 + self.shape * z
            p = base ** (-1 / self.shape) if base > 0 else 0.0
        return min(1.0, max(1 - p * self.seen / n / risk, 1e-12))

    def pack(self) -> list[float]:
        return [self.limit, self.alert, self.shape, self.scale, float(self.seen), self.total, self.square, *self.peaks]

    @classmethod
    def unpack(cls, v: Sequence[float]) -> Tail:
        return cls(*[float(x) for x in v[:4]], int(v[4]), deque(float(x) for x in v[7:]), float(v[5]), float(v[6]))


@dataclass
class Scorer:
    """State of one channel; its size does not grow with the channel."""

    n_init: int = N_INIT
    level: float = LEVEL
    risk: float = RISK
    depth: int = DEPTH
    keep: int = MAX_EXCESS
    n: int = 0
    recent: deque = field(default_factory=deque)
    warm: list[float] = field(default_factory=list)
    up: Tail = field(default_factory=Tail)
    down: Tail = field(default_factory=Tail)

    def _calibrate(self) -> None:
        dev = np.array(self.warm)
        for tail, side in ((self.up, dev), (self.down, -dev)):
            tail.limit = float(np.quantile(side, self.level))
            for x in side[side > tail.limit]:
                tail.add(float(x - tail.limit), self.keep)
            tail.fit(len(dev), self.risk)
        self.warm = []

    def step(self, value: float) -> float:
        """The score of the next point."""
        dev = None
        if len(self.recent) == self.depth:
            total = 0.0
            for x in self.recent:
                total += x
            dev = value - total / self.depth
        self.n += 1
        score = 0.0
        if self.n <= self.n_init:
            if dev is not None:
                self.warm.append(dev)
            if self.n == self.n_init:
                self._calibrate()
        else:
            # Calibration saw the points after the first window only.
            n = self.n - self.depth
            for tail, x in ((self.up, dev), (self.down, -dev)):
                if x > tail.alert:
                    score = max(score, tail.score(x, n, self.risk))
                elif x > tail.limit:
                    tail.add(x - tail.limit, self.keep)
                    tail.fit(n, self.risk)
        if not score:
            self.recent.append(value)
            if len(self.recent) > self.depth:
                self.recent.popleft()
        return score

    def steps(self, values: np.ndarray) -> np.ndarray:
        """The scores of the next points, equal to those of ``step``.

        After calibration only points over a tail's limit change the state, and
        the limits stand. Between two alerts all points enter the moving mean, so
        deviations are worked out for whole stretches and only the excesses are
        looked at one by one.
        """
        scores = np.zeros(len(values))
        at = 0
        while at < len(values) and self.n < self.n_init:
            scores[at] = self.step(float(values[at]))
            at += 1
        while at < len(values):
            part = np.asarray(values[at : at + STRETCH], dtype=float)
            line = np.concatenate([np.array(self.recent, dtype=float), part])
            # Added up in the order of the window, as one by one.
            mean = np.zeros(len(part))
            for i in range(self.depth):
                mean = mean + line[i : i + len(part)]
            dev = part - mean / self.depth
            done = len(part)
            for i in np.flatnonzero((dev > self.up.limit) | (-dev > self.down.limit)):
                score, n = 0.0, self.n + int(i) + 1 - self.depth
                for tail, x in ((self.up, float(dev[i])), (self.down, -float(dev[i]))):
                    if x > tail.alert:
                        score = max(score, tail.score(x, n, self.risk))
                    elif x > tail.limit:
                        tail.add(x - tail.limit, self.keep)
                        tail.fit(n, self.risk)
                if score:
                    # An alert stays out of the mean, so the rest of the stretch is worked out anew.
                    scores[at + i] = score
                    done = int(i) + 1
                    break
            normal = line[: self.depth + done - (1 if scores[at + done - 1] else 0)]
            self.recent = deque(float(x) for x in normal[-self.depth :])
            self.n += done
            at += done
        return scores

    def pack(self) -> tuple:
        return self.n, list(self.recent), list(self.warm), self.up.pack(), self.down.pack()

    def unpack(self, state: Sequence) -> Scorer:
        n, recent, warm, up, down = state
        self.n, self.recent, self.warm = int(n), deque(float(x) for x in recent), [float(x) for x in warm]
        self.up, self.down = Tail.unpack(up), Tail.unpack(down)
        return self


STATE_SCHEMA = "n BIGINT, recent ARRAY<DOUBLE>, warm ARRAY<DOUBLE>, up ARRAY<DOUBLE>, down ARRAY<DOUBLE>, last_order STRING"


def spot_scores(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | str, value: str, **settings) -> DataFrame:
    """(keys, order columns, value, idx, score) of each channel in order.

    The method is sequential by definition: a point's score depends on all points
    before it. Channels run in parallel; within a task rows arrive sorted and only
    the small state of the running channel is held, never the channel itself.
    Equal order values and non-finite points are errors.
    """
    order = [order] if isinstance(order, str) else list(order)
    picked, value_name = rows.select(*keys, *order, value), value
    schema = T.StructType([*picked.schema.fields, T.StructField("idx", T.LongType()), T.StructField("score", T.DoubleType())])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before, scorer = None, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            value = pdf[value_name].to_numpy(dtype=float)
            idx, scores = np.zeros(len(pdf), dtype="int64"), np.zeros(len(pdf))
            turns = np.zeros(len(pdf), bool)
            for k in keys:
                turns[1:] |= (pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1])
            repeated = np.ones(len(pdf), bool)
            repeated[0] = False
            for o in order:
                repeated[1:] &= pdf[o].to_numpy()[1:] == pdf[o].to_numpy()[:-1]
            starts = [0, *np.flatnonzero(turns)]
            for first, last in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(pdf[k].iloc[first] for k in keys)
                place = tuple(pdf[o].iloc[first] for o in order)
                same = first + 1 + np.flatnonzero(repeated[first + 1 : last])
                if key != at:
                    at, scorer = key, Scorer(**settings)
                elif place == before:
                    same = [first]
                if len(same):
                    raise ValueError(f"two points at {tuple(pdf[o].iloc[same[0]] for o in order)} in {key}")
                wrong = np.flatnonzero(~np.isfinite(value[first:last]))
                if len(wrong):
                    raise ValueError(f"non-finite point at {tuple(pdf[o].iloc[first + wrong[0]] for o in order)} in {key}")
                before = tuple(pdf[o].iloc[last - 1] for o in order)
                idx[first:last] = scorer.n + np.arange(last - first)
                scores[first:last] = scorer.steps(value[first:last])
            yield pdf.assign(idx=idx, score=scores)

    return picked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def alert_counts(scores: DataFrame, keys: Sequence[str], warm_up: int = N_INIT) -> DataFrame:
    """Per channel: rows, alerts after the warm-up, the first of them and the highest score."""
    late = F.col("idx") >= warm_up
    hit = late & (F.col("score") > 0)
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("positives"),
        F.min(F.when(hit, F.col("idx"))).alias("first_positive"), F.max(F.when(late, F.col("score"))).alias("max_score"))


def alerting_entities(counts: DataFrame) -> DataFrame:
    """Whether any channel of an entity alerts."""
    return counts.groupBy("case", "entity").agg(F.bool_or(F.col("positives") > 0).alias("kept"))


def moving_deviation(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, depth: int = DEPTH, block: int = 100_000) -> DataFrame:
    """Deviation of each point from the mean of the ``depth`` points before it.

    Points are numbered over the whole channel, cut into blocks by number, and the
    last points of a block are copied into the next, so no window spans a channel.
    """
    at = full_rank(rows, keys, [F.col(o) for o in order], "_at")
    own = F.expr(f"(_at - 1) div {block}")
    spread = at.withColumn("_own", own).withColumn("_block", F.explode(F.when(
        (F.col("_at") - 1) % block >= block - depth, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-depth, -1)
    out = spread.withColumn("before", F.when(F.count(value).over(w) == depth, F.avg(value).over(w))).where("_own = _block")
    return out.withColumn("deviation", F.col(value) - F.col("before")).drop("_at", "_own", "_block", "before")
