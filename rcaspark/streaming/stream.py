"""The channel scorer as a stateful stream, with late, repeated and broken rows set aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rcaspark.session import scratch_path
from rcaspark.streaming.spot import STATE_SCHEMA, Scorer

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMEMBER = 1000  # order keys of a channel that a repeat is known by
STATE = f"{STATE_SCHEMA}, known ARRAY<STRING>"
OUTPUT = "channel STRING, seq STRING, value DOUBLE, idx BIGINT, score DOUBLE, status STRING"


class ChannelScorer(StatefulProcessor):
    """State of one channel: the scorer, and the order keys of its last scored rows.

    ``seq`` is a sortable order key. Rows of a micro-batch come sorted, frame by
    frame, and only one frame is held; a non-finite one is ``nonfinite``, one with the key of a scored row that is
    still remembered ``repeated``, and any other at or before the last scored
    one ``late``: all come out with a status and no score, and do not touch the
    scorer. ``remember`` keys are kept, so the state does not grow.
    """

    def __init__(self, settings: dict | None = None, remember: int = REMEMBER):
        self.settings, self.remember = settings or {}, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scorer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scorer, known, last = Scorer(**self.settings), [], None
        if self.state.exists():
            *packed, _, known = self.state.get()
            scorer.unpack(packed)
            known = list(known)
            last = known[-1]
        held, changed = set(known), False
        for batch in rows:
            value, seq = batch["value"].to_numpy(dtype=float), batch["seq"].to_numpy()
            status = np.where(np.isfinite(value), "scored", "nonfinite").astype(object)
            fresh: list = []
            for i in np.flatnonzero(status == "scored"):
                if last is None or seq[i] > last:
                    last = seq[i]
                    fresh.append(last)
                else:
                    status[i] = "repeated" if seq[i] == last or seq[i] in held else "late"
            scored = status == "scored"
            idx = pd.array([None] * len(batch), dtype="Int64")
            idx[scored] = scorer.n + np.arange(int(scored.sum()))
            score = np.full(len(batch), np.nan)
            score[scored] = scorer.steps(value[scored])
            known, changed = [*known, *fresh][-self.remember :], changed or bool(fresh)
            yield pd.DataFrame({"channel": key[0], "seq": seq, "value": value, "idx": idx, "score": score, "status": status})
        if changed:
            self.state.update((*scorer.pack(), last, known))

    def close(self) -> None:
        pass


def score_stream(rows: DataFrame, remember: int = REMEMBER, **settings) -> DataFrame:
    """(channel, seq, value) stream to scored and set-aside rows."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Spark refuses to sort streams, as it would sort a micro-batch only. That is what is wanted here.
    conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    ordered = rows.repartition("channel").sortWithinPartitions("channel", "seq")
    return ordered.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=ChannelScorer(settings, remember), outputStructType=OUTPUT, outputMode="append", timeMode="none")


def drop_repeats(rows: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """A row seen again within the watermark delay is dropped; state older than it is forgotten."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def split_quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rows set aside)."""
    return scored.where("status = 'scored'"), scored.where("status <> 'scored'")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files as a stream with the schema of what is there; ``path`` is a folder or a glob."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
