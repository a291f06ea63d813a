"""Incremental ingestion of finished recordings, and a monitor over state events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skytrace.operators.monitor import POLL_S, RANK, due, settle, step
from skytrace.sources.scan import SIDECAR

#: Stands for null in the state of a running recording.
NEVER = -(1 << 63)


def ingest(spark: SparkSession, sidecar_dir: str, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``pipeline`` over newly finished recordings and writes its rows under their batch, so that a replayed batch replaces itself."""
    arrived = spark.readStream.schema(SIDECAR).option("multiLine", True).option("timeZone", "UTC").json(sidecar_dir).filter("recording_status = 'SUCCESS'")

    def write(batch: DataFrame, batch_id: int) -> None:
        pipeline(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rendezvous(sidecars: DataFrame, files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streams of sidecars and of data files (path, length, modificationTime) to one row a recording, whichever comes first.

    Both sides are reduced to one row a file name and meet on it; a sidecar's creation and its file's time lie within ``delay`` of
    one another, so either side is kept waiting so long and no longer. The same on tables, but for repeats further apart than that.
    """
    name = lambda path: F.regexp_extract(path, r"([^/]+)$", 1)
    s = sidecars.withColumn("file_name", name(F.col("output_filename"))).filter("recording_status = 'SUCCESS' and creation_timestamp is not null")
    f = files.select(name(F.col("path")).alias("data_name"), F.col("path").alias("data_path"), F.col("length").alias("data_length"), F.col("modificationTime").alias("data_time"))
    if sidecars.isStreaming:
        s = s.withWatermark("creation_timestamp", delay).dropDuplicatesWithinWatermark(["file_name"])
        f = f.withWatermark("data_time", delay).dropDuplicatesWithinWatermark(["data_name"])
    else:
        s, f = s.dropDuplicates(["file_name"]), f.dropDuplicates(["data_name"])
    near = F.expr(f"data_time between creation_timestamp - interval {delay} and creation_timestamp + interval {delay}")
    return s.join(f, (F.col("file_name") == F.col("data_name")) & near).drop("data_name")


class Monitor(StatefulProcessor):
    """Events to outcomes as in :mod:`skytrace.operators.monitor`, whatever the batches they come in.

    Events wait in a list until the watermark has passed them and are then walked in the order of time, so an event that comes
    late, but within the watermark's delay, counts at its time. One timer a recorder, at the first waiting event or at the
    end that is due, wakes it up.
    """

    def __init__(self, poll_s: float = POLL_S) -> None:
        self.poll_s = poll_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event string, duration_s double")
        self.running = handle.getValueState("running", "start long, until long, crash long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["event"].isin(list(RANK)) & frame["at"].notna()]
            if len(frame):
                self.waiting.appendList([(int(at), event, None if pd.isna(d) else float(d)) for at, event, d in zip(frame["at"], frame["event"], frame["duration_s"], strict=True)])
        yield from self._walk(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._walk(key, timerValues)

    def _walk(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """What the watermark has passed; the rest waits on."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda e: (e[0], RANK[e[1]], e[2] is not None, e[2] or 0.0)) if self.waiting.exists() else []
        running = tuple(None if x == NEVER else x for x in self.running.get()) if self.running.exists() else None
        was, found, n = running, [], 0
        for at, event, duration in waiting:
            if at > now:
                break
            running, out = step(running, at, event, duration, self.poll_s)
            found += out
            n += 1
        running, out = settle(running, now)
        found += out
        if n:
            self.waiting.put(waiting[n:]) if n < len(waiting) else self.waiting.clear()
        if running != was:
            self.running.update(tuple(NEVER if x is None else x for x in running)) if running else self.running.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ahead = [x for x in (waiting[n][0] if n < len(waiting) else None, due(running)[0] if running else None) if x is not None]
        if ahead:
            self.handle.registerTimer(-(-min(ahead) // 1000))
        if found:
            yield pd.DataFrame({"recorder_id": key[0], "started": [x[0] for x in found], "ended": [x[1] for x in found], "outcome": [x[2] for x in found]})

    def close(self) -> None:
        pass


def monitor(events: DataFrame, delay: str = "10 seconds", poll_s: float = POLL_S) -> DataFrame:
    """Event stream (recorder_id, ts, event, duration_s) to (recorder_id, started, ended, outcome), one row a recording that has ended or was refused."""
    kind = events.schema["recorder_id"].dataType.simpleString()
    e = events.withWatermark("ts", delay).select("recorder_id", "ts", F.unix_micros("ts").alias("at"), "event", F.col("duration_s").cast("double").alias("duration_s"))
    out = e.groupBy("recorder_id").transformWithStateInPandas(
        statefulProcessor=Monitor(poll_s), outputStructType=f"recorder_id {kind}, started long, ended long, outcome string", outputMode="Append", timeMode="EventTime"
    )
    return out.select("recorder_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "outcome")
