"""Outcomes of recordings from their recorder's events, walked in the order of time.

A recording ends as soon as it is cancelled or stopped; a crash is seen at the next poll of its recorder, and the end of the
duration at once. What comes first ends it, at one time in the order cancelled, stopped, crashed, duration. A null
duration has no end. A START while a recording runs is refused (DEVICE_BUSY) and leaves it alone.
Events of a recorder with none open, and events of other kinds, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.operators.order import carried

#: Order of events at one time.
RANK = {"CANCEL": 0, "STOP": 1, "CRASH": 2, "START": 3}
#: Seconds between two polls of a running recording.
POLL_S = 0.5

#: (start, end of the duration or None, poll that sees a crash or None), in microseconds.
Open = tuple[int, int | None, int | None]
Outcome = tuple[int, int, str]


def due(running: Open) -> tuple[int | None, str]:
    """When and how a recording ends without further events."""
    _, until, crash = running
    return (crash, "FAILED") if crash is not None and (until is None or crash <= until) else (until, "SUCCESS")


def settle(running: Open | None, now: int) -> tuple[Open | None, list[Outcome]]:
    """The recording after what is due by ``now``, when no event of that time is missing."""
    if running is not None:
        end, outcome = due(running)
        if end is not None and end <= now:
            return None, [(running[0], end, outcome)]
    return running, []


def step(running: Open | None, at: int, event: str, duration_s: float | None, poll_s: float = POLL_S) -> tuple[Open | None, list[Outcome]]:
    """The recording after one event, and the outcomes by then. Events come in the order of (time, rank)."""
    running, out = settle(running, at if event == "START" else at - 1)
    if event == "START":
        if running is not None:
            return running, [*out, (at, at, "DEVICE_BUSY")]
        return (at, None if duration_s is None else at + max(0, round(duration_s * 1e6)), None), out
    if running is None:
        return None, out
    start, until, crash = running
    if event == "CRASH":
        poll = round(poll_s * 1e6)
        seen = start - (start - at) // poll * poll
        return (start, until, crash if crash is not None else seen if until is None else min(seen, until)), out
    return None, [*out, (start, at, "CANCELLED" if event == "CANCEL" else "SUCCESS")]


def outcomes(events: DataFrame, poll_s: float = POLL_S) -> DataFrame:
    """Events (recorder_id, ts, event, duration_s) to (recorder_id, started, ended, outcome), one row a recording that has ended or was refused.

    After a CANCEL or STOP nothing runs, whatever was before. So a segmented scan numbers the stretches between them, and a
    stretch is walked by itself, sorted, with one open recording held: no recorder is one task. Events without a time are left out.
    """
    spark = events.sparkSession
    rank = F.element_at(F.create_map(*[F.lit(x) for p in RANK.items() for x in p]), F.col("event"))
    e = events.select("recorder_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event", F.nanvl(F.col("duration_s").cast("double"), F.lit(None).cast("double")).alias("duration_s"), rank.alias("rank")).dropna(subset=["at", "rank"])
    e = carried(e, ["recorder_id"], ["at", "rank", "duration_s"], stretch=("sum", (F.col("rank") <= 1).cast("long")))
    kind = events.schema["recorder_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            out = []
            for recorder, stretch, at, event, duration in zip(*(batch.column(c).to_pylist() for c in ("recorder_id", "stretch", "at", "event", "duration_s")), strict=True):
                if (recorder, stretch) != key:
                    if key is not None:
                        out += [(key[0], *x) for x in settle(running, 1 << 62)[1]]
                    key, running = (recorder, stretch), None
                running, found = step(running, at, event, duration, poll_s)
                out += [(recorder, *x) for x in found]
            yield batch_of(out, batch)
            last = batch
        if key is not None:
            yield batch_of([(key[0], *x) for x in settle(running, 1 << 62)[1]], last)

    def batch_of(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [like.schema.field("recorder_id").type, pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["recorder_id", "started", "ended", "outcome"])

    rows = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "recorder_id", "stretch").sortWithinPartitions("recorder_id", "stretch", "at", "rank", F.asc_nulls_first("duration_s"))
    return rows.mapInArrow(walk, f"recorder_id {kind}, started long, ended long, outcome string").select("recorder_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "outcome")
