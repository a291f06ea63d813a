"""Stream parts: the monitor by its own states and as a stream, ingestion with a replayed folder."""

import json
import math
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from skytrace import streaming
from skytrace.operators import monitor as monitoring
from skytrace.operators.monitor import RANK
from skytrace.sources.scan import SIDECAR


class State:
    """A value or list state."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v

    def put(self, v):
        self.held = list(v)

    def appendList(self, v):  # noqa: N802
        self.held = [*(self.held or []), *v]

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, _):  # noqa: N802
        return self.states.setdefault(name, State())

    getListState = getValueState  # noqa: N815

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def run(batches, delay=0.0):
    """Outcomes (start s, end s, outcome) of one recorder; batches of (second, event[, duration]), the watermark follows each."""
    m, h = streaming.Monitor(), Handle()
    m.init(h)
    out, latest, mark = [], 0.0, -1

    def taken(frames):
        return [(r.started / 1e6, r.ended / 1e6, r.outcome) for f in frames for r in f.itertuples()]

    for batch in [*batches, None]:
        if batch:
            rows = pd.DataFrame([{"at": int(e[0] * 1e6), "event": e[1], "duration_s": e[2] if len(e) > 2 else 100.0} for e in batch])
            out += taken(m.handleInputRows(("r",), iter([rows[:1], rows[1:]]), Now(mark)))
            latest = max(latest, *(e[0] for e in batch))
        mark = int((latest - delay) * 1000) if batch else 10**15
        while any(t <= mark for t in h.timers):
            before = set(h.timers)
            out += taken(m.handleExpiredTimer(("r",), Now(mark), None))
            assert h.timers != before
    assert not h.states["waiting"].exists() and not h.timers
    return out


def slow(events, poll=0.5):
    """The same by looking at all later events of each recording."""
    events = sorted(events, key=lambda e: (e[0], RANK[e[1]], len(e) > 2 and e[2] is not None, (e[2] if len(e) > 2 else 100.0) or 0.0))
    out, free = [], -1.0
    for i, e in enumerate(events):
        if e[1] != "START":
            continue
        t, d = e[0], e[2] if len(e) > 2 else 100.0
        if t < free:
            out.append((t, t, "DEVICE_BUSY"))
            continue
        ends = [(t + d, 3, "SUCCESS")] if d is not None else []
        for x in events[i + 1 :]:
            if x[1] == "CRASH":
                seen = t + math.ceil(round((x[0] - t) / poll, 9)) * poll
                if d is None or x[0] <= t + d:
                    ends.append((min(seen, t + d) if d is not None else seen, 2, "FAILED"))
            elif x[1] in ("STOP", "CANCEL"):
                ends.append((x[0], RANK[x[1]], "CANCELLED" if x[1] == "CANCEL" else "SUCCESS"))
        if ends:
            out.append((t, min(ends)[0], min(ends)[2]))
        free = min(ends)[0] if ends else math.inf
    return sorted(out)


def test_monitor_in_known_cases():
    assert run([[(0, "START"), (5, "STOP"), (9, "START")]]) == [(0, 5, "SUCCESS"), (9, 109, "SUCCESS")]
    assert run([[(0, "STOP"), (5, "START")]]) == [(5, 105, "SUCCESS")]
    assert run([[(100, "START")], [(95, "STOP")]], delay=10) == [(100, 200, "SUCCESS")]  # the STOP was before
    assert run([[(100, "START"), (110, "START"), (120, "STOP")]]) == [(110, 110, "DEVICE_BUSY"), (100, 120, "SUCCESS")]
    assert run([[(100, "START"), (110, "CRASH"), (150, "STOP")]]) == run([[(100, "START"), (110, "CRASH")], [(150, "STOP")]]) == [(100, 110, "FAILED")]
    assert run([[(100, "START"), (110.2, "CRASH"), (110.3, "STOP")]]) == [(100, 110.3, "SUCCESS")]  # before the next poll
    assert run([[(0, "START", None)], [(1e6, "STOP")]]) == [(0, 1e6, "SUCCESS")]
    assert run([[(0, "START", None)]]) == []
    assert run([[(0, "START"), (100, "CANCEL"), (100, "STOP"), (100, "START", 1.0)]]) == [(0, 100, "CANCELLED"), (100, 101, "SUCCESS")]


def test_monitor_gives_the_same_for_every_split():
    rnd = random.Random(4)
    for _ in range(300):
        events = [(rnd.randrange(0, 240) / 4, rnd.choice(["START", "START", "STOP", "CRASH", "CANCEL"]), rnd.choice([None, 0.25, 3.0, 10.0])) for _ in range(rnd.randint(1, 25))]
        want = slow(events)
        late = sorted(events, key=lambda e: e[0] + rnd.uniform(0, 4.9))  # at most so late
        cuts = sorted(rnd.sample(range(len(late) + 1), rnd.randint(0, min(5, len(late)))))
        batches = [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)], strict=True) if a < b]
        assert sorted(run(batches, delay=5.0)) == want
        assert sorted(run([events])) == want


def test_monitor_over_tables(spark):
    rnd = random.Random(6)
    events = [(r, rnd.randrange(0, 4000) / 4, rnd.choice(["START", "START", "STOP", "CRASH", "CANCEL", "HEARTBEAT"]), rnd.choice([None, 0.25, 3.0, 50.0])) for r in ["hot"] * 400 + ["a", "b", "c"] * 30]
    df = spark.createDataFrame([(r, t, e, d) for r, t, e, d in events], "recorder_id string, t double, event string, duration_s double").select("recorder_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "event", "duration_s")
    found = monitoring.outcomes(df.union(df.limit(1).select("recorder_id", F.lit(None).cast("timestamp"), "event", "duration_s"))).select("recorder_id", F.unix_micros("started") / 1e6, F.unix_micros("ended") / 1e6, "outcome")
    want = [(r, *x) for r in ("hot", "a", "b", "c") for x in slow([(t, e, d) for k, t, e, d in events if k == r and e in RANK])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_monitor_as_a_stream(spark, tmp_path):
    """Three files of events, one of them late, through the real state store; equal to the batch of all."""
    files = [[(0, "START", 500.0), (40, "CRASH", None)], [(50, "START", None), (30, "STOP", None)], [(200, "STOP", None), (5000, "HEARTBEAT", None)]]
    schema = "recorder_id string, ts timestamp, event string, duration_s double"
    every = []
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        lines = [json.dumps({"recorder_id": "r", "ts": f"2026-01-01T{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}Z", "event": e} | ({"duration_s": d} if d else {})) for t, e, d in rows]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        every += lines
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = streaming.monitor(stream, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, monitoring.outcomes(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()))
    assert got == want and [x[3] for x in got] == ["SUCCESS", "SUCCESS"]


def test_ingest_takes_finished_recordings_once(spark, tmp_path):
    side, out, mark = (str(tmp_path / x) for x in ("side", "out", "mark"))
    (tmp_path / "side").mkdir()
    for i, status in enumerate(("SUCCESS", "FAILED", "SUCCESS")):
        (tmp_path / "side" / f"{i}.json").write_text(json.dumps({"output_filename": f"f{i}", "recording_status": status}))
    run = lambda: streaming.ingest(spark, side, lambda b: b.select("output_filename", F.lit(1).alias("x")), out, mark).awaitTermination(60)
    assert run() and run()
    (tmp_path / "side" / "9.json").write_text(json.dumps({"output_filename": "f9", "recording_status": "SUCCESS"}))
    assert run()
    assert sorted(r["output_filename"] for r in spark.read.parquet(out).collect()) == ["f0", "f2", "f9"]


def test_sidecars_and_files_meet_in_either_order(spark, tmp_path):
    side, data, out, mark = (tmp_path / x for x in ("side", "data", "out", "mark"))
    side.mkdir()
    data.mkdir()
    now = int(time.time())
    stamp = lambda s: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now + s))

    def sidecar(name, file, status="SUCCESS", at=0):
        (side / f"{name}.json").write_text(json.dumps({"output_filename": f"/rec/{file}", "recording_status": status, "creation_timestamp": stamp(at)}))

    def run():
        s = spark.readStream.schema(SIDECAR).option("multiLine", True).option("timeZone", "UTC").json(str(side))
        f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(data))
        met = streaming.rendezvous(s, f).select("file_name", "data_length")
        q = met.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    sidecar("1", "a.iq")
    sidecar("2", "failed.iq", "FAILED")
    (data / "b.iq").write_bytes(b"12345")
    (data / "failed.iq").write_bytes(b"1")
    run()
    (data / "a.iq").write_bytes(b"123")
    sidecar("3", "b.iq", at=5)
    sidecar("4", "a.iq", at=9)  # a replayed sidecar
    sidecar("5", "never.iq")
    sidecar("6", "late.iq", at=-9000)
    (data / "late.iq").write_bytes(b"1")
    run()
    got = sorted(map(tuple, spark.read.parquet(str(out)).collect()))
    assert got == [("a.iq", 3), ("b.iq", 5)]
    s = spark.read.schema(SIDECAR).option("multiLine", True).option("timeZone", "UTC").json(str(side))
    batch = streaming.rendezvous(s, spark.read.format("binaryFile").load(str(data))).select("file_name", "data_length")
    assert sorted(map(tuple, batch.collect())) == got
