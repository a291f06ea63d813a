import math
import os
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skytrace import functions as FN
from skytrace.operators import catalog as C
from skytrace.operators import training as TN
from skytrace.operators.order import summed
from skytrace.plans import recordings
from skytrace.sources import iq, scan, store


def test_names(spark):
    table = {"NOAA 19": "NOAA_19", "ISS (ZARYA)/Test": "ISS_ZARYA_Test", "A!!!B": "A_B", "  ***KISS92***  ": "KISS92", "": "UNKNOWN", "   ": "UNKNOWN", "!!!": "UNKNOWN", None: "UNKNOWN"}
    df = spark.createDataFrame([(k, v) for k, v in table.items()], "k string, v string")
    assert all(r[0] == r[1] for r in df.select(FN.sanitise_name(F.col("k")), "v").collect())


def test_parameters(spark):
    rows = [("ok", "137900000", "2400000", None, "60"), ("ok2", "92000000", "250000", "AUTO", "1"), ("f", "1000", "250000", "30", "60"), ("f2", "1.5", "250000", "29.7", "60"), ("r", "92000000", "500000", "30", "60"), ("g", "92000000", "250000", "-5", "60"), ("d", "92000000", "250000", "auto", "1e7")]
    got = C.parameter_violations(spark.createDataFrame(rows, "recording_id string, frequency_hz string, sample_rate string, gain string, duration string")).collect()
    assert {(r[0], r[1]) for r in got} == {("f", "frequency_hz"), ("f2", "frequency_hz"), ("r", "sample_rate"), ("g", "gain"), ("d", "duration")}


def test_log_precedence(spark):
    both = spark.createDataFrame([("No supported devices found; resource busy",)], "t string")
    r = both.select(FN.failure_class(F.col("t")), FN.probe_class(F.col("t"), F.lit(1))).first()
    assert tuple(r) == ("DEVICE_BUSY", "NOT_FOUND")


def test_unique_names_past_taken(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "recording_id long, base string")
    taken = spark.createDataFrame([("a",), ("a_2",), ("a_3",)], "name string")
    got = C.unique_names(new, taken=taken).orderBy("recording_id").collect()
    assert [r["unique_name"] for r in got] == ["a_4", "a_5", "b"]


def test_first_free_name(spark):
    """Against names tried one after the other."""
    cases = ((["NOAA"], ["NOAA_19"]), (["a", "a", "a"], ["a", "a_5"]), (["b"], ["b_2"]), (["c"] * 6, ["c_2", "c_4", "c_5", "c_02"]), (["d", "d", "d_2"], []), (["e_2", "e_2"], ["e_2", "e"]))
    new = [(100 * k + i, b) for k, (own, _) in enumerate(cases) for i, b in enumerate(own)]
    taken = [(t,) for _, names in cases for t in names]
    got = {r["recording_id"]: r["unique_name"] for r in C.unique_names(spark.createDataFrame(new, "recording_id long, base string"), taken=spark.createDataFrame(taken, "name string")).collect()}
    used = {t for t, in taken} | {"d_2"}
    for i, b in new:
        if b == "d_2":
            want = b
        else:
            want, n = b, 1
            while want in used:
                n += 1
                want = f"{b}_{n}"
        used.add(want)
        assert got[i] == want


def test_names_are_worked_out_a_few_times(spark):
    """However many passes the scans take; it was 14 times a name."""
    calls = spark.sparkContext.accumulator(0)

    def name(i: int) -> str:
        calls.add(1)
        return "ab"[i % 2]

    new = spark.range(100).select(F.col("id").alias("recording_id"), F.udf(name)("id").alias("base"))
    taken = spark.createDataFrame([("a",), ("a_2",), ("b_3",)], "name string")
    assert C.unique_names(new, taken=taken).filter("unique_name in ('a_3', 'b', 'b_2', 'b_4')").count() == 4
    assert calls.value <= 500


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_utc_in_any_session_zone(spark, zone, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = {"2026-03-08T02:30:00": "2026-03-08T02:30:00+00:00", "2026-01-01T12:00:00+05:30": "2026-01-01T06:30:00+00:00", "2026-01-01 00:00:00.5Z": "2026-01-01T00:00:00.500000+00:00", "1969-12-31T23:59:59": "1969-12-31T23:59:59+00:00", "nonsense": None, None: None}
        df = spark.createDataFrame(list(table.items()), "x string, want string").withColumn("got", FN.utc_iso(FN.to_utc(F.col("x"))))
        assert all(r["got"] == r["want"] for r in df.collect())
        base = df.filter("want like '2026-03%'").select(FN.base_name(F.lit("A b"), FN.to_utc(F.col("x")), F.lit(5)).alias("b"))
        row = base.select("b", FN.utc_iso(FN.parse_base_name(F.col("b"))["start"])).first()
        assert tuple(row) == ("A_b_20260308_023000_5Hz", "2026-03-08T02:30:00+00:00")
        (tmp_path / "s.json").write_text('{"satellite_name": "A", "scheduled_aos": "2026-03-08T02:30:00", "recording_status": "SUCCESS"}')
        assert scan.sidecars(spark, str(tmp_path)).select(FN.utc_iso(F.col("scheduled_aos"))).first()[0] == "2026-03-08T02:30:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lifecycle(spark):
    rows = [("r", i, s) for i, s in enumerate(("STARTING", "RECORDING", "STOPPING", "COMPLETED", "RECORDING"))]
    got = C.lifecycle_audit(spark.createDataFrame(rows, "recorder_id string, ts long, state string")).orderBy("ts").collect()
    assert [r["allowed"] for r in got] == [True, True, True, True, False]


def test_overlap_and_verification(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    r = spark.createDataFrame([(1, "d", t(0), t(5)), (2, "d", t(1), t(2)), (3, "d", t(4), t(6)), (4, "d", t(7), t(8))], "recording_id long, device string, start timestamp, stop timestamp")
    assert {x["recording_id"] for x in C.overlaps(r).collect()} == {2, 3}
    side = spark.createDataFrame([("a", False, t(0), t(1), 100), ("b", False, t(0), t(1), 100), ("c", True, t(0), t(1), 100), ("e", False, t(0), t(1), 100)], "file_name string, simulated boolean, start timestamp, stop timestamp, expected_size long")
    files = spark.createDataFrame([("a", 90), ("b", 89), ("c", 1)], "file_name string, length long")
    assert {x["file_name"]: x["verified"] for x in C.verify(side, files).collect()} == {"a": "SUCCESS", "b": "FAILED", "c": "SUCCESS", "e": "FAILED"}


def test_sizes_are_sums_in_the_order_of_the_files(spark, tmp_path):
    """Sums of doubles that are floored near whole numbers: the same however the files are cut in tasks, also for an order of many lines."""
    rng = np.random.default_rng(5)
    keys = np.append(rng.integers(1, 500, 6000), np.zeros(6000, int))
    rng.shuffle(keys)
    prices = rng.integers(2, 2000, 12000) * 0.05
    os.mkdir(tmp_path / "lineitem.parquet")
    for i in range(3):  # a folder of files, each of several row groups
        part = slice(4000 * i, 4000 * (i + 1))
        pq.write_table(pa.table({"l_orderkey": keys[part], "l_extendedprice": prices[part]}), tmp_path / "lineitem.parquet" / f"part-{i}.parquet", row_group_size=500)
    pq.write_table(pa.table({"o_orderkey": np.arange(500), "o_custkey": np.ones(500, int), "o_orderdate": [datetime(2026, 1, 1)] * 500, "o_totalprice": np.ones(500), "o_orderstatus": ["F"] * 500}), tmp_path / "orders.parquet")
    sums = {}
    for k, price in zip(keys.tolist(), prices.tolist(), strict=True):
        sums[k] = sums.get(k, 0.0) + price
    want = {k: math.floor(v * 18) for k, v in sums.items()}
    cut = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cut)
    try:
        for size in ("1k", "16k", "128m"):
            spark.conf.set(cut, size)
            got = recordings.verified_recordings(spark, str(tmp_path)).collect()
            assert {r["file_name"]: r["file_size"] for r in got if r["file_size"] is not None} == want
    finally:
        spark.conf.set(cut, before)


def test_summed_keeps_the_order_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 1e16), ("a", 2, -1e16), ("b", 1, None), ("b", 2, 2.0), ("c", 1, None), (None, 1, 4.0)], "k string, n int, x double")
    got = {r["k"]: r["s"] for r in summed(df, ["k"], ["n"], s=F.col("x")).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": None, None: 4.0}


def test_validation_and_splits(spark):
    names = ("snr_db",)
    rows = [("a", "1", "0"), ("b", None, "1"), ("c", "x", "1"), ("d", "inf", "2"), ("a", "1", "0"), ("a", "1", "0")]
    df = spark.createDataFrame(rows, "capture_id string, snr_db string, label string")
    got = sorted((r[0], r[2]) for r in TN.validate(df, names).collect())
    assert got == [("bad_label", "d"), ("duplicate", "a"), ("duplicate", "a"), ("infinite", "d"), ("missing", "b"), ("non_numeric", "c")]
    both = sorted((r[0], r[2]) for r in TN.validate(df.drop("label"), names).collect())
    assert both == [("duplicate", "a"), ("duplicate", "a"), ("infinite", "d"), ("missing", "b"), ("missing_column", None), ("non_numeric", "c")]
    assert [tuple(r) for r in TN.validate(df.filter("false"), names).collect()] == [("empty", None, None)]
    assert {r[1] for r in TN.validate(df.drop("capture_id"), names).collect() if r[0] == "missing_column"} == {"capture_id"}
    lone = spark.createDataFrame([(i, int(i == 3)) for i in range(8)], "id long, label int")
    assert TN.split(lone, "id").filter("is_test").count() == 2
    many = spark.range(100).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    parts = TN.split(many, "id").groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["label"]: r["n"] for r in parts} == {0: 20, 1: 5}
    assert {r["count"] for r in TN.folds(many, "id", 5).groupBy("label", "fold").count().collect()} == {16, 4}


def test_guard_and_statuses(spark):
    df = spark.createDataFrame([("1",), ("0",)], "is_synthetic string")
    with pytest.raises(ValueError):
        TN.guard_synthetic(df, False)
    assert TN.guard_synthetic(df, True)
    one = spark.createDataFrame([(1.0,)], "snr_db double")
    assert TN.score(one).first()["ml_status"] == "MODEL_NOT_AVAILABLE"
    assert TN.score(one, status="SKIPPED").first()["ml_status"] == "SKIPPED"


def test_iq_chunks_equal_one_chunk(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=5000) + 1j * rng.normal(size=5000)).astype(np.complex64)
    x.tofile(tmp_path / "a.iq")
    np.save(tmp_path / "b.npy", x)
    files = spark.createDataFrame([(str(tmp_path / "a.iq"), "a", "complex64", 0, x.nbytes)], "path string, capture_id string, fmt string, offset long, length long")
    want = scan.power_db(x, 1000.0, 64, 32)
    for frames in (7, 1024):
        got = scan.iq_slices(files, 1000.0, 64, 32, frames).orderBy("t_idx").collect()
        assert len(got) == scan.frame_count(5000, 64, 32) and np.allclose([r["power_db"] for r in got], want)
    head = scan.npy_files(spark.createDataFrame([(str(tmp_path / "b.npy"),)], "path string")).first()
    assert (head["fmt"], head["verdict"], head["rows"]) == ("complex64", "iq", 5000)


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_text_matrices(spark, tmp_path, split):
    rng = np.random.default_rng(3)
    large = rng.normal(size=(200, 3)).round(4)
    files = {
        "good.csv": "# header, by hand\n1,2\n\n3 , 4  # last\n", "good2.txt": "1 2 3\r\n 4\t5 6 \n", "Upper.CSV": "1e3,-inf\nnan,.5", "large.csv": "\n".join(",".join(map(str, r)) for r in large.tolist()),
        "ragged.csv": "1,2\n3\n", "onerow.csv": "1,2\n", "onecolumn.txt": "1\n2\n3\n", "words.csv": "a,b\n1,2\n", "suffix.csv": "1d,2\n1,2\n", "open.csv": "1,2,\n3,4,\n", "empty.txt": "", "comments.txt": "# x\n#y\n", "ignored.log": "1 2\n3 4\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        good, bad = scan.text_matrices(spark, str(tmp_path))
        got = {}
        for r in good.collect():
            assert r["time_s"] == r["t_idx"]
            got.setdefault(r["capture_id"], {})[r["t_idx"]] = r["power_db"]
        assert {r["capture_id"] for r in bad.collect()} == {"ragged", "onerow", "onecolumn", "words", "suffix", "open", "comments"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {k.split(".")[0]: np.loadtxt(str(tmp_path / k), delimiter="," if k.lower().endswith("csv") else None) for k in ("good.csv", "good2.txt", "Upper.CSV", "large.csv")}
    assert set(got) == set(want)
    for k, m in want.items():
        np.testing.assert_array_equal([got[k][i] for i in range(len(got[k]))], m)


def test_iq_source_reads_what_is_asked_for(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

    rng = np.random.default_rng(5)
    x = {c: (rng.normal(size=3000) + 1j * rng.normal(size=3000)).astype(np.complex64) for c in "ab"}
    (tmp_path / "in").mkdir()
    x["a"].tofile(tmp_path / "in" / "a.iq")
    np.save(tmp_path / "in" / "b.npy", x["b"])
    np.save(tmp_path / "in" / "matrix.npy", np.zeros((3, 4)))
    (tmp_path / "in" / "note.md").write_text("no capture")
    iq.register(spark)
    options = {"path": str(tmp_path / "in"), "sample_rate": "1000", "nperseg": "64", "noverlap": "32", "frames": "20"}
    df = spark.read.format("iq").options(**options).load()
    want = {c: scan.power_db(v, 1000.0, 64, 32) for c, v in x.items()}
    rows = df.collect()
    assert len(rows) == sum(map(len, want.values())) and all(np.allclose(r["power_db"], want[r["capture_id"]][r["t_idx"]]) for r in rows)
    some = df.filter("capture_id = 'b' and t_idx >= 25 and t_idx < 41")
    assert sorted(r["t_idx"] for r in some.collect()) == list(range(25, 41)) and some.rdd.getNumPartitions() == 2
    assert df.filter("capture_id = 'none'").count() == 0
    reader, other = iq.IqReader(options), StringContains(("capture_id",), "a")
    bounds = [GreaterThan(("t_idx",), 39), LessThanOrEqual(("t_idx",), 60)]
    assert list(reader.pushFilters([EqualTo(("capture_id",), "a"), *bounds, other])) == [*bounds, other]
    assert [(p.capture_id, p.lo, p.hi) for p in reader.partitions()] == [("a", 40, 60), ("a", 60, 80)]
    (tmp_path / "in" / "a.iq").unlink()  # only the captures asked for are opened
    (tmp_path / "in" / "a.npy").write_bytes(b"broken")
    assert df.filter("capture_id = 'b'").count() == len(want["b"])


def test_result_store_is_keyed(spark, tmp_path):
    """A replayed capture leaves one row; a lookup reads its part of the table alone."""
    path = str(tmp_path / "r")
    old = store.migrate(spark.createDataFrame([("7x", "f", 1), ("7x", "f", 1), ("a1", "g", None)], "id string, input_file string, detection_result int"))
    assert old.columns == list(store.RESULT_COLUMNS) and old.first()["rule_detection_result"] is None
    for _ in range(2):
        store.append_results(old, path)
    captured = spark.createDataFrame([(f"f{i}", "2026", True, 0.5, "n", 0.5, 1.0, 2.0) for i in range(40)], "path string, timestamp_utc string, detected boolean, confidence double, notes string, valid_signal_ratio double, frequency_drift_hz double, smoothness_score double")
    store.append_results(store.result_rows(captured.limit(30)), path)
    store.append_results(store.result_rows(captured), path)
    all_ = store.results(spark, path)
    assert all_.count() == 42 and all_.select("id").distinct().count() == 42
    one = store.get_result(spark, path, "7x")
    assert one.count() == 1 and one.columns == list(store.RESULT_COLUMNS) and one.first()["input_file"] == "f"
    assert store.get_result(spark, path, "7y").count() == 0 and store.get_result(spark, path, "zz").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7x)" in plan and "id_part" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_summaries_of_both_generations(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("a.iq", "2026-01-02T03:04:05+0000", True, 0.5, 0.9, 10.0, float("inf"), "n", "SKIPPED", None, None, None)], "path string, timestamp_utc string, detected boolean, confidence double, valid_signal_ratio double, frequency_drift_hz double, smoothness_score double, notes string, ml_status string, ml_detection_result int, ml_confidence_score double, model_version string")
    store.write_summaries(rows, str(tmp_path / "s"))
    (tmp_path / "s" / "date=2025-01-01").mkdir()
    (tmp_path / "s" / "date=2025-01-01" / "old.json").write_text(json.dumps({"input_file": "b", "timestamp_utc": "2025", "detection_result": False, "confidence_score": 0.25}))
    new, old = store.read_summaries(spark, str(tmp_path / "s")).orderBy("input_file").collect()
    assert (new["rule_detection_result"], new["rule_confidence_score"], new["smoothness_score"], new["ml_status"]) == (True, 0.5, None, "SKIPPED")
    assert (old["rule_detection_result"], old["rule_confidence_score"], old["ml_status"]) == (False, 0.25, None)


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, size in (("a.iq", 3), ("deep/b.x.NPY", 4), ("c.Csv", 5), ("d.wav", 6), ("noend", 7)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    got = {(r["file_name"], r["stem"], r["kind"], r["length"]) for r in scan.manifest(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.iq", "a", "iq", 3), ("b.x.NPY", "b.x", "npy", 4), ("c.Csv", "c", "spectrogram", 5), ("d.wav", "d", "rejected", 6), ("noend", "noend", "rejected", 7)}


def test_sidecar_with_null_rate_counts(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file_name string")
    side = spark.createDataFrame([("a", None, 5)], "file_name string, sample_rate int, frequency_hz int")
    assert {r["file_name"]: r["has_sidecar"] for r in C.with_sidecar(files, side).collect()} == {"a": True, "b": False}


def test_npy_matrices_of_either_order(spark, tmp_path):
    m = np.arange(35, dtype=np.float32).reshape(7, 5)
    np.save(tmp_path / "rows.npy", m)
    np.save(tmp_path / "columns.npy", np.asfortranarray(m))
    files = scan.npy_files(spark.createDataFrame([(str(tmp_path / f"{x}.npy"), x) for x in ("rows", "columns")], "path string, capture_id string"))
    got = {}
    for r in scan.npy_slices(files, 3).collect():
        got.setdefault(r["capture_id"], {})[r["t_idx"]] = r["power_db"]
    assert {k: [v[i] for i in range(7)] for k, v in got.items()} == {"rows": m.tolist(), "columns": m.tolist()}


def test_unsigned_bytes_are_centred(spark, tmp_path):
    raw = np.random.default_rng(2).integers(0, 256, 400).astype(np.uint8)
    raw.tofile(tmp_path / "a.bin")
    x = (raw.astype(float) - 127.5) / 127.5
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), "a", "cu8", 0, 400)], "path string, capture_id string, fmt string, offset long, length long")
    got = scan.iq_slices(files, 1000.0, 64, 32).orderBy("t_idx").collect()
    assert np.allclose([r["power_db"] for r in got], scan.power_db(x[0::2] + 1j * x[1::2], 1000.0, 64, 32))
