"""Segmented scans against plain windows and loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skytrace.operators import catalog as C
from skytrace.operators import order

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("schema", ["k string, o timestamp, i long, x double, s string", "k string, o timestamp_ntz, i long, x double, s string", "k string, o date, i long, x double, s string", "k string, o string, i long, x double, s string"])
def test_scan_equals_a_window(spark, schema):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        o = T0 + timedelta(hours=rnd.randrange(90))
        o = None if i % 50 == 0 else o.date() if "o date" in schema else str(o) if "o string" in schema else o
        rows.append((rnd.choice(["hot"] * 8 + ["a", "b", None]), o, i, rnd.choice([None, rnd.random()]), rnd.choice([None, "p", "q"])))
    df = spark.createDataFrame(rows, schema)
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.max("x").over(w).alias("m"), F.coalesce(F.count("x").over(w), F.lit(0)).alias("n"), F.lag("s").over(Window.partitionBy("k").orderBy("o", "i")).alias("last"))
    got = order.carried(df, ["k"], ["o", "i"], m=("max", F.col("x")), n=("sum", F.col("x").isNotNull().cast("long")), last=("last", F.col("s")))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scan_of_one_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("only").alias("k"), "id")
    bucket = df.groupBy(order.range_bucket(df, ["id"])).count().collect()
    assert len(bucket) == 4 and max(r["count"] for r in bucket) < 10_000
    assert order.carried(df, ["k"], ["id"], n=("sum", F.lit(1).cast("long"))).filter("n <> id").count() == 0
    assert order.carried(df.filter("false"), ["k"], ["id"], n=("sum", F.lit(1).cast("long"))).count() == 0


def test_range_is_found_by_halving(spark):
    """A row is compared with as many bounds as their number has digits, not with all; nulls come first."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 9 > 0, F.col("id") * 37 % 501).alias("o"), "id")
        bucket = order.range_bucket(df, ["o", "id"])
        plan = df.select(bucket)._jdf.queryExecution().analyzed().toString()
        assert "filter(" not in plan and "aggregate(array(32, 16, 8, 4, 2, 1)" in plan
        rows = df.select("o", "id", bucket.alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows.sort(key=lambda r: (r["o"] is not None, r["o"] or 0, r["id"]))
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows) and {r["b"] for r in rows} == set(range(64))


def test_pass_labels_of_long_and_short_intervals(spark):
    rnd = random.Random(3)
    t = lambda s: T0 + timedelta(seconds=s)
    passes = [(rnd.choice(["hot", "hot", "b", None]), a := rnd.randrange(10**6), a + rnd.choice([1, 60, 5000, 10**7])) for _ in range(60)]
    recs = [(i, rnd.choice(["hot", "hot", "b", "c", None]), a := rnd.randrange(-(10**6), 2 * 10**6), a + rnd.choice([0, 30, 90_000])) for i in range(300)]
    p = spark.createDataFrame([(s, t(a), t(b)) for s, a, b in passes] + [("c", None, t(1)), ("c", t(1), None)], "satellite string, aos timestamp, los timestamp")
    r = spark.createDataFrame([(i, s, t(a), t(b)) for i, s, a, b in recs] + [(1000, "hot", None, t(5)), (1001, "hot", t(5), None)], "recording_id long, satellite string, start timestamp, stop timestamp")
    got = {x["recording_id"]: x["label"] for x in C.pass_labels(r, p, 60, 120).collect()}
    assert got == {i: int(any(s is not None and s == q and a <= hi + 120 and b >= lo - 60 for q, lo, hi in passes)) for i, s, a, b in recs} | {1000: 0, 1001: 0}


def test_one_sidecar_a_file(spark):
    files = spark.createDataFrame([("a", 90), ("b", 5), ("b", 7)], "file_name string, length long")
    side = spark.createDataFrame([("a", 1, 5, T0), ("a", 2, 6, T0 + timedelta(1)), ("a", 3, 7, None)], "file_name string, sample_rate int, frequency_hz int, creation_timestamp timestamp")
    got = C.with_sidecar(files.limit(1), side).collect()
    assert [(r["sample_rate"], r["frequency_hz"]) for r in got] == [(2, 6)]
    assert C.with_sidecar(files.limit(1), side.drop("creation_timestamp")).count() == 1
    recs = spark.createDataFrame([("b", True, None, None, 1)], "file_name string, simulated boolean, start timestamp, stop timestamp, expected_size long")
    assert [r["file_size"] for r in C.verify(recs, files).collect()] == [7]
    twice = spark.createDataFrame([("a", True, T0, T0, 1, T0, ["x"]), ("a", False, T0, T0 + timedelta(1), 1000, T0 + timedelta(1), ["y"]), (None, True, T0, T0, 1, T0, None), (None, True, T0, T0, 1, T0, None)], "file_name string, simulated boolean, start timestamp, stop timestamp, expected_size long, creation_timestamp timestamp, command array<string>")
    assert sorted((r["file_name"] or "", r["simulated"], r["verified"]) for r in C.verify(twice, files).collect()) == [("", True, "FAILED"), ("", True, "FAILED"), ("a", False, "FAILED")]


def test_a_null_base_has_no_name(spark):
    new = spark.createDataFrame([(1, None), (2, None), (3, "b"), (4, "b")], "recording_id long, base string")
    assert [r["unique_name"] for r in C.unique_names(new).orderBy("recording_id").collect()] == [None, None, "b", "b_2"]
