"""A user with most of the events is neither one array nor one task."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from skytrace.operators import training as TN
from skytrace.plans import captures
from skytrace.sources import scan


def test_spectra_of_a_hot_user(spark, tmp_path):
    rows = [(i, (i * 7919) % 50_000 * 60, 1 if i % 3 else i % 40, float(i % 101)) for i in range(3000)] + [(9000 + i, 60 * i, 99, 1.0) for i in range(7)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {len(r["v"]) for r in captures.event_frames(events).collect()} == {captures.NPERSEG}
    got = {(r["user_id"], r["t_idx"], r["bin"]): (r["time_s"], r["power"]) for r in captures.event_spectra(spark, str(tmp_path)).collect()}
    want = {}
    for user in {r[2] for r in rows}:
        v = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == user]
        for (k, b), p in np.ndenumerate(scan.power_db(np.array(v), captures.FS, captures.NPERSEG, captures.NOVERLAP)):
            want[user, k, b] = ((4 * k + 4) / 8, p)
    assert got.keys() == want.keys() and 99 not in {k[0] for k in got}
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-4 for x in want)


def test_rows_are_numbered_without_one_task_a_class(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 2).alias("label"))
    n = F.row_number().over(Window.partitionBy("label").orderBy(TN.hash_order("doc_id", "42"), "doc_id"))
    want = df.withColumn("n", n).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("label")))
    assert sorted(want.select("doc_id", (n - 1) % 5).collect()) == sorted(TN.folds(df, "doc_id", 5).select("doc_id", "fold").collect())
    assert sorted(want.select("doc_id", F.col("n") <= F.ceil(F.col("total") * 0.25)).collect()) == sorted(TN.split(df, "doc_id").select("doc_id", "is_test").collect())
    for plan in (TN.split(df, "doc_id"), TN.folds(df, "doc_id", 5)):
        rows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in x]
        assert rows and all("_bucket" in x for x in rows)
