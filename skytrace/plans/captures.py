"""Spectrograms, traces, features and detection: embeddings as slices, events as traces, line items as long spectrograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytrace.functions import FEATURE_NAMES
from skytrace.operators import features as FT
from skytrace.operators import trace as TR
from skytrace.operators.order import numbered
from skytrace.sources import scan, store

RATE, CENTER, BINS, THRESHOLD = 240_000.0, 136_800_000.0, 64, 0.25
F0, DF = scan.matrix_axis(RATE, CENTER, BINS)
ROUND = 6
#: Ids of a range in which slices are numbered.
ID_RANGE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a capture, its vectors by id are the slices."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("capture_id"), "vec_id", F.col("embedding").cast("array<double>").alias("power_db"))


def ordered(slim: DataFrame) -> DataFrame:
    """Numbers the slices of each capture, by ranges of ids: only rows without bins are shuffled, and no capture is one task."""
    n = F.col("_n") - 1
    return numbered(slim, ["capture_id"], F.expr(f"vec_id div {ID_RANGE}"), ["vec_id"]).withColumns({"t_idx": n.cast("long"), "time_s": n.cast("double"), "n_slices": F.col("_total")}).drop("vec_id", "_n", "_total")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(FT.peak_rows(spectra(spark, sf_dir), THRESHOLD, F0, DF))


def longest(df: DataFrame, key: str) -> int:
    """Rows of the commonest key: one count by key, which reads that column alone."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FT.peak_features(peaks(spark, sf_dir), length="n_slices", longest=longest(table(spark, sf_dir, "embeddings"), "label"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names})


def slice_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(peaks(spark, sf_dir).select("capture_id", "t_idx", "bin", "strongest_db", "noise_db", "valid", "trace_hz", "width_hz"), "strongest_db", "noise_db", "trace_hz", "width_hz")


def capture_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TR.smooth(peaks(spark, sf_dir).select("capture_id", "t_idx", "trace_hz", "n_slices"), length="n_slices", longest=longest(table(spark, sf_dir, "embeddings"), "label"))
    return rounded(out, "trace_hz", "filled", "smoothed", "jump")


def capture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), *FEATURE_NAMES)


def detect_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FT.detect(features(spark, sf_dir), max_smoothness=80_000.0)
    return rounded(out, *FEATURE_NAMES, "confidence")


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised features in model order; every fifth event value is made infinite or missing first."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    bad = F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 5 == 1, float("-inf")).when(F.col("event_id") % 5 == 2, float("nan")).otherwise(F.col("value"))
    wide = e.select("event_id", *[bad.alias(n) if n == "smoothness_score" else F.col("value").alias(n) for n in FEATURE_NAMES])
    return rounded(FT.project_features(wide, ("smoothness_score", "snr_db")), "smoothness_score", "snr_db")


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by time are a trace, numbered by days, so no user is one task."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("capture_id"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value").cast("double")).alias("trace_hz"))
    e = numbered(e, ["capture_id"], F.date_trunc("day", "ts"), ["ts", "event_id"])
    return e.select("capture_id", (F.col("_n") - 1).cast("long").alias("t_idx"), "trace_hz", F.col("_total").alias("n_slices"))


def event_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(TR.smooth(event_trace(spark, sf_dir), length="n_slices", longest=longest(table(spark, sf_dir, "events"), "user_id")), "trace_hz", "filled", "smoothed", "jump")


def event_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TR.smooth(event_trace(spark, sf_dir), length="n_slices", longest=longest(table(spark, sf_dir, "events"), "user_id")).withColumn("p", F.when(F.col("smoothed").isNotNull(), F.col("t_idx")))
    drift = F.when(F.count("p") >= 2, F.abs(F.max_by("smoothed", "p") - F.min_by("smoothed", "p"))).otherwise(0.0)
    rough = F.when(F.count("p") >= 3, F.stddev_pop("jump")).otherwise(float("inf"))
    return rounded(t.groupBy("capture_id").agg(F.count("p").alias("points"), drift.alias("drift"), rough.alias("smoothness")), "drift", "smoothness")


def lineitem_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("double").alias("power"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "power")) - 1
    return rounded(TR.strongest_long(li.withColumn("bin", n), "l_orderkey", "bin", "power", longest(li, "l_orderkey")), "strongest_db", "noise_db")


def matrix_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and time of every bin's maximum over the captures, on the matrix axis."""
    s = spectra(spark, sf_dir).select(F.posexplode("power_db").alias("bin", "p"))
    out = s.groupBy("bin").agg(F.max("p").alias("max_power"), F.avg("p").alias("mean_power"), F.count(F.lit(1)).alias("n"))
    return rounded(out.withColumn("frequency_hz", F.lit(F0) + F.lit(DF) * F.col("bin")), "max_power", "mean_power", "frequency_hz")


NPERSEG, NOVERLAP, FS = 8, 4, 8.0


def event_frames(events: DataFrame) -> DataFrame:
    """(user_id, t_idx, v): the NPERSEG values of each whole frame. Rows are numbered by hours, so no user is one task or one array."""
    step = NPERSEG - NOVERLAP
    e = numbered(events.select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value")), ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id", "value"])
    e = e.withColumn("i", F.col("_n") - 1).withColumn("t_idx", F.explode(F.expr(f"sequence(i div {step} - {NPERSEG // step - 1}, i div {step})")))
    e = e.filter((F.col("t_idx") >= 0) & (step * F.col("t_idx") + NPERSEG <= F.col("_total")))
    return e.groupBy("user_id", "t_idx").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v")).select("user_id", "t_idx", F.transform("v", lambda x: x["value"]).alias("v"))


def event_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power spectra of each user's event values (framing, window, FFT, dB, shift) in Arrow batches of frames."""

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                db = scan.power_db(np.concatenate([np.asarray(v, float) for v in batch["v"]]), FS, NPERSEG, 0)
                k, b = np.repeat(batch["t_idx"].to_numpy(), NPERSEG), np.tile(np.arange(NPERSEG), len(batch))
                yield pd.DataFrame({"user_id": batch["user_id"].repeat(NPERSEG).to_numpy(), "t_idx": k, "bin": b, "time_s": (k * (NPERSEG - NOVERLAP) + NPERSEG / 2) / FS, "power": db.ravel()})

    frames = event_frames(table(spark, sf_dir, "events"))
    return frames.mapInPandas(spectra, "user_id long, t_idx long, bin long, time_s double, power double").select("user_id", "t_idx", "bin", "time_s", F.round("power", 4).alias("power"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, k = FT.detect(features(spark, sf_dir), max_smoothness=80_000.0), F.col("capture_id").cast("int") % 4
    suffix = F.when(k == 0, ".iq").when(k == 1, ".csv").when(k == 2, ".NPY").otherwise(".npy")
    return FT.retained(det.withColumns({"path": F.concat(F.lit("captures/"), "capture_id", suffix), "timestamp_utc": F.lit("2026-01-01T00:00:00+0000"), "kind": F.when(k % 2 == 0, "iq").otherwise("spectrogram"), "ml_status": F.lit("SKIPPED"), "ml_detection_result": F.lit(None).cast("int"), "ml_confidence_score": F.lit(None).cast("double"), "model_version": F.lit(None).cast("string")}))


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of this generation with an older one that lacks the later columns."""
    new = store.result_rows(_scored(spark, sf_dir))
    old = store.migrate(new.drop("rule_detection_result", "rule_confidence_score", "ml_detection_result", "ml_confidence_score", "model_version").withColumn("id", F.concat(F.lit("old-"), "id")))
    return rounded(new.unionByName(old), "confidence_score", "valid_signal_ratio", "frequency_drift_hz", "smoothness_score", "rule_confidence_score")


def capture_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.summaries(_scored(spark, sf_dir)), "rule_confidence_score", "valid_signal_ratio", "frequency_drift_hz", "smoothness_score")


QUERIES = {f.__name__: f for f in (detect_captures, slice_peaks, capture_traces, capture_features, model_inputs, event_smoothing, event_drift, lineitem_peaks, matrix_axes, event_spectra, result_table, capture_summaries)}

_SLICES = f"""
s as (select cast(label as varchar) as capture_id, row_number() over (partition by label order by vec_id) - 1 as t_idx,
             list_transform(embedding, lambda x: cast(x as double)) as p from embeddings),
k as (select *, list_max(p) as strongest_db, list_median(p) as noise_db, list_position(p, list_max(p)) - 1 as bin from s),
w as (select *, strongest_db >= noise_db + {THRESHOLD} as valid,
             list_filter(range(0, len(p)), lambda i: p[i + 1] >= noise_db + {THRESHOLD}) as above from k),
pk as (select *, case when valid then cast({F0!r} as double) + cast({DF!r} as double) * bin end as trace_hz,
              case when valid then (list_max(above) - list_min(above)) * cast({DF!r} as double) end as width_hz from w)
"""


def _smooth_sql(source: str) -> str:
    """CTEs from a trace table (capture_id, t_idx, trace_hz) to sm with filled, smoothed and jump."""
    near = ", ".join(f"coalesce(lag(filled, {k}) over o, first_value(filled) over f)" for k in (3, 2, 1)) + ", filled, " + ", ".join(f"coalesce(lead(filled, {k}) over o, last_value(filled) over f)" for k in (1, 2, 3))
    return f"""
g as (select *, last_value(trace_hz ignore nulls) over b as pv, last_value(case when trace_hz is not null then t_idx end ignore nulls) over b as pi,
             first_value(trace_hz ignore nulls) over a as nv, first_value(case when trace_hz is not null then t_idx end ignore nulls) over a as ni
      from {source}
      window b as (partition by capture_id order by t_idx rows between unbounded preceding and current row),
             a as (partition by capture_id order by t_idx rows between current row and unbounded following)),
fl as (select *, case when trace_hz is not null then trace_hz when pv is null then nv when nv is null then pv
                      else pv + (nv - pv) * (t_idx - pi) / (ni - pi) end as filled from g),
md as (select *, list_median([{near}]) as med from fl
       window o as (partition by capture_id order by t_idx),
              f as (partition by capture_id order by t_idx rows between unbounded preceding and unbounded following)),
mk as (select *, case when trace_hz is not null then med end as smoothed from md),
sm as (select *, smoothed - last_value(smoothed ignore nulls) over (partition by capture_id order by t_idx rows between unbounded preceding and 1 preceding) as jump from mk)
"""


_FEATURES = f"""with {_SLICES}, {_smooth_sql('pk')},
ft as (select capture_id,
  coalesce(avg(case when valid then strongest_db - noise_db end), avg(strongest_db - noise_db), 0) as snr_db,
  case when count(smoothed) >= 2 then abs(arg_max(smoothed, case when smoothed is not null then t_idx end) - arg_min(smoothed, case when smoothed is not null then t_idx end)) else 0 end as frequency_drift_hz,
  case when count(smoothed) >= 3 then stddev_pop(jump) else cast('inf' as double) end as smoothness_score,
  avg(case when valid then 1.0 else 0.0 end) as valid_signal_ratio, max(strongest_db) as peak_power, sum(list_sum(p)) / sum(len(p)) as mean_power,
  coalesce(median(width_hz), 0) as occupied_bandwidth_hz,
  case when count(case when valid then 1 end) >= 2 then cast(max(case when valid then t_idx end) - min(case when valid then t_idx end) as double) else 0 end as signal_duration_seconds
  from sm group by capture_id),
fr as (select *, case when signal_duration_seconds > 0 then frequency_drift_hz / signal_duration_seconds else 0 end as drift_rate_hz_per_second from ft)"""
#: The same of windows of 5 slices of a capture.
WINDOW_FEATURES_SQL = "with s as (select 'SAT ' || c as satellite, c || '-' || (n // 5) as capture_id, n % 5 as t_idx, p, vec_id from (select cast(label as varchar) as c, row_number() over (partition by label order by vec_id) - 1 as n, list_transform(embedding, lambda x: cast(x as double)) as p, vec_id from embeddings)),\nk as" + _FEATURES.partition("\nk as")[2]
_ROUNDED = ", ".join(f"round({n}, 6) as {n}" for n in FEATURE_NAMES)
_DETECT = f"""{_FEATURES},
tt as (select *, valid_signal_ratio >= 0.45 as a, frequency_drift_hz >= 1500 as b, smoothness_score <= 80000 as c from fr),
dt as (select *, a and b and c as detected,
  (least(valid_signal_ratio / 0.45, 1) + least(frequency_drift_hz / 1500, 1) + case when isfinite(smoothness_score) then greatest(0, 1 - smoothness_score / 80000) else 0 end) / 3 as confidence,
  case when a and b and c then 'candidate satellite Doppler-like drift' else concat_ws('; ', case when not a then 'not enough valid signal points' end, case when not b then 'frequency drift below threshold' end, case when not c then 'trace too noisy' end) end as notes from tt),
sc as (select *, 'captures/' || capture_id || ['.iq', '.csv', '.NPY', '.npy'][cast(capture_id as int) % 4 + 1] as path, '2026-01-01T00:00:00+0000' as timestamp_utc,
  case when cast(capture_id as int) % 2 = 0 then 'iq' else 'spectrogram' end as kind from dt)"""
_RESULT = """sha256(path || '|' || timestamp_utc) as id, path as input_file, timestamp_utc, cast(detected as int) as detection_result, round(confidence, 6) as confidence_score,
  round(valid_signal_ratio, 6) as valid_signal_ratio, round(frequency_drift_hz, 6) as frequency_drift_hz, round(smoothness_score, 6) as smoothness_score, cast(null as varchar) as spectrogram_image_path,
  case when detected and kind = 'iq' then path end as raw_iq_file_path, notes"""

ORACLE_SQL = {
    "detect_captures": f"{_DETECT} select capture_id, {_ROUNDED}, detected, round(confidence, 6) as confidence, notes from dt",
    "slice_peaks": f"with {_SLICES} select capture_id, t_idx, bin, round(strongest_db, 6) as strongest_db, round(noise_db, 6) as noise_db, valid, round(trace_hz, 6) as trace_hz, round(width_hz, 6) as width_hz from pk",
    "capture_traces": f"with {_SLICES}, {_smooth_sql('pk')} select capture_id, t_idx, round(trace_hz, 6) as trace_hz, round(filled, 6) as filled, round(smoothed, 6) as smoothed, round(jump, 6) + cast(0 as double) as jump from sm",
    "capture_features": f"{_FEATURES} select capture_id, {_ROUNDED} from fr",
    "model_inputs": "select event_id, round(case event_id % 5 when 0 then 1e6 when 1 then -1e6 when 2 then -1e6 else value end, 6) as smoothness_score, round(value, 6) as snr_db from events",
    "event_smoothing": f"""with tr as (select cast(user_id as varchar) as capture_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t_idx,
        case when event_type <> 'error' then cast(value as double) end as trace_hz from events), {_smooth_sql('tr')}
        select capture_id, t_idx, round(trace_hz, 6) as trace_hz, round(filled, 6) as filled, round(smoothed, 6) as smoothed, round(jump, 6) + cast(0 as double) as jump from sm""",
    "event_drift": f"""with tr as (select cast(user_id as varchar) as capture_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t_idx,
        case when event_type <> 'error' then cast(value as double) end as trace_hz from events), {_smooth_sql('tr')}
        select capture_id, count(smoothed) as points,
          round(case when count(smoothed) >= 2 then abs(arg_max(smoothed, case when smoothed is not null then t_idx end) - arg_min(smoothed, case when smoothed is not null then t_idx end)) else 0 end, 6) as drift,
          round(case when count(smoothed) >= 3 then stddev_pop(jump) else cast('inf' as double) end, 6) as smoothness from sm group by capture_id""",
    "lineitem_peaks": """with n as (select l_orderkey, cast(l_extendedprice as double) as power,
          row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bin from lineitem),
        m as (select l_orderkey, max(power) as p, median(power) as noise from n group by 1)
        select m.l_orderkey, min(n.bin) as bin, round(m.p, 6) as strongest_db, round(m.noise, 6) as noise_db from m join n on n.l_orderkey = m.l_orderkey and n.power = m.p group by m.l_orderkey, m.p, m.noise""",
    "matrix_axes": f"""with s as (select unnest(list_transform(embedding, lambda x: cast(x as double))) as p, unnest(range(0, len(embedding))) as bin from embeddings)
        select bin, round(max(p), 6) as max_power, round(avg(p), 6) as mean_power, count(*) as n, round(cast({F0!r} as double) + cast({DF!r} as double) * bin, 6) as frequency_hz from s group by bin""",
    "event_spectra": """with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n, cast(value as double) as v from events),
        fr as (select e.user_id, k.k as t_idx, e.i - 4 * k.k as j, e.v * (0.5 - 0.5 * cos(2 * pi() * (e.i - 4 * k.k) / 8)) as x
               from e, lateral (select unnest([e.i // 4 - 1, e.i // 4]) as k) k where k.k >= 0 and 4 * k.k + 8 <= e.n and e.i - 4 * k.k between 0 and 7),
        tw as (select b.range as b, j.range as j, cos(2 * pi() * b.range * j.range / 8) as c, sin(2 * pi() * b.range * j.range / 8) as s from range(8) b, range(8) j),
        ft as (select fr.user_id, fr.t_idx, tw.b, sum(x * c) as re, sum(x * s) as im from fr join tw on tw.j = fr.j group by all)
        select user_id, t_idx, (b + 4) % 8 as bin, (t_idx * 4 + 4) / 8.0 as time_s,
          round(10 * log10((re * re + im * im) / (8.0 * 3.0) + 2.220446049250313e-16), 4) as power from ft""",
    "result_table": f"""{_DETECT} select {_RESULT}, cast(detected as int) as rule_detection_result, round(confidence, 6) as rule_confidence_score, cast(null as int) as ml_detection_result, cast(null as double) as ml_confidence_score, cast(null as varchar) as model_version from sc
        union all by name select * replace ('old-' || id as id), cast(null as int) as rule_detection_result, cast(null as double) as rule_confidence_score, cast(null as int) as ml_detection_result, cast(null as double) as ml_confidence_score, cast(null as varchar) as model_version from (select {_RESULT} from sc)""",
    "capture_summaries": f"""{_DETECT} select path as input_file, timestamp_utc, detected as rule_detection_result, round(confidence, 6) as rule_confidence_score, round(valid_signal_ratio, 6) as valid_signal_ratio,
        round(frequency_drift_hz, 6) as frequency_drift_hz, case when isfinite(smoothness_score) then round(smoothness_score, 6) end as smoothness_score, notes, 'SKIPPED' as ml_status,
        cast(null as int) as ml_detection_result, cast(null as double) as ml_confidence_score, cast(null as varchar) as model_version from sc""",
}
