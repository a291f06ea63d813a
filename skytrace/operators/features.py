"""Nine features of each capture, their projection, and the rule detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.functions import FEATURE_NAMES, MAX_SMOOTHNESS_HZ, MIN_DRIFT_HZ, MIN_VALID_RATIO, RETAINED_SUFFIXES, sanitise

from . import trace as T


def extract_features(smoothed: DataFrame) -> DataFrame:
    """One aggregation by capture over the smoothed trace table (with power sums of each slice)."""
    valid, snr = F.col("valid"), F.col("strongest_db") - F.col("noise_db")
    point = F.col("smoothed").isNotNull()
    drift = F.when(F.count_if(point) >= 2, F.abs(F.max_by("smoothed", F.when(point, F.col("t_idx"))) - F.min_by("smoothed", F.when(point, F.col("t_idx")))))
    spread = F.when(F.count_if(point) >= 3, F.stddev_pop("jump")).otherwise(float("inf"))
    when_valid = F.when(valid, F.col("time_s"))
    duration = F.when(F.count_if(valid) >= 2, F.max(when_valid) - F.min(when_valid)).otherwise(0.0)
    out = smoothed.groupBy("capture_id").agg(
        F.coalesce(F.avg(F.when(valid, snr)), F.avg(snr), F.lit(0.0)).alias("snr_db"),
        F.coalesce(drift, F.lit(0.0)).alias("frequency_drift_hz"),
        spread.alias("smoothness_score"),
        F.coalesce(F.avg(valid.cast("double")), F.lit(0.0)).alias("valid_signal_ratio"),
        F.max("strongest_db").alias("peak_power"),
        (F.sum("power_sum") / F.sum("n_bins")).alias("mean_power"),
        F.coalesce(F.percentile("width_hz", F.lit(0.5)), F.lit(0.0)).alias("occupied_bandwidth_hz"),
        duration.alias("signal_duration_seconds"),
    )
    rate = F.when(F.col("signal_duration_seconds") > 0, F.try_divide("frequency_drift_hz", "signal_duration_seconds")).otherwise(0.0)
    return out.withColumn("drift_rate_hz_per_second", rate).select("capture_id", *FEATURE_NAMES)


def peak_rows(slices: DataFrame, threshold_db: float, f0: float | Column, df: float | Column) -> DataFrame:
    """What features need of each slice, without its bins. No shuffle."""
    s = T.strongest(slices, threshold_db, f0, df)
    return s.withColumn("power_sum", F.aggregate("power_db", F.lit(0.0), lambda a, x: a + x)).withColumn("n_bins", F.size("power_db")).drop("power_db")


def slice_features(slices: DataFrame, threshold_db: float, f0: float | Column, df: float | Column, kernel: int = 7) -> DataFrame:
    """Slices (capture_id, t_idx, time_s, power_db) to features. Only slim trace rows are shuffled."""
    return peak_features(peak_rows(slices, threshold_db, f0, df), kernel)


def peak_features(peaks: DataFrame, kernel: int = 7, length: str | None = None, longest: int | None = None) -> DataFrame:
    """Rows of ``peak_rows`` to features; ``length`` and ``longest`` as in ``smooth``. Columns that features don't read go first, so that all passes of the smoothing read one shuffle."""
    used = ("capture_id", "t_idx", "time_s", "valid", "strongest_db", "noise_db", "trace_hz", "width_hz", "power_sum", "n_bins")
    return extract_features(T.smooth(peaks.select(*used, *([length] if length else [])), kernel, length=length, longest=longest))


def detect(features: DataFrame, min_ratio: float = MIN_VALID_RATIO, min_drift: float = MIN_DRIFT_HZ, max_smoothness: float = MAX_SMOOTHNESS_HZ) -> DataFrame:
    """Adds detected, confidence and notes. NaN fails every test; infinite smoothness adds nothing to the confidence."""
    ratio, drift, rough = F.col("valid_signal_ratio"), F.col("frequency_drift_hz"), F.col("smoothness_score")
    sound = lambda x, c: F.coalesce(c & ~F.isnan(x), F.lit(False))
    ok_ratio, ok_drift, ok_rough = sound(ratio, ratio >= min_ratio), sound(drift, drift >= min_drift), sound(rough, rough <= max_smoothness)
    finite = ~F.isnan(rough) & (F.abs(rough) < float("inf"))
    calm = F.when(finite, F.greatest(F.lit(0.0), 1 - rough / max(max_smoothness, 1e-9))).otherwise(0.0)
    parts = F.least(ratio / max(min_ratio, 1e-9), F.lit(1.0)) + F.least(drift / max(min_drift, 1e-9), F.lit(1.0)) + calm
    good = ok_ratio & ok_drift & ok_rough
    # fixed values: notes as the recordings' consumers know them
    notes = F.when(good, "candidate satellite Doppler-like drift").otherwise(
        F.concat_ws("; ", F.when(~ok_ratio, "not enough valid signal points"), F.when(~ok_drift, "frequency drift below threshold"), F.when(~ok_rough, "trace too noisy"))
    )
    return features.withColumns({"detected": good, "confidence": parts / 3, "notes": notes})


def project_features(features: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """Sanitised features in the wished order; an unknown name is an error."""
    unknown = [n for n in names if n not in features.columns]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    others = [c for c in features.columns if c not in FEATURE_NAMES]
    return features.select(*others, *[sanitise(F.col(n).cast("double")).alias(n) for n in names])


def retained(results: DataFrame) -> DataFrame:
    """Adds raw_iq_file_path: kept only for detected captures of raw I/Q."""
    raw = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*RETAINED_SUFFIXES)
    return results.withColumn("raw_iq_file_path", F.when(F.col("detected") & (F.col("kind") == "iq") & raw, F.col("path")))
