"""Column functions: names, timestamps, sizes, statuses, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the recordings' producer.
FEATURE_NAMES = ("snr_db", "frequency_drift_hz", "drift_rate_hz_per_second", "smoothness_score", "valid_signal_ratio", "peak_power", "mean_power", "occupied_bandwidth_hz", "signal_duration_seconds")
MIN_VALID_RATIO, MIN_DRIFT_HZ, MAX_SMOOTHNESS_HZ, SNR_THRESHOLD_DB = 0.45, 1500.0, 8000.0, 6.0
DEFAULT_SAMPLE_RATE, DEFAULT_CENTER_HZ = 240_000, 136_800_000
FREQUENCY_RANGE, GAIN_RANGE, DURATION_RANGE = (24_000_000, 1_766_000_000), (0.0, 50.0), (1.0, 86_400.0)
SAMPLE_RATE_RANGES = ((225_001, 300_000), (900_001, 3_200_000))
SIZE_TOLERANCE, SANITISED_LIMIT = 0.10, 1e6
BUSY_MARKERS = ("usb_claim_interface error", "usb_open error", "error claiming", "resource busy")
NOT_FOUND_MARKERS = ("no supported devices found",)
FOUND_MARKERS = ("found 1 device", "found device", "detached kernel driver")
RAW_SUFFIXES = ("bin", "iq", "dat")
RETAINED_SUFFIXES = ("npy", "bin", "iq", "dat")


def sanitise_name(name: Column) -> Column:
    """Safe file-name part: runs of other characters become one underscore; empty or null becomes UNKNOWN."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^_+|_+$", ""), F.lit("")), F.lit("UNKNOWN"))


def base_name(name: Column, start: Column, frequency_hz: Column) -> Column:
    """NAME_YYYYMMDD_HHMMSS_<f>Hz with the time in UTC, whatever the session's zone."""
    time = F.regexp_replace(F.substring(utc_iso(start), 1, 19), "[-:]", "")
    return F.concat_ws("_", sanitise_name(name), F.translate(time, "T", "_"), F.concat(frequency_hz.cast("string"), F.lit("Hz")))


def parse_base_name(base: Column) -> Column:
    """Struct (name, start, frequency_hz), null where the name has another form."""
    part = lambda g: F.nullif(F.regexp_extract(base, r"^(.+)_(\d{8}_\d{6})_(\d+)Hz(?:_\d+)?$", g), F.lit(""))
    return F.struct(part(1).alias("name"), F.try_to_timestamp(F.concat(part(2), F.lit("Z")), F.lit("yyyyMMdd_HHmmssX")).alias("start"), part(3).cast("long").alias("frequency_hz"))


def capture_id(stem: Column, timestamp: Column) -> Column:
    return F.concat(F.replace(stem, F.lit(" "), F.lit("_")), F.lit("_"), F.replace(timestamp, F.lit(":"), F.lit("")))


def expected_size(rate: Column, seconds: Column) -> Column:
    """Bytes of unsigned 8-bit I/Q pairs, truncated."""
    return (rate * 2 * seconds).cast("bigint")


def seconds_between(start: Column, stop: Column) -> Column:
    """Null unless both are there."""
    return (F.unix_micros(stop) - F.unix_micros(start)) / 1e6


def final_state(status: Column) -> Column:
    return F.when(status == "SUCCESS", "COMPLETED").when(status == "CANCELLED", "CANCELLED").when(status.isin("FAILED", "DEVICE_BUSY"), "FAILED")


def stop_status(cancelled: Column, crashed: Column, verified: Column) -> Column:
    """Cancelled comes before crashed, crashed before what the file check found."""
    return F.when(cancelled, "CANCELLED").when(crashed, "FAILED").otherwise(verified)


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found |= F.contains(F.lower(text), F.lit(m))
    return F.coalesce(found, F.lit(False))


def failure_class(log: Column) -> Column:
    """Busy before not found."""
    return F.when(_has(log, BUSY_MARKERS), "DEVICE_BUSY").when(_has(log, NOT_FOUND_MARKERS), "DEVICE_NOT_FOUND").otherwise("PROCESS_ERROR")


def probe_class(log: Column, exit_code: Column) -> Column:
    """Not found before busy, the other way round than :func:`failure_class`."""
    found = _has(log, FOUND_MARKERS) | F.coalesce(exit_code == 0, F.lit(False))
    return F.when(_has(log, NOT_FOUND_MARKERS), "NOT_FOUND").when(_has(log, BUSY_MARKERS), "BUSY").when(found, "FOUND").otherwise("UNKNOWN")


def file_kind(path: Column) -> Column:
    """From the lower-cased suffix: npy (its header decides), spectrogram, iq or rejected."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix == "npy", "npy").when(suffix.isin("txt", "csv"), "spectrogram").when(suffix.isin(*RAW_SUFFIXES), "iq").otherwise("rejected")


def sanitise(x: Column) -> Column:
    """Non-finite numbers to the limits; NaN and null to the lower one. NaN is tested first, as Spark ranks it above all numbers."""
    return F.when(x.isNull() | F.isnan(x), -SANITISED_LIMIT).when(x == float("inf"), SANITISED_LIMIT).when(x == float("-inf"), -SANITISED_LIMIT).otherwise(x)


def to_utc(x: Column) -> Column:
    """Text to a timestamp: a time without a zone is UTC, whatever the session's zone; null and unreadable texts are null."""
    zoned = x.rlike(r"(?i)(z|utc|[+-]\d{2}(:?\d{2})?)$") & x.contains(":")
    return F.try_to_timestamp(F.when(zoned, x).otherwise(F.concat(F.when(x.contains(":"), x).otherwise(F.concat(x, F.lit("T00:00:00"))), F.lit("Z"))))


def utc_iso(t: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC with microseconds where there are any; null stays null. Made from the epoch, so the session's zone doesn't matter."""
    us = F.unix_micros(t)
    second, rest = F.floor(us / 1_000_000), F.pmod(us, F.lit(1_000_000))
    day, of_day = F.floor(second / 86_400).cast("int"), F.pmod(second, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)
    text = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.when(rest > 0, F.format_string(".%06d", rest)).otherwise(""), F.lit("+00:00"))
    return F.when(t.isNotNull(), text)
