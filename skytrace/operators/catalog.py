"""Jobs over the recording catalogue: parameter rules, joins, verification, overlaps, lifecycle, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.functions import DEFAULT_CENTER_HZ, DEFAULT_SAMPLE_RATE, DURATION_RANGE, FREQUENCY_RANGE, GAIN_RANGE, SAMPLE_RATE_RANGES, SIZE_TOLERANCE
from skytrace.operators.order import carried

# Allowed moves between lifecycle states; an idle or ended recorder may start.
TRANSITIONS = {
    "IDLE": ("STARTING",), "COMPLETED": ("STARTING",), "FAILED": ("STARTING",), "CANCELLED": ("STARTING",),
    "STARTING": ("RECORDING", "FAILED", "STOPPING"), "RECORDING": ("STOPPING",), "STOPPING": ("COMPLETED", "FAILED", "CANCELLED"),
}


def _within(x: Column, low: float, high: float) -> Column:
    return F.coalesce(x.between(low, high) & ~F.isnan(x.cast("double")), F.lit(False))


def parameter_violations(catalog: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, rule, value) for each frequency_hz, sample_rate, gain or duration (as strings) out of range. Automatic gain is null or 'auto'."""
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    rate = number("sample_rate", "bigint")
    auto = F.col("gain").isNull() | (F.lower(F.trim("gain")) == "auto")
    good = {
        "frequency_hz": _within(number("frequency_hz", "bigint"), *FREQUENCY_RANGE),
        "sample_rate": reduce(lambda a, b: a | b, [_within(rate, *r) for r in SAMPLE_RATE_RANGES]),
        "gain": auto | _within(number("gain", "double"), *GAIN_RANGE),
        "duration": _within(number("duration", "double"), *DURATION_RANGE),
    }
    found = F.filter(F.array(*[F.when(~ok, F.struct(F.lit(c).alias("rule"), F.col(c).cast("string").alias("value"))) for c, ok in good.items()]), lambda x: x.isNotNull())
    return catalog.select(key, F.explode(found).alias("f")).select(key, "f.rule", "f.value")


def latest(sidecars: DataFrame) -> DataFrame:
    """One sidecar a file name: that of the latest creation_timestamp, where there is such a column, else the largest row."""
    others = [c for c in sidecars.columns if c not in ("file_name", "creation_timestamp") and not sidecars.schema[c].dataType.typeName() == "map"]
    order = F.struct(*[c for c in ("creation_timestamp",) if c in sidecars.columns], *sorted(others))
    return sidecars.groupBy("file_name").agg(F.max_by(F.struct(*sidecars.columns), order).alias("s")).select("s.*")


def with_sidecar(manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every file with its sidecar's rate and frequency, or the defaults; of several sidecars of a file, the latest."""
    own = sidecars.select("file_name", "sample_rate", "frequency_hz", *[c for c in ("creation_timestamp",) if c in sidecars.columns])
    s = latest(own).select("file_name", F.col("sample_rate").alias("_r"), F.col("frequency_hz").alias("_f"), F.lit(True).alias("_has"))
    return manifest.join(s, "file_name", "left").withColumns(
        {"sample_rate": F.coalesce("_r", F.lit(DEFAULT_SAMPLE_RATE)), "frequency_hz": F.coalesce("_f", F.lit(DEFAULT_CENTER_HZ)), "has_sidecar": F.coalesce("_has", F.lit(False))}
    ).drop("_r", "_f", "_has")


def verify(sidecars: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds file_size and verified: missing, empty or too small files fail; there is no upper bound.

    A file listed twice counts once, by its largest size; of several sidecars of a file the latest is judged. Those without a file all fail.
    """
    files = manifest.groupBy("file_name").agg(F.max("length").alias("file_size"))
    named = latest(sidecars.filter("file_name is not null")).unionByName(sidecars.filter("file_name is null"))
    both = named.join(files, "file_name", "left").select(*sidecars.columns, "file_size")
    timed = ~F.col("simulated") & F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("expected_size") > 0)
    short = timed & (F.try_divide(F.col("file_size"), F.col("expected_size")) < 1 - SIZE_TOLERANCE)
    bad = F.col("file_size").isNull() | (F.col("file_size") <= 0) | F.coalesce(short, F.lit(False))
    return both.withColumn("verified", F.when(bad, "FAILED").otherwise("SUCCESS"))


def pass_labels(recordings: DataFrame, passes: DataFrame, pre_s: float, post_s: float) -> DataFrame:
    """label 1 where [start, stop] overlaps a pass of the same satellite, widened by the buffers; else 0.

    A recording overlaps a pass if the latest end of the passes that begin by its stop isn't before its start: one
    segmented scan over beginnings and stops, a row each, however long the intervals are.
    """
    at = lambda t: F.unix_micros(t)
    edge = lambda t, s: (F.unix_seconds(t) + F.lit(s)) * 1_000_000
    p = passes.select("satellite", edge(F.col("aos"), -pre_s).cast("long").alias("_t"), F.lit(0).alias("_kind"), edge(F.col("los"), post_s).cast("long").alias("_hi")).dropna(subset=["_t", "_hi"])
    r = recordings.withColumns({"_t": at(F.col("stop")), "_kind": F.lit(1)})
    seen = carried(r.unionByName(p, allowMissingColumns=True), ["satellite"], ["_t", "_kind"], _until=("max", F.col("_hi"))).filter("_kind = 1")
    return seen.withColumn("label", F.coalesce((F.col("_until") >= at(F.col("start"))) & F.col("satellite").isNotNull() & F.col("_t").isNotNull(), F.lit(False)).cast("int")).select(*recordings.columns, "label")


def overlaps(recordings: DataFrame, key: str = "recording_id") -> DataFrame:
    """Recordings that start while an earlier one of the same device still runs."""
    return carried(recordings, ["device"], ["start", key], busy_until=("max", F.col("stop"))).filter(F.col("busy_until") > F.col("start"))


def lifecycle_audit(events: DataFrame, transitions: dict[str, tuple[str, ...]] = TRANSITIONS, recorder: str = "recorder_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds previous and allowed. A recorder's first event counts as following IDLE."""
    out = carried(events, [recorder], list(order), previous=("last", F.col("state")))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, to in transitions.items() for b in to])
    move = F.concat(F.coalesce("previous", F.lit("IDLE")), F.lit(">"), "state")
    return out.withColumn("allowed", F.coalesce(F.array_contains(pairs, move), F.lit(False)))


def unique_names(names: DataFrame, base: str = "base", order: tuple[str, ...] = ("recording_id",), taken: DataFrame | None = None) -> DataFrame:
    """Adds unique_name: the first free one of base, base_2, base_3 and so on for each row in turn; a null base has no name.

    ``taken`` (name) holds names in use; a new base that looks like a numbered name of another new base counts as in use too.
    The k-th taken number s of a base leaves s - k free ones before it, so the n-th row's number is n plus the
    taken ones with s - k < n: one running count over rows and taken numbers together. All counts are segmented scans.
    A scan reads its rows several times, so names are worked out once, before the scans that read them again.
    """
    number = r"_([1-9]\d{0,8})$"
    bases = names.select(F.col(base).alias("_b")).filter("_b is not null").distinct().localCheckpoint()
    used = bases.select(F.col("_b").alias("name"))
    as_is = None if taken is None else taken.select("name").distinct().localCheckpoint()
    used = used if as_is is None else used.union(as_is)
    slots = used.filter(F.col("name").rlike(number)).select(F.regexp_replace("name", number, "").alias("_b"), F.regexp_extract("name", number, 1).cast("int").alias("_s")).filter("_s > 1")
    slots = (slots if as_is is None else slots.union(as_is.select(F.col("name").alias("_b"), F.lit(1).alias("_s")))).distinct().join(bases, "_b", "left_semi").localCheckpoint()
    one = F.lit(1).cast("long")
    gaps = carried(slots, ["_b"], ["_s"], _k=("sum", one)).select("_b", (F.col("_s") - F.col("_k") - 1).alias("_at"), one.alias("_taken"))
    rows = carried(names.withColumn("_b", F.col(base)), ["_b"], list(order), _k=("sum", one)).withColumns({"_at": F.col("_k") + 1, "_taken": F.lit(0).cast("long")}).drop("_k").localCheckpoint()
    # at one place rows come before taken numbers
    both = carried(rows.unionByName(gaps, allowMissingColumns=True), ["_b"], ["_at", "_taken"], _before=("sum", F.col("_taken"))).filter("_taken = 0")
    place = F.col("_at") + F.col("_before")
    return both.withColumn("unique_name", F.when(place == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), place.cast("string")))).select(*names.columns, "unique_name")


def status_rollup(recordings: DataFrame, keys: tuple[str, ...] = ("satellite", "device")) -> DataFrame:
    """Counts, bytes and mean completeness by status, with subtotals."""
    return recordings.rollup(*keys, "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.avg(F.try_divide(F.col("size"), F.col("expected_size"))).alias("completeness"), F.grouping_id().alias("level")
    )
