"""The recording catalogue: orders as recordings, parts as parameters and names, events as states, documents as files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace import functions as FN
from skytrace.operators import catalog as C
from skytrace.operators import monitor
from skytrace.operators.order import summed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("recording_id"), F.col("o_custkey").alias("device"), F.concat(F.lit("SAT "), (F.col("o_custkey") % 7).cast("string")).alias("satellite"),
        start.alias("start"), F.timestamp_seconds(F.unix_seconds(start) + 30 * 86400).alias("stop"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("code"),
    )


def parameter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("double")
    c = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("recording_id"), F.floor(price * 100_000).cast("string").alias("frequency_hz"), F.floor(price * 1000).cast("string").alias("sample_rate"),
        F.when(F.col("p_size") % 10 == 0, " AUTO ").when(F.col("p_size") % 10 == 1, "loud").otherwise((F.col("p_size") + 5).cast("string")).alias("gain"), (F.col("p_size") - 3).cast("string").alias("duration"),
    )
    return C.parameter_violations(c)


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_name"), F.col("o_orderkey").alias("recording_id"))
    side = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("file_name"), (F.col("c_nationkey") * 1000 + 240_000).cast("int").alias("sample_rate"), (F.col("c_nationkey") + 136_000_000).cast("int").alias("frequency_hz"))
    return C.with_sidecar(files, side)


def verified_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recordings(spark, sf_dir).select(F.col("recording_id").alias("file_name"), (F.col("device") % 11 == 0).alias("simulated"), "start", "stop", FN.expected_size(F.lit(1000), F.col("price") / 100).alias("expected_size"))
    # whole numbers are often just met, so the order of addition decides: that of the rows in the files, however these are cut in tasks
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_name"), F.col("l_extendedprice").cast("double").alias("price"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = summed(lines, ["file_name"], ["_file", "_row"], total=F.col("price")).select("file_name", F.floor(F.col("total") * 18).cast("long").alias("length"))
    return C.verify(r, files).select("file_name", "simulated", "expected_size", "file_size", "verified")


def pass_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("recording_id"), F.concat(F.lit("SAT "), (F.col("user_id") % 7).cast("string")).alias("satellite"), F.col("ts").cast("timestamp").alias("start"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 600).alias("stop"))
    passes = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("SAT "), (F.col("user_id") % 7).cast("string")).alias("satellite"), F.col("ts").cast("timestamp").alias("aos"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 300).alias("los"))
    return C.pass_labels(events, passes, 60, 120).select("recording_id", "label")


def overlapping_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlaps(recordings(spark, sf_dir)).select("recording_id", "device", "start", "busy_until")


def lifecycle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "STARTING"), ("view", "RECORDING"), ("purchase", "STOPPING"), ("error", "FAILED")) for x in p]), F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("recorder_id"), "ts", F.coalesce(state, F.lit("COMPLETED")).alias("state"))
    return C.lifecycle_audit(e, order=("ts", "event_id")).groupBy("previous", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


def recorder_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of recordings: clicks start one for some hours, signups one without an end; polls are an hour apart."""
    event = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "START"), ("signup", "START"), ("view", "STOP"), ("purchase", "CANCEL"), ("error", "CRASH")) for x in p]), F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("recorder_id"), "ts", event.alias("event"), F.when(F.col("event_type") == "click", F.floor("value") * 3600.0).alias("duration_s"))
    return monitor.outcomes(e, poll_s=3600.0)


def log_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure and probe classes of log texts; markers are put into some of them."""
    n = F.col("doc_id") % 6
    put = F.when(n == 0, " usb_claim_interface error -6").when(n == 1, " No Supported Devices Found.").when(n == 2, " no supported devices found; resource busy").when(n == 3, " Found 1 device").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), put).alias("log"), (F.col("doc_id") % 5).alias("code"))
    return d.select("doc_id", FN.failure_class(F.col("log")).alias("failure"), FN.probe_class(F.col("log"), F.col("code")).alias("probe"))


def names_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names built, parsed back, made unique; UTC times; sizes; final states."""
    r = recordings(spark, sf_dir)
    hz = (F.col("recording_id") % 1000 + 137_000_000).cast("long")
    base = FN.base_name(F.col("satellite"), F.col("start"), hz)
    out = r.select("recording_id", base.alias("base"), "start", "stop", "price", "code").withColumn("parsed", FN.parse_base_name(F.col("base")))
    status = F.when(F.col("code") == "F", "SUCCESS").when(F.col("code") == "O", "DEVICE_BUSY").otherwise("CANCELLED")
    return out.select(
        "recording_id", "base", F.col("parsed.name").alias("name"), F.col("parsed.start").alias("start"), F.col("parsed.frequency_hz").alias("frequency_hz"), FN.seconds_between(F.col("start"), F.col("stop")).alias("seconds"),
        FN.expected_size(F.col("price"), F.lit(1.5)).alias("expected_size"), FN.final_state(status).alias("state"), FN.stop_status(F.col("recording_id") % 5 == 0, F.col("recording_id") % 3 == 0, F.lit("SUCCESS")).alias("stop_status"),
        FN.capture_id(F.col("base"), F.concat(F.substring(FN.utc_iso(F.col("start")), 1, 19), F.lit("+0000"))).alias("capture_id"),
    )


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised names, whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", FN.sanitise_name(F.col("text")).alias("name"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("recording_id"), FN.sanitise_name(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("base"))
    return C.unique_names(p)


def names_past_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free names for parts where every third part's name, plain or numbered, is in use already."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("recording_id"), FN.sanitise_name(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("base"), "p_size")
    number = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("_"), (F.col("p_size") % 4 + 1).cast("string"))).otherwise("")
    return C.unique_names(p.select("recording_id", "base"), taken=p.filter("recording_id % 3 = 0").select(F.concat("base", number).alias("name")))


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders in four spellings, as ISO texts in UTC."""
    k, day = F.col("o_orderkey") % 4, F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    text = F.when(k == 0, F.concat(day, F.lit("T10:00:00"))).when(k == 1, F.concat(day, F.lit("T10:00:00+02:00"))).when(k == 2, F.concat(day, F.lit(" 23:59:59.250000Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("given")).withColumn("utc", FN.utc_iso(FN.to_utc(F.col("given"))))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("iq", "CSV", "npy", "wav", "Dat")]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), "n_chars")
    return d.select("path", FN.file_kind(F.col("path")).alias("kind"), F.col("n_chars").alias("length"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("code") == "F", "SUCCESS").when(F.col("code") == "O", "FAILED").otherwise("CANCELLED")
    r = recordings(spark, sf_dir).select("satellite", (F.col("device") % 3).alias("device"), status.alias("status"), F.floor("price").cast("long").alias("size"), (F.col("price") + 1000).alias("expected_size"))
    return C.status_rollup(r).withColumn("completeness", F.round("completeness", 6))


QUERIES = {f.__name__: f for f in (parameter_violations, catalog_join, verified_recordings, pass_labels, overlapping_recordings, lifecycle_audit, recorder_outcomes, log_classes, names_and_sizes, safe_names, unique_names, names_past_taken, utc_times, file_manifest, status_rollup)}

_REC = """r as (select o_orderkey as recording_id, o_custkey as device, 'SAT ' || (o_custkey % 7) as satellite, cast(o_orderdate as timestamp) as start,
  cast(o_orderdate as timestamp) + interval 30 day as stop, cast(o_totalprice as double) as price, o_orderstatus as code from orders)"""
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({0}, ' '), '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'UNKNOWN')"


def _markers(x: str, markers: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({x}), '{m}')" for m in markers) + ")"


ORACLE_SQL = {
    "parameter_violations": """with c as (select p_partkey as recording_id, cast(floor(cast(p_retailprice as double) * 100000) as bigint) as f, cast(floor(cast(p_retailprice as double) * 1000) as bigint) as s, p_size as z from part)
        select recording_id, 'frequency_hz' as rule, cast(f as varchar) as value from c where not f between 24000000 and 1766000000
        union all select recording_id, 'sample_rate', cast(s as varchar) from c where not (s between 225001 and 300000 or s between 900001 and 3200000)
        union all select recording_id, 'gain', case when z % 10 = 1 then 'loud' else cast(z + 5 as varchar) end from c where z % 10 <> 0 and (z % 10 = 1 or z + 5 > 50)
        union all select recording_id, 'duration', cast(z - 3 as varchar) from c where z - 3 < 1 or z - 3 > 86400""",
    "catalog_join": """select o_custkey as file_name, o_orderkey as recording_id, coalesce(c_nationkey * 1000 + 240000, 240000) as sample_rate, coalesce(c_nationkey + 136000000, 136800000) as frequency_hz, c_custkey is not null as has_sidecar
        from orders left join customer on c_custkey = o_custkey and c_custkey % 3 <> 0""",
    "verified_recordings": """with f as (select l_orderkey, cast(floor(sum(cast(l_extendedprice as double)) * 18) as bigint) as size from lineitem group by 1),
        x as (select o_orderkey as file_name, o_custkey % 11 = 0 as simulated, cast(trunc(2000 * (cast(o_totalprice as double) / 100)) as bigint) as expected_size, size as file_size from orders left join f on l_orderkey = o_orderkey)
        select *, case when file_size is null or file_size <= 0 or (not simulated and expected_size > 0 and file_size / expected_size < 0.9) then 'FAILED' else 'SUCCESS' end as verified from x""",
    "pass_labels": """with e as (select event_id as recording_id, user_id % 7 as sat, date_trunc('second', ts) as sec, ts as start, date_trunc('second', ts) + interval 600 second as stop, event_type from events),
        p as (select sat, sec - interval 60 second as lo, sec + interval 420 second as hi from e where event_type = 'error')
        select recording_id, cast(exists (select 1 from p where p.sat = e.sat and e.start <= p.hi and e.stop >= p.lo) as int) as label from e""",
    "overlapping_recordings": f"""with {_REC}, w as (select *, max(stop) over (partition by device order by start, recording_id rows between unbounded preceding and 1 preceding) as busy_until from r)
        select recording_id, device, start, busy_until from w where busy_until > start""",
    "lifecycle_audit": """with e as (select user_id, ts, event_id, case event_type when 'click' then 'STARTING' when 'view' then 'RECORDING' when 'purchase' then 'STOPPING' when 'error' then 'FAILED' else 'COMPLETED' end as state from events),
        l as (select *, lag(state) over (partition by user_id order by ts, event_id) as previous from e)
        select previous, state, coalesce(previous, 'IDLE') || '>' || state in ('IDLE>STARTING', 'COMPLETED>STARTING', 'FAILED>STARTING', 'CANCELLED>STARTING', 'STARTING>RECORDING', 'STARTING>FAILED', 'STARTING>STOPPING', 'RECORDING>STOPPING', 'STOPPING>COMPLETED', 'STOPPING>FAILED', 'STOPPING>CANCELLED') as allowed, count(*) as n from l group by all""",
    "recorder_outcomes": """with recursive e as (
          select user_id as r, epoch_us(ts) as t, case event_type when 'purchase' then 0 when 'view' then 1 when 'error' then 2 else 3 end as rank,
                 case when event_type = 'click' then cast(floor(value) * 3600000000 as bigint) end as dur, event_id from events where ts is not null and event_type is not null),
        o as (select *, row_number() over (partition by r order by t, rank, dur nulls first, event_id) as k from e),
        -- s, u, c: start of the running recording, end of its duration, poll that sees its crash; a, b: what has ended
        w(r, k, s, u, c, a, b) as (
          select distinct r, 0::bigint, null::bigint, null::bigint, null::bigint, null::struct(s bigint, e bigint, o varchar), null::struct(s bigint, e bigint, o varchar) from o
          union all
          select r, k, case when rank = 3 and s is null then t when rank < 2 then null else s end, case when rank = 3 and s is null then t + dur when rank < 2 then null else u end,
                 case when rank = 3 and s is null or rank < 2 then null when rank = 2 and s is not null then coalesce(c, least(s + cast(ceil((t - s) / 3600000000.0) as bigint) * 3600000000, u)) else c end,
                 a, case when s is null then null when rank = 3 then {s: t, e: t, o: 'DEVICE_BUSY'} when rank = 0 then {s: s, e: t, o: 'CANCELLED'} when rank = 1 then {s: s, e: t, o: 'SUCCESS'} end
          from (select r, k, t, rank, dur, case when over then null else s end as s, case when over then null else u end as u, case when over then null else c end as c,
                       case when over then {s: s, e: least(u, c), o: case when c <= u or u is null then 'FAILED' else 'SUCCESS' end} end as a
                from (select w.r, o.k, o.t, o.rank, o.dur, s, u, c, coalesce(s is not null and (least(u, c) < o.t or least(u, c) = o.t and o.rank = 3), false) as over from w join o on o.r = w.r and o.k = w.k + 1))),
        x as (select r, unnest([a, b]) as z from w
          union all select r, {s: s, e: least(u, c), o: case when c <= u or u is null then 'FAILED' else 'SUCCESS' end} from w where s is not null and least(u, c) is not null and k = (select max(k) from o where o.r = w.r))
        select r as recorder_id, make_timestamp(z.s) as started, make_timestamp(z.e) as ended, z.o as outcome from x where z is not null""",
    "log_classes": f"""with d as (select doc_id, coalesce(text, '') || case doc_id % 6 when 0 then ' usb_claim_interface error -6' when 1 then ' No Supported Devices Found.' when 2 then ' no supported devices found; resource busy' when 3 then ' Found 1 device' else '' end as log, doc_id % 5 as code from documents)
        select doc_id, case when {_markers('log', FN.BUSY_MARKERS)} then 'DEVICE_BUSY' when {_markers('log', FN.NOT_FOUND_MARKERS)} then 'DEVICE_NOT_FOUND' else 'PROCESS_ERROR' end as failure,
        case when {_markers('log', FN.NOT_FOUND_MARKERS)} then 'NOT_FOUND' when {_markers('log', FN.BUSY_MARKERS)} then 'BUSY' when {_markers('log', FN.FOUND_MARKERS)} or code = 0 then 'FOUND' else 'UNKNOWN' end as probe from d""",
    "names_and_sizes": f"""with {_REC}, b as (select *, replace(satellite, ' ', '_') as name, recording_id % 1000 + 137000000 as frequency_hz from r),
        n as (select *, name || '_' || strftime(start, '%Y%m%d_%H%M%S') || '_' || frequency_hz || 'Hz' as base from b)
        select recording_id, base, name, start, frequency_hz, 30 * 86400.0 as seconds, cast(trunc(price * 2 * 1.5) as bigint) as expected_size,
        case code when 'F' then 'COMPLETED' when 'O' then 'FAILED' else 'CANCELLED' end as state, case when recording_id % 5 = 0 then 'CANCELLED' when recording_id % 3 = 0 then 'FAILED' else 'SUCCESS' end as stop_status,
        base || '_' || strftime(start, '%Y-%m-%dT%H%M%S+0000') as capture_id from n""",
    "safe_names": f"select doc_id, {_SAFE.format('text')} as name from documents",
    "unique_names": f"""with p as (select p_partkey as recording_id, {_SAFE.format("regexp_extract(p_name, '^([^ ]+)', 1)")} as base from part),
        n as (select *, row_number() over (partition by base order by recording_id) as n from p) select recording_id, base, case when n = 1 then base else base || '_' || n end as unique_name from n""",
    "names_past_taken": f"""with p as (select p_partkey as recording_id, {_SAFE.format("regexp_extract(p_name, '^([^ ]+)', 1)")} as base, p_size from part),
        b as (select base, count(*) as c from p group by 1),
        t as (select distinct base || case when p_size % 4 > 0 then '_' || (p_size % 4 + 1) else '' end as name from p where recording_id % 3 = 0),
        used as (select name from t union select base from b),
        slot as (select regexp_replace(name, '_([1-9][0-9]{{0,8}})$', '') as base, cast(regexp_extract(name, '_([1-9][0-9]{{0,8}})$', 1) as bigint) as s from used where regexp_matches(name, '_([1-9][0-9]{{0,8}})$') union select name, 1 from t),
        try as (select base, unnest(range(1, c + 1 + (select count(*) from slot x where x.base = b.base))) as s from b),
        free as (select base, s, row_number() over (partition by base order by s) as n from try anti join slot using (base, s)),
        n as (select *, row_number() over (partition by base order by recording_id) as n from p)
        select recording_id, n.base, case when s = 1 then n.base else n.base || '_' || s end as unique_name from n join free on free.base = n.base and free.n = n.n""",
    "utc_times": """with t as (select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as d, o_orderkey % 4 as k from orders)
        select o_orderkey, case k when 0 then d || 'T10:00:00' when 1 then d || 'T10:00:00+02:00' when 2 then d || ' 23:59:59.250000Z' end as given,
          case k when 0 then d || 'T10:00:00+00:00' when 1 then d || 'T08:00:00+00:00' when 2 then d || 'T23:59:59.250000+00:00' end as utc from t""",
    "file_manifest": """with d as (select 'in/' || coalesce(source, 'none') || '/' || doc_id || '.' || ['iq', 'CSV', 'npy', 'wav', 'Dat'][doc_id % 5 + 1] as path, doc_id, n_chars from documents)
        select path, ['iq', 'spectrogram', 'npy', 'rejected', 'iq'][doc_id % 5 + 1] as kind, n_chars as length from d""",
    "status_rollup": f"""with {_REC}, x as (select satellite, device % 3 as device, case code when 'F' then 'SUCCESS' when 'O' then 'FAILED' else 'CANCELLED' end as status, cast(floor(price) as bigint) as size, price + 1000 as expected from r)
        select satellite, device, status, count(*) as n, cast(sum(size) as bigint) as bytes, round(avg(size / expected), 6) as completeness, grouping(satellite, device, status) as level from x group by rollup (satellite, device, status)""",
}
