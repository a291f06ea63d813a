"""Numbering of rows within keys that may hold any share of the table; sums in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a table's order, if there aren't fewer shuffle partitions.
MOST_RANGES = 256


def numbered(df: DataFrame, by: list[str], bucket: Column, order: list) -> DataFrame:
    """Adds _n, the 1-based place of each row of a key by ``order``, and _total, the key's rows.

    ``bucket`` must not fall as ``order`` rises. Rows are numbered within (key, bucket) and moved on by the counts of the
    buckets before, so only slim counts of a key meet in one task.
    """
    parts = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    rows = df.withColumn("_bucket", F.struct(*parts, bucket.alias("b")))  # a struct is never null, so the join keeps the rows' partitioning
    key = [F.col("_bucket")[f"k{i}"] for i in range(len(by))]
    before = Window.partitionBy(*key).orderBy(F.col("_bucket")["b"]).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*key)).alias("_total"))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return inside.join(starts, "_bucket").select(*df.columns, (F.col("_n") + F.col("_before")).alias("_n"), "_total")


def _plain(df: DataFrame, name: str) -> Column:
    """A column that sorts like ``name`` and can be written as a literal."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name) if kind == "timestamp" else F.unix_date(name) if kind == "date" else F.col(name)


def range_bucket(df: DataFrame, order: list[str]) -> Column:
    """Number of each row's range of ``order``, as Spark cuts the whole table in ranges of like size; at most ``MOST_RANGES`` bounds come to the driver."""
    place = F.struct(*[_plain(df, c).alias(f"o{i}") for i, c in enumerate(order)])
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = df.select(place.alias("p")).repartitionByRange(n, "p").groupBy(F.spark_partition_id().alias("_")).agg(F.min("p").alias("p")).orderBy("p").select("p.*")
    kinds = dict(firsts.dtypes)
    bounds = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(firsts.columns, r, strict=True)]) for r in firsts.collect()[1:]]
    if not bounds:
        return F.lit(0)
    # the bounds up to a place, by halving: so a row's work hardly grows with their number; the place is made once a row
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = lambda p: F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.get(F.array(*bounds), k + step - 1) <= p, k + step).otherwise(k))
    return F.transform(F.array(place), found)[0]


def carried(df: DataFrame, by: list[str], order: list[str], **running: tuple[str, Column]) -> DataFrame:
    """A segmented scan: adds running aggregates over the rows of a key before each row by ``order``, whatever share of the table a key holds.

    ``running`` names them: ("max", x), ("sum", x; 0 before the first) or ("last", x; the row before, also where x is null).
    A key is cut in ranges of ``order``. Rows meet within (key, range); what the ranges before have in sum, as a
    maximum or at last is one slim row a range, and is carried into it. Rows that ``order`` doesn't tell apart come in any order.
    """
    parts = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    rows = df.withColumn("_bucket", F.struct(*parts, range_bucket(df, order).alias("b")))
    place = F.struct(*[_plain(df, c).alias(f"o{i}") for i, c in enumerate(order)])
    value = {n: F.struct(x.alias("v")) if how == "last" else x for n, (how, x) in running.items()}
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[F.col("_bucket")[f"k{i}"] for i in range(len(by))]).orderBy(F.col("_bucket")["b"]).rowsBetween(Window.unboundedPreceding, -1)
    whole = {"max": F.max, "sum": F.sum, "last": lambda x: F.max_by(x, place)}
    over = {"max": F.max, "sum": F.sum, "last": lambda x: F.last(x, ignorenulls=True)}
    totals = rows.groupBy("_bucket").agg(*[whole[how](value[n]).alias(n) for n, (how, _) in running.items()])
    carry = totals.select("_bucket", *[over[how](F.col(n)).over(before).alias(f"_c_{n}") for n, (how, _) in running.items()])
    out = rows.select("*", *[over[how](value[n]).over(inside).alias(f"_i_{n}") for n, (how, _) in running.items()]).join(carry, "_bucket")
    both = {
        "max": lambda i, c: F.greatest(i, c), "sum": lambda i, c: F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)), "last": lambda i, c: F.coalesce(i, c)["v"],
    }
    return out.select(*df.columns, *[both[how](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, (how, _) in running.items()])


def summed(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """One row a key: sums added row after row by ``order``; rows that it doesn't tell apart are added in any order.

    groupBy adds up what the tasks have, so its sums of doubles change in the last bit with the cut of the input. Addition
    in a given order can't be dealt out: a key is one task here, but its rows pass as a stream that spills, never as one value.
    """
    rows = Window.partitionBy(*by).orderBy(*order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select(*by, *[F.sum(x).over(so_far).alias(n) for n, x in sums.items()], F.lead(F.lit(True)).over(rows).isNull().alias("_last"))
    return out.filter("_last").drop("_last")
