"""Slices to traces: strongest bin, noise floor, validity, gap filling, median filter, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.order import carried

#: Slices of a cell, cells of a block: a block is what one task smooths. Bins of a slice whose values one task may hold.
CELL, CELLS, LONG = 1024, 64, 1 << 16


def any_nan(p: Column) -> Column:
    return F.exists(p, lambda x: F.isnan(x))


def array_median(p: Column) -> Column:
    """Exact median, the mean of the middle two for an even count; NaN if any element is NaN."""
    s, n = F.array_sort(p), F.size(p)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(any_nan(p), float("nan")).when(n > 0, mid)


def strongest(slices: DataFrame, threshold_db: float, f0: float | Column, df: float | Column) -> DataFrame:
    """Adds bin (first on ties), strongest_db, noise_db, valid, trace_hz (null where not valid) and width_hz (valid slices). No shuffle."""
    p = F.col("power_db")
    out = slices.withColumns({"strongest_db": F.array_max(p), "noise_db": array_median(p)})
    out = out.withColumn("bin", (F.array_position(p, F.col("strongest_db")) - 1).cast("int"))
    limit = F.col("noise_db") + F.lit(threshold_db)
    ok = F.coalesce((F.col("strongest_db") >= limit) & ~F.isnan("strongest_db") & ~F.isnan("noise_db"), F.lit(False))
    out = out.withColumn("valid", ok).withColumn("trace_hz", F.when(F.col("valid"), F.lit(f0) + F.lit(df) * F.col("bin")))
    above = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i) >= limit)
    return out.withColumn("width_hz", F.when(F.col("valid"), (F.array_max(above) - F.array_min(above)) * F.lit(df)))


def strongest_long(points: DataFrame, slice_col: str, bin_col: str, power_col: str, longest: int | None = None) -> DataFrame:
    """The same for one row per bin: slice, bin, strongest_db, noise_db.

    A percentile holds the values of a slice, so slices of more than ``LONG`` bins get their median from :func:`ranked_median`;
    ``longest`` is the number of bins of the longest slice, where it has been counted.
    """
    first = F.max_by(F.col(bin_col), F.struct(F.col(power_col), -F.col(bin_col)))
    figures = [first.alias("bin"), F.max(power_col).alias("strongest_db")]
    noise = F.percentile(power_col, F.lit(0.5)).alias("noise_db")
    if longest is not None and longest <= LONG:
        return points.groupBy(slice_col).agg(*figures, noise)
    long_ = points.groupBy(slice_col).agg(F.count(power_col).alias("n"), *figures).filter(F.col("n") > LONG).drop("n")
    short = points.join(long_.select(slice_col), slice_col, "left_anti").groupBy(slice_col).agg(*figures, noise)
    return short.unionByName(long_.join(ranked_median(points.join(long_.select(slice_col), slice_col, "left_semi"), slice_col, power_col), slice_col))


def ranked_median(points: DataFrame, slice_col: str, power_col: str) -> DataFrame:
    """(slice, noise_db): exact medians of slices of any size, by a segmented scan over the values; nulls don't count."""
    p = points.select(slice_col, F.col(power_col).cast("double").alias("v")).dropna(subset=["v"])
    n = p.groupBy(slice_col).agg(F.count(F.lit(1)).alias("n"))
    ranked = carried(p, [slice_col], ["v"], below=("sum", F.lit(1).cast("long"))).join(n, slice_col)
    middle = (F.col("below") == F.floor((F.col("n") - 1) / 2)) | (F.col("below") == F.floor(F.col("n") / 2))
    return ranked.filter(middle).groupBy(slice_col).agg(F.avg("v").alias("noise_db"))


def fill_gaps(trace: DataFrame, capture: str | list[str] = "capture_id", index: str = "t_idx", value: str = "trace_hz", before: str | None = None, after: str | None = None) -> DataFrame:
    """Adds filled: linear between the nearest points by slice index, flat beyond the ends, null for a capture without points.

    ``before`` and ``after`` name columns (v, i) with the last point before the rows at hand and the first one behind them.
    """
    back = Window.partitionBy(capture).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(capture).orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows is cheap
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(index).alias("i")))
    p, n = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
    out = trace.withColumn("_p", F.coalesce(p, before) if before else p).withColumn("_n", F.coalesce(n, after) if after else n)
    p, n = F.col("_p"), F.col("_n")
    mixed = p["v"] + (n["v"] - p["v"]) * (F.col(index) - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
    return out.withColumn("filled", F.coalesce(F.col(value), mixed, p["v"], n["v"])).drop("_p", "_n")


def median_filter(trace: DataFrame, kernel: int = 7, capture: str | list[str] = "capture_id", index: str = "t_idx", value: str = "filled", mask: str = "trace_hz") -> DataFrame:
    """Adds smoothed: median over ``kernel`` rows (even: one more), ends repeated; null where ``mask`` is."""
    half = (kernel if kernel % 2 else kernel + 1) // 2
    w = Window.partitionBy(capture).orderBy(index)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = trace.withColumn("_first", F.first(value).over(whole)).withColumn("_last", F.last(value).over(whole))
    near = [F.coalesce(F.lag(value, k).over(w), F.col("_first")) for k in range(half, 0, -1)] + [F.col(value)]
    near += [F.coalesce(F.lead(value, k).over(w), F.col("_last")) for k in range(1, half + 1)]
    out = out.withColumn("_near", F.array(*near))
    return out.withColumn("smoothed", F.when(F.col(mask).isNotNull(), F.element_at(F.array_sort("_near"), half + 1))).drop("_first", "_last", "_near")


def jumps(trace: DataFrame, capture: str | list[str] = "capture_id", index: str = "t_idx", value: str = "smoothed") -> DataFrame:
    """Adds jump: difference to the last point before that isn't null; gaps are skipped."""
    before = Window.partitionBy(capture).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn("jump", F.col(value) - F.last(value, ignorenulls=True).over(before))


def smooth(trace: DataFrame, kernel: int = 7, capture: str = "capture_id", index: str = "t_idx", value: str = "trace_hz", length: str | None = None, cell: int = CELL, cells: int = CELLS, longest: int | None = None) -> DataFrame:
    """Gap filling, median filter and jumps of captures of any length.

    ``length`` names a column with the slices of a row's capture, which is dropped: captures of one block or less then need one
    window each, and only longer ones go through ``smooth_blocks``. Without it all do. ``longest`` is the length of the longest capture,
    where it has been counted: if that is a block or less, blocks aren't even planned. The rows are the same either way.
    """
    if length is None:
        return smooth_blocks(trace, kernel, capture, index, value, cell, cells)
    is_long = F.col(length) > cell * cells
    none_long = longest is not None and longest <= cell * cells
    short = fill_gaps((trace if none_long else trace.filter(~is_long)).drop(length), capture, index, value)
    short = jumps(median_filter(short, kernel, capture, index, mask=value), capture, index)
    return short if none_long else short.unionByName(smooth_blocks(trace.filter(is_long).drop(length), kernel, capture, index, value, cell, cells))


def smooth_blocks(trace: DataFrame, kernel: int = 7, capture: str = "capture_id", index: str = "t_idx", value: str = "trace_hz", cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """The same in blocks of ``cell * cells`` slices with a halo of one cell on either side, so that no capture is one task.

    ``index`` counts a capture's slices from 0 without gaps. The rows are shuffled once, by capture and block. What a block must
    know of the others (the points next to its halo, then the last smoothed point before it) comes from one slim row a block.
    A null capture is one capture of its own.
    """
    cell = max(cell, kernel // 2, 1)
    block = cell * cells
    names, i = trace.columns, F.col(index)
    span = F.expr(f"sequence(greatest(`{index}` - {cell}, 0) div {block}, (`{index}` + {cell}) div {block})")
    rows = trace.withColumn("_block", F.explode(span))
    keys = ["_capture", "_block"]  # never null, so that joins keep the partitioning
    rows = rows.withColumn("_capture", F.coalesce(F.concat(F.lit("="), F.col(capture).cast("string")), F.lit(""))).repartition(*keys)
    home, place = F.expr(f"`{index}` div {block}") == F.col("_block"), i % block

    def point(pick, where: Column) -> Column:
        # With all columns, so that this pass reads the same shuffle as the others.
        return pick(F.struct(F.col(value).alias("v"), i.alias("i"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)]), F.when(home & F.col(value).isNotNull() & where, i))

    ever = F.lit(True)
    edges = rows.groupBy(*keys).agg(
        point(F.max_by, ever).alias("hi"), point(F.max_by, place < block - cell).alias("hi_inner"), point(F.min_by, ever).alias("lo"), point(F.min_by, place >= cell).alias("lo_inner")
    )
    w = Window.partitionBy("_capture").orderBy("_block")
    down = Window.partitionBy("_capture").orderBy(F.desc("_block"))
    far = (Window.unboundedPreceding, -2)
    vi = lambda p: F.when(p.isNotNull(), F.struct(p["v"].alias("v"), p["i"].alias("i")))
    edges = edges.select(*keys, *[vi(F.col(c)).alias(c) for c in ("hi", "hi_inner", "lo", "lo_inner")]).select(
        *keys,
        F.coalesce(F.lag("hi_inner").over(w), F.last("hi", ignorenulls=True).over(w.rowsBetween(*far))).alias("_before"),
        F.coalesce(F.lag("lo_inner").over(down), F.last("lo", ignorenulls=True).over(down.rowsBetween(*far))).alias("_after"),
    )
    out = fill_gaps(rows.join(edges, keys), keys, index, value, "_before", "_after").drop("_before", "_after")
    out = median_filter(out, kernel, keys, index, mask=value).filter(home)
    out = jumps(out, keys, index)
    own = F.struct(F.col("smoothed").alias("v"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    lasts = out.groupBy(*keys).agg(F.max_by(own, F.when(F.col("smoothed").isNotNull(), i)).alias("last"))
    lasts = lasts.select(*keys, F.last(F.col("last")["v"], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"))
    return out.join(lasts, keys).select(*names, "filled", "smoothed", F.coalesce("jump", F.col("smoothed") - F.col("_left")).alias("jump"))
