"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, null last, get the weights in turn and share ``total`` times all words. A target
stops at ``cap`` times its source's words; the excess goes to the other sources by weight until none is above.

Within a source documents have unequal rates: the expected copies of a document of n words are proportional to
2 ** (``tilt`` * floor(log2(n + 1))), so that with a tilt above 0 longer documents are taken more often (0: all alike),
never above ``cap``, and such that the expected words are the source's target. A document gets floor(rate) certain
copies; the rest of its rate is the inclusion probability p of one copy more. Documents with p > 0 are ranked by the odds
of a uniform hash number u over the inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in that order
while the words so far, plus half of the next document's, stay within what the certain copies leave: a sample of a
fixed number of words.

The order is found without sorting a source: words are summed by fine bins of the rank, only the bin in
which the target is reached is sorted, and its last taken document becomes the source's threshold.

Nulls: a null text has no words; a null source is a source of its own; a null id hashes as an empty one. Rows
that repeat an id are ranked equal where their sizes are, and are then all taken or all left. Ties of rank go to the
smaller id. A document without words is taken as its rank says. An empty table gives no rows. Columns of the input named
like the added ones are replaced by them; all others stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bins of the rank in each source; how much more often longer documents are taken.
BINS, TILT = 4096, 0.125
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of an MD5 of the id."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float, total: float) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): weights water-filled under the cap."""
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * float(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = limits.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    after = Window.orderBy(F.col("most") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, 0)
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(after)
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * final).alias("target"))


def rank_odds(u: Column, p: Column) -> Column:
    """Pareto rank, mapped from (0, inf) to (0, 1)."""
    q = (u / (1 - u)) * ((1 - p) / p)
    return q / (1 + q)


def rates(slim: DataFrame, weights: tuple[float, ...], cap: float, total: float, tilt: float) -> DataFrame:
    """From (source, size) to (source, level, source_size, target, sure, p, need), a row for each source and level of size.

    The expected copies of a level are least(cap, t * merit); t is such that their words meet the target.
    """
    levels = slim.groupBy("source", _level(F.col("size")).alias("level")).agg(F.sum("size").alias("words"))
    levels = levels.withColumn("merit", F.pow(F.lit(2.0), F.col("level") * float(tilt)))
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, total)
    own = levels.alias("l").join(goals.alias("g"), F.expr("l.source <=> g.source")).select("l.source", "level", "words", "merit", "source_size", "target")
    by_merit = Window.partitionBy("source").orderBy(F.desc("merit"))  # at most 64 levels
    earlier, onwards = by_merit.rowsBetween(Window.unboundedPreceding, -1), by_merit.rowsBetween(0, Window.unboundedFollowing)
    # if all levels of larger merit are at the cap, t is what is left over the words of the others
    t = F.try_divide(F.col("target") - float(cap) * F.coalesce(F.sum("words").over(earlier), F.lit(0)), F.sum(F.col("words") * F.col("merit")).over(onwards))
    own = own.withColumn("t", t).withColumn("free", F.when(F.col("t") * F.col("merit") <= float(cap), F.col("t")))
    rate = F.least(F.lit(float(cap)), F.coalesce(F.max("free").over(Window.partitionBy("source")) * F.col("merit"), F.when(F.col("source_size") > 0, float(cap)).otherwise(0.0)))
    own = own.withColumn("rate", rate).withColumn("sure", F.floor("rate")).withColumn("p", F.col("rate") - F.col("sure"))
    need = F.col("target") - F.sum(F.col("sure") * F.col("words")).over(Window.partitionBy("source"))
    return own.select("source", "level", "source_size", "target", "sure", "p", need.alias("need"))


def _level(size: Column) -> Column:
    return F.floor(F.log2(size + 1.0)).cast("int")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, total: float = 1.0, tilt: float = TILT, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", size_col: str | None = None
) -> DataFrame:
    """``docs`` with source_size and target (of its source) and copies (how often the mix takes the row).

    ``size_col`` names an existing long column with sizes; without it the words of ``text`` are counted.
    """
    size = F.coalesce(F.col(size_col) if size_col else word_count("text"), F.lit(0)).cast("long")
    slim = materialize(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), size.alias("size")), "mix-sizes")
    rate = materialize(rates(slim, weights, cap, total, tilt), "mix-rates")

    ranked = (
        slim.withColumn("level", _level(F.col("size"))).alias("d").join(rate.filter("p > 0").alias("r"), F.expr("d.source <=> r.source and d.level = r.level"))
        .select("d.source", "id", "size", "need", rank_odds(uniform("id", seed), F.col("p")).alias("t")).withColumn("bin", F.floor(F.col("t") * BINS).cast("int"))
    )
    bins = ranked.groupBy("source", "bin", "need").agg(F.sum("size").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    reached = bins.withColumn("until", so_far).filter(F.col("until") >= F.col("need")).groupBy("source").agg(F.min(F.struct("bin", "until", "words")).alias("b"))
    reached = reached.select("source", F.col("b.bin").alias("bin"), (F.col("b.until") - F.col("b.words")).alias("before"))
    edge = ranked.alias("d").join(reached.alias("b"), F.expr("d.source <=> b.source and d.bin = b.bin")).select("d.source", "t", "id", "size", "need", "before")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1))
    fits = edge.withColumn("mid", F.col("before") + F.coalesce(run, F.lit(0)) + F.col("size") / 2).filter(F.col("mid") <= F.col("need"))
    last = fits.groupBy("source").agg(F.max(F.struct("t", "id")).alias("last"))
    cuts = (
        rate.alias("r").join(reached.alias("b"), F.expr("r.source <=> b.source"), "left").join(last.alias("l"), F.expr("r.source <=> l.source"), "left")
        .selectExpr("r.source", "r.level", "r.source_size", "r.target", "r.sure", "r.p", "b.bin", "l.last.t", "l.last.id")
    )
    cuts = materialize(cuts, "mix-cuts")
    own = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    hidden = "cut_" + uuid.uuid4().hex  # no input column has this name
    # exploded from an array of one, so that the words are counted once and not in each expression that needs the level
    joined = docs.select(*own, F.explode(F.array(_level(size))).alias(f"{hidden}_level")).join(
        cuts.select(F.struct("*").alias(hidden)), F.col(source_col).cast("string").eqNullSafe(F.col(f"{hidden}.source")) & (F.col(f"{hidden}_level") == F.col(f"{hidden}.level"))
    )
    cut = lambda c: F.col(f"{hidden}.{c}")
    t, least = rank_odds(uniform(id_col, seed), cut("p")), F.lit(-(1 << 63))
    at = F.floor(t * BINS)
    before_last = (t < cut("t")) | ((t == cut("t")) & (F.coalesce(F.col(id_col).cast("long"), least) <= F.coalesce(cut("id"), least)))
    more = F.when(cut("p") <= 0, 0).when(cut("bin").isNull() | (at < cut("bin")), 1).when((at == cut("bin")) & before_last, 1).otherwise(0)
    return joined.select(*own, cut("source_size").alias("source_size"), cut("target").alias("target"), (cut("sure") + more).cast("int").alias("copies"))
