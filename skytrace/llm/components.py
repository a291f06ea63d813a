"""Connected components of links, by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected(links: DataFrame) -> DataFrame:
    """Links (a, b) to (id, comp): the smallest id that each linked node reaches."""
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of a node is tied to the node's smallest neighbour
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.filter("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        # every smaller neighbour, and the node itself, is tied to its smallest
        tied = large.filter("u <> v").join(small_low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
        new = materialize(small.filter("u <> v").distinct(), "edges")
        discard(e)
        e, before, state = new, state, _state(new)
        if state == before:
            roots = e.select(F.col("v").alias("id")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots.select("id", F.col("id").alias("comp")))


def _state(e: DataFrame) -> tuple:
    """Number and fingerprint of distinct edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def absorb(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) after further links (a, b); only links between different components are contracted."""
    own = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c_{side}"))
    ends = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    between = materialize(ends.filter("a <> b").distinct(), "between")
    if between.isEmpty():
        return comps
    merged = materialize(connected(between), "merged")
    moved = comps.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return materialize(moved.union(merged.join(comps.select("id"), "id", "left_anti").select("id", "comp")), "components")


def same_id(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the leads of classes that share an id, from rows (doc_id, rep)."""
    several = rows.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    return rows.join(several.select("doc_id", "a"), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
