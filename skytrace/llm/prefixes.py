"""Prefix trie of conversations by truncation peeling.

1. A turn is an MD5 of its role and text and its number of words; a conversation is the path of its turns, and the key of
   its first d turns an MD5 chained over theirs. Texts never travel.
2. Conversations that end at the same node are merged: their ids, sorted by ranges of (node, id) and joined in pieces,
   go through one SHA-256 per node.
3. From the greatest depth down, nodes that survive from the level below meet the conversations that newly end at their
   depth, are merged by key and written out as they are then complete; their last turn is stripped, and they are
   grouped again as parents with the sums of their subtrees.
4. Levels are peeled in bands (2^k, 2^(k+1)]: rows with one node at the foot of a band are peeled by one task, if no such
   group is large. A band with a large group is cut in two, down to single levels, which Spark's partial aggregation
   merges whatever their sizes. So a path of n turns is carried n, n/2, n/4... turns long, and the steps of a band
   need one shuffle.

One conversation's path (24 bytes a turn) is held by one task; nothing else is.

Nulls and odd cases: a null role or text counts as empty, null turns come first, and turns of one number are ordered by
their MD5. Rows that repeat are turns of their own. Rows with a null id take no part. An empty table gives no
nodes, as nobody is a member of the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts
from .mixing import word_count

ROOT = bytes(16)
#: Bytes of a turn in a path: its node's key and its words.
STEP = 24
#: Bytes of the paths of a group that one task peels; a single path may be longer.
GROUP_BYTES = 4 << 20
#: Bytes of joined ids in a row.
PIECE = 1 << 16
OPEN = "depth int, path binary, conv long, n long, children long, leaves long, saved long, ends string"
NODE = "key binary, parent binary, depth int, conv long, n long, children long, leaves long, saved long, ends string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (key, words) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("key"), word_count("text").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def with_heads(lists: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each list with its first h turns replaced by those of conversation c - c % every (none where absent), h = crc32(c) % most."""
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = lists.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) to (conv_id, depth, path, last): the path holds each prefix's key and its last turn's words."""
    for batch in batches:
        out, depths, ends = [], [], []
        for turns in batch.column("turns").to_pylist():
            key, path = ROOT, []
            for t in turns:
                key = hashlib.md5(key + t["key"]).digest()
                path += (key, t["words"].to_bytes(8, "big"))
            out.append(b"".join(path))
            depths.append(len(turns))
            ends.append(key)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int32()), pa.array(out, pa.binary()), pa.array(ends, pa.binary())], ["conv_id", "depth", "path", "last"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (last, conv_id) to (last, first, n, ids): ids joined by commas, so many bytes a row."""
    key, ids, size = None, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"last": key, "first": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}], pa.schema([("last", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for last, conv in zip(batch.column("last").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (last != key or size > PIECE):
                yield done()
                ids, size = [], 0
            key = last
            ids.append(conv)
            size += len(str(conv)) + 1
    if ids:
        yield done()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (last, first) to (conv, n, ends): the smallest id, the number and the hash of all of a node."""
    key, first, n, sha = None, None, 0, None
    names, kinds = ["conv", "n", "ends"], [pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for last, low, k, ids in zip(*(batch.column(c).to_pylist() for c in ("last", "first", "n", "ids")), strict=True):
            if last != key:
                if sha:
                    out.append((first, n, sha.hexdigest()))
                key, first, n, sha = last, low, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            n += k
        if out:
            yield batch_of(out)
    if sha:
        yield batch_of([(first, n, sha.hexdigest())])


def _key(depth: int) -> Column:
    """Key of a path's node at ``depth``."""
    return F.substring("path", STEP * (depth - 1) + 1, 16) if depth else F.lit(ROOT)


def _peel(lo: int):
    """Rows sorted by their node at depth ``lo`` to complete nodes deeper than that and, with a path, what survives at ``lo``."""
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["key", "parent", "depth", "conv", "n", "children", "leaves", "saved", "ends", "path"]

    def group(rows: list[tuple], out: list[tuple]) -> None:
        levels: dict[int, dict[bytes, list]] = defaultdict(dict)

        def meet(depth: int, path: bytes, conv: int, n: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
            key = path[STEP * (depth - 1) :][:16] if depth else ROOT
            x = levels[depth].get(key)
            if x is None:
                levels[depth][key] = [path, conv, n, children, leaves, saved, ends]
            else:
                x[1:] = min(x[1], conv), x[2] + n, x[3] + children, x[4] + leaves, x[5] + saved, x[6] or ends

        for row in rows:
            meet(*row)
        for depth in range(max(levels), lo, -1):
            at, above = STEP * (depth - 1), STEP * (depth - 2)
            for key, (path, conv, n, children, leaves, saved, ends) in levels.pop(depth, {}).items():
                leaves, saved = leaves if children else 1, saved + (n - 1) * int.from_bytes(path[at + 16 : at + 24], "big")
                out.append((key, path[above : above + 16] if depth > 1 else ROOT, depth, conv, n, children, leaves, saved, ends, None))
                meet(depth - 1, path, conv, n, 1, leaves, saved, None)
        for key, (path, conv, n, children, leaves, saved, ends) in levels.pop(lo, {}).items():
            out.append((key, None, lo, conv, n, children, leaves, saved, ends, path[: STEP * lo]))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, foot, out = [], None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("foot", "depth", "path", "conv", "n", "children", "leaves", "saved", "ends"))
            for f, *row in zip(*columns, strict=True):
                if f != foot and held:
                    group(held, out)
                    held = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                foot = f
                held.append(tuple(row))
        if held:
            group(held, out)
        if out:
            yield batch_of(out)

    return run


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The complete nodes of one level, with their path."""
    met = rows.groupBy(_key(depth).alias("key")).agg(*[F.min(c).alias(c) for c in ("path", "conv")], *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"))
    words = F.conv(F.hex(F.substring("path", STEP * depth - 7, 8)), 16, 10).cast("long")
    return met.select(
        "key", _key(depth - 1).alias("parent"), F.lit(depth).alias("depth"), "conv", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * words).alias("saved"), "ends", "path",
    )


def prefix_nodes(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = lists.sparkSession
    parts = n_parts(spark)
    paths = materialize(lists.mapInArrow(_paths, "conv_id long, depth int, path binary, last binary"), "paths")
    pieces = paths.select("last", "conv_id").repartitionByRange(parts, "last", "conv_id").sortWithinPartitions("last", "conv_id").mapInArrow(_joined_ids, "last binary, first long, n long, ids string")
    ids = pieces.repartition(parts, "last").sortWithinPartitions("last", "first").mapInArrow(_hashed_ids, "conv long, n long, ends string")
    zero = F.lit(0).cast("long")
    ended = ids.join(paths.select(F.col("conv_id").alias("conv"), "depth", "path"), "conv").select("depth", "path", "conv", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    ended = materialize(ended.sortWithinPartitions("depth"), "ended")  # so that a band reads its own pages
    discard(paths)

    deepest = ended.agg(F.max("depth")).first()[0]
    feet = [0, *(1 << k for k in range(max(deepest or 0, 1).bit_length()) if 1 << k < (deepest or 0))] if deepest else []
    bands = list(zip(feet, [*feet[1:], deepest], strict=True)) if feet else []
    open_, found = spark.createDataFrame([], OPEN), []
    while bands:
        lo, hi = bands.pop()
        rows = open_.unionByName(ended.filter((F.col("depth") > lo) & (F.col("depth") <= hi)))
        if hi - lo == 1:
            found.append(materialize(_level(rows, hi), "level"))
            open_ = found[-1].select(F.lit(lo).alias("depth"), F.substring("path", 1, STEP * lo).alias("path"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends"))
            continue
        rows = rows.withColumn("foot", _key(lo))
        groups = rows.groupBy("foot").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("path") - STEP * lo).alias("size")).filter("k > 1")
        if (groups.agg(F.max("size")).first()[0] or 0) > GROUP_BYTES:
            middle = (lo + hi) // 2
            bands += [(lo, middle), (middle, hi)]
            continue
        peeled = materialize(rows.repartition(parts, "foot").sortWithinPartitions("foot").mapInArrow(_peel(lo), f"{NODE}, path binary"), "band")
        found.append(peeled.filter("path is null"))
        open_ = peeled.filter("path is not null").select(*ended.columns)

    # the root: all that survives at depth 0, and conversations without turns
    top = open_.unionByName(ended.filter("depth = 0")).agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends")).filter("n is not null")
    first = top.select("conv").first()
    empty = F.lit(hashlib.sha256().hexdigest())
    root = top.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"), "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"), "saved", "ends")
    nodes = root
    if found:
        below = found[0].drop("path")
        for x in found[1:]:
            below = below.unionByName(x.drop("path"))
        own = below.select(F.col("key").alias("parent"), F.col("conv").alias("above"))
        deeper = below.filter("depth > 1").join(own, "parent").select(root.columns)
        nodes = nodes.unionByName(below.filter("depth = 1").withColumn("above", F.lit(first[0])).select(root.columns)).unionByName(deeper)
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", empty).alias("ends_sha256"),
    )
