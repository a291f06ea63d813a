"""Removal of repeated passages: suffixes at anchors, ordered by deep-shallow sorting.

A byte goes if a string of ``width`` (100) bytes that covers it also starts earlier: in a document with a smaller
id, or earlier in the same one.

1. Every window of 100 bytes has an anchor: of its 32-byte substrings the one with the smallest hash, the leftmost
   of equal ones. Equal windows have equal anchors at the same place. Neighbouring windows with one anchor form
   a run. Runs whose anchor occurs once repeat nothing and are left out.
2. Runs of equal contents (by hash) are a class, found by partial aggregation before any text moves. Two members of each class are
   sorted: its first, and its last in the name of all that come after the first.
3. The texts right of the anchor, and those left of it read backwards, are the suffixes to sort. Multikey quicksort, of all
   anchors at once with keys of 8 bytes, orders them to a shallow depth; groups that still agree are ordered by blind tries.
   Neighbours' common prefixes then tell, for each place of a window about the anchor, which windows are equal, and all
   but the earliest repeat. What is found of a class's last member holds for all but its first.
4. An anchor with more members than one task should sort is dealt by halves of the places: windows with at most m bytes left of the
   anchor agree in the 100 - m bytes right of it, the others in more than m bytes left of it, so each half is grouped by these bytes, and
   halved again where a group is still too large. At a single place all of a group is equal, which an aggregate settles.

Classes, and groups at a single place, are equal by two 64-bit hashes. Nulls: a null text is empty. Rows with one id are the
same document: equal texts are at the same places, and what is first in one is first in the other; of different texts
one comes before the other. A null id comes before all others. An empty table
gives no rows. ``remove_repeats`` returns the id, the columns named in ``keep`` as they are, and its own; all others go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts, slices, text_bytes
from .shingles import mix, prefix_hash

WIDTH, GRAM = 100, 32
PLACES = WIDTH - GRAM + 1
#: Bytes sorted by multikey quicksort before blind tries take over.
SHALLOW = 24
#: Members of a group that one task sorts; larger groups are dealt again.
RUNS_AT_ONCE = 20_000
_CHUNK = 1 << 20


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts that end at ``ends`` in ``data``: (text, start, windows, anchor place, anchor hash, content hash)."""
    n = len(data) - WIDTH + 1
    total, inv = prefix_hash(data)
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = mix((total[GRAM:] - total[:-GRAM]) * inv[: len(data) - GRAM + 1])
    anchors = np.empty(n, np.int64)
    low = np.uint64(_CHUNK * 2 - 1)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        key = (grams[a : b + PLACES - 1] & ~low) | np.arange(b - a + PLACES - 1, dtype=np.uint64)
        size = 1
        while 2 * size <= PLACES:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[: b - a], key[PLACES - size : PLACES - size + b - a])
        anchors[a:b] = (key & low).astype(np.int64) + a
    starts = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + WIDTH <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    keep = inside[first]
    first, size = first[keep], size[keep]
    place = anchors[first] - first
    content = mix((total[first + size + WIDTH - 1] - total[first]) * inv[first] + (size * 256 + place).astype(np.uint64))
    return text[first], first - starts[text[first]], size, place, grams[anchors[first]], content


def text_tag(text: bytes) -> int:
    """Fifteen bits that tell texts with one id apart; they stand above a start, so that places of two texts differ."""
    return zlib.crc32(text) & 0x7FFF


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = text_bytes(part.column("text"))
            ends = np.cumsum([len(t) for t in texts])
            text, start, size, place, gram, content = anchor_runs(np.frombuffer(b"".join(texts), np.uint8), ends)
            if len(text):
                tags = np.array([text_tag(t) for t in texts], np.int64)
                at = (tags[text] << 48) | (start << 16) | (size << 8) | place
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(pa.array(text)), pa.array(at)], ["h", "c", "doc", "at"])


class BlindTrie:
    """Order of distinct-or-equal strings that share a prefix: inner nodes know a depth and one child a byte, leaves the string.

    A search goes down by the bytes at the nodes' depths alone; one comparison with the leaf it meets then tells
    where the string parts, and the new leaf is put there.
    """

    def __init__(self, depth: int) -> None:
        self.root, self.depth = None, depth

    def add(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = (s, [i])
            return
        node = self.root
        while type(node) is list:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t, d, n = node[0], self.depth, len(s)
        if s == t:
            node[1].append(i)
            return
        while s[d] == t[d]:
            d += 1
        above, key, node = None, 0, self.root
        while type(node) is list and node[0] < d:
            above, key = node, s[node[0]]
            node = node[1][key]
        if type(node) is list and node[0] == d:
            node[1][s[d]] = (s, [i])
            return
        fresh = [d, {t[d]: node, s[d]: (s, [i])}]
        if above is None:
            self.root = fresh
        else:
            above[1][key] = fresh

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is list:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def multikey_quicksort(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within their groups by their first ``SHALLOW`` bytes, and the number of each place's run of equal ones.

    All segments are split at once, three ways about a pivot: smaller and larger rows go on at the same depth, equal ones
    a key (8 bytes) deeper. A segment is done when it has one row or has reached the depth.
    """
    keys = rows[:, :SHALLOW].view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.concatenate([[False], group[order][1:] != group[order][:-1]])[: len(order)])
    depth = np.zeros(len(order), np.int64)  # of the segment that each place belongs to
    live = np.arange(len(order))
    while len(live):
        sizes = np.bincount(segment[live])
        live = live[(sizes[segment[live]] > 1) & (depth[live] < keys.shape[1])]
        if not len(live):
            break
        own = segment[live]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(first, len(own)))
        key = keys[order[live], depth[live]]
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        way = (key > pivot).astype(np.int64) - (key < pivot)
        by = np.lexsort((way, own))
        order[live], way, own = order[live][by], way[by], own[by]
        depth[live] += way == 0
        part = np.zeros(len(order), np.int64)
        part[live[1:]] = (own[1:] == own[:-1]) & (way[1:] != way[:-1])
        segment = segment + np.cumsum(part)
    return order, segment


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, then blind tries: order of the rows (bytes, equal lengths, a multiple of 8) within their groups, and the common prefix of each with the one before (-1 at a group's start)."""
    order, same = multikey_quicksort(group, rows)
    counts = np.bincount(same, minlength=1)
    deep = np.flatnonzero(counts[same] > 1)
    if len(deep):
        apart = (rows[order[deep[1:]]] != rows[order[deep[:-1]]]).any(axis=1) & (same[deep[1:]] == same[deep[:-1]])
        deep = deep[np.isin(same[deep], same[deep[1:]][apart])]  # groups of equal rows are in order
        edges = np.flatnonzero(np.diff(same[deep])) + 1
        for at in np.split(deep, edges) if len(deep) else ():
            members = order[at]
            trie = BlindTrie(SHALLOW)
            for i, s in zip(members.tolist(), rows[members], strict=True):
                trie.add(s.tobytes(), i)
            order[at] = trie.order()
    a, b = rows[order[1:]], rows[order[:-1]]
    lcp = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = a != b
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, lcp


def repeated_places(group: np.ndarray, age: np.ndarray, size: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Matrix runs x windows: whether an earlier run (by ``age``) of the group holds the same window. ``texts`` hold the runs' bytes.

    Only windows with ``low`` to ``high`` bytes left of the anchor are compared.
    """
    n, wide = len(texts), WIDTH + (-WIDTH) % 8
    right, left = np.zeros((n, wide), np.uint8), np.zeros((n, wide), np.uint8)
    for i, (t, p) in enumerate(zip(texts, place.tolist(), strict=True)):
        x = np.frombuffer(t, np.uint8)
        r, back = x[p : p + WIDTH], x[:p][::-1]
        right[i, : len(r)], left[i, : len(back)] = r, back
    out = np.zeros((n, PLACES), bool)
    ro, rl = deep_shallow(group, right)
    lo, ll = deep_shallow(group, left)
    old = np.argsort(age, kind="stable")
    rclass, lclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(PLACES):  # bytes of the window left of the anchor
        rclass[ro] = np.cumsum(rl < WIDTH - s)
        lclass[lo] = np.cumsum(ll < s)
        window = place - s
        rows = old[((window >= 0) & (window < size) & (low <= s) & (s <= high))[old]]
        if len(rows) < 2:
            continue
        key = rclass[rows] * (n + 1) + lclass[rows]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = age[rows] > age[rows[first]][inverse]
        out[rows[again], window[rows[again]]] = True
    return out


MEMBER = "h long, c long, doc long, at long, copy boolean, body binary"
DEALT = f"{MEMBER}, g long, low int, high int"
#: Intervals of a first member in its document; those of a copy count from the start of its run, and doc and at are the first member's.
FOUND = "h long, c long, doc long, at long, lo long, hi long, copy boolean"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by group (anchors, or groups dealt by places) to the intervals that repeat; whole groups are taken together."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        group = t.column("g" if "g" in t.column_names else "h").to_numpy()
        h, c, docs, at, copy = (t.column(x).to_numpy() for x in ("h", "c", "doc", "at", "copy"))
        by = np.lexsort((at, docs, copy, c, group))
        same_class = (c[by[1:]] == c[by[:-1]]) & (group[by[1:]] == group[by[:-1]])
        again = same_class & (at[by[1:]] == at[by[:-1]]) & (docs[by[1:]] == docs[by[:-1]]) & (copy[by[1:]] == copy[by[:-1]])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same_class]), np.arange(len(by)), 0))
        lead, by = by[first][np.concatenate([[True], ~again])], by[np.concatenate([[True], ~again])]  # rows with one id hold a run once
        lead_doc, lead_at = docs[lead], at[lead]
        group, h, c, docs, at, copy = (x[by] for x in (group, h, c, docs, at, copy))
        start, size, place = at >> 16, (at >> 8) & 255, at & 255
        low, high = (t.column(x).to_numpy()[by] if x in t.column_names else np.full(len(by), v) for x, v in (("low", 0), ("high", PLACES - 1)))
        age = np.empty(len(at), np.int64)
        by_age = np.lexsort((start + place, docs))
        ds, ps = docs[by_age], (start + place)[by_age]
        age[by_age] = np.cumsum(np.concatenate([[False], (ds[1:] != ds[:-1]) | (ps[1:] != ps[:-1])]))
        again = repeated_places(group, age, size, place, low, high, t.column("body").take(pa.array(by)).to_pylist())
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1]
        base = np.where(copy[row], 0, start[row])
        own = (h[row], c[row], np.where(copy, lead_doc, docs)[row], np.where(copy, lead_at, at)[row], base + lo, base + hi - 1 + WIDTH, copy[row])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in own], [x.split()[0] for x in FOUND.split(", ")])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held.append(t)
        rows += t.num_rows
        if rows >= RUNS_AT_ONCE:
            whole = pa.concat_tables(held)
            group = whole.column("g" if "g" in whole.column_names else "h").to_numpy()
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if cut:
                yield flush(whole.slice(0, cut))
            held, rows = [whole.slice(cut)], whole.num_rows - cut
    if rows:
        yield flush(pa.concat_tables(held))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, runs, text) to a row for each run with its bytes; runs of another text with the same id are told by their hash."""
    for batch in batches:
        for part in slices(batch, "text"):
            out: list[tuple] = []
            for doc, runs, t in zip(part.column("doc").to_pylist(), part.column("runs").to_pylist(), text_bytes(part.column("text")), strict=True):
                for r in runs:
                    start, size, place = (r["at"] >> 16) & 0xFFFFFFFF, (r["at"] >> 8) & 255, r["at"] & 255
                    body = t[start : start + size + WIDTH - 1]
                    if len(body) == size + WIDTH - 1:
                        total, _ = prefix_hash(np.frombuffer(body, np.uint8))
                        if mix(total[-1:] + np.uint64(size * 256 + place)).view(np.int64)[0] == r["c"]:
                            out.append((r["h"], r["c"], doc, r["at"], r["copy"], body))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in MEMBER.split(", ")])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members to the groups of both halves of their places, where they have windows there."""
    for batch in batches:
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        middle = (low + high) // 2
        for lo, hi in ((low, middle), (middle + 1, high)):
            rows, groups = [], []
            for i, (h, at, body, a, b) in enumerate(zip(batch.column("h").to_pylist(), batch.column("at").to_pylist(), batch.column("body").to_pylist(), lo.tolist(), hi.tolist(), strict=True)):
                size, place = (at >> 8) & 255, at & 255
                if place >= a and place - size < b:
                    rows.append(i)
                    groups.append(xxhash.xxh64_intdigest(body[place - a : place + WIDTH - b] + bytes((a, b)), h & 0xFFFFFFFF) - (1 << 63))
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:6], pa.array(groups, pa.int64()), pa.array(lo[rows], pa.int32()), pa.array(hi[rows], pa.int32())], schema=batch.schema)


def _large_groups(rows: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Intervals (FOUND) of the members of anchors that are too large for a task, dealt by halves of the places until they aren't."""
    parts = n_parts(rows.sparkSession)
    rows = rows.withColumns({"g": F.col("h"), "low": F.lit(0), "high": F.lit(PLACES - 1)})
    out = []
    while True:
        dealt = materialize(rows.mapInArrow(_halves, DEALT), "dealt")
        large = materialize(dealt.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RUNS_AT_ONCE).select("g"), "large")
        small = dealt.join(large, "g", "left_anti").select(dealt.columns)
        out.append(materialize(small.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_sorted_groups, FOUND), "repeats"))
        rest = dealt.join(large, "g", "left_semi").select(dealt.columns)
        place = F.col("at").bitwiseAND(255) - F.col("low")
        single = rest.filter("low = high").select("h", "c", "doc", "at", "copy", "g", place.alias("w"), (F.shiftright("at", 16) + place).alias("lo"))
        earliest = single.groupBy("h", "g").agg(F.min(F.struct("doc", "lo")).alias("f")).select("h", "g", F.col("f.doc").alias("d0"), F.col("f.lo").alias("l0"))
        again = single.join(earliest, ["h", "g"]).filter("doc <> d0 or lo <> l0")
        own = again.filter("not copy").select("h", "c", "doc", "at", "lo", (F.col("lo") + WIDTH).alias("hi"), "copy")
        copies = again.filter("copy").select("h", "c", "w").distinct().join(classes, ["h", "c"]).select("h", "c", "first.doc", "first.at", F.col("w").alias("lo"), (F.col("w") + WIDTH).alias("hi"), F.lit(True).alias("copy"))
        out.append(materialize(own.union(copies), "repeats"))
        rows = rest.filter("low < high")
        if rows.isEmpty():
            return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi) intervals of bytes that repeat, from (doc_id, text); they may overlap."""
    runs = docs.select("doc_id", "text").mapInArrow(_runs, "h long, c long, doc long, at long")
    whence = F.xxhash64("doc", "at")
    shared = runs.select("h", whence.alias("o")).groupBy("h").agg(F.min("o").alias("a"), F.max("o").alias("b")).filter("a <> b").select("h")
    found = materialize(runs.join(shared, "h").select("h", "c", "doc", "at"), "runs")
    ends = found.groupBy("h", "c").agg(F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("last"))
    classes = materialize(ends, "classes")
    large = classes.groupBy("h").agg(F.sum(F.when(F.col("first") == F.col("last"), 1).otherwise(2)).alias("n")).filter(F.col("n") > RUNS_AT_ONCE).select("h")
    large = materialize(large, "large")
    some = not large.isEmpty()
    texts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    member = lambda end, copy: F.struct("h", "c", F.col(f"{end}.doc").alias("doc"), F.col(f"{end}.at").alias("at"), F.lit(copy).alias("copy"))

    def bodies(of: DataFrame) -> DataFrame:
        both = F.when(F.col("first") == F.col("last"), F.array(member("first", False))).otherwise(F.array(member("first", False), member("last", True)))
        todo = of.select(F.explode(both).alias("m")).groupBy("m.doc").agg(F.collect_list(F.struct("m.h", "m.c", "m.at", "m.copy")).alias("runs"))  # of one document each
        return todo.join(texts, "doc").select("doc", "runs", "text").mapInArrow(_bodies, MEMBER)

    few = bodies(classes.join(large, "h", "left_anti").select(classes.columns) if some else classes)
    parts = n_parts(docs.sparkSession)
    spans = materialize(few.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sorted_groups, FOUND), "repeats")
    if some:
        for more in _large_groups(bodies(classes.join(large, "h", "left_semi").select(classes.columns)), classes):
            spans = spans.union(more)
    own = spans.filter("not copy").select("doc", "lo", "hi")
    of = spans.filter("copy").select("h", "c", F.col("doc").alias("d0"), F.col("at").alias("a0"), "lo", "hi")
    start = F.shiftright("at", 16)
    copies = found.join(of, ["h", "c"]).filter("doc <> d0 or at <> a0").select("doc", (start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi"))
    copies = materialize(copies, "copies")
    discard(found)
    return copies.union(own)


def _cut(digest: bool, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t, spans in zip(text_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                    lo, hi = np.array([(s["lo"], s["hi"]) for s in spans or ()], np.int64).reshape(-1, 2).T
                    own = (lo >> 32 == text_tag(t)) & ((hi & 0xFFFFFFFF) <= len(t))
                    if not own.any():
                        out.append((len(t), 0, 0, t))
                        continue
                    gone = np.zeros(len(t) + 1, np.int64)
                    np.add.at(gone, lo[own] & 0xFFFFFFFF, 1)
                    np.add.at(gone, hi[own] & 0xFFFFFFFF, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    out.append((len(t), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
                last = [hashlib.sha256(x[3]).hexdigest() if digest else x[3].decode("utf-8", "ignore") for x in out]
                columns = [part.column(c) for c in names] + [pa.array([x[i] for x in out], pa.int64()) for i in range(3)] + [pa.array(last, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns ``keep``, n_bytes, n_removed, n_spans, kept_text), or kept_sha256 in the place of the text when ``digest``.

    Where a cut falls inside a character, its other bytes go from kept_text too.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    slim = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    spans = repeats(slim).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    names = ["doc_id", *keep]
    joined = docs.select(*names, "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")).join(spans, "doc", "left").select(*names, "text", "spans")
    last = "kept_sha256" if digest else "kept_text"
    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*kinds, "n_bytes long", "n_removed long", "n_spans long", f"{last} string"])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(docs.select(*names).schema)
    for c in ("n_bytes", "n_removed", "n_spans"):
        shape = shape.append(pa.field(c, pa.int64()))
    return joined.mapInArrow(_cut(digest, names, shape.append(pa.field(last, pa.string()))), schema)
