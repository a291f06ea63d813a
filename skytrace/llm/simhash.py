"""SimHash near copies by pigeonhole blocks.

1. A text's fingerprint has a bit for each bit of XXH64 (seed 42) that is set in more than half of its word shingles.
   Documents with equal fingerprints are one class, led by the smallest id; only leads go on.
2. Fingerprints that differ in at most 3 bits agree in one of any 4 blocks of bits: each lead goes to the buckets of its
   4 blocks, and bits are counted only between leads of a bucket.
3. A bucket of more than ``BUCKET`` leads is dealt again: its leads differ in at most 3 of the bits left, so they agree in one
   of 4 blocks of those. At 11 bits left a bucket can't be too large, so all buckets are compared in full in the end and none
   is cut off.
4. A bucket gives the links of a spanning forest, at most one a lead; links are contracted by star contractions.

Nulls and odd cases: a null or blank text has fingerprint 0, which is linked like any other; fewer words than a shingle
has are one shingle. Rows with one id are one node: the classes they belong to are linked. A null id takes no part and
gets a null component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts, slices, text_bytes
from .components import connected, same_id

SEED, REACH, ALL = 42, 3, (1 << 64) - 1
#: Leads that one task compares with one another (8 at least: a bucket with b bits left holds 2^b); hashes whose bits are counted at once.
BUCKET, AT_ONCE = 2048, 1 << 16
#: Buckets up to this size are compared together, place by place.
SMALL = 16


def fingerprint(text: bytes, k: int = 3) -> int:
    """The 64-bit fingerprint of a text's ``k``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    start, end = (end - sizes)[: max(1, len(words) - k + 1)], end[min(k, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(start), AT_ONCE):
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[a : a + AT_ONCE].tolist(), end[a : a + AT_ONCE].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = np.array([fingerprint(t, k) for t in text_bytes(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def blocks(left: int, parts: int = REACH + 1) -> list[int]:
    """The set bits of ``left`` in so many blocks of nearly equal size, as masks."""
    bits = [i for i in range(64) if left >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


@lru_cache(maxsize=100_000)
def _left_blocks(mask: int) -> list[int]:
    return blocks(~mask & ALL)


def near(prints: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[others] ^ prints[i]) <= REACH


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (places) that tie together all fingerprints within reach of one another; each is compared with those not yet tied."""
    links, left = [], np.arange(len(prints))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(prints, i, left)
            if hit.any():
                found = left[hit].tolist()
                links += [(i, j) for j in found]
                todo += found
                left = left[~hit]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, print, rep) sorted by bucket to links (a, b) between their leads."""
    held: list[pa.RecordBatch] = []

    def kept(last: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        mask, key, prints, rep = (t.column(c).to_numpy() for c in ("mask", "key", "print", "rep"))
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        starts = np.append(np.flatnonzero(new), len(rep))
        end = len(rep) if last else int(starts[-2])
        held[:] = t.slice(end).combine_chunks().to_batches()
        prints, a, b = prints.view(np.uint64), [], []
        sizes = np.diff(starts)
        bucket = np.repeat(np.arange(len(sizes)), sizes)[:end]
        small = sizes[bucket] <= SMALL
        for step in range(1, min(SMALL, end)):
            i = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:])
            if not len(i):
                break
            i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= REACH]
            a.append(rep[i])
            b.append(rep[i + step])
        for g in np.flatnonzero(sizes > SMALL):
            if starts[g] < end:
                own = forest(prints[starts[g] : starts[g + 1]])
                a.append(rep[starts[g] + np.array([i for i, _ in own], np.int64)])
                b.append(rep[starts[g] + np.array([j for _, j in own], np.int64)])
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) > 50_000:
                yield kept(False)
    if held:
        yield kept(True)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leads of too large a bucket to the buckets of the blocks of the bits that their mask leaves."""
    for batch in batches:
        mask, prints = batch.column("mask").to_numpy().view(np.uint64), batch.column("print").to_numpy().view(np.uint64)
        for part in range(REACH + 1):
            more = mask | np.array([_left_blocks(m)[part] for m in mask.tolist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(more.view(np.int64)), pa.array((prints & more).view(np.int64)), batch.column("print"), batch.column("rep")], ["mask", "key", "print", "rep"])


def links_of(leads: DataFrame) -> DataFrame:
    """Links (a, b) that tie together all leads (print, rep) within reach."""
    spark = leads.sparkSession
    first = F.explode(F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in blocks(ALL)]))
    rows = leads.select(first.alias("mask"), "print", "rep").select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print", "rep")
    out, more = [], True
    while more:
        full = materialize(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {BUCKET}").select("mask", "key"), "full")
        more = not full.isEmpty()
        now = rows.join(full, ["mask", "key"], "left_anti") if more else rows
        now = now.repartition(n_parts(spark), "mask", "key").sortWithinPartitions("mask", "key", "print")
        out.append(materialize(now.mapInArrow(_bucket_links, "a long, b long"), "links"))
        if more:
            again = rows.join(full, ["mask", "key"], "left_semi").select("mask", "print", "rep")
            rows = materialize(again.mapInArrow(_again, "mask long, key long, print long, rep long"), "buckets")
        discard(full)
    return reduce(DataFrame.union, out)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    about = materialize(texts.mapInArrow(_fingerprints(k), "doc_id long, print long"), "prints")
    leads = materialize(about.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "leads")
    rows = about.join(leads, "print", "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    comps = connected(links_of(leads).union(same_id(rows)))
    of = leads.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("print", F.coalesce("comp", "rep").alias("comp"))
    hex_ = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return about.join(of, "print", "left").select("doc_id", hex_.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id"))
