"""Exact components of near copies: a metric-space join under the Jaccard distance of word shingles.

1. Documents with equal shingle sets are one class, led by the smallest id; only leads go on.
2. Two sets with similarity 0.8 or more share one of their rarest fifth of shingles (and one more), in any order common
   to all documents. Frequent shingles come last in that order, by a sketch whose counts are added over all documents. The first
   pivots are the leaders of those shingles: of the documents that hold one, the one that shares most. A leader's
   region is every document that shares such a shingle with it or under it. Pivots drawn at random would lie at
   distance 1 from nearly all documents, and no window would exclude anything; these don't.
3. A region is joined by pivots, twice. First under a coarser metric that never exceeds the distance, that of
   the counts of the hashes in a few bins: members without anybody in reach there go, so that most texts aren't
   needed. Then exactly. Either time, distances to a few pivots give Voronoi cells; a document is at home with its nearest pivot
   and is replicated to every other cell within the window of the triangle inequality, in which a linked document may be
   at home; the cells are joined in the same way in turn. Every link is one between a pivot and a member. Documents of
   one component needn't be compared any more, and a region of one component is done.
4. A region that fits a task is joined there. A larger one is dealt out in pieces: each piece meets the region's next
   pivots, the cells are the regions of the next round, and so on until no region holds two components. Sets are
   sent to regions in waves, so disk doesn't grow with the regions that a document is in.
5. Links are contracted to components by star contractions. A region gives at most one link a document.

Only ids and sets of hashes travel, never texts nor pairs of documents.

Nulls and odd cases: a document without words has no shingles and is linked with nothing; one of fewer than five
words is one shingle. Rows with one id are one node: they are linked if any of their texts are, and so are the classes
they belong to. A null id takes no part and gets a null component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts, slices, text_bytes
from .components import absorb, connected, same_id
from .regions import Region, partners, voronoi
from .shingles import mix, shingle_sets

#: Bits of the frequency sketch and of a block of it; a counter so many standard deviations above its block's median over all documents counts as frequent.
SKETCH_BITS, BLOCK_BITS, FREQUENT, LEAST_FREQUENT = 22, 16, 6, 12
#: Documents and shingles of a piece of a region; pivots of a large region in a round, and those of them with a cell (bits of a long).
PIECE_DOCS, PIECE_SHINGLES, ROUND_PIVOTS, CELLS = 400, 1_000_000, 256, 32
#: Documents of a region that is looked through under the bins as a whole.
BIN_DOCS = 2000
#: Sets travel to their regions in waves: one shuffles at most this share of the hashes of all documents, or so many hashes if that is more.
WAVE_SHARE, WAVE_LEAST = 0.25, 32_000_000
#: Documents under one shingle, up to which those without a partner of the right size and place are told apart.
FEW = 64
#: Ids (8 bytes each) that are broadcast at most to pick the texts whose sets are needed; with more, the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of text hashed at once, one text at least; hashing takes several dozen bytes for each of them.
SLICE = 1_000_000


def _frequent(docs: DataFrame) -> np.ndarray:
    """Level (0: not frequent, else about log2 of what it has above the median) of each counter, over all documents. At most 2^22 bytes.

    Only the counts of all documents tell: in what one task reads, a shingle of hundreds of documents may occur once.
    """
    n, size = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for s in shingle_sets(text_bytes(part.column("text"))):
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), 1)
        for place in range(4):  # most counts are of one byte
            part = ((counts >> (8 * place)) & 255).astype(np.uint8).reshape(-1, size)
            some = np.flatnonzero(part.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([place] * len(some), pa.int32()), pa.array([part[i].tobytes() for i in some], pa.binary())], ["block", "place", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, part in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "part")), strict=True):
                sums.setdefault(block, np.zeros(size, np.int64))
                sums[block] += np.frombuffer(part, np.uint8).astype(np.int64) << (8 * place)
        for block, counts in sums.items():
            usual = float(np.median(counts))
            hot = np.flatnonzero(counts >= max(LEAST_FREQUENT, usual + FREQUENT * usual**0.5))
            yield pa.RecordBatch.from_arrays([pa.array(block * size + hot, pa.int32()), pa.array(np.log2(counts[hot] - usual).astype(np.int8) + 1, pa.int8())], ["counter", "level"])

    parts = docs.select("text").mapInArrow(run, "block int, place int, part binary").repartition(n_parts(docs.sparkSession), "block")
    found = materialize(parts.mapInArrow(summed, "counter int, level byte"), "frequent")
    level = np.zeros(n, np.uint8)
    for b in found.toArrow().to_batches():
        level[b.column("counter").to_numpy()] = b.column("level").to_numpy()
    discard(found)
    return level


def prefix_length(n: int) -> int:
    """Shingles of which a set of ``n`` shares one with every set of similarity 0.8 or more."""
    return n - (4 * n + 4) // 5 + 1


def bins(s: np.ndarray) -> bytes:
    """Counts of the hashes in about n/4 bins (a power of two), at most 255 each."""
    b = bin_bits(len(s))
    return np.minimum(np.bincount((s >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b), 255).astype(np.uint8).tobytes()


def bin_bits(n: int) -> int:
    return max(3, min(12, n.bit_length() - 2))


def with_partner(n: np.ndarray, counts: list[bytes]) -> np.ndarray:
    """Which sets may be linked with another one, by their bins; see :func:`regions.partners`. Full bins tell only sizes."""
    ok, full = np.zeros(len(n), bool), np.array([255 in c for c in counts])
    for i in np.flatnonzero(full):
        near = (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i])) & (np.arange(len(n)) != i)
        ok |= near
        ok[i] |= near.any()
    bits = np.array([bin_bits(int(x)) for x in n])
    rows = {int(b): np.flatnonzero((bits == b) & ~full) for b in np.unique(bits)}
    bins_of = {b: np.frombuffer(b"".join([counts[i] for i in r]), np.uint8).reshape(len(r), -1).astype(np.int32) for b, r in rows.items() if len(r)}
    for b, own in bins_of.items():  # sizes within a fifth differ by one bit at most
        above = rows[b + 1] if b + 1 in bins_of else np.empty(0, np.int64)
        both = np.concatenate([rows[b], above])
        folded = np.vstack([own, bins_of[b + 1].reshape(len(above), -1, 2).sum(axis=2)]) if len(above) else own
        ok[both] |= partners(n[both], folded, np.arange(len(both)) >= len(own))
    return ok


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r, piece, whole, doc, n, weight, bins) sorted by region, without those that :func:`with_partner` excludes from a whole region."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        rows = held
        if rows[0][2]:
            ok = with_partner(np.array([x[4] for x in rows], np.int64), [x[6] for x in rows])
            rows = [x for x, good in zip(rows, ok, strict=True) if good]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 3, 4, 5)], ["r", "doc", "n", "weight"])

    for batch in batches:
        for part in slices(batch, "bins"):
            for row in zip(*(part.column(c).to_pylist() for c in ("r", "piece", "whole", "doc", "n", "weight", "bins")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield done()
                    held = []
                held.append(row)
    if held:
        yield done()


def _describe(level_of):
    """(doc_id, n, fingerprints of the set, bins, shingles of the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, odd = level_of.value, np.uint64(0x94D049BB133111EB)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(text_bytes(part.column("text")))
                f1 = [int(np.sum(s, dtype=np.uint64).view(np.int64)) for s in sets]
                f2 = [int(np.sum(mix(s ^ odd), dtype=np.uint64).view(np.int64)) for s in sets]
                heads = []
                for s in sets:
                    own = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    ordered = s[np.argsort(own, kind="stable")] if own.any() else s
                    heads.append(ordered[: prefix_length(len(s))].view(np.int64) if len(s) else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *heads])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([bins(s) for s in sets], pa.binary()), lists], ["doc_id", "n", "f1", "f2", "bins", "head"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc, set as packed hashes)."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "set"])


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle, without those of rare shingles that no other document under the shingle can be linked with by it.

    Sets of n and m with their first common shingle at the places p and q need n - p and m - q to hold all that is common.
    """
    held: list[pa.RecordBatch] = []

    def kept(parts: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        tok, n, left = t.column("tok").to_numpy(), t.column("n").to_numpy(), (t.column("n").to_numpy() - t.column("pos").to_numpy())
        end = len(tok) if last else int(np.searchsorted(tok, tok[-1], "left"))
        if end < len(tok):
            held[:] = t.slice(end).to_batches()
        tok, n, left = tok[:end], n[:end], left[:end]
        ok = np.zeros(end, bool)
        for step in range(1, FEW):
            same = np.flatnonzero(tok[step:] == tok[:-step])
            same = same[~ok[same] | ~ok[same + step]]
            if not len(same) and not (tok[step:] == tok[:-step]).any():
                break
            a, b = same, same + step
            fit = (100 * np.minimum(n[a], n[b]) >= 80 * np.maximum(n[a], n[b])) & (9 * np.minimum(left[a], left[b]) >= 4 * (n[a] + n[b]))
            ok[a[fit]] = ok[b[fit]] = True
        yield from t.slice(0, end).select(["tok", "doc", "n", "times"]).filter(pa.array(ok)).to_batches()

    for batch in batches:
        many = pc.greater(batch.column("times"), FEW)  # their documents are dealt over tasks, so nothing can be told here
        yield batch.filter(many).select(["tok", "doc", "n", "times"])
        batch = batch.filter(pc.invert(many))
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) > 50_000:
                parts, held = held, []
                yield from kept(parts, False)
    if held:
        yield from kept(held, True)


def _joined_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region and piece, pivots first, to links (r, a, b) and, for regions in pieces, cells (r, a, n, cells as bits)."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        r, _, whole = held[0][:3]
        region = Region(np.array([x[4] for x in held]), np.array([x[5] for x in held]), [np.frombuffer(x[6], np.uint64) for x in held])
        links, cells, own = region.links, None, np.arange(len(held))
        if whole:
            region.join(own)
        else:
            pivots = own[[x[3] for x in held]]
            rest = own[len(pivots) :]
            region.measure(pivots, pivots)
            if len(rest):
                near = voronoi(region.measure(rest, pivots)[:, :CELLS])
                cells = near @ (1 << np.arange(near.shape[1], dtype=np.int64))
        n, m = len(links), 0 if cells is None else len(cells)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r] * (n + m), pa.int64()), pa.array([a for a, _ in links] + (region.docs[rest].tolist() if m else []), pa.int64()), pa.array([b for _, b in links] + [None] * m, pa.int64()),
                pa.array([None] * n + (region.n[rest].tolist() if m else []), pa.int64()), pa.array([None] * n + (cells.tolist() if m else []), pa.int64()),
            ],
            ["r", "a", "b", "n", "cells"],
        )

    for batch in batches:
        for part in slices(batch, "set"):
            for row in zip(*(part.column(c).to_pylist() for c in ("r", "piece", "whole", "pivot", "doc", "comp", "set")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield done()
                    held = []
                if not held or held[-1] != row:  # rows may repeat
                    held.append(row)
    if held:
        yield done()


def _round(regions: DataFrame, sets: DataFrame, most: float) -> DataFrame:
    """One round of all open regions (r, doc, n, comp): links and cells, see :func:`_joined_regions`.

    A document's set travels to each of its regions, and regions per document grow with the groups of near copies. So the pieces are
    dealt over as many waves as keep what one shuffles at about ``most`` hashes; its files go before the next one begins.

    A region in pieces has as pivots ``ROUND_PIVOTS`` documents outside its commonest component, or any if all are alone.
    """
    parts = n_parts(regions.sparkSession)
    sizes = regions.groupBy("r", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).groupBy("r").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most"))
    sizes = sizes.withColumn("pieces", F.ceil(F.greatest(F.col("k") / PIECE_DOCS, F.col("n") / PIECE_SHINGLES)).cast("int")).select("r", "pieces", F.when(F.col("most") > 1, F.col("main")).alias("main"))
    whole = F.col("pieces") == 1
    dealt = materialize(regions.join(sizes, "r").select("r", "doc", "n", "comp", "weight", "pieces", "main"), "dealt")
    chosen = dealt.filter(~whole & ~F.col("comp").eqNullSafe(F.col("main")))
    order = Window.partitionBy("r").orderBy(F.desc("weight"), "doc")
    chosen = materialize(chosen.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= ROUND_PIVOTS).drop("at"), "pivots")
    piece = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("pieces"))).cast("int")
    waves = math.ceil(sum(x.agg(F.sum(F.col("n") * k)).first()[0] or 0 for x, k in ((dealt, F.lit(1)), (chosen, F.col("pieces")))) / most) or 1
    members = dealt.join(chosen.select("r", "doc"), ["r", "doc"], "left_anti").select("r", piece.alias("piece"), whole.alias("whole"), F.lit(False).alias("pivot"), "doc", "comp")
    copies = chosen.select("r", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(False).alias("whole"), F.lit(True).alias("pivot"), "doc", "comp")
    out = []
    for wave in range(waves):
        rows = members.union(copies).filter(F.pmod(F.xxhash64("r", "piece"), F.lit(waves)) == wave).join(sets, "doc").select("r", "piece", "whole", "pivot", "doc", "comp", "set")
        rows = rows.repartition(parts, "r", "piece").sortWithinPartitions("r", "piece", F.desc("pivot"), "doc", "set")
        out.append(materialize(rows.mapInArrow(_joined_regions, "r long, a long, b long, n long, cells long"), "round"))
    whole_round = out[0] if waves == 1 else materialize(reduce(DataFrame.union, out), "round")
    for x in (dealt, chosen, *(out if waves > 1 else ())):
        discard(x)
    return whole_round


def _next_regions(found: DataFrame, comps: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells of regions in pieces as the next regions (r, doc, n, comp, weight); cells that tell too little apart stay one region."""
    cells = found.filter("b is null").select("r", F.col("a").alias("doc"), "n", "cells")
    apart = cells.groupBy("r").agg((F.sum(F.bit_count("cells")) <= 1.5 * F.count(F.lit(1))).alias("apart"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda j: F.getbit("cells", j) == 1)
    own = cells.join(apart, "r").select(F.explode(F.when(F.col("apart"), bits).otherwise(F.array(F.lit(-1)))).alias("j"), "r", "doc", "n")
    own = own.select(F.when(F.col("j") < 0, F.col("r")).otherwise(F.xxhash64("r", "j")).alias("r"), "doc", "n")
    own = own.join(comps.select(F.col("id").alias("doc"), "comp"), "doc", "left").join(weights, "doc").select("r", "doc", "n", F.coalesce("comp", "doc").alias("comp"), "weight")
    mixed = own.groupBy("r").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("r")
    return materialize(own.join(mixed, "r", "left_semi"), "regions")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = spark.sparkContext.broadcast(_frequent(texts))
    about = materialize(texts.mapInArrow(_describe(level), "doc_id long, n long, f1 long, f2 long, bins binary, head array<long>"), "about")
    leads = materialize(about.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("head").alias("head"), F.any_value("bins").alias("bins")), "leads")
    rows = materialize(about.select("doc_id", "n", "f1", "f2").join(leads.drop("head", "bins"), ["f1", "f2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    discard(about)
    links = same_id(rows)

    heads = leads.select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), F.posexplode("head").alias("pos", "tok"))
    shared = materialize(heads.groupBy("tok").agg(F.count(F.lit(1)).cast("int").alias("times")).filter("times > 1"), "shared")
    members = heads.join(shared, "tok").select("tok", "doc", "n", "pos", "times")
    salt = F.when(F.col("times") > FEW, F.xxhash64("doc")).otherwise(0)
    members = members.repartition(n_parts(spark), "tok", salt).sortWithinPartitions("tok").mapInArrow(_partnered, "tok long, doc long, n int, times int")
    members = materialize(members, "members")
    discard(shared)

    weights = materialize(members.groupBy("doc").agg(F.sum(F.floor(F.log2("times"))).alias("weight")), "weights")
    pivots = members.join(weights, "doc").groupBy("tok").agg(F.min(F.struct((-F.col("weight")).alias("light"), "doc")).alias("p")).select("tok", F.col("p.doc").alias("r"))
    regions = members.join(pivots, "tok").groupBy("r", "doc").agg(F.max("n").alias("n"))
    regions = materialize(regions.join(weights, "doc").select("r", "doc", "n", "weight"), "regions")
    discard(members)
    regions, _ = _excluded(regions, leads.select(F.col("rep").alias("doc"), F.col("n").alias("of"), "bins")), discard(regions)
    most = max(WAVE_LEAST, WAVE_SHARE * (leads.agg(F.sum("n")).first()[0] or 0))
    discard(leads)

    ids = materialize(regions.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    needed = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = materialize(needed.mapInArrow(_sets, "doc long, set binary"), "sets")

    comps, more = None, not regions.isEmpty()
    while more:
        found = _round(regions, sets, most)
        discard(regions)
        new = found.filter("b is not null").select("a", "b")
        comps = materialize(connected(new.union(links)), "components") if comps is None else absorb(comps, new)
        more = not found.filter("b is null").isEmpty()
        if more:
            regions = _next_regions(found, comps, weights)
            more = not regions.isEmpty()
        discard(found)
    if comps is None:
        comps = connected(links)
    discard(sets)
    return rows.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))


def _excluded(regions: DataFrame, bins_of: DataFrame) -> DataFrame:
    """Regions (r, doc, n, comp, weight) without the members whose bins leave no partner; regions of more than ``BIN_DOCS`` stay whole."""
    sizes = regions.groupBy("r").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("pieces", F.when(F.col("k") <= BIN_DOCS, 1).otherwise(F.ceil(F.col("k") / PIECE_DOCS)).cast("int"))
    whole = F.col("pieces") == 1
    piece = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("pieces"))).cast("int")
    # ids with several sets have several bins and stay where one of them has a partner
    rows = regions.join(sizes, "r").select("r", piece.alias("piece"), whole.alias("whole"), "doc", "weight").join(bins_of.join(regions.select("doc").distinct(), "doc", "left_semi"), "doc")
    rows = rows.select("r", "piece", "whole", "doc", F.col("of").alias("n"), "weight", "bins").repartition(n_parts(regions.sparkSession), "r", "piece").sortWithinPartitions("r", "piece")
    kept = rows.mapInArrow(_with_partners, "r long, doc long, n long, weight long").groupBy("r", "doc").agg(F.max("n").alias("n"), F.max("weight").alias("weight"))
    return materialize(kept.select("r", "doc", "n", F.col("doc").alias("comp"), "weight"), "regions")
