"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` rows by hash of the id); every row is indexed. A query walks the
tree through a priority queue ordered by what a node promises: the inner product with its centre, and as much more as its
rows spread about it. How far spread counts, and how many leaves a query visits, is calibrated on the whole index:
``CALIBRATION_QUERIES`` rows of the sample are searched by brute force among all rows, and visits are widened until the
wished recall of theirs is reached.

Leaves are small, so they travel in groups: a group's rows are packed in blocks sorted by leaf, a query goes once to a
group with the list of its leaves there, and meets the rows of these alone. Queries search the first few leaves
(the square root of all visits), and then, knowing the last score of that list, the others, where only rows that beat
it are handed on. So a query's lists hold about 2 k sqrt(visits) rows, whatever the number of tasks. Scores are double
inner products of the original vectors, summed the same way for every row, so that equal vectors tie exactly.

Nulls: a null id, a null, empty or zero vector, or one with a null or non-finite component takes no part.
Vectors meet only vectors of their own length; the tree is fitted for the commonest length, and vectors of
other lengths share one leaf. Repeated rows with one id are separate candidates. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import discard, materialize, n_parts
from .vectors import HELD_QUERIES, TopK, matrices, merge_topk, usable

#: Rows the tree is fitted on at most; queries it is calibrated with; children of a node; rows of a leaf in the sample.
SAMPLE_ROWS, CALIBRATION_QUERIES, BRANCH, LEAF_ROWS = 20_000, 400, 8, 25
BLOCK_ROWS, RECALL = 2048, 0.94
#: Deviations by which a node may promise more than its centre; rows of its parent that a node's spread is mixed with.
SPREADS, SHRUNK = (0.0, 1.5, 3.0, 4.5), 4
#: A group of leaves holds about half a partition's rows, within these bounds; a leaf with more is dealt out in pieces. Queries met at once.
LEAST_PIECE, MOST_PIECE, QUERIES_AT_ONCE = 48, BLOCK_ROWS, 512


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Plain Lloyd rounds; (centres, owner of each row). Empty clusters take the rows farthest from their centre."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * (x @ centres.T)
        own = far.argmin(1)
        for j in range(k):
            mine = own == j
            centres[j] = x[mine].mean(0) if mine.any() else x[far.min(1).argmax()]
    return centres, own


class Tree:
    """Nodes as arrays: centre of each node, children of inner nodes, leaf number or -1."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.n_leaves = [x.mean(0)], {}, [-1], 0
        self.spread, self.more = [float(((x - x.mean(0)) ** 2).mean())], SPREADS[0]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows or np.all(rows == rows[0]):
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            centres, own = kmeans(rows, min(branch, len(rows)), rng)
            parts = [(c, rows[own == j]) for j, c in enumerate(centres) if (own == j).any()]
            if len(parts) == 1:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            self.children[node] = []
            for c, part in parts:
                self.children[node].append(len(self.leaf))
                todo.append((len(self.leaf), part))
                self.leaf.append(-1)
                self.centres.append(c)
                self.spread.append(float((((part - c) ** 2).mean() * len(part) + self.spread[node] * SHRUNK) / (len(part) + SHRUNK)))
        self.centres, self.spread = np.array(self.centres), np.sqrt(self.spread)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: nearest child all the way down."""
        at = np.zeros(len(x), np.int64)
        leaf = np.asarray(self.leaf)
        while True:
            inner = np.flatnonzero(leaf[at] < 0)
            if not len(inner):
                return leaf[at]
            for node in np.unique(at[inner]):
                mine = inner[at[inner] == node]
                kids = np.asarray(self.children[int(node)])
                c = self.centres[kids]
                at[mine] = kids[((c**2).sum(1) - 2 * (x[mine] @ c.T)).argmin(1)]

    def promise(self, q: np.ndarray) -> np.ndarray:
        """What each node's rows may reach."""
        return self.centres @ q + self.more * float(np.sqrt(q @ q)) * self.spread

    def visits(self, q: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves, best bin first."""
        out, near, heap = [], self.promise(q).tolist(), [(0.0, 0)]
        while heap and len(out) < n:
            node = heapq.heappop(heap)[1]
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            else:
                for kid in self.children[node]:
                    heapq.heappush(heap, (-near[kid], kid))
        return out


def _truth(tree: Tree, dim0: int, ids: np.ndarray, vecs: np.ndarray, k: int):
    """All rows to each calibration query's best of the batch: its number, the row's leaf and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(k, np.float64)
        for batch in batches:
            own = np.asarray(batch.column("id"))
            for dim, at, m in matrices(batch):
                if dim != dim0:
                    continue
                leaf = tree.assign(m).astype(np.int64)
                for i in range(0, len(at), BLOCK_ROWS):
                    part = slice(i, i + BLOCK_ROWS)
                    rough = vecs @ m[part].T
                    rough[ids[:, None] == own[at[part]][None, :]] = -np.inf
                    best = np.argpartition(-rough, min(k, rough.shape[1]) - 1, axis=1)[:, :k]
                    for j, cols in enumerate(best):
                        cols = cols[np.isfinite(rough[j, cols])]
                        top.add(j, leaf[part][cols], rough[j, cols])
        yield top.flush()

    return run


def calibrate(tree: Tree, queries: np.ndarray, truth: list[np.ndarray], sizes: np.ndarray, recall: float) -> int:
    """Leaves to visit, widened by a twentieth until the wished share of the true rows' leaves (``truth``) is among them.

    First the tree's spread is set to what reaches it with the fewest rows in leaves ranked by their promise.
    """
    leaves = np.flatnonzero(np.asarray(tree.leaf) >= 0)
    number = np.asarray(tree.leaf)[leaves]
    costs = []
    for tree.more in SPREADS:
        need = []
        for q, own in zip(queries, truth, strict=True):
            order = number[np.argsort(-tree.promise(q)[leaves], kind="stable")]
            place = np.empty(tree.n_leaves, np.int64)
            place[order] = np.arange(tree.n_leaves)
            need.append(np.cumsum(sizes[order])[place[own]])
        need = np.sort(np.concatenate([np.zeros(0), *need]))
        costs.append(need[min(len(need) - 1, int(recall * len(need)))] if len(need) else 0.0)
    tree.more = SPREADS[int(np.argmin(costs))]
    ranks, n = [np.empty(0, np.int64)], 1
    for q, own in zip(queries, truth, strict=True):
        place = np.empty(tree.n_leaves, np.int64)
        place[tree.visits(q, tree.n_leaves)] = np.arange(tree.n_leaves)
        ranks.append(place[own])
    ranks = np.concatenate(ranks)
    while n < tree.n_leaves and (ranks < n).sum() < recall * len(ranks):
        n = min(tree.n_leaves, n + max(1, n // 20))
    return n


def groups_of(expected: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(group of each leaf, pieces of each group): neighbouring leaves of about ``width`` rows; a larger leaf is a group in pieces."""
    group, rows = np.zeros(len(expected), np.int32), [0.0]
    for leaf, n in enumerate(expected.tolist()):
        if rows[-1] and rows[-1] + n > width:
            rows.append(0.0)
        group[leaf] = len(rows) - 1
        rows[-1] += n
    return group, np.ceil(np.array(rows) / width).clip(1).astype(np.int64)


def _indexer(tree: Tree, dim0: int, group: np.ndarray, pieces: np.ndarray):
    """Leaf and group of each row, and the number of pieces its group is dealt out in (the last number is for rows of other lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.full(batch.num_rows, -1, np.int32)
            for dim, at, m in matrices(batch):
                if dim == dim0:
                    leaf[at] = tree.assign(m)
            own = np.where(leaf < 0, -1, group[leaf]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(pieces[own]), pa.array(leaf), batch.column("id"), batch.column("vec")], ["grp", "pieces", "leaf", "id", "vec"])

    return run


def _packer(kind: type):
    """Rows sorted by group and leaf to blocks of one group, with components of the table's own type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf, group = (np.asarray(batch.column(c)) for c in ("id", "leaf", "grp"))
            for dim, at, m in matrices(batch):
                cuts = np.flatnonzero(np.diff(group[at])) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    for i in range(0, len(part), BLOCK_ROWS):
                        own = part[i : i + BLOCK_ROWS]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "grp": pa.array([group[at[own[0]]]], pa.int32()), "dim": pa.array([dim], pa.int32()), "leaves": pa.array([leaf[at[own]].tobytes()], pa.binary()),
                                "ids": pa.array([ids[at[own]].tobytes()], pa.binary()), "vecs": pa.array([m[own].astype(kind).tobytes()], pa.binary()),
                            }
                        )

    return run


def _router(tree: Tree, dim0: int, group: np.ndarray, start: int, stop: int):
    """Queries (id, vec, score and vec_id to beat) to blocks for each group that holds some of their visits ``start`` to ``stop``.

    ``qat`` and ``qleaf`` pair a block's queries with their leaves there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {"qids": np.asarray(batch.column("id")), "qscores": np.asarray(batch.column("score")), "qlast": np.asarray(batch.column("last"))}
            for dim, at, m in matrices(batch):
                pairs = [np.array((tree.visits(q, stop) if dim == dim0 else [-1])[start:], np.int64) for q in m]
                leaf, query = np.concatenate(pairs), np.repeat(np.arange(len(m)), list(map(len, pairs)))
                to = group[leaf] if dim == dim0 else np.full(len(leaf), -1)
                order = np.lexsort((query, to))
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    if not len(part):
                        continue
                    rows, place = np.unique(query[part], return_inverse=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "grp": pa.array([to[part[0]]], pa.int32()), "dim": pa.array([dim], pa.int32()), "qvecs": pa.array([m[rows].tobytes()], pa.binary()),
                            "qat": pa.array([place.astype(np.int32).tobytes()], pa.binary()), "qleaf": pa.array([leaf[part].astype(np.int32).tobytes()], pa.binary()),
                        }
                        | {c: pa.array([v[at[rows]].tobytes()], pa.binary()) for c, v in own.items()}
                    )

    return run


def _searcher(k: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(k, np.float64)
        for batch in batches:
            for r in batch.to_pylist():
                ids, qids, last = (np.frombuffer(r[c], np.int64) for c in ("ids", "qids", "qlast"))
                leaves, qat, qleaf = (np.frombuffer(r[c], np.int32) for c in ("leaves", "qat", "qleaf"))
                x = np.frombuffer(r["vecs"], kind).reshape(len(ids), -1).astype(np.float64)
                qs, beat = np.frombuffer(r["qvecs"], np.float64).reshape(len(qids), -1), np.frombuffer(r["qscores"], np.float64)
                slack = 1e-9 * (1 + np.sqrt((qs**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max()))
                edges = np.append(np.flatnonzero(np.diff(leaves, prepend=leaves[0] - 1)), len(leaves))
                for a in range(0, len(qids), QUERIES_AT_ONCE):
                    b = min(len(qids), a + QUERIES_AT_ONCE)
                    mine = np.flatnonzero((qat >= a) & (qat < b))
                    mine = mine[np.argsort(qleaf[mine], kind="stable")]
                    lo, hi = (np.searchsorted(qleaf[mine], leaves[edges[:-1]], side) for side in ("left", "right"))
                    rough = np.full((b - a, len(ids)), -np.inf)
                    for s, e, i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
                        if j > i:
                            visiting = qat[mine[i:j]]
                            rough[visiting - a, s:e] = qs[visiting] @ x[s:e].T
                    kth = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(ids) > k + 1 else np.full(b - a, -np.inf)
                    for j in range(a, b):
                        own, q = rough[j - a], int(qids[j])
                        at = np.flatnonzero((own >= max(kth[j - a], beat[j], top.bound(q)) - slack[j]) & (own > -np.inf) & (ids != q))
                        scores = (x[at] * qs[j]).sum(axis=1)
                        better = (scores > beat[j]) | ((scores == beat[j]) & (ids[at] <= last[j]))
                        if better.any():
                            top.add(q, ids[at[better]], scores[better])
                if len(top.held) > HELD_QUERIES:
                    yield top.flush()
        yield top.flush()

    return run


def tree_search(df: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About the top ``k`` by inner product for rows where ``is_query`` (a condition on ``id``) holds: query_id, rank, vec_id, score."""
    rows = usable(df, id_col, vec_col, nonzero=True)
    counts = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not counts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim0, total = counts[0]
    chance = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, sample_rows / total) * (1 << 30))
    found = rows.filter(chance & (F.size("vec") == dim0)).orderBy(F.xxhash64("id", F.lit(11))).limit(sample_rows).toArrow()
    sample = np.asarray(found.column("vec").combine_chunks().flatten()).reshape(-1, dim0)
    if not len(sample):
        sample = np.zeros((1, dim0))
    tree = Tree(sample)
    expected = np.bincount(tree.assign(sample), minlength=tree.n_leaves) * (total / len(sample))
    some = slice(0, CALIBRATION_QUERIES)  # the first by hash
    asked, vecs = np.asarray(found.column("id"))[some], sample[some][: found.num_rows]
    best = merge_topk(rows.mapInArrow(_truth(tree, dim0, asked, vecs, k), "query_id long, vec_id long, score double"), k).select("query_id", "vec_id").toArrow()
    whose, leaf = best.column("query_id").to_numpy(), best.column("vec_id").to_numpy()
    n = calibrate(tree, vecs, [leaf[whose == j] for j in range(len(vecs))], expected, recall)
    first = min(n, max(1, math.isqrt(n)))
    kind = np.float32 if isinstance(df.schema[vec_col].dataType.elementType, FloatType) else np.float64
    parts = n_parts(df.sparkSession)
    width = float(np.clip(total / parts / 2, LEAST_PIECE, MOST_PIECE))
    group, pieces = groups_of(expected, width)
    pieces = np.append(pieces, max(1, math.ceil(total / width)))
    blocks = materialize(
        rows.mapInArrow(_indexer(tree, dim0, group, pieces), "grp int, pieces long, leaf int, id long, vec array<double>")
        .repartition(parts, "grp", F.pmod(F.xxhash64("id"), F.col("pieces")))
        .sortWithinPartitions("grp", "leaf", "id")
        .mapInArrow(_packer(kind), "grp int, dim int, leaves binary, ids binary, vecs binary"),
        "tree-leaves",
    )

    def search(queries: DataFrame, start: int, stop: int) -> DataFrame:
        routed = queries.mapInArrow(_router(tree, dim0, group, start, stop), "grp int, dim int, qvecs binary, qat binary, qleaf binary, qids binary, qscores binary, qlast binary")
        return blocks.join(routed, ["grp", "dim"]).mapInArrow(_searcher(k, kind), "query_id long, vec_id long, score double")

    queries = rows.filter(is_query)
    near = materialize(merge_topk(search(queries.withColumns({"score": F.lit(-math.inf), "last": F.lit(-1).cast("long")}), 0, first), k), "tree-first")
    if first == n:
        discard(blocks)
        return near
    last = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score", F.col("vec_id").alias("last"))
    wider = queries.join(last, "id", "left").select("id", "vec", F.coalesce("score", F.lit(-math.inf)).alias("score"), F.coalesce("last", F.lit(-1).cast("long")).alias("last"))
    return merge_topk(near.select("query_id", "vec_id", "score").union(search(wider, first, n)), k)
