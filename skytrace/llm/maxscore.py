"""Exact top-k search by integer inner product, with MaxScore pruning.

Each dimension is a term and holds one posting list per shard of candidates. A list's impacts are the
contributions ``q_d * x_d`` less their smallest value in the shard, so impacts are never negative and the
largest one bounds the term. Terms whose bounds together stay below the running threshold are
non-essential: the essential lists are traversed first, then the others are probed, largest bound first,
for the candidates that can still compete. Shards are merged at the end.

Candidates are packed into shards where they are read; the stated query set goes to every shard in blocks.

Nulls: a null id, a null or empty vector or one with a null or non-finite component takes no part. Vectors
meet only vectors of their own length. Repeated rows with one id are separate candidates. An empty table
gives no rows. Other columns are ignored. Components after scaling and scores must fit a long. Shards are dealt out by a
hash of their first id and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_parts
from .shingles import mix
from .vectors import HELD_QUERIES, TopK, matrices, merge_topk, usable

#: Candidates in a shard and queries in a block; terms probed between two tests of competitiveness.
SHARD_ROWS, QUERY_BLOCK, PROBE = 4096, 512, 8


def _packer(rows: int, scale: float, groups: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for dim, at, m in matrices(batch):
                x = np.floor(m * scale).astype(np.int64)
                for i in range(0, len(at), rows):
                    own = ids[at[i : i + rows]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(mix(own[:1].view(np.uint64) + np.uint64(i))[0] % np.uint64(groups))], pa.int32()), pa.array([dim], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x[i : i + rows].T).tobytes()], pa.binary())],
                        ["g", "dim", "ids", "comps"],
                    )

    return pack


def search_shard(q: np.ndarray, lists: np.ndarray, low: np.ndarray, high: np.ndarray, bound: float, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (positions, scores) of one shard that may reach ``bound``. ``lists``: terms x candidates, as doubles where these hold every partial sum, else as integers.

    Integers are bounded by rounded doubles with a slack above their error; the scores themselves are integer sums.
    """
    if lists.dtype != np.float64:
        doubles = [x.astype(np.float64) for x in (q, lists, low, high)]
        error = 4 * (len(q) + 2) * np.finfo(np.float64).eps * (float((np.abs(doubles[0]) * np.maximum(np.abs(doubles[2]), np.abs(doubles[3]))).sum()) + (abs(bound) if np.isfinite(bound) else 0.0))
        alive, _ = search_shard(*doubles, bound - error, probe)
        return alive, q @ lists[:, alive]
    a, b = q * low, q * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    spans = most - least
    order = np.argsort(-spans, kind="stable")
    tail = np.append(np.cumsum(spans[order][::-1])[::-1], 0.0)  # bound of the terms from here on
    need = bound - float(least.sum())
    essential = int(np.searchsorted(-tail, -need, side="left")) if np.isfinite(bound) else len(order)  # tail[essential:] < need
    essential = min(len(order), max(essential, 1))
    head = order[:essential]
    part = q[head] @ lists[head] - least[head].sum()
    alive = np.flatnonzero(part + tail[essential] >= need) if np.isfinite(bound) else np.arange(lists.shape[1])
    part = part[alive]
    for i in range(essential, len(order), probe):
        if not len(alive):
            break
        terms = order[i : i + probe]
        part = part + q[terms] @ lists[np.ix_(terms, alive)] - least[terms].sum()
        keep = part + tail[min(i + probe, len(order))] >= need
        alive, part = alive[keep], part[keep]
    return alive, part + least.sum()


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(k, np.int64)
        for batch in batches:
            for dim, ids, comps, qids, qcomps in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "comps", "qids", "qcomps")), strict=True):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                lists, qs = np.frombuffer(comps, np.int64).reshape(dim, -1), np.frombuffer(qcomps, np.int64).reshape(dim, -1).T
                low, high = lists.min(axis=1), lists.max(axis=1)
                exact = float(np.abs(lists).max()) * float(np.abs(qs).max()) * dim < 2**52
                if exact:  # doubles hold every partial sum exactly
                    lists, qs, low, high = (x.astype(np.float64) for x in (lists, qs, low, high))
                for q, vec in zip(qids.tolist(), qs, strict=True):
                    at, score = search_shard(vec, lists, low, high, top.bound(q))
                    own = ids[at] != q
                    top.add(q, ids[at][own], score[own].astype(np.int64))
                if len(top.held) > HELD_QUERIES:
                    yield top.flush()
        yield top.flush()

    return run


def maxscore_topk(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact top ``k`` for the rows where ``is_query`` (a condition on ``id``) holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows, groups = usable(df, id_col, vec_col, nonzero=False), 2 * n_parts(spark)
    kind = "g int, dim int, ids binary, comps binary"
    shards = rows.mapInArrow(_packer(SHARD_ROWS, scale, groups), kind)
    queries = (
        rows.filter(is_query).mapInArrow(_packer(QUERY_BLOCK, scale, groups), kind)
        .select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "dim", F.col("ids").alias("qids"), F.col("comps").alias("qcomps"))
    )
    found = shards.join(queries, ["g", "dim"]).mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    return merge_topk(found, k)
