"""Packing of vectors into blocks, and bounded running top-k lists for block joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries whose running lists one task keeps before it hands them on.
HELD_QUERIES = 20_000


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """Rows (id, vec) whose vector is not null or empty, is finite throughout and, if asked, is not all zero."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    if nonzero:
        ok &= F.exists("vec", lambda x: x != 0.0)
    return out.filter(F.coalesce(ok, F.lit(False)))


def matrices(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) for each dimension in a batch."""
    lists = batch.column(column)
    lengths = np.asarray(pc.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        take = (ends[rows] - dim)[:, None] + np.arange(dim)
        yield int(dim), rows, flat[take]


class TopK:
    """Running top-k lists by query: higher score first, ties to the smaller id."""

    def __init__(self, k: int, kind: type) -> None:
        self.k, self.kind, self.held = k, kind, {}

    def bound(self, q: int) -> float:
        got = self.held.get(q)
        return -np.inf if got is None or len(got[0]) < self.k else got[1][-1]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if q in self.held:
            ids, scores = np.concatenate([self.held[q][0], ids]), np.concatenate([self.held[q][1], scores])
        if len(ids) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, -scores))[: self.k]
        self.held[q] = (ids[best], scores[best])

    def flush(self) -> pa.RecordBatch:
        q = np.repeat(np.fromiter(self.held, np.int64, len(self.held)), [len(v[0]) for v in self.held.values()])
        ids = np.concatenate([np.empty(0, np.int64), *[v[0] for v in self.held.values()]])
        scores = np.concatenate([np.empty(0, self.kind), *[v[1] for v in self.held.values()]])
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def merge_topk(found: DataFrame, k: int) -> DataFrame:
    """One ranked list of ``k`` from the tasks' lists, merged in two steps so that no task meets all lists of a query."""
    score = found.schema["score"].dataType.simpleString()
    best = lambda c: F.slice(
        F.array_sort(c, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)), 1, k
    )
    item = F.struct(F.col("score").alias("s"), F.col("vec_id").alias("v"))
    first = (
        found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(8)).alias("salt"))
        .agg(best(F.collect_list(item)).alias("top"))
    )
    merged = first.groupBy("query_id").agg(best(F.flatten(F.collect_list("top"))).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), F.col("t.s").cast(score).alias("score")
    )
