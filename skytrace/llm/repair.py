"""Cheapest repair of conversations' structure by a run-length dynamic program.

1. Each row is a symbol: its role's initial (s, u, a or another) and its fault (must go, truncated, none). Only symbols and
   digests travel for the decisions; a duplicate is the second row of a digest within its conversation.
2. Equal consecutive symbols are a run. What a row costs from state to state (start, after s, after u, after a), with
   the insertions before it, is a 4 x 4 matrix in the min-plus semiring; a run of n takes the costs to go across by the binary
   powers of its matrix, which each worker keeps.
3. The choices are unrolled from the start with the costs to go at the ends of runs: the least initial among the cheapest edits
   (D, I, K, R), run by run; a long run is halved until its costs fit a short list.
4. Texts meet the audit in a second shuffle and are hashed as they come, sorted; none is held.

The edits of one conversation (a byte or two a row) are held by one task, as they are one value of the result.

Nulls and odd cases: a null role or text is one space, a null turn comes first and is written as a space, and rows with a
null id are one conversation with a null id. Rows of one turn are ordered by the MD5 of their role and text. A conversation
without rows has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, n_parts

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
INF = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What an edit that makes a user or an assistant turn leads to.
MADE = (2, 2, 3, 2)
ACCEPTED = (0, INF, INF, 0)
#: A role's initial leads from a state to another where it may stand.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Rows of a run whose costs to go are listed at once; bits of the numbers of rows in a run.
LISTED = 4096

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def inserted() -> Matrix:
    """Costs from state to state by insertions alone."""
    out = [[INF] * 4 for _ in range(4)]
    for i in range(4):
        at, cost = i, 0
        while cost < out[i][at]:
            out[i][at] = cost
            at, cost = MADE[at], cost + INSERT
    return tuple(map(tuple, out))


INSERTED = inserted()


def edits(symbol: int) -> tuple[dict[int, tuple[int, int]], ...]:
    """For each edit of a row of this symbol, in ASCII order but for insertions: state to (cost, next state)."""
    initial, fault = "sua?"[symbol // 3], symbol % 3
    stays = TRUNCATED if fault == 1 else 0
    keep = {} if fault == 2 else {s: (stays, t) for s, t in KEPT.get(initial, {}).items()}
    rerole = {} if fault == 2 else {s: (stays + REROLE, t) for s, t in enumerate(MADE)}
    return {s: (DELETE, s) for s in range(4)}, keep, rerole


EDITS = [edits(s) for s in range(12)]


@lru_cache(maxsize=None)  # 12 symbols, some 60 powers
def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2^bit rows of a symbol, each with the insertions before it."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    step = [[INF] * 4 for _ in range(4)]
    for moves in EDITS[symbol]:
        for s, (cost, t) in moves.items():
            step[s][t] = min(step[s][t], cost)
    return times(INSERTED, tuple(map(tuple, step)))


def across(symbol: int, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before ``n`` rows of a symbol, from those after them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            v = apply(power(symbol, bit), v)
    return v


def unroll(symbol: int, n: int, after: tuple[int, ...], state: int, out: list[str]) -> int:
    """Adds the edits of a run that starts in ``state``; gives the state after it."""
    if n > LISTED:
        half = n // 2
        state = unroll(symbol, half, across(symbol, n - half, after), state, out)
        return unroll(symbol, n - half, after, state, out)
    costs = [after]
    for _ in range(n):
        costs.append(apply(power(symbol, 0), costs[-1]))
    delete, keep, rerole = EDITS[symbol]
    for left in range(n, 0, -1):
        now, then = costs[left], costs[left - 1]
        while True:
            best = now[state]
            if delete[state][0] + then[state] == best:
                out.append("D")
                break
            if INSERT + now[MADE[state]] == best:
                out.append("I")
                state = MADE[state]
                continue
            for initial, moves in (("K", keep), ("R", rerole)):
                if state in moves and moves[state][0] + then[moves[state][1]] == best:
                    out.append(initial)
                    state = moves[state][1]
                    break
            break
    return state


def decide(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """(cost, audit) of runs (symbol, number)."""
    v = apply(INSERTED, ACCEPTED)
    after = []
    for symbol, n in reversed(runs):
        after.append(v)
        v = across(symbol, n, v)
    state, out = 0, []
    for (symbol, n), v_after in zip(runs, reversed(after), strict=True):
        state = unroll(symbol, n, v_after, state, out)
    while not ACCEPTED[state] == 0:
        out.append("I")
        state = MADE[state]
    return v[0], "".join(out)


_short = lru_cache(maxsize=100_000)(decide)
DECIDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, initial, fault, dropped) sorted by conversation to one row each."""
    names = [x.split()[0] for x in DECIDED.split(", ")]

    def conversation(conv: int | None, rows: bytearray, initials: list[str], turns: list[int]) -> tuple:
        faults = [0, 0, 0, 0]
        for x in rows:
            faults[x & 3] += 1
        illegal = initials[0]
        low, high, distinct = turns
        symbols = bytes((x >> 2) * 3 + (0, 2, 2, 1)[x & 3] for x in rows)
        runs = tuple((s, sum(1 for _ in own)) for s, own in groupby(symbols))
        cost, audit = (_short if len(runs) <= 64 else decide)(runs)
        return conv, high - low + 1 - distinct if distinct else 0, faults[1], faults[2], faults[3], illegal, cost, audit

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "audit" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)

    begun, conv, out = False, None, []
    rows, pairs, before, low, high, distinct = bytearray(), 0, None, None, None, 0
    for batch in batches:
        for own, turn, initial, fault, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "dropped")), strict=True):
            if not begun or own != conv:
                if begun:
                    out.append(conversation(conv, rows, [pairs], [low, high, distinct]))
                begun, conv = True, own
                rows, pairs, before, low, high, distinct = bytearray(), 0, None, None, None, 0
            if dropped:
                continue
            if turn is not None:
                if turn != high:
                    distinct += 1
                low, high = turn if low is None else low, turn
            if before is not None and before + initial not in ("su", "ua", "au"):
                pairs += 1
            before = initial
            rows.append({"s": 0, "u": 4, "a": 8}.get(initial, 12) | fault)
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if begun:
        out.append(conversation(conv, rows, [pairs], [low, high, distinct]))
    if out:
        yield batch_of(out)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit first and its texts in order, to the hash of the repaired texts."""
    names = [x.split()[0] for x in DECIDED.split(", ")]
    head, sha, at, state, some, out = None, None, 0, 0, False, []

    def turn(role: str, text: str) -> None:
        nonlocal some
        sha.update(f"{'\n' if some else ''}{role}:{text}".encode())
        some = True

    def insertions() -> None:
        nonlocal at, state
        audit = head[-1]
        while at < len(audit) and audit[at] == "I":
            turn("assistant" if state == 2 else "user", "")
            state, at = MADE[state], at + 1

    def done() -> None:
        insertions()
        out.append((*head, sha.hexdigest()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, x in zip([*names, "repaired_sha256"], zip(*rows, strict=True), strict=True)], [*names, "repaired_sha256"])

    for batch in batches:
        for is_row, role, text, *own in zip(*(batch.column(c).to_pylist() for c in ("is_row", "role", "text", *names)), strict=True):
            if not is_row:
                if head is not None:
                    done()
                head, sha, at, state, some = own, hashlib.sha256(), 0, 0, False
                continue
            insertions()
            edit, at = head[-1][at], at + 1
            if edit == "K":
                turn(role, text)
                state = KEPT[role[0]][state]
            elif edit == "R":
                turn("assistant" if state == 2 else "user", text)
                state = MADE[state]
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if head is not None:
        done()
    if out:
        yield batch_of(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) with the faults dealt by crc32('conv_id:turn') % 20; dropped rows have copy 0."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(0))).when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))


def repair(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text, copy; copy 0: no row, only its conversation) with counts of faults, cost, audit and repaired_sha256."""
    spark = rows.sparkSession
    bounded_batches(spark)
    parts = n_parts(spark)
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    slim = rows.select("conv_id", "turn", digest.alias("digest"), "copy", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), (F.col("copy") == 0).alias("dropped"))
    order = [F.asc_nulls_first("turn"), "digest", "copy"]
    again = F.row_number().over(Window.partitionBy("conv_id", "digest", "dropped").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    slim = slim.repartition(parts, "conv_id").withColumn("again", again).select("conv_id", "turn", "digest", "copy", "initial", fault.alias("fault"), "dropped").sortWithinPartitions("conv_id", *order)
    decided = slim.mapInArrow(_decide, DECIDED)
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = decided.select(F.lit(False).alias("is_row"), nothing("turn", "long"), nothing("digest", "binary"), nothing("copy", "int"), nothing("role", "string"), nothing("text", "string"), *[x.split()[0] for x in DECIDED.split(", ")])
    texts = rows.filter("copy > 0").select(F.lit(True).alias("is_row"), "turn", digest.alias("digest"), "copy", "role", "text", *[F.col("conv_id") if x.startswith("conv_id") else nothing(*x.split()) for x in DECIDED.split(", ")])
    both = heads.unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "is_row", *order)
    return both.mapInArrow(_repaired, f"{DECIDED}, repaired_sha256 string")
