"""Prefix trie and structure repair against slow versions of their definitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skytrace.llm import prefixes, repair

SCHEMA = "conv_id long, turn long, role string, text string, source string, depth int, path binary, n long, ends string"


def frame(spark, rows):
    """With columns named like those the operators add."""
    return spark.createDataFrame([(*r, "x", 7, b"p", 9, "e") for r in rows], SCHEMA)


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def first_null(x):
    return (x is not None, x or 0)


def slow_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((first_null(turn), md5(role, text), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {p[:d]: [] for p in built.values() for d in range(len(p) + 1)}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        leaf = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in under), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def some_conversations(seed):
    rnd = random.Random(seed)
    said = ["", "yes.", "no", "two words here", "\n", None, "la\x0bla é漢"]
    rows = []
    for c in [*range(45), -3, -25, 400, 401, 1 << 40]:
        if rnd.random() < 0.15:
            continue
        n = rnd.choice([1, 1, 2, 3, 4, 6, 9])
        rows += [(c, None if rnd.random() < 0.1 else t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(said)) for t in range(n)]
    rows += [(60, t, "user", "long " * (t % 3)) for t in range(70)] + [(80, t, "user", "long " * (t % 3)) for t in range(64)]
    rows += [(c, t, "user", "the same.") for c in range(100, 140) for t in range(5)]
    rows += rows[:5] + [(None, 1, "user", "a"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("limit", [prefixes.GROUP_BYTES, 1000, 0])
def test_trie_is_that_of_the_definition_however_bands_are_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(prefixes, "GROUP_BYTES", limit)
    rows = some_conversations(3) if limit else some_conversations(3)[:90] + [(60, t, "user", "x") for t in range(5)]
    got = prefixes.prefix_nodes(prefixes.with_heads(prefixes.turn_lists(frame(spark, rows))))
    assert sorted(map(tuple, got.collect())) == slow_trie(rows)


def test_ids_in_pieces_hash_alike(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(-20, 40)] + [(c, 0, "user", "other") for c in range(100, 103)]
    got = prefixes.prefix_nodes(prefixes.turn_lists(frame(spark, rows))).collect()
    ids = ",".join(str(c) for c in range(-20, 40))
    assert {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in got}[-20, 1] == hashlib.sha256(ids.encode()).hexdigest()
    assert len(got) == 3


def test_trie_without_turns_or_rows(spark):
    assert prefixes.prefix_nodes(prefixes.with_heads(prefixes.turn_lists(frame(spark, [])))).collect() == []
    assert prefixes.prefix_nodes(prefixes.turn_lists(frame(spark, [(None, 1, "user", "x")]))).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its only turn goes, and there is no conversation 0
    (r,) = prefixes.prefix_nodes(prefixes.with_heads(prefixes.turn_lists(frame(spark, [(c, 0, "user", "x")])))).collect()
    assert tuple(r)[:7] == (c, 0, None, 1, 0, 1, 0) and r["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


# --- structure repair


def faults_of(rows):
    """(symbol, fault) of each row in order."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """(cost, audit, repaired) by search of all edit sequences."""
    faults = faults_of(rows)
    best = [None]

    def walk(i, cost, audit, out, made):
        if cost > (best[0] or [2 * len(rows)])[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in out)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            found = (cost, audit, out)
            best[0] = min(best[0] or found, found, key=lambda x: x[:2])
        if made < 2:
            for role in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*out, (role, "")], made + 1)
        if i < len(rows):
            role, text = rows[i]
            walk(i + 1, cost + 2, audit + "D", out, 0)
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                walk(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for to in ("user", "assistant"):
                    walk(i + 1, cost + more + 1, audit + "R", [*out, (to, text)], 0)

    walk(0, 0, "", [], 0)
    return best[0]


def slow_conversations(rows):
    damaged = {}
    for c, turn, role, text in rows:
        own = damaged.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(first_null(turn), md5(role, text), role, text, turn)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in damaged.items():
        own = sorted(own, key=lambda x: x[:2])
        pairs = [x[2:4] for x in own]
        faults = faults_of(pairs)
        turns = [x[4] for x in own if x[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, texts = slow_repair(pairs)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts).encode()).hexdigest()
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: first_null(r[0]))


def test_repair_is_the_cheapest_of_all(spark):
    rnd = random.Random(8)
    said = ["Well.", "so", "", " \n", "two\nlines!", None, "Why?", "漢。", "end. ", "x. \x0b"]
    rows = []
    for c in [*range(60), -4, 1 << 40]:
        for t in range(rnd.choice([1, 2, 3, 4, 5])):
            rows.append((c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), rnd.choice(said)))
    rows += rows[:3] + [(None, 1, "user", "Hm."), (None, None, None, None)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = sorted(map(tuple, repair.repair(repair.damaged(frame(spark, rows))).collect()), key=lambda r: first_null(r[0]))
    assert got == slow_conversations(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert repair.repair(repair.damaged(frame(spark, []))).collect() == []


def stepwise(symbols):
    """(cost, audit) row by row from the end, without runs."""
    best = {s: min([(5 * k, "I" * k) for k in range(3) if [(0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3)][s][k] in ((0, 3) if k == 0 else (3,))]) for s in range(4)}
    for x in reversed(symbols):
        delete, keep, rerole = repair.EDITS[x]
        plain = {s: min((cost + best[t][0], e + best[t][1]) for e, moves in (("D", delete), ("K", keep), ("R", rerole)) for at, (cost, t) in moves.items() if at == s) for s in range(4)}
        best = {}
        for s in range(4):
            ways, at = [plain[s]], s
            for k in (1, 2):
                at = repair.MADE[at]
                ways.append((5 * k + plain[at][0], "I" * k + plain[at][1]))
            best[s] = min(ways)
    return best[0]


@pytest.mark.parametrize("listed", [4096, 1, 5])
def test_runs_give_what_single_rows_give(monkeypatch, listed):
    monkeypatch.setattr(repair, "LISTED", listed)
    rnd = random.Random(listed)
    for _ in range(400):
        symbols = [s for s in rnd.choices(range(12), k=rnd.randint(0, 7)) for _ in range(rnd.choice([1, 1, 2, 5, 13]))]
        runs = tuple((s, len(list(own))) for s, own in itertools.groupby(symbols))
        assert repair.decide(runs) == stepwise(symbols)
    if listed == 4096:
        assert repair.decide(((3, 1_000_000),)) == (500_000, "KR" * 500_000)  # every second user turn becomes an assistant's
