"""Operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.llm import bpe, cotrain, jaccard, kmtree, licenses, maxscore, mixing, ppm, suffixes, tokens
from skytrace.llm.queries import TOKENIZERS

RND = random.Random(5)
WORDS = [f"{a}{b}" for a in ("la", "on", "ther", "é", "qu") for b in ("ing", "tion", "s", "o", "漢")]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(n) for n in (80, 120, 200, 60)]
    near = base[2].split()
    near[50] = "changed"
    texts = [*base, base[0], base[0], " ".join(near), None, "", "one two", "one  two", "one\ntwo three", "a" * 1500, prose(40) + " " + base[1] + " " + prose(30), prose(3000), "GNU General Public License, cc-by CC BY the MIT License Apache License"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def empty(docs):
    return docs.filter("false")


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:120] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [], 1), (1040, [float("nan")] + [0.0] * 7, 1), (1060, [0.0] * 8, 1), (1080, [1.0, None] + [0.0] * 6, 1)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_maxscore_is_exact(spark):
    x, df = vectors(spark)
    x = np.vstack([x, np.zeros((1, 8))])
    ids = np.array([*range(400), 1060])
    q = np.floor(x * 1024).astype(np.int64)
    got = collections.defaultdict(list)
    for r in maxscore.maxscore_topk(df, F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in np.flatnonzero(ids % 20 == 0):
        s = q @ q[i]
        want = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if j != i][:10]
        assert got[int(ids[i])] == want
    assert maxscore.maxscore_topk(empty(df), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [3, 1 << 20, 1 << 28, 1 << 29])
def test_maxscore_keeps_every_candidate_that_may_compete(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        lists = rng.integers(-size, size, (6, 200))
        q = rng.integers(-size, size, 6)
        lists[:, 50:60] = lists[:, :1]
        true = q @ lists
        bound = int(np.sort(true)[-10])
        own = (q, lists) if size > 1 << 22 else (q.astype(float), lists.astype(float))
        at, score = maxscore.search_shard(*own, own[1].min(axis=1), own[1].max(axis=1), float(bound), probe=2)
        found = dict(zip(at.tolist(), score.tolist(), strict=True))
        assert all(found.get(int(i)) == true[i] for i in np.flatnonzero(true >= bound))


def test_maxscore_of_large_values_other_lengths_and_repeated_rows(spark):
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(120, 6)) * 2**26)
    x[60:70] = x[60]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (200, [1.0, 2.0]), (201, [3.0, 4.0]), (202, [3.0, 4.0])]
    got = collections.defaultdict(list)
    for r in maxscore.maxscore_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 10, 1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = [(i, np.array(v, np.int64)) for i, v in rows]
    for i, v in q:
        if i % 20 == 0:
            assert got[i] == [(j, -s) for s, j in sorted((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v))[:10]]


def test_shards_are_dealt_evenly():
    import pyarrow as pa

    batch = lambda a: pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.array([[1.0]] * 10_000)], ["id", "vec"])
    groups = [g for b in maxscore._packer(4096, 1.0, 64)(batch(10_000 * k) for k in range(40)) for g in b.column("g").to_pylist()]
    assert len(set(groups)) > 45


def test_frequent_words_have_a_bound(spark):
    flat = spark.createDataFrame([(1,)] * 30 + [(5,)] * 3, "n long")
    assert (ppm._limit(flat, "n", 10), ppm._limit(flat, "n", 2), ppm._limit(flat, "n", 100), ppm._limit(flat.filter("n = 1"), "n", 10), ppm._limit(flat.filter("n > 9"), "n", 1)) == (4, 8, 1, 2, 1)


def test_rows_without_an_id_take_no_part_in_searches(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    more = df.union(spark.createDataFrame([(None, [99.0, 99.0]), (None, None)], df.schema))
    for search in (lambda d: maxscore.maxscore_topk(d, F.col("id") % 20 == 0, 5), lambda d: kmtree.tree_search(d, F.col("id") % 20 == 0, 5, recall=1.0)):
        assert sorted(map(tuple, search(more).collect())) == sorted(map(tuple, search(df).collect()))


def test_tree_search_recall(spark):
    x, df = vectors(spark)
    hits, n = 0, 0
    got = collections.defaultdict(list)
    for r in kmtree.tree_search(df, F.col("id") % 20 == 0, 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 400, 20):
        s = x @ x[i]
        s[i] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        assert all(abs(v - s[j]) < 1e-9 for _, j, v in got[i])
        hits, n = hits + len(set(want.tolist()) & {j for _, j, _ in got[i]}), n + 20
    assert hits >= 0.9 * n and 1060 not in got
    assert kmtree.tree_search(empty(df), F.col("id") % 20 == 0).count() == 0


def test_tree_search_beyond_its_sample(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in kmtree.tree_search(df, F.col("id") % 20 == 0, 20, sample_rows=1500).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(0, 6000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.lexsort((np.arange(6000), -s))[:20].tolist()) & got[i])
    assert set(map(len, got.values())) == {20} and len(got) == 300 and hits >= 0.9 * 20 * 300


def test_tree_search_of_ties_repeated_rows_and_other_lengths(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(7, [1.0, 1.0])] * 2 + [(i, [1.0, 2.0, 3.0]) for i in (100, 101, 120)] + [(140, [2.0] * 5)]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, leaf int")
    got = collections.defaultdict(list)
    for r in kmtree.tree_search(df, F.col("id") % 20 == 0, 40, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vec = [np.array(v) for _, v in rows]
    for q in (0, 20, 100, 120):
        own = vec[[i for i, _ in rows].index(q)]
        want = sorted((-float(own @ v), i) for (i, _), v in zip(rows, vec, strict=True) if i != q and len(v) == len(own))
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert 140 not in got


@pytest.mark.parametrize("run", [lambda d: tokens.count_tokens(d, f"{TOKENIZERS}/piece_bpe_32k.model"), licenses.scan_licenses, lambda d: bpe.bpe_round_trip(d, f"{TOKENIZERS}/word_bpe_49k.json")])
def test_by_document_operators_of_empty_tables_and_repeated_rows(docs, run):
    assert run(empty(docs)).count() == 0
    more = docs.select("doc_id", "text", "lang").filter("doc_id < 10")
    more = more.union(more).union(docs.sparkSession.createDataFrame([(None, "the MIT license", "x"), (None, None, None)], more.schema))
    got = collections.Counter(tuple(map(str, r)) for r in run(more).collect())
    assert sum(got.values()) == 22 and sum(n for r, n in got.items() if r[0] != "None") == 20 and all(n % 2 == 0 for r, n in got.items() if r[0] != "None")


def test_token_counts(docs):
    from tokenizers import Tokenizer, models, normalizers

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    t = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + tokens.load_vocabulary(path), unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tokens.count_tokens(docs, path).collect():
        assert r["n_tokens"] == (len(t.encode(text[r["doc_id"]]).ids) if text[r["doc_id"]] else 0)


def test_license_scan(docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    r = got[15]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (13, 5, 0, 11, "apache,cc-by,gpl,mit")
    assert got[7]["n_words"] == 0 and got[7]["first_word"] is None and got[7]["labels"] == "" and got[8]["score"] == 0


LICENCE_TEXTS = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: GPL-2.0-or-later", "// SPDX-Licence-Identifier: MIT",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + "x " * 50 + "Neither the name of", "see CC-BY-SA 4.0 and the GNU Lesser General Public License v2.1",
    "gnu general public license version 3 or any later version", "The MIT License apache license cc by", "gnu\tgpl; Mozilla Public License, v. 2.0 " * 3, "word " * 2000 + "cc by " * 700, "no lic here", "ac cc\u00e9 by", "permission redistribution gnu", "CC BY\x00CC-BY", "  ", "licensed under the mit license agreement",
]


def brute_licences(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    line, found = " " + " ".join(words) + " ", []
    for label, _, priority, _, regex in licenses.rules():
        for m in re.finditer(regex, line):
            first = line.count(" ", 0, m.start())
            found.append((first, -first - m[0].count(" "), -priority, label))
    kept = []
    for first, until, rank, label in sorted(found):
        if not kept or first >= kept[-1][1]:
            kept.append((first, -until, rank, label))
        elif -until > kept[-1][1] and rank < kept[-1][2]:
            kept[-1] = (first, -until, rank, label)
    names = {label for _, label in base}
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(names)), ",".join(sorted(names | {x[3] for x in kept})), max([-x[2] / 100 for x in kept], default=0.0)


def test_license_scan_against_brute_force(spark):
    rnd = random.Random(3)
    pieces = [r for t in LICENCE_TEXTS for r in (t, t.upper())] + ["GNU General Public License", "version 2", "or later", "MIT", "license", "cc-by", "licensed under the", "public domain", "Creative Commons Attribution"]
    texts = LICENCE_TEXTS + [rnd.choice((" ", "\n* ", ", ")).join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 6))) for _ in range(60)] + [None, "", "MIT License", "MIT License"]
    df = spark.createDataFrame([(i // 2, t, "x", 1, 2.0) for i, t in enumerate(texts)] + [(None, "gnu gpl", "x", 1, 2.0)], "doc_id long, text string, line string, found int, score double")
    got = sorted((str(r["doc_id"]), *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]) for r in licenses.scan_licenses(df).collect())
    want = sorted((str(i // 2), *brute_licences(t)) for i, t in enumerate(texts))
    assert sorted(map(str, got)) == sorted(map(str, [*want, ("None", *brute_licences("gnu gpl"))]))
    assert licenses.scan_licenses(df.filter("false")).count() == 0


def test_license_rules_hold_their_keyword():
    from skytrace.llm.license_rules import signatures

    own = signatures()
    assert len(own) > 200 and len({x[3] for x in own}) == len(own)
    assert {brute_licences(t)[5] for t in LICENCE_TEXTS[:4]} == {"mit", "apache,apache-2.0", "gpl-2.0-or-later"} and brute_licences(LICENCE_TEXTS[4])[5] == "bsd-3-clause"


@pytest.mark.parametrize("many", [2, 2000])
def test_suffix_repeats(docs, many, monkeypatch):
    monkeypatch.setattr(suffixes, "RUNS_AT_ONCE", many)
    seen = set()
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, digest=True).collect()}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.remove_repeats(empty(docs)).count() == 0


def test_suffix_repeats_of_repeated_and_null_ids(spark):
    """Rows of one id are one document, each with its own text; a null id comes first; clashing columns don't matter."""
    a, b = prose(60), prose(60)
    rows = [(5, a + " x", 1), (5, b, 2), (5, b, 2), (None, prose(20) + b, 3), (9, "z" + a, 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(df, digest=True).collect()]
    size = lambda t: len(t.encode())
    assert sorted(got, key=str) == sorted([(5, size(a) + 2, 0), (5, size(b), size(b)), (5, size(b), size(b)), (None, size(rows[3][1]), 0), (9, size(a) + 1, size(a)), (9, 0, 0)], key=str)


def test_multikey_quicksort_orders_by_shallow_keys():
    rng = np.random.default_rng(9)
    for n, high in ((1, 3), (2, 2), (500, 2), (500, 256)):
        rows = rng.integers(0, high, (n, 104)).astype(np.uint8)
        rows[: n // 2, :10] = 1
        group = rng.integers(0, 4, n)
        order, segment = suffixes.multikey_quicksort(group, rows)
        keyed = [(group[i], rows[i, : suffixes.SHALLOW].tobytes()) for i in order]
        assert keyed == sorted(keyed) and sorted(order.tolist()) == list(range(n))
        assert all((x == y) == (s == t) for x, y, s, t in zip(keyed, keyed[1:], segment, segment[1:], strict=False))


def test_deep_shallow_order():
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.integers(0, 3, (40, 104)).astype(np.uint8), 3, axis=0)
    rows[:60, :90] = rows[0, :90]
    group = rng.integers(0, 3, len(rows))
    order, lcp = suffixes.deep_shallow(group, rows)
    keyed = [(group[i], rows[i].tobytes()) for i in order]
    assert keyed == sorted(keyed) and sorted(order.tolist()) == list(range(len(rows)))
    for (a, x), (b, y), n in zip(keyed[:-1], keyed[1:], lcp[1:], strict=True):
        assert n == (next((i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), 104) if a == b else -1)


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.bpe_round_trip(docs, f"{TOKENIZERS}/word_bpe_49k.json").collect():
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)


def brute_mix(rows, weights=(1, 2, 3), cap=3.0, tilt=mixing.TILT):
    """{row number: copies} of (id, source, size) rows."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    w, goal, left, open_ = {s: weights[i % len(weights)] for i, s in enumerate(names)}, {}, float(sum(size.values())), list(names)
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = [s for s in open_ if cap * size[s] <= level * w[s]]
        if not full:
            break
        for s in full:
            goal[s] = cap * size[s]
            left -= goal[s]
            open_.remove(s)
    goal |= {s: level * w[s] for s in open_}
    out = {}
    for s in names:
        own = [(k, i, n) for k, (i, x, n) in enumerate(rows) if x == s]
        merit = {k: 2 ** (tilt * ((n + 1).bit_length() - 1)) for k, _, n in own}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(cap, mid * merit[k]) * n for k, _, n in own) < goal[s] else (lo, mid)
        rate = {k: min(cap, hi * merit[k]) for k in merit}
        out |= {k: int(r + 1e-9) for k, r in rate.items()}
        need = goal[s] - sum(out[k] * n for k, _, n in own)
        ranked = []
        for k, i, n in own:
            p = rate[k] - out[k]
            if p > 1e-9:
                u = (int(hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                ranked.append((u / (1 - u) * (1 - p) / p, i, n, k))
        so_far = 0
        for _, _, n, k in sorted(ranked, key=lambda x: (x[0], x[1])):
            if so_far + n / 2 > need:
                break
            so_far += n
            out[k] += 1
    return out, goal


@pytest.mark.parametrize("sources", [("b", "a", None), ("only",), ("tiny", "a", "b")])
def test_mixing_takes_the_ranked_documents(spark, sources):
    rows = [(i, sources[i % len(sources)] if i > 60 else sources[-1], RND.choice([0, 1, 2, 3, 50, RND.randint(0, 400)]) if sources[i % len(sources)] != "tiny" else 1) for i in range(1500)]
    df = spark.createDataFrame([(i, "w " * n, s, "x", 1.0, 2) for i, s, n in rows], "doc_id long, text string, source string, target string, mix_p double, level int")
    got = mixing.mix(df).withColumn("size", mixing.word_count("text")).collect()
    want, goal = brute_mix(rows)
    assert {r["doc_id"]: r["copies"] for r in got} == {rows[k][0]: c for k, c in want.items()}
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-6 for r in got) and max(r["copies"] for r in got) <= 3 and {"mix_p", "level"} < set(got[0].asDict())
    for s in set(sources):
        assert abs(sum(r["copies"] * r["size"] for r in got if r["source"] == s) - goal[s]) <= 400
    again = mixing.mix(df.repartition(7)).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}


def test_mixing_of_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b", None), (None, None, "s"), (1, "a b c", "s"), (1, "a b c", "s"), (2, "", None)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(r["copies"] is not None and 0 <= r["copies"] <= 3 for r in got)
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) == 1 and mixing.mix(empty(df)).count() == 0


def test_mixing_prefers_by_probability(spark):
    """Over many seeds documents of a level are taken about as often as their probability says."""
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", (1, 60)[i % 4 // 2]) for i in range(400)], "doc_id long, source string, size long").cache()
    p = {(r["source"], r["level"]): r["sure"] + r["p"] for r in mixing.rates(df.select("source", "size"), (1, 2), 3.0, 0.5, 0.5).collect()}
    taken = collections.Counter()
    for seed in range(6):
        for r in mixing.mix(df, (1, 2), total=0.5, tilt=0.5, seed=str(seed), size_col="size").collect():
            taken[r["source"], (r["size"] + 1).bit_length() - 1] += r["copies"] / 600
    assert len(set(p.values())) == 4 and all(abs(taken[k] - x) < 0.12 for k, x in p.items())


def test_classifier_separates_and_survives_no_labels(spark, docs):
    good = [(i, prose(60), "en", "s", 300) for i in range(200)]
    bad = [(1000 + i, prose(60).upper().replace(" ", "!! "), "en", "t", 300) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = df.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    got = cotrain.classify(df, labels).collect()
    assert all(r["keep"] == (r["doc_id"] < 1000) for r in got)
    none = cotrain.classify(docs, labels.filter("false")).collect()
    assert len(none) == docs.count() and all(r["keep"] for r in none)


def layered(rnd):
    """Good and bad documents, of which some show it in their words, some in their lines and some in both."""
    rows = []
    for i in range(420):
        bad, how = i % 3 == 0, rnd.choice(["words", "lines", "both"])
        words = prose(40)
        if bad and how != "lines":
            words = " ".join(w + rnd.choice(["###", "$$$", ""]) for w in words.split())
        own = words.split()
        lines = [" ".join(own[k : k + 8]) for k in range(0, 40, 8)]
        if bad and how != "words":
            lines = lines[:2] * 4
        rows.append((i, "\n".join(lines), rnd.choice(["en", None]), f"s{i % 4}", len(words), int(not bad)))
    return rows


def test_views_teach_each_other_from_all_documents_without_label(spark, monkeypatch):
    """Against a plain version that holds all documents; the table has clashing columns, repeated rows and null ids."""
    monkeypatch.setattr(cotrain, "TAUGHT", 9)
    rows = layered(random.Random(9))
    rows += [rows[1], rows[2], (None, rows[0][1], None, None, None, 0), (None, None, None, None, None, 1), (1000, "", "en", "s", 0, 1)]
    df = spark.createDataFrame([(*r[:5], 0.5, 1.0, True, r[5], b"x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, m0 double, keep boolean, quality int, tx binary")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:420] if r[0] % 4 == 1] + [(2, None), (2, 7), (None, 1)], "doc_id long, quality int")
    known = {r[0] for r in rows[:420] if r[0] % 4 == 1}
    f32 = lambda x: x.astype(np.float32).astype(float)
    texts = [(r[1] or "").encode() for r in rows]
    x = (f32(cotrain.text_features(texts)), f32(cotrain.meta_features(texts, [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])))
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).collect()}
    order = [i for i in sorted(range(len(rows)), key=lambda i: (hashes[rows[i][0]], rows[i][0] or -1)) if rows[i][0] in known]
    y = np.array([rows[i][5] for i in order], float)
    held = np.arange(len(y)) % 4 == 0
    views, pool = [v[order] for v in x], [i for i, r in enumerate(rows[:420] + rows[-1:]) if r[0] not in known]
    pool = [i if i < 420 else len(rows) - 1 for i in pool]
    models, learned = [cotrain.fit_logistic(v[~held], y[~held]) for v in views], [{}, {}]
    for _ in range(cotrain.ROUNDS):
        given = [{}, {}]
        for v in (0, 1):
            good, bad = cotrain.bounds(views[v][~held], y[~held])
            m = {i: float(cotrain.decide(x[v][i : i + 1], models[v])[0]) for i in pool if i not in learned[1 - v]}
            key = lambda i, s: (-s * m[i], hashes[rows[i][0]])  # noqa: B023, E731
            for i in sorted((i for i in m if m[i] <= bad), key=lambda i: key(i, -1))[: cotrain.TAUGHT]:
                given[1 - v][i] = 0.0
            for i in sorted((i for i in m if m[i] >= good), key=lambda i: key(i, 1))[: cotrain.TAUGHT]:
                given[1 - v][i] = 1.0
        for v in (0, 1):
            learned[v].update(given[v])
            t = np.array(list(learned[v].values()))
            models[v] = cotrain.fit_logistic(np.vstack([views[v][~held], x[v][list(learned[v])]]), np.append(y[~held], t), np.append(np.ones((~held).sum()), np.full(len(t), 0.5)))
    model = cotrain.train(df, labels)
    assert model["taught"] == [len(t) for t in learned] and min(model["taught"]) >= 2 * cotrain.TAUGHT
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(model["models"], models, strict=True))
    got = cotrain.classify(df, labels).collect()
    right = {r[0]: r[5] for r in rows}
    assert len(got) == len(rows) and all(r["keep"] for r in got if r["doc_id"] is not None and right[r["doc_id"]])
    assert sum(not r["keep"] for r in got) >= 120
    kept = cotrain.good_documents(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)


def test_near_copies(docs):
    import re

    sets, ids = {}, []
    for r in docs.collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "").encode().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        ids.append(r["doc_id"])
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}
    assert jaccard.near_copies(empty(docs)).count() == 0


def test_absorbed_links_equal_whole_components(spark):
    from skytrace.llm import components

    for _ in range(1):
        old, new = ([(RND.randrange(60), RND.randrange(60)) for _ in range(n)] for n in (25, 15))
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        first = components.connected(frame(old))
        got = {(r["id"], r["comp"]) for r in components.absorb(first, frame(new)).collect()}
        whole = {(r["id"], r["comp"]) for r in components.connected(frame(old + new)).collect()}
        linked = {i for pair in old + new for i in pair if pair[0] != pair[1]}
        assert got == whole and {i for i, _ in got} == linked


def brute_components(rows):
    """{id: component} of (id, text) rows: rows with one id are one node."""
    import re

    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    comp = {i: i for i, _ in sets if i is not None}
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and a != b and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in comp:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def near_copy_rows(rnd):
    """Groups of near copies of several distances, a hot one among them, passages that many share, repeated and null ids."""
    rows, words = [], [f"w{i}" for i in range(3000)]
    shared = [rnd.choice(words) for _ in range(40)]
    for group, size in ((0, 70), (1, 12), (2, 9), (3, 2)):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 140))] + shared * (group % 2)
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randrange(0, 6)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append(" ".join(own[rnd.randrange(0, 4) :]))
    rows += [" ".join([*(rnd.choice(words) for _ in range(rnd.randrange(3, 60))), *shared]) for _ in range(40)]
    rnd.shuffle(rows)
    rows = [(100 + i, t) for i, t in enumerate(rows)]
    return rows + [(7, rows[0][1]), (7, rows[9][1]), (None, rows[3][1]), (None, "alone"), (8, None), (8, "a b"), (9, ""), (10, "a  b"), rows[5], rows[5]]


@pytest.mark.parametrize("bounds", [{}, {"PIECE_DOCS": 8, "ROUND_PIVOTS": 5, "CELLS": 4, "FEW": 3, "BROADCAST_IDS": 10}])
def test_near_copies_of_hot_groups(spark, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copy_rows(random.Random(11))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, comp long")
    want = brute_components(rows)
    got = jaccard.near_copies(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_region_join_links_every_component():
    from skytrace.llm import regions

    rng = np.random.default_rng(3)
    for _ in range(6):
        base = [rng.choice(5000, rng.integers(3, 60), replace=False) for _ in range(6)]
        sets = [np.unique(np.where(rng.random(len(b)) < rng.choice([0, 0.05, 0.1, 0.2]), rng.integers(0, 5000, len(b)), b)).astype(np.uint64) for b in base for _ in range(rng.integers(1, 15))]
        region = regions.Region(np.arange(len(sets)), np.arange(len(sets)), sets)
        region.join(rng.permutation(len(sets)))
        comp = np.arange(len(sets))
        for _ in sets:
            for i, x in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(x, sets[j]))
                    if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                        comp[i] = comp[j] = min(comp[i], comp[j])
        assert len(np.unique(np.stack([comp, region.comp]), axis=1).T) == len(np.unique(comp)) == len(np.unique(region.comp))
        # the coarser metric keeps whoever is linked, and leaves out most of the others
        spread = [(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
        spread = [np.sort(s) for s in spread]
        alone = [np.sort(rng.integers(0, 1 << 64, rng.integers(40, 300), dtype=np.uint64)) for _ in range(30)]
        every = spread + alone
        ok = jaccard.with_partner(np.array([len(s) for s in every]), [jaccard.bins(s) for s in every])
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                assert 100 * both < 80 * (len(x) + len(sets[j]) - both) or (ok[i] and ok[j])
        assert ok[len(sets) :].sum() <= 15


def test_frequent_shingles_show_over_all_documents(spark):
    """A passage that each task meets once is as frequent as one that a single task meets all the time."""
    passage, rnd = [f"p{i}" for i in range(9)], random.Random(4)
    df = spark.createDataFrame([(" ".join([*(f"w{rnd.randrange(10**6)}" for _ in range(20)), *passage]),) for _ in range(40)], "text string")
    from skytrace.llm.shingles import shingle_sets

    at = (shingle_sets([" ".join(passage).encode()])[0] >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64)
    spread, alone = jaccard._frequent(df.repartition(40)), jaccard._frequent(df.coalesce(1))
    assert (spread[at] > 0).all() and (spread == alone).all() and (spread > 0).sum() == len(set(at.tolist()))


def test_bins_are_compared_in_regions_of_several_pieces(spark, monkeypatch):
    """Members without a partner leave a region that is too large for a task of the exact join."""
    monkeypatch.setattr(jaccard, "PIECE_DOCS", 8)
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 64, 100, dtype=np.uint64)) for _ in range(30)]
    sets.append(np.sort(np.append(sets[4][:-5], rng.integers(0, 1 << 64, 5, dtype=np.uint64))))
    regions = spark.createDataFrame([(0, i, 100, 1) for i in range(31)], "r long, doc long, n long, weight long")
    bins_of = spark.createDataFrame([(i, 100, bytearray(jaccard.bins(s))) for i, s in enumerate(sets)], "doc long, of long, bins binary")
    assert {r["doc"] for r in jaccard._excluded(regions, bins_of).collect()} == {4, 30}


def test_sets_travel_in_waves(spark, monkeypatch):
    """However many regions documents are in, one wave shuffles about a share of all hashes; the components stay the same."""
    rows = near_copy_rows(random.Random(12))
    plain, joins = jaccard.materialize, []

    def noted(df, name):
        joins.append(name)
        return plain(df, name)

    for name, value in {"WAVE_LEAST": 3000, "WAVE_SHARE": 0.05, "PIECE_DOCS": 8, "ROUND_PIVOTS": 5, "CELLS": 4}.items():
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "materialize", noted)
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and joins.index("components") - joins.index("round") > 3  # waves of the first round
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_components(rows)
