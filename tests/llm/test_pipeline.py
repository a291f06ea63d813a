"""The five stages in a row against a brute-force version on a small table with nulls, copies and shared passages."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from skytrace.llm.queries import TOKENIZERS

RND = random.Random(11)
WORDS = [a + b for a in ("la", "on", "ther", "qu", "mi", "ste") for b in ("ing", "tion", "s", "o", "ra", "den")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def leads(docs):
    """The documents that are the smallest of their component, or have no words."""
    sets, comp = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: t for i, t in docs.items() if comp[i] == i}


def without_repeats(docs):
    """Texts without bytes covered by an earlier 100-byte string; emptied texts go."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        if not gone.any() or kept.strip():
            out[i] = kept
    return out


def test_stages_against_brute_force(spark, tmp_path):
    good = [prose(RND.randint(40, 90)) for _ in range(150)]
    near = good[3].split()
    near[20] = "changed"
    passage = prose(55)
    good += [good[0], good[0], " ".join(near), f"{prose(30)} {passage} {prose(30)}", f"{prose(25)} {passage} {prose(35)}"]
    bad = [prose(60).upper().replace(" ", "!! ") for _ in range(50)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t)) for i, t in enumerate(good)]
    rows += [(1000 + i, t, "en", "c", len(t)) for i, t in enumerate(bad)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 1000), 0) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want = without_repeats(leads({i: t for i, t, *_ in rows if i < 1000}))
    assert len(want) < len(good) and any(want[i] != t for i, t, *_ in rows if i in want)
    tokenizer, source = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json"), {i: s for i, _, _, s, _ in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= set(want) and max(copies.values()) <= 3
    for r in got:
        ids = tokenizer.encode(want[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    size, taken = {i: len(t.split()) for i, t in want.items()}, defaultdict(int)
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    for s, w in (("a", 1), ("b", 2), (None, 3)):
        assert abs(taken[s] - sum(size.values()) * w / 6) <= 2 * max(size.values())


def test_empty_table_and_nulls(spark, tmp_path):
    for name, rows in (("none", []), ("nulls", [(1, None, None, None, None), (2, "", "en", "a", 0), (None, prose(30), "en", "a", 9), (3, prose(8), None, "b", 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert got <= {r[0] for r in rows}


def test_quality_judges_each_row_by_itself(spark, tmp_path):
    """Without labels every row stays, also with a null id; with labels a rejected row goes though its id has a kept one."""
    schema = "doc_id long, quality int, toxic int"
    for name, labels in (("none", []), ("some", [(i, int(i < 1000), 0) for i in (*range(0, 120), *range(1000, 1060))])):
        spark.createDataFrame(labels, schema).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = [(i, prose(60), "en", "a", 400) for i in range(160)] + [(1000 + i, prose(60).upper().replace(" ", "!! "), "en", "c", 500) for i in range(80)]
    bad = prose(60).upper().replace(" ", "!! ")
    odd = [(None, prose(60), "en", "a", 400), (None, bad, "en", "c", 500), (7000, prose(60), "en", "a", 400), (7000, bad, "en", "c", 500)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    assert Counter(map(tuple, corpus_pipeline.quality(spark, docs, f"{tmp_path}/none").collect())) == Counter(rows + odd)
    got = Counter(map(tuple, corpus_pipeline.quality(spark, docs, f"{tmp_path}/some").collect()))
    assert [got[r] for r in odd] == [1, 0, 1, 0]


def test_null_id_row_survives_the_first_three_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(None, prose(30), "en", "a", 9), (3, prose(8), None, "b", 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == {None, 3}


def test_near_duplicates_in_waves(spark, monkeypatch):
    """The second stage keeps the same documents, whole rows, when the sets of its groups don't fit one wave."""
    from skytrace.llm import jaccard

    rnd, rows = random.Random(8), []
    for group in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        for _ in range(4):
            own = list(base)
            own[rnd.randrange(150)] = "other"
            rows.append((len(rows), " ".join(own), "en", f"s{group}", len(" ".join(own))))
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, value in {"WAVE_LEAST": 800, "WAVE_SHARE": 0.0}.items():
        monkeypatch.setattr(jaccard, name, value)
    names, plain = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: names.append(name) or plain(df, name))
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got)) == rows[::4] and names.count("round") > 3
