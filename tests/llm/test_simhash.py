"""SimHash near copies against a plain version over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from skytrace.llm import simhash

RND = random.Random(11)
WORDS = [f"{a}{b}" for a in ("la", "On", "ther", "É", "qu") for b in ("ing", "tion", "s", "o", "漢")]


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """Rows (id, text) to (id, hex, component); rows of one id and prints within 3 bits are tied."""
    prints = [slow_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    live = [i for i, (d, _) in enumerate(rows) if d is not None]
    for i in live:
        for j in live:
            if j < i and ((prints[i] ^ prints[j]).bit_count() <= 3 or rows[i][0] == rows[j][0]):
                comp[root(i)] = root(j)
    least = {}
    for i in live:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((d, f"{p:016x}", least[root(i)] if d is not None else None) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 24])
def test_near_copies_equal_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    base = [prose(n) for n in (60, 300, 900, 4000)]
    texts = [*base, base[1], base[1].upper(), None, "", " \n", "one", "One Two", "one\x0btwo three", "a" * 3000]
    for b in [*base[1:], base[3], base[3]]:
        for _ in range(14):
            words = b.split()
            for _ in range(RND.choice([1, 1, 2, 5])):
                words[RND.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[2]), (None, None), (1, base[0] + " more"), (-5, base[3])]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, print string, mask long, key long, rep long")
    got = sorted(map(tuple, simhash.near_copies(df).collect()), key=str)
    assert got == slow_components(rows)
    assert simhash.near_copies(df.filter("false")).collect() == []


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 24])
def test_links_tie_all_prints_within_reach(spark, monkeypatch, bucket):
    """Clusters of prints a few bits apart, more of them than fit a bucket."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(2)
    prints = set()
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(40):
            prints.add(at ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 4, 6]))))
    prints = sorted(prints)
    leads = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(prints)], "print long, rep long")
    comp = list(range(len(prints)))
    for r in simhash.links_of(leads).collect():
        assert (prints[r["a"]] ^ prints[r["b"]]).bit_count() <= 3
        old, new = comp[r["a"]], comp[r["b"]]
        comp = [new if c == old else c for c in comp]
    for i, p in enumerate(prints):
        for j in range(i):
            assert (p ^ prints[j]).bit_count() > 3 or comp[i] == comp[j]


def test_blocks_cover_the_bits_left():
    left = (1 << 64) - 1
    while left.bit_count() > 11:
        own = simhash.blocks(left)
        assert sum(own) == left and all(own)
        left &= ~own[0]
    assert 1 << left.bit_count() <= simhash.BUCKET
