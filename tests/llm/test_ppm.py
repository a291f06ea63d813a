"""Language-model scores against a plain dictionary version that shares nothing with the operator."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skytrace.llm import ppm

ORDER = 5
SCHEMA = "doc_id long, text string, g long, n long, piece int, w string, held_out string, row long"


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


class Slow:
    """Prediction by partial matching with escape method C, exclusion, and contexts of up to five bytes; line feeds stand before a text, a zero byte ends it."""

    def __init__(self, texts):
        self.counts, self.n, self.next, self.known = Counter(), Counter(), defaultdict(list), {}
        for t in texts:
            s = b"\n" * ORDER + t + b"\0"
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.counts[s[i - k : i + 1]] += 1
        for gram, c in self.counts.items():
            self.n[gram[:-1]] += c
            self.next[gram[:-1]].append(gram[-1])

    def chance(self, gram):
        if not gram:
            return 1 / 256
        if gram not in self.known:
            ctx, shorter = gram[:-1], gram[1:]
            below = lambda b: self.chance(ctx[1:] + bytes([b]) if ctx else b"")
            lower = self.chance(shorter)
            if not self.n[ctx]:
                p = lower
            else:
                n, d = self.n[ctx], len(self.next[ctx])
                free = 1 - sum(below(b) for b in self.next[ctx])
                if gram in self.counts:
                    p = self.counts[gram] / (n if free < 1e-9 else n + d)
                else:
                    p = d / (n + d) / max(free, 1e-9) * lower
            self.known[gram] = p
        return self.known[gram]

    def score(self, t):
        s = b"\n" * ORDER + t + b"\0"
        return sum(math.log10(self.chance(s[i - ORDER : i + 1])) for i in range(ORDER, len(s)))


def wanted(rows):
    out_of = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    training = [lowered(t) for (_, t), out in zip(rows, out_of, strict=True) if not out]
    model, words = Slow(training), Counter(w for t in training for w in t.split())
    ends = len(training)
    total, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    want = []
    for (i, t), out in zip(rows, out_of, strict=True):
        own = lowered(t).split()
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in own) + math.log10((ends + 1) / (total + distinct + 1))
        want.append((i, out, len(own) + 1, sum(w in words for w in own) + (ends > 0), total, base, model.score(lowered(t)), len((t or "").encode())))
    return want


def compared(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4) for r in rows], SCHEMA)
    got = [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")) for r in ppm.score_documents(df).collect()]
    key = lambda r: (str(r[0]), r[7], round(r[6], 4))
    got, want = sorted(got, key=key), sorted(wanted(rows), key=key)
    assert [(*r[:5], r[7]) for r in got] == [(*r[:5], r[7]) for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) < 1e-7 * w[2] and abs(g[6] - w[6]) < 1e-7 * (w[7] + 1)
    return got


@pytest.mark.parametrize("bounds", [{}, {"PIECE": 500, "LARGEST": 900, "AT_ONCE": 300, "FREQUENT": 5, "GRAMS_HELD": 1000, "WORDS_HELD": 20}])
def test_scores_equal_a_plain_version(spark, monkeypatch, bounds):
    """Also where pieces are many more than partitions, and with clashing columns."""
    for name, value in bounds.items():
        monkeypatch.setattr(ppm, name, value)
    rnd = random.Random(3)
    words = ["The", "the", "of", "ÉTÉ", "漢字", "a", "on,", "tion", "ther"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 60])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "nul\0byte"), (104, "a" * 2000), (None, "the of a"), (None, None), rows[3], rows[3], (7, "another text of the id")]
    assert any(r[1] for r in compared(spark, rows))


def test_scores_without_training_documents_or_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    got = compared(spark, [(i, "some words, " * i) for i in held])
    assert all(abs(r[6] + (r[7] + 1) * math.log10(256)) < 1e-6 * (r[7] + 1) and r[3:5] == (0, 0) for r in got)
    assert ppm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_gram_counts(spark):
    """Over 420,000 grams of a depth: no bound falls on them."""
    rnd = random.Random(5)
    rows = [(900 + i, "".join(chr(97 + int(26 * rnd.random())) for _ in range(45_000))) for i in range(12)]
    assert len({t[j : j + 6] for _, t in rows for j in range(len(t))}) > 420_000
    compared(spark, rows)


def test_pieces_are_bounded_at_any_size(spark):
    """Each partition gets as many pieces as another, and no piece more than its share of the bytes."""
    for n in (1, 4, 5, 23):
        keys = ppm._spread(spark, 4, n)
        assert len(keys) == n == len(set(keys))
        places = Counter(r["p"] for r in spark.createDataFrame([(k,) for k in keys], "id long").select(F.pmod(F.hash("id"), F.lit(4)).alias("p")).collect())
        assert max(places.values()) <= -(-n // 4)
