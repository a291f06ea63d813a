"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view sees what is written: frequencies of byte values, hashed words and word pairs, repetition and length of
words. The metadata view sees the page about it: language, source and size columns, and the layout (how many lines there
are, how long and how different, and how many occur before), but no word or character. Both are logistic
regressions, fitted on at most ``LABELLED`` rows with labels, chosen by hash of the id. How far a view may be trusted is
measured on these rows by cross-fitting: it is sure beyond the margins where ``SURE`` of its judgements of a class are right.
In each round both views judge all documents without a label of 0 or 1, and of those it is sure of and the other
view hasn't learned yet, each gives the other its ``TAUGHT`` surest of a class. The views are calibrated and combined
by a logistic regression over their scores on a part of the labelled rows that no round has seen; the threshold
leaves all but ``LOST`` of the good rows of that part. All documents are then scored.

A round reads the texts twice, for the margins of all (only ids and two numbers are shuffled) and for the
features of the few rows that are taught.

Nulls: a null text is empty; a null language, source or size is a value of its own. Labels that are null are left
out. A row with a null id is judged like any other but teaches nothing; of rows that repeat an id one is taught. Without rows
of both classes every document has score 1 and is kept. Rows that repeat stay. An empty table gives
no rows. Texts of any length are read whole. Columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, slices, text_bytes
from .shingles import mix, word_hashes

#: Labelled rows that are fitted on at most; rounds; rows of a class that a view teaches the other in a round; share of good rows that may fall below the threshold.
LABELLED, ROUNDS, TAUGHT, LOST = 8_000, 3, 100, 0.0
#: Share of right judgements that makes a view sure; labelled rows it takes to tell.
SURE, TOLD_BY = 0.95, 10
#: Measures of a page's layout.
LAYOUT = 7
#: Bins of hashed languages and sources, of words and of word pairs; features of the two views; bytes of text hashed at once.
META_BINS, WORD_BINS, PAIR_BINS = 48, 192, 64
TEXT_SIZE, META_SIZE, SLICE = 261 + WORD_BINS + PAIR_BINS, META_BINS + 2 + LAYOUT, 1_000_000


def text_features(texts: list[bytes]) -> np.ndarray:
    """Per text: square roots of the byte frequencies, then word length, distinct words, repeated words, doubled words, emptiness, and square roots of the frequencies of hashed words and word pairs."""
    out = np.zeros((len(texts), TEXT_SIZE))
    words, owner = word_hashes(texts)
    pairs, first = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]), np.flatnonzero(owner[1:] == owner[:-1])
    for at, own, h, bins in ((261, owner, words, WORD_BINS), (261 + WORD_BINS, owner[first], pairs[first], PAIR_BINS)):
        n = np.bincount(own * bins + (h % np.uint64(bins)).astype(np.int64), minlength=len(texts) * bins).reshape(len(texts), bins)
        out[:, at : at + bins] = np.sqrt(n / np.maximum(1, n.sum(axis=1, keepdims=True)))
    for i, t in enumerate(texts):
        if not t:
            out[i, 260] = 1.0
            continue
        out[i, :256] = np.sqrt(np.bincount(np.frombuffer(t, np.uint8), minlength=256) / len(t))
        words = t.split()
        n = max(1, len(words))
        distinct = len(set(words))
        out[i, 256] = min(4.0, len(t) / n / 10)
        out[i, 257] = distinct / n
        out[i, 258] = (n - distinct) / n
        out[i, 259] = sum(map(bytes.__eq__, words[1:], words)) / n
    return out


def layout(text: bytes) -> list[float]:
    """Number of lines, their mean, longest and shortest length, how much they differ, shares of lines that occur before and of empty ones."""
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), float, len(lines))
    mean = sizes.mean()
    return [np.log1p(len(lines)) / 10, np.log1p(mean) / 10, np.log1p(sizes.max()) / 10, np.log1p(sizes.min()) / 10, sizes.std() / (1 + mean), 1 - len(set(lines)) / len(lines), (sizes == 0).mean()]


def meta_features(texts: list[bytes], langs: list, sources: list, sizes: list) -> np.ndarray:
    """Per row: hashed language and source, layout, the size column and whether it is null."""
    out = np.zeros((len(langs), META_SIZE))
    for i, (t, a, b, n) in enumerate(zip(texts, langs, sources, sizes, strict=True)):
        out[i, zlib.crc32(f"lang:{a}".encode()) % META_BINS] = 1.0
        out[i, zlib.crc32(f"source:{b}".encode()) % META_BINS] = 1.0
        out[i, META_BINS : META_BINS + LAYOUT] = layout(t)
        out[i, -2] = np.log1p(max(0, n or 0)) / 10
        out[i, -1] = n is None
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Weights and intercept by Newton steps; classes weigh alike."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(y)) if w is None else w
    for c in (0, 1):
        w = np.where(y == c, w / max(1e-12, w[y == c].sum()), w)
    beta, penalty = np.zeros(x1.shape[1]), ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x1 @ beta)
        h = (x1 * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + penalty
        step = np.linalg.solve(h, x1.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def decide(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def bounds(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(margin from which a view is sure of good rows, margin up to which of bad ones), from models of either half judging the other."""
    half, margin = np.arange(len(y)) % 2 == 0, np.empty(len(y))
    for own in (half, ~half):
        if len(np.unique(y[own])) < 2:
            return np.inf, -np.inf
        margin[~own] = decide(x[~own], fit_logistic(x[own], y[own]))

    def tail(m: np.ndarray, right: np.ndarray) -> float:
        order = np.argsort(-m, kind="stable")
        n = np.arange(1, len(m) + 1)
        sure = np.flatnonzero((np.cumsum(right[order]) >= SURE * n) & (n >= TOLD_BY))
        return float(m[order][sure[-1]]) if len(sure) else np.inf

    return tail(margin, y == 1), -tail(-margin, y == 0)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, surest) -> dict:
    """Both views' weights, the combination's weights and the threshold.

    ``surest(models, limits, known)`` gives for each view a list of (id, label, features of the other view) of the documents that it
    teaches; ``known`` are the ids that either view has learned.
    """
    seen = ~held
    taught: tuple[dict, dict] = ({}, {})  # id to (label, features), of what a view has learned
    models = [fit_logistic(v[seen], y[seen]) for v in views]
    limits = [bounds(v[seen], y[seen]) for v in views]
    for _ in range(ROUNDS):
        found = surest(models, limits, [set(t) for t in taught])
        for teacher, learner in ((0, 1), (1, 0)):
            taught[learner].update({key: (label, x) for key, label, x in found[teacher]})
        if not any(found):
            break
        for v, own in enumerate(taught):
            if own:
                x, t = np.vstack([views[v][seen], *[x for _, x in own.values()]]), np.append(y[seen], [label for label, _ in own.values()])
                models[v] = fit_logistic(x, t, np.append(np.ones(seen.sum()), np.full(len(own), 0.5)))
    both = np.column_stack([decide(v[held], m) for v, m in zip(views, models, strict=True)])
    scale = np.maximum(1e-9, np.abs(both).max(axis=0))
    join = fit_logistic(both / scale, y[held], ridge=1e-4)
    score = sigmoid(decide(both / scale, join))
    good = np.sort(score[y[held] == 1])
    bad = np.sort(score[y[held] == 0])[::-1]
    low = good[int(LOST * len(good))]
    below = bad[bad < low]
    limit = below[0] + (low - below[0]) / 4 if len(below) else low / 4  # nearer to the next bad row, for the good ones' sake
    return {"models": models, "scale": scale, "join": join, "limit": float(min(low, limit)), "taught": [len(t) for t in taught]}


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _arrays(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(got.num_rows, n).astype(float) for c, n in (("tx", TEXT_SIZE), ("mt", META_SIZE)))


def _pool(docs: DataFrame, marks: DataFrame):
    """The ``surest`` of :func:`co_train` over all documents without a label."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*COLUMNS).filter("doc_id is not null")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _rows(part, [part.column("doc_id")], ["doc_id"])

    def surest(models: list, limits: list, known: list) -> list:
        shared = spark.sparkContext.broadcast(models)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    m = [decide(v.astype(np.float32).astype(float), b) for v, b in zip(_views(part), shared.value, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, m)], ["doc_id", "m0", "m1"])

        judged = rows.mapInArrow(margins, f"doc_id {kind}, m0 double, m1 double")
        sure = [(F.col(f"m{v}") >= good) | (F.col(f"m{v}") <= bad) for v, (good, bad) in enumerate(limits)]
        judged = judged.filter(sure[0] | sure[1]).join(marks.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.max("m0").alias("m0"), F.max("m1").alias("m1"))
        judged = materialize(judged, "margins")
        lessons: list[dict] = [{}, {}]
        for v, (good, bad) in enumerate(limits):
            m, new = F.col(f"m{v}"), ~F.col("doc_id").isin(list(known[1 - v])) if known[1 - v] else F.lit(True)
            for label, ok, order in ((1.0, m >= good, F.desc(f"m{v}")), (0.0, m <= bad, F.asc(f"m{v}"))):
                for r in judged.filter(ok & new).orderBy(order, F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(TAUGHT).select("doc_id").collect():
                    lessons[v].setdefault(r[0], label)
        discard(judged)
        ids = sorted({*lessons[0], *lessons[1]})  # at most 4 * TAUGHT
        if not ids:
            return [[], []]
        chosen = rows.filter(F.col("doc_id").isin(ids)).mapInArrow(features, f"doc_id {kind}, tx binary, mt binary").groupBy("doc_id").agg(F.max(F.struct("tx", "mt")).alias("f")).select("doc_id", "f.*").toArrow()
        at = {key: i for i, key in enumerate(chosen.column("doc_id").to_pylist())}
        x = _arrays(chosen)
        return [[(key, label, x[1 - v][at[key]]) for key, label in own.items()] for v, own in enumerate(lessons)]

    return surest


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """The model of :func:`co_train`, or None without rows of both classes."""
    bounded_batches(docs.sparkSession)
    at = F.xxhash64("doc_id", F.lit(5))
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(at, "doc_id").limit(labelled)
    # at most `labelled` small rows, so the chosen ids may be sent to all tasks
    known = docs.select(*COLUMNS).join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _rows(part, [part.column("doc_id"), part.column("quality")], ["doc_id", "quality"])

    got = known.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, tx binary, mt binary").orderBy(at, "doc_id").limit(labelled).toArrow()
    y, views = np.array(got.column("quality").to_pylist(), float), _arrays(got)
    model = None
    if len(y) >= 20 and 0 < y.sum() < len(y):
        held = np.arange(len(y)) % 4 == 0
        if len(np.unique(y[~held])) == 2 and len(np.unique(y[held])) == 2:
            model = co_train(views, y, held, _pool(docs, marks))
    return model


def scores(part: pa.RecordBatch, model: dict | None) -> list[np.ndarray]:
    """text_score, meta_score, score and keep of each row."""
    n = part.num_rows
    if model is None:
        return [np.ones(n)] * 3 + [np.ones(n, bool)]
    both = np.column_stack([decide(v.astype(np.float32).astype(float), b) for v, b in zip(_views(part), model["models"], strict=True)])
    s = sigmoid(decide(both / model["scale"], model["join"]))
    return [sigmoid(both[:, 0]), sigmoid(both[:, 1]), s, s >= model["limit"]]


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of each row of documents (doc_id, text, lang, source, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, scores(part, shared.value))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, score double, keep boolean")


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = text_bytes(part.column("text"))
    return text_features(texts), meta_features(texts, *(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _rows(part: pa.RecordBatch, first: list, names: list[str]) -> pa.RecordBatch:
    x, z = (v.astype(np.float32) for v in _views(part))
    return pa.RecordBatch.from_arrays([*first, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], [*names, "tx", "mt"])


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with their columns. Each row is judged by itself where it is read: no join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(scores(part, shared.value)[-1]))

    return docs.mapInArrow(good, docs.schema)
