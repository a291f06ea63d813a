"""Language-model scoring by partial matching, beside a unigram base.

The model is a byte-context trie of depth ``ORDER``, pretrained on the training documents. A context with n
occurrences and d distinct successors gives a known successor c / (n + d) and escapes with the rest (method C);
an escape goes to the context without its first byte, where the successors already known are excluded and the
others share its mass. So every context's chances sum to 1. Nothing is pruned: every gram of the training documents
counts, at every size. The chances are a table by gram, made depth by depth with joins; documents are dealt out in
pieces by hash, a piece's distinct grams are joined with the table and brought to its documents.

The base is the sum over words and one end of log10((c + 1) / (N + 1 * (V + 1))). Counts of frequent words (at most
``FREQUENT``) are sent to all tasks; all other words of a document are joined with the counts.

Nulls: a null text is empty and still has its end, which is a zero byte, so that a zero byte in a text is scored as an end; a null id counts as an empty text in the split. Rows that repeat
are separate documents. Without training documents all chances are even (1/256 a byte) and N = V = 0. An empty
table gives no rows. Texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts, slices, text_bytes

ORDER, FREQUENT = 5, 100_000
#: Bytes scored at once; words a task gathers before it hands them on; grams it gathers before it merges them; byte that ends a text.
AT_ONCE, WORDS_HELD, GRAMS_HELD, END = 2_000_000, 400_000, 2_000_000, 0
#: Bytes of text a piece at least (smaller ones would only repeat the frequent grams) and at most, on average: a piece is what a task
#: scores at once, and pieces of one task come one after the other.
PIECE, LARGEST = 3_000_000, 16_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed ORDER + 1 bytes that end at each byte of each text and at its end; first place of each text)."""
    pad = b"\n" * ORDER
    joined = b"".join([pad + t + b"\0" for t in texts])
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts])
    key = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        key = (key << np.uint64(8)) | data[i : len(data) - ORDER + i]
    ends = np.cumsum(sizes)
    keep = np.ones(len(key), bool)
    for e in ends[:-1].tolist():
        keep[e - ORDER : e] = False  # grams over the border of two texts
    counts = sizes - ORDER
    return key[keep], np.concatenate([[0], np.cumsum(counts)[:-1]])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of several lists and the sums of their counts."""
    g, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return g, np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(g)).astype(np.int64)


def _piece_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, text, held_out) sorted by piece to (piece, gram, occurrences in training texts) of the distinct grams of each piece."""
    piece, held = None, []

    def done() -> pa.RecordBatch:
        g, n = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), piece, np.int64)), pa.array(g.view(np.int64)), pa.array(n)], ["piece", "g", "n"])

    for batch in batches:
        for part in slices(batch, "text", AT_ONCE):
            for own in pc.unique(part.column("piece")).to_pylist():
                if own != piece:
                    if held:
                        yield done()
                    piece, held = own, []
                for out in (False, True):
                    texts = part.filter(pc.and_(pc.equal(part.column("piece"), own), pc.equal(part.column("held_out"), out))).column("text")
                    if len(texts):
                        k, c = np.unique(grams([t.translate(_LOWER) for t in text_bytes(texts)])[0], return_counts=True)
                        held.append((k, np.zeros_like(c) if out else c))
                if sum(len(k) for k, _ in held) > GRAMS_HELD:
                    held[:] = [_merged(held)]
    if held:
        yield done()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for t in text_bytes(batch.column("text")):
            held.update(t.translate(_LOWER).split())
            if len(held) > WORDS_HELD:
                yield out()
                held = Counter()
    yield out()


def _limit(counts: DataFrame, column: str, most: int) -> int:
    """Least power of two that at most ``most`` of the counts reach, above all counts if even the largest are too many."""
    rows = sorted(counts.groupBy(F.floor(F.log2(column)).cast("int").alias("b")).count().collect(), reverse=True)
    total, limit = 0, rows[0][0] + 1 if rows else 0
    for b, n in rows:
        total += n
        if total > most:
            break
        limit = b
    return 1 << min(limit, 62)


def chances(counted: DataFrame) -> DataFrame:
    """(g, n) of distinct grams of ORDER + 1 bytes, n = 0 where only texts to be scored hold them, to (g, log10 chance)."""
    below = None
    for k in range(ORDER + 1):
        own = F.col("g").bitwiseAND((1 << (8 * (k + 1))) - 1)
        here = counted if k == ORDER else counted.groupBy(own.alias("g")).agg(F.sum("n").alias("n"))
        if below is None:
            here = here.withColumn("low", F.lit(float(-np.log10(256.0))))
        else:
            here = here.withColumn("s", F.col("g").bitwiseAND((1 << (8 * k)) - 1)).join(below.select(F.col("g").alias("s"), F.col("log").alias("low")), "s")
        # a context has at most 256 successors; its free share is that of the successors it doesn't know
        about = Window.partitionBy(F.shiftright("g", 8))
        known = F.col("n") > 0
        here = here.select("g", "n", "low", F.sum("n").over(about).alias("t"), F.count_if(known).over(about).alias("d"), (1 - F.coalesce(F.sum(F.when(known, F.pow(F.lit(10.0), "low"))).over(about), F.lit(0.0))).alias("free"))
        full = F.col("free") < 1e-9  # every byte is known here: no escape is left to share
        p = F.try_divide(F.col("n"), F.when(full, F.col("t")).otherwise(F.col("t") + F.col("d")))
        escape = F.log10(F.try_divide(F.col("d"), F.col("t") + F.col("d")) / F.greatest("free", F.lit(1e-9)))
        log = F.when(known, F.log10(p)).when(F.col("t") > 0, escape + F.col("low")).otherwise(F.col("low"))
        made = materialize(here.select("g", log.alias("log")), "chances")
        if below is not None:
            discard(below)
        below = made
    return below


def _spread(spark: SparkSession, parts: int, n: int) -> list[int]:
    """Keys of ``n`` pieces that the hash of a shuffle deals evenly to ``parts`` partitions, several to each where there are more pieces."""
    each = -(-n // parts)
    order = Window.partitionBy("p").orderBy("id")
    rows = spark.range(40 * parts * each).withColumn("p", F.pmod(F.hash("id"), F.lit(parts))).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
    return [r["id"] for r in rows.orderBy("k", "p").limit(n).collect()]


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of each row."""
    spark = docs.sparkSession
    part_of = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
    base = docs.select(F.col(id_col), "text", (part_of == held).alias("held_out"))
    training = base.filter(~F.col("held_out"))
    n_docs = training.count()
    words = materialize(training.select("text").mapInArrow(_count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    limit = _limit(words, "n", FREQUENT)
    common = words.filter(F.col("n") >= limit).toArrow()
    frequent = dict(zip(common.column("w").to_pylist(), np.log10(common.column("n").to_numpy() + 1.0).tolist(), strict=True))
    shared = spark.sparkContext.broadcast(frequent)
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a piece for each task where that leaves them PIECE bytes, and more pieces than tasks where they would hold over LARGEST
    n_pieces = max(min(n_parts(spark), 1 + size // PIECE), -(-size // LARGEST))
    place = F.pmod(F.xxhash64(id_col, "text"), F.lit(n_pieces))
    if n_pieces <= 8 * n_parts(spark):  # more are dealt evenly enough by their numbers
        place = F.get(F.lit(_spread(spark, n_parts(spark), n_pieces)).cast("array<bigint>"), place.cast("int"))
    dealt = base.withColumn("piece", place.cast("long"))
    by_piece = materialize(dealt.select("piece", "text", "held_out").repartition(n_parts(spark), "piece").sortWithinPartitions("piece").mapInArrow(_piece_grams, "piece long, g long, n long"), "grams")
    counted = materialize(by_piece.groupBy("g").agg(F.sum("n").alias("n")), "counted")
    model = chances(counted)
    discard(counted)

    def score(piece: pa.Table, found: pa.Table) -> pa.Table:
        own = found.column("g").to_numpy().view(np.uint64)
        order = np.argsort(own)
        return pa.Table.from_batches(list(score_rows(piece, own[order], found.column("log").to_numpy()[order])))

    def score_rows(piece: pa.Table, known_grams: np.ndarray, chance: np.ndarray) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in piece.to_batches():
            for part in slices(batch, "text", AT_ONCE):
                texts = text_bytes(part.column("text"))
                key, first = grams([t.translate(_LOWER) for t in texts])
                different, inverse = np.unique(key, return_inverse=True)
                scores = np.add.reduceat(chance[np.searchsorted(known_grams, different)][inverse], first)
                n, known, sums, rare = [], [], [], []
                for t in texts:
                    own = t.translate(_LOWER).split()
                    found = [x for x in map(logs.get, own) if x is not None]
                    n.append(len(own) + 1)
                    known.append(len(found))
                    sums.append(sum(found))
                    rare.append(list(Counter(w for w in own if w not in logs).items()) if len(found) < len(own) else [])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([c for r in rare for _, c in r], pa.int64())], ["w", "k"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), pa.array([len(t) for t in texts], pa.int64()), lists],
                    [id_col, "held_out", "n_tokens", "known", "sums", "score", "n_bytes", "rare"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    found = by_piece.join(model, "g").select("piece", "g", "log")
    scored = dealt.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(score, f"{id_col} {kind}, held_out boolean, n_tokens long, known long, sums double, score double, n_bytes long, rare array<struct<w:binary,k:long>>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    discard(by_piece)
    discard(model)
    rare = scored.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("w"), F.col("r.k").alias("k"))
    found = rare.join(words.filter(F.col("n") < limit), "w").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("logs"))
    ends = int(n_docs > 0)
    return scored.drop("rare").join(found, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + ends).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("logs", F.lit(0.0)) + float(np.log10(n_docs + 1)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), "score", "n_bytes",
    )
