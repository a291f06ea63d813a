"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts the bytes of a text into chunks, so that documents which share a passage share the chunks inside
it. A chunk is encoded once, from its first white space to its last, and its ids are kept. At a join of two chunks
the bytes about the cut are encoded again, outwards from the cut until each side has reached a place from which on
the ids are those of the chunk kept: its outermost white space, which the tokenizer drops and never joins words across.
A chunk without white space is passed over, and the join goes on into the next one. So ids are those of the whole text.
Words of a chunk that were met before are taken from a table, as tokenizers do themselves.

Chunks are shared by all documents that a Python worker meets, in bounded tables that are cleared when full; nothing is
shuffled. Decoding joins the tokens as the file's decoder does: it has none, so tokens are joined by one space.

Nulls: a null text is an empty one and has no tokens. Texts of any length are encoded whole. Rows that repeat stay. An
empty table gives no rows. Input columns named like an added one are replaced. The tokenizer's file is read once, by
the driver, and its text (a few MB) is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, text_bytes

#: Words and chunks a worker keeps, and words up to which it keeps them after a task; a chunk ends where so many bits of the hash are 0.
KEPT_WORDS, KEPT_PIECES, KEPT_CHUNKS, CUT_BITS = 400_000, 100_000, 20_000, 8
LEFT_WORDS = 50_000
#: Below it, letters, digits and case are alike in all Unicode versions.
LATIN_END = "\u0250"
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
_MULTIPLIER = 0x9E3779B97F4A7C15


def cuts(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``data``: where the hash of the 8 bytes before has ``bits`` zeros, and at its end."""
    if len(data) < 16:
        return [len(data)]
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power = _MULTIPLIER
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MULTIPLIER)
    return [*(np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 8).tolist(), len(data)]


def _visible_bytes() -> dict[int, int]:
    """Byte-level alphabets show printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit) and decoded bytes, by the text of a tokenizer's file."""

    def __init__(self, text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("the joining of words needs a tokenizer without decoder and post-processor")
        # the short way repeats these steps of the file; with others every word takes the whole tokenizer
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]] if (spec["normalizer"] or {}).get("normalizers") else None
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.short = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and all(x["content"].startswith("<|") for x in spec["added_tokens"]) and sys.byteorder == "little"
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"]) if self.short else None
        self.visible = _visible_bytes()
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        #: Each token with the space before it.
        self.token = {i: b" " + t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        #: Of each chunk: the bytes before its first white space and after its last, ids and tokens of what lies between.
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes, bytes]] = {}

    def piece(self, text: str) -> tuple[bytes, bytes]:
        """One piece of the pre-tokenizer, by the tokenizer's own merges."""
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            tokens = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.visible))
            got = self.pieces[text] = array("I", [t.id for t in tokens]).tobytes(), "".join([" " + t.value for t in tokens]).encode()
        return got

    def learn(self, words: list[bytes]) -> None:
        """Encode words that aren't kept. Latin words take a short way to the merges, others the whole tokenizer."""
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        for w in words:
            text = w.decode("utf-8", "replace")
            if self.short and text.isprintable() and max(text) < LATIN_END and "<|" not in text:
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                found = [self.piece(x) for x in self.pattern.findall(text.lower())]
                self.words[w] = found[0] if len(found) == 1 else (b"".join([x for x, _ in found]), b"".join([x for _, x in found]))
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                self.words[w] = array("I", ids).tobytes(), b"".join([self.token[i] for i in ids])

    def release(self) -> None:
        """Drop large tables after a task: an idle worker holds memory that other work needs."""
        if len(self.words) > LEFT_WORDS:
            self.words, self.pieces, self.chunks = {}, {}, {}

    def codes(self, words: list[bytes]) -> tuple[bytes, bytes]:
        """Ids and tokens of whole words."""
        try:
            found = [self.words[u] for u in words]
        except KeyError:
            self.learn([u for u in dict.fromkeys(words) if u not in self.words])
            try:
                found = [self.words[u] for u in words]
            except KeyError:  # the table was cleared
                self.learn(list(dict.fromkeys(words)))
                found = [self.words[u] for u in words]
        return b"".join([x for x, _ in found]), b"".join([x for _, x in found])

    def chunk(self, data: bytes) -> tuple[bytes, bytes, bytes, bytes] | None:
        """A chunk's entry, encoded when it is met first; None if it holds no white space."""
        got = self.chunks.get(data)
        if got is None:
            parts = data.translate(BLANKS).split(b" ")
            if len(parts) == 1:
                return None
            got = (parts[0], parts[-1], *self.codes([x for x in parts[1:-1] if x]))
            if len(data) <= 1 << 12:
                if len(self.chunks) >= KEPT_CHUNKS:
                    self.chunks.clear()
                self.chunks[data] = got
        return got

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for data in texts:
            ids, tokens, open_, start = [], [], [], 0
            for end in cuts(data):
                own, start = data[start:end], end
                got = self.chunk(own)
                if got is None:
                    open_.append(own)
                    continue
                first, last, inner, back = got
                open_.append(first)
                join = b"".join(open_)
                if join:  # from the last white space before the cut to the first after it
                    x, y = self.codes([join])
                    ids.append(x)
                    tokens.append(y)
                ids.append(inner)
                tokens.append(back)
                open_ = [last]
            join = b"".join(open_)
            if join:
                x, y = self.codes([join])
                ids.append(x)
                tokens.append(y)
            yield b"".join(ids), b"".join(tokens)[1:]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """The worker's encoder; it is kept between tasks."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(text)
    return _ENCODERS[key]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids as binary, decoded), or the SHA-256 of both in hex when ``digest``."""

    bounded_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids, back = [], [], []
                for code, text in encoder.encode(text_bytes(part.column("text"))):
                    n.append(len(code) // 4)
                    ids.append(hashlib.sha256(code).hexdigest() if digest else code)
                    back.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, pa.string())], names)
        encoder.release()

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("token_ids", "decoded"))]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, {names[2]} {'string' if digest else 'binary'}, {names[3]} string"
    return docs.select(id_col, "text").mapInArrow(run, schema)
