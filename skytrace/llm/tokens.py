"""Token counts under a unigram vocabulary: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that occur in a text; dynamic programming carries the best
score and the number of pieces of that best path, never the path itself. The rules are those of the
tokenizers library's Unigram model with byte fallback: matches extend a position in order of rising start and
length, only a strictly better score replaces a path, and a character that is no piece by itself costs the
smallest score less 10 and counts as its UTF-8 bytes. Spaces become U+2581 and one is put in front.

No piece holds U+2581 after another character, which is checked when the vocabulary is loaded, so that best
paths never cross from a word to the space after it: a text's count is the sum over its words' counts (each
with the spaces before it), and each task keeps the counts of words it has met, in a bounded table.

Nulls: a null or empty text has 0 tokens. Texts of any length are counted whole. Rows that repeat stay. An empty
table gives no rows. Columns of the input named n_tokens are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices

SPACE, UNKNOWN_COST = "▁", 10.0
#: Words whose counts a task keeps.
KEPT_WORDS = 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every normal or user-defined piece of a sentencepiece file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in plain]


class Counter:
    """Counts pieces of best paths."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_COST
        self.by_word = all(SPACE not in piece.lstrip(SPACE) for piece, _ in vocabulary)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.seen: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """The automaton reports matches by rising end and, for one end, by rising start: the library's order of candidates."""
        unknown, score, count = self.unknown, [0.0], [0]
        at, best, pieces, single = 1, -np.inf, 0, False
        for last, (size, s) in self.auto.iter(text):
            while at <= last:
                if not single and score[-1] + unknown > best:
                    best, pieces = score[-1] + unknown, count[-1] + len(text[at - 1].encode())
                score.append(best)
                count.append(pieces)
                at, best, single = at + 1, -np.inf, False
            s += score[at - size]
            if s > best:
                best, pieces = s, count[at - size] + 1
            if size == 1:
                single = True
        for at in range(at, len(text) + 1):
            if not single and score[-1] + unknown > best:
                best, pieces = score[-1] + unknown, count[-1] + len(text[at - 1].encode())
            score.append(best)
            count.append(pieces)
            best, single = -np.inf, False
        return count[-1]

    def word(self, text: str) -> int:
        """Count of one word with the spaces before it."""
        n = self.seen.get(text)
        if n is None:
            if len(self.seen) >= KEPT_WORDS:
                self.seen.clear()
            n = self.viterbi(text)
            if len(text) <= 64:
                self.seen[text] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(spaced)
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.word, self.split.findall(spaced)))
        words, plain = text.split(" "), self.plain
        try:
            return sum(map(plain.__getitem__, words))  # each word has one space before it
        except KeyError:
            if len(plain) >= KEPT_WORDS:
                plain.clear()
            total = 0
            for w in words:
                n = plain.get(w)
                if n is None:
                    n = self.viterbi(SPACE + w)
                    if len(w) <= 64:
                        plain[w] = n
                total += n
            return total


_COUNTERS: dict[tuple, Counter] = {}


def _counter(vocabulary: list[tuple[str, float]]) -> Counter:
    """The counter of a Python worker, kept between its tasks."""
    key = (len(vocabulary), hash(tuple(vocabulary[:: max(1, len(vocabulary) // 1000)])))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [counter.count(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, n_tokens long")
