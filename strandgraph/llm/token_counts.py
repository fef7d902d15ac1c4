"""Token counts by a count-only Viterbi over a unigram vocabulary.

The box has no unigram model, and tokenizers are never trained; the vocabulary is the public piece file, its scores taken
as log probabilities, and the tokenizer to agree with is tokenizers.models.Unigram over it (with byte fallback; scores
add up in double precision, and those of this file are whole numbers, so sums are exact). Aho-Corasick lists each piece
that ends at a character; the dynamic program carries the best score and its number of pieces, nothing else. Tie rule:
a later candidate must be better, and candidates come by their start, so the longest of equal ones wins. A character that
no piece covers alone costs the least score less 10 and counts as one piece for each of its UTF-8 bytes.

A null or empty text has 0 tokens. Rows are counted one by one: repeated rows, null ids, other columns and empty tables
need no rule of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, resident, text_or_empty
from .pieces import SPACE, Pieces
from .sentencepieces import read_model

MEMO_CHUNKS = 300_000
MEMO_LENGTH = 48
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces = p = Pieces(model)
        self.automaton = ahocorasick.Automaton()
        self.vocabulary = [(s, sc) for s, sc in zip(p.surface, p.score)]
        for i, (piece, score) in enumerate(self.vocabulary):
            if i != p.unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(p.score) - UNKNOWN_PENALTY
        self.byte_fallback = len(p.byte_ids) == 256
        self.chunk = Memo(self.count_chunk, MEMO_CHUNKS)

    def count_chunk(self, text: str) -> int:
        text = text.replace(" ", SPACE)
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        filled = 0  # places up to here have their unknown candidate, the last to come at a place

        def close(at: int, alone: bool) -> None:
            if not alone:
                score = best[at - 1] + self.unknown
                if best[at] is None or score > best[at]:
                    best[at] = score
                    count[at] = count[at - 1] + (len(text[at - 1].encode()) if self.byte_fallback else 1)

        alone = False
        for end, (length, score) in self.automaton.iter(text):  # by end, longest first
            while filled < end:
                filled += 1
                close(filled, alone)
                alone = False
            to, start = end + 1, end + 1 - length
            score += best[start]
            if best[to] is None or score > best[to]:
                best[to], count[to] = score, count[start] + 1
            alone |= length == 1
        while filled < n:
            filled += 1
            close(filled, alone)
            alone = False
        return count[n]

    def count(self, text: str | None) -> int:
        chunk = self.chunk
        return sum(chunk(c) if len(c) <= MEMO_LENGTH else self.count_chunk(c) for c in self.pieces.chunks(self.pieces.spaced(text or "")))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """(key, n_tokens bigint), a row for each of docs."""
    model = read_model(model_path)
    digest = hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = resident(("counter", digest), lambda: Counter(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = pa.array([c.count(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_pydict({key: part.column(0), "n_tokens": counts})

    chosen = docs.select(F.col(f"`{key}`"), text_or_empty(docs, text).alias("the_text"))
    return chosen.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint")
