"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

Merging takes the adjacent pair of best score (of equal ones the leftmost) until no pair makes a piece. Its result is the
only sequence of pieces in which each piece is what merging makes of itself and each two neighbours are what merging makes
of the two together: a merge across a border would show in the pair at that border, as what happens left and right of it
is decided by those two alone up to then. So the encoder needs no merge list of the text: it takes the longest piece that
Aho-Corasick finds at a place, checks it against the piece before by merging those two again (kept in a memo table), else
takes the next shorter one, else goes back; a bitfield holds places that no sequence can pass, so none is tried twice.

Characters without a piece become byte pieces. A null or empty text has no ids and decodes to the empty text. Rows are
encoded one by one: repeated rows, ties, null ids, other columns and empty tables need no rule of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, resident, text_or_empty
from .pieces import SPACE, Pieces, default_model

MEMO_CHUNKS, MEMO_PAIRS = 350_000, 200_000
#: Longer chunks aren't kept in the memo table.
MEMO_LENGTH = 48


class Codec:
    """Encodes and decodes with one model. A character that has no piece counts as the piece number_of_pieces + its code."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces = p = Pieces(model)
        self.size = len(p.surface)
        self.automaton = ahocorasick.Automaton()
        own = {piece: i for piece, i in p.ids.items() if self.merged(piece) == [piece]}
        for piece, i in own.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(s) for s in p.surface]
        #: The longest piece that is a beginning of this one, else its first character, else -1.
        self.shorter = [-1] * self.size
        for piece, i in own.items():
            if len(piece) > 1:
                begins = (own.get(piece[:k]) for k in range(len(piece) - 1, 0, -1))
                self.shorter[i] = next((b for b in begins if b is not None), self.size + ord(piece[0]))
        self.pair = Memo(self.fits, MEMO_PAIRS)
        self.chunk = Memo(self.encode_chunk, MEMO_CHUNKS)
        self.digits = [str(i) for i in range(self.size)]
        self.byte_of = {i: b for b, i in p.byte_ids.items()}
        self.bytes_of = [
            bytes([self.byte_of[i]]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else s.replace(SPACE, " ").encode() if k == "normal" else b"\xff"
            for i, (s, k) in enumerate(zip(p.surface, p.kind))
        ]

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: used for single pieces and pairs of them."""
        ids, score, parts = self.pieces.ids, self.pieces.score, list(text)
        while len(parts) > 1:
            best = at = None
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _string(self, i: int) -> str:
        return self.pieces.surface[i] if i < self.size else chr(i - self.size)

    def fits(self, key: int) -> bool:
        """Whether merging leaves two neighbours as they are; key is the left one * 2**21 + the right one."""
        a, b = self._string(key >> 21), self._string(key & (1 << 21) - 1)
        return self.merged(a + b) == [a, b]

    def encode_chunk(self, text: str) -> tuple[int, ...]:
        text = text.replace(" ", SPACE)
        n, size, length, shorter, pair = len(text), self.size, self.length, self.shorter, self.pair
        longest = [-1] * n
        for end, i in self.automaton.iter(text):  # by end, so the last one at a start is the longest
            longest[end + 1 - length[i]] = i
        dead = bytearray(n // 8 + 1)
        out: list[int] = []
        at, left, strange = 0, -1, False
        i = longest[0]
        while at < n:
            if i == -2:  # all that starts here has been tried
                dead[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                at -= length[i] if i < size else 1
                left = out[-1] if out else -1
                i = -2 if i >= size or shorter[i] < 0 else shorter[i]
                continue
            if i == -1:
                i = size + ord(text[at])
            end = at + (length[i] if i < size else 1)
            if not dead[end >> 3] >> (end & 7) & 1 and (left < 0 or pair.young.get(left << 21 | i) or pair(left << 21 | i)):
                out.append(i)
                strange |= i >= size
                left, at = i, end
                if at < n:
                    i = longest[at]
            else:
                i = -2 if i >= size or shorter[i] < 0 else shorter[i]
        return tuple(j for i in out for j in ([i] if i < size else self.pieces.fallback(chr(i - size)))) if strange else tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.chunk
        young = memo.young
        for chunk in self.pieces.chunks(self.pieces.spaced(text or "")):
            ids = young.get(chunk)
            if ids is None:
                ids = memo(chunk) if len(chunk) <= MEMO_LENGTH else self.encode_chunk(chunk)
                young = memo.young
            out += ids
        return out

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8, an invalid byte as U+FFFD, without the space that was put before."""
        kind, surface = self.pieces.kind, self.pieces.surface
        try:
            whole = b"".join(map(self.bytes_of.__getitem__, ids)).decode()  # byte pieces and controls alone can be invalid
        except UnicodeDecodeError:
            whole, at = "", 0
            for end in [k for k, i in enumerate(ids) if kind[i] == "control"] + [len(ids)]:
                whole += _utf8(b"".join(map(self.bytes_of.__getitem__, ids[at:end])))
                at = end + 1
        first = next((i for i in ids if kind[i] != "control"), None)
        return whole[1:] if first is not None and kind[first] == "normal" and surface[first].startswith(SPACE) else whole


def _utf8(run: bytes) -> str:
    """Valid characters as they are; each byte that belongs to none as U+FFFD."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[k : k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def read_model(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids (array<int>) and decoded (string), a row for each of docs."""
    model = read_model(model_path)
    digest = hashlib.sha256(model).hexdigest()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = resident(("codec", digest), lambda: Codec(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # few texts and their ids at a time
                part = batch.slice(at, 512)
                rows = [(ids := c.encode(t), c.decode(ids)) for t in part.column(1).to_pylist()]
                columns = {
                    key: part.column(0),
                    "n_tokens": pa.array([len(i) for i, _ in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c.joined(i).encode()).hexdigest() for i, _ in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([i for i, _ in rows], pa.list_(pa.int32()))
                if with_text:
                    columns["decoded"] = pa.array([d for _, d in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col(f"`{key}`"), text_or_empty(docs, text).alias("the_text")).mapInArrow(run, schema)
