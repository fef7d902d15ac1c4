"""Removal of passages that occur earlier, by windows of n words, with a count-min prefilter.

1. Sketch. Of the short word sequences (grams) inside a window one is its minimiser, the one of least hash (the first of
   equal ones). Equal windows have equal minimisers at the same place, so how often a gram is a minimiser is at least how
   often the window occurs, with one seventh of the entries. Each partition counts its minimisers' cells in a count-min
   sketch of two rows; the sketches travel sparse, cut into segments, and are merged by segment with saturating counters.
   The width follows the input without a bound, and no sketch is ever in one place: each partition also sends its distinct
   (minimiser, document) pairs to the segments of the first row, what passes there goes on to those of the second row,
   and what passes both comes back to its document. A task holds one segment's counters.
2. Groups. Windows whose minimiser came back may be repeated; no repeated one is lost. They are grouped by 128 bits of
   hash and the smallest document is taken, summed up in each partition before the shuffle, so a window that a third of
   the rows have is one row a partition.
3. Removal. Each document gets the windows that it is the first to have; all its other estimated windows, and later
   starts in the same row, are repeats, and the words that they cover go.

With SPARE cells a row for each minimiser about a twentieth of the windows that occur once pass step 1, at any size.

Defined results: a null or empty text has no words. Null ids come before all others (ids below -2**62 may tie with them), in the
order of a hash of the text: of rows without an id the first to have a passage keeps it. Rows that share an id don't remove each
other's words: only smaller ids and earlier starts in the same row do. Ids are whole numbers. An empty table gives an
empty one; the columns of the input don't matter beyond the two that are named.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, text_or_empty
from .word_hashes import Chunk, chunks, mix

WINDOW = 20
ROWS = 2
#: Cells of a segment, and how many segments a row of the sketch has at most before they grow (to 128 MB at 2**43 cells).
SEGMENT, SEGMENTS = 1 << 20, 1 << 16
#: Cells of a row for each minimiser that is expected.
SPARE = 4
#: Minimisers that a task holds before it sends them.
HELD = 2_000_000
_POSITION = np.uint64((1 << 20) - 1)
_STRETCH = 1 << 19
_LOWEST = -(1 << 63)
_PARTS = "segment int, kind int, a binary, b binary"


def _minimisers(chunk: Chunk, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the hash and the place of its minimiser.

    Of equal grams in a window the first counts. So two equal windows that overlap never share the place of their minimiser:
    the later one's would be in the earlier one too, and before its first. Grams are compared by 44 bits.
    """
    gram = _gram(window)
    g, span, least = chunk.grams(gram), window - gram + 1, []
    for at in range(0, max(0, len(g) - span + 1), _STRETCH):
        part = g[at : at + _STRETCH + span - 1]
        part = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            part = np.minimum(part[: len(part) - size], part[size:])
            size *= 2
        if rest := span - size:
            part = np.minimum(part[: len(part) - rest], part[rest:])
        least.append((part & _POSITION).astype(np.int64) + at)
    if not least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.concatenate(least)[starts]
    return g[places], places


def _cells(gram_hash: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(gram_hash + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) & np.uint64(width - 1)


def _gram(window: int) -> int:
    return max(1, window * 2 // 5)


def sketch_width(characters: int, window: int) -> tuple[int, int]:
    """(cells of a row, cells of a segment) for so many bytes of text, six of which are taken for a word and its separator."""
    expected = SPARE * characters // 6 * 2 // (window - _gram(window) + 2)
    width = max(SEGMENT, 1 << max(1, int(expected)).bit_length())
    return width, max(SEGMENT, width // SEGMENTS)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    edges = np.flatnonzero(np.diff(values, prepend=-1, append=-2))
    return ((int(values[a]), int(a), int(b)) for a, b in zip(edges, edges[1:]))


def _rows(parts: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(parts), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[at : at + 4096]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["segment", "kind", "a", "b"])


def _asked(hashes: np.ndarray, keys: np.ndarray, row: int, width: int, size_of: int) -> list[tuple[int, int, bytes, bytes]]:
    """(segment, 1, hashes, keys) of minimisers to be looked up in a row of the sketch."""
    segments = (_cells(hashes, row, width) // np.uint64(size_of)).astype(np.int64)
    order = np.lexsort((hashes, segments))
    segments, hashes, keys = segments[order], hashes[order], keys[order]
    return [(row * (width // size_of) + s, 1, hashes[a:b].tobytes(), keys[a:b].tobytes()) for s, a, b in _runs(segments)]


def _sketch(keyed: DataFrame, window: int, width: int, size_of: int) -> DataFrame:
    """Rows of two kinds. 0: a partition's cells of a segment, counted once (a) and more (b), as deflated differences of sorted
    places; 1: its minimisers' hashes (a) and their documents (b), for the first row's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            g, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out = []
            for row in range(ROWS):
                cells, counts = np.unique(_cells(g, row, width), return_counts=True)
                for s, a, b in _runs((cells // np.uint64(size_of)).astype(np.int64)):
                    places = (cells[a:b] % np.uint64(size_of)).astype(np.int32)
                    once, more = (zlib.compress(np.diff(places[c], prepend=np.int32(0)).tobytes(), 1) for c in (counts[a:b] == 1, counts[a:b] > 1))
                    out.append((row * (width // size_of) + s, 0, once, more))
            order = np.lexsort((keys, g))
            g, keys = g[order], keys[order]
            new = np.append(True, (g[1:] != g[:-1]) | (keys[1:] != keys[:-1]))
            yield from _rows(out + _asked(g[new], keys[new], 0, width, size_of))

        size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, chunk in chunks(batch.column(1)):
                starts = chunk.whole(window)
                if len(starts):
                    g, places = _minimisers(chunk, window, starts)
                    of = chunk.texts()[starts]
                    fresh = np.append(True, (places[1:] != places[:-1]) | (of[1:] != of[:-1]))
                    held.append((g[fresh], keys[at + of[fresh]]))
                    size += int(fresh.sum())
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    return keyed.select("the_key", "the_text").mapInArrow(run, _PARTS)


def _looked_up(row: int, width: int, size_of: int):
    """What passes a row of the sketch: its segments' sketches are added up with saturation, then minimisers are looked up.

    The first row hands its survivors on as questions to the second, with the second's sketches; that gives (key, minimisers).
    """
    first, last = row * (width // size_of), (row + 1) * (width // size_of)

    def on(hashes: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if row + 1 < ROWS:
            yield from _rows(_asked(hashes, keys, row + 1, width, size_of))
            return
        order = np.lexsort((hashes, keys))
        keys, hashes = keys[order], hashes[order]
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(keys)), pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[edges]), lists], ["key", "minimisers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        segment, counts, held, size = -1, np.zeros(0, np.uint8), [], 0
        for batch in batches:
            for own, kind, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not first <= own < last:
                    yield from _rows([(own, kind, a, b)])
                    continue
                if own != segment:
                    segment, counts = own, np.zeros(size_of, np.uint8)
                if kind == 0:
                    for blob, n in ((a, 1), (b, 2)):
                        places = np.cumsum(np.frombuffer(zlib.decompress(blob), np.int32))
                        counts[places] = np.minimum(counts[places], 255 - n) + np.uint8(n)
                    continue
                hashes, keys = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                passed = counts[(_cells(hashes, row, width) % np.uint64(size_of)).astype(np.int64)] >= 2
                held.append((hashes[passed], keys[passed]))
                size += int(passed.sum())
                if size > HELD:
                    yield from on(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield from on(*(np.concatenate(x) for x in zip(*held)))

    return run


def repeated_minimisers(keyed: DataFrame, window: int) -> DataFrame:
    """(key, minimisers): for each document the hashes of its minimisers that the sketch takes for repeated."""
    characters = keyed.agg(F.sum(F.octet_length("the_text"))).first()[0] or 0
    width, size_of = sketch_width(characters, window)
    parts = _sketch(keyed, window, width, size_of)
    for row, schema in ((0, _PARTS), (1, "key bigint, minimisers array<bigint>")):
        parts = parts.repartition("segment").sortWithinPartitions("segment", "kind").mapInArrow(_looked_up(row, width, size_of), schema)
    return cut(parts.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("minimisers"))).alias("minimisers")))


def _estimated(chunk: Chunk, lists: pa.Array, window: int) -> np.ndarray:
    """The starts of windows whose minimiser is in their text's list."""
    starts = chunk.whole(window)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    if not len(starts) or not sizes.sum():
        return starts[:0]
    of = chunk.texts()[starts]
    some = sizes[of] > 0
    starts, of = starts[some], of[some]
    if not len(starts):
        return starts
    g, _ = _minimisers(chunk, window, starts)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):  # a text's own minimisers: both sides are shifted by its number
        return starts[np.isin(g + mix(of.astype(np.uint64)), flat + mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)))]


def first_windows(marked: DataFrame, window: int) -> DataFrame:
    """(first_key, h1s): the windows, among those estimated repeated, that a document is the first to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, chunk in chunks(batch.column(1), lanes=2):
                starts = _estimated(chunk, batch.column(2).slice(at, len(chunk.starts) - 1), window)
                if len(starts):
                    h = [chunk.grams(window, lane)[starts].view(np.int64) for lane in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at + chunk.texts()[starts]]), *map(pa.array, h)], ["key", "h1", "h2"])

    found = marked.mapInArrow(run, "key bigint, h1 bigint, h2 bigint")
    first = found.groupBy("h1", "h2").agg(F.min("key").alias("first_key"))
    return first.groupBy("first_key").agg(F.collect_list("h1").alias("h1s"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text.

    kept_text is the text itself where nothing was removed, else the kept words, each after the white space it had before it.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    kind = dict(docs.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {kind}")
    names = [c for c in docs.columns if c != text]
    the_text = text_or_empty(docs, text)
    unnamed = F.lit(_LOWEST) + F.xxhash64(the_text).bitwiseAND(F.lit((1 << 62) - 1))  # no key that all rows without an id share
    keyed = docs.select(F.coalesce(docs[key].cast("bigint"), unnamed).alias("the_key"), the_text.alias("the_text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("the_rest"))
    found = repeated_minimisers(keyed, window)
    # the texts are dealt out by their key once, for both steps: the same columns, so that the exchange is the same
    marked = keyed.join(found, F.col("the_key") == F.col("key"), "left").select("the_key", "the_text", "minimisers", "the_rest")
    firsts = first_windows(marked, window)
    joined = marked.join(firsts, F.col("the_key") == F.col("first_key"), "left").select("the_text", "minimisers", "h1s", "the_rest")
    rest = joined.schema["the_rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, chunk in chunks(batch.column(0), lanes=2):
                n = len(chunk.starts) - 1
                removed = _removed(chunk, batch.column(1).slice(at, n), batch.column(2).slice(at, n), window)
                totals = np.diff(chunk.starts)
                gone = np.add.reduceat(np.append(removed, 0), chunk.starts[:-1]) * (totals > 0) if n else np.zeros(0, int)
                digests, kept = [], []
                for k, value in enumerate(batch.column(0).slice(at, n).to_pylist()):
                    if gone[k]:
                        keep = (~removed[chunk.starts[k] : chunk.starts[k + 1]]).tolist()
                        words = compress(value.encode().split(), keep)
                        spaced = list(compress(re.findall(rb"[ \t-\r]*[^ \t-\r]+", value.encode()), keep))
                        kept.append(b"".join(spaced).lstrip(b" \t\n\x0b\x0c\r").decode())
                    else:
                        words = value.encode().split()
                        kept.append(value)
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).slice(at, n), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                    ["the_rest", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return joined.mapInArrow(run, f"the_rest {rest}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def _removed(chunk: Chunk, lists: pa.Array, firsts: pa.Array, window: int) -> np.ndarray:
    """For each word whether a window covers it that is not the first of its kind."""
    total = len(chunk.hashes[0])
    starts = _estimated(chunk, lists, window)
    if not len(starts):
        return np.zeros(total, bool)
    of = chunk.texts()[starts]
    h1, h2 = (chunk.grams(window, lane)[starts] for lane in range(2))
    order = np.lexsort((starts, h2, h1, of))
    same = np.zeros(len(starts), bool)
    a, b = order[1:], order[:-1]
    same[a] = (of[a] == of[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    later = ~same
    edges = np.searchsorted(of, np.arange(len(chunk.starts)))
    lengths = np.asarray(firsts.value_lengths().fill_null(0))
    flat = firsts.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if lengths.sum() else np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    later &= lengths[of] > 0  # a text that is the first to have none of its windows
    for k in np.flatnonzero(lengths):
        s = slice(edges[k], edges[k + 1])
        later[s] &= np.isin(h1[s], flat[ends[k] - lengths[k] : ends[k]])
    repeated = starts[~later]
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + window, -1)
    return np.cumsum(cover[:-1]) > 0


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeats cut out of their texts; n_chars, if there is one, follows. A document with nothing left stays, empty."""
    names = [c for c in docs.columns if c != text]
    done = dedup(docs, key, text, window)
    columns = {c: F.col("the_rest")[c] for c in names} | {text: F.col("kept_text")}
    if "n_chars" in names:
        columns["n_chars"] = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
    return done.select(*(columns[c].alias(c) for c in docs.columns))
