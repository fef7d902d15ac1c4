"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. A document's set is the hashes of its distinct n-word shingles. One permutation is split into 256 bins; a bin's value is
   its least hash, and an empty bin takes that of the first bin with a value in its own fixed permutation of all bins
   (optimal densification: each empty bin draws anew). Bins in bands make bucket keys. With 42 bands of 6 bins a pair of
   similarity 0.8 meets in none with a probability of 3e-6.
2. Documents of equal sets are one node, its smallest id; sets are summed up before the shuffle, so thousands of copies
   cost a row a partition.
3. Each bucket gives a star: the edges from its hub to the others, distinct over all buckets; never all pairs.
4. A star's members are cut into blocks by a hash; a task has one block and the hub, or two blocks, whatever the size of the
   star. There links are confirmed on the full sets, made anew from the texts, which travel compressed; only which node is
   joined with which leaves a task.
5. A star of one block is decided by then. In larger ones, members that the first pass leaves outside their hub's component may
   still link with members of other blocks. A prefix filter, which loses nothing, finds which: with a star's shingles in any one
   order, two sets of similarity t share a shingle among the first 1 - 2t / (1 + t) of the smaller one's and the first 1 - t
   of the larger one's. In the order from rare to frequent, by counts in a few members, pages of one template share none
   there, so they go without a comparison.
6. What the filter leaves is compared block by block. Two documents that share a bucket are in its hub's star, so each such
   pair is decided or in one component already; nothing is capped.

Defined results: a null or empty text has no shingles and links with nothing; fewer words than n are one shingle. Rows that
share an id are one document with several texts, linked with whatever one of them is linked with. A row with a null id is
linked with nothing, has a null component and is kept. Empty tables give empty ones; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anew, free_name, release, text_or_empty
from .common import gathered as cut
from .components import components
from .word_hashes import Chunk, chunks, grams, mix

BINS, BANDS, BAND_ROWS = 256, 42, 6
#: Members of a star in a block; a task holds two blocks at most.
BLOCK = 256
#: Members of a star, about, whose shingles' counts order its shingles; they only make the order good, any is exact.
PIVOTS = 32
#: Shingles of one side that are compared at once, so that a task's tables stay small if texts are long.
STRETCH = 250_000
#: Shingles whose rows are a matrix at a time: 16 MB for two blocks.
SLAB = 8192
#: Shingles that leave a task in one batch, about.
BATCH = 1 << 17
#: Similarity as a fraction of whole numbers.
SIMILARITY = (80, 100)

_rng = np.random.Generator(np.random.PCG64(7))
_DRAWS = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_EDGES = np.arange(1, BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)
_BAND_BASE = np.cumprod(np.full(BAND_ROWS, 0x9E3779B97F4A7C15 | 1, np.uint64))
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(chunk: Chunk, n: int) -> Iterator[np.ndarray]:
    """For each text of the chunk its distinct shingles' hashes, sorted."""
    hashes = chunk.hashes[0]
    all_grams = chunk.grams(n)
    for a, b in zip(chunk.starts[:-1], chunk.starts[1:]):
        if b - a >= n:
            yield np.unique(all_grams[a : b - n + 1])
        else:
            yield grams(hashes[a:b], b - a) if b > a else hashes[:0]


def densified(shingles: np.ndarray) -> np.ndarray:
    """The bins' values of a set that isn't empty."""
    at = np.searchsorted(shingles, _EDGES)
    low, high = np.append(0, at), np.append(at, len(shingles))
    full = low < high
    values = shingles[np.minimum(low, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        draws = _DRAWS[empty]
        values[empty] = values[draws[np.arange(len(empty)), full[draws].argmax(1)]]
    return values


def band_keys(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = densified(shingles)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
        return mix((v * _BAND_BASE).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def signatures(keyed: DataFrame, n: int) -> DataFrame:
    """(key, n_shingles, d1, d2, bands): d1 and d2 are 128 bits that equal sets share; bands is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, chunk in chunks(batch.column(1), lower=True):
                sizes, d1, d2, bands = [], [], [], []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(chunk, n):
                        sizes.append(len(s))
                        d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                        d2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                        bands.append(band_keys(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["key", "n_shingles", "d1", "d2", "bands"],
                )

    return keyed.select("key", "the_text").mapInArrow(run, "key bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    release()
    for batch in batches:
        c = zstandard.ZstdCompressor(level=1)
        blobs = [c.compress(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["key", "blob"])


def _pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one of left and one of right (row numbers) that reach the similarity."""
    part, whole = SIMILARITY
    both = [sets[k] for k in left] + [sets[k] for k in right]
    sizes = np.array([len(s) for s in both])
    kinds, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1  # shingles that are there once can't be common to a pair
    chosen = common[column]
    row, column = np.repeat(np.arange(len(both)), sizes)[chosen], number[column[chosen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, shared = len(left), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(common.sum()), SLAB):
        lo, hi = np.searchsorted(column, (at, at + SLAB))
        table = np.zeros((len(both), SLAB), np.float32)
        table[row[lo:hi], column[lo:hi] - at] = 1
        shared += table[:n] @ table[n:].T
    shared = np.rint(shared).astype(np.int64)
    i, j = np.nonzero((shared > 0) & (whole * shared >= part * (sizes[:n, None] + sizes[None, n:] - shared)))
    return left[i], right[j]


def _stretches(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """rows in stretches of STRETCH shingles at most, or of one row."""
    total = np.cumsum(sizes[rows]) // STRETCH
    return np.split(rows, np.flatnonzero(np.diff(total)) + 1)


def _joined(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A label for each set, equal for those that links join, among pairs of one of left and one of right (row numbers)."""
    sizes = np.array([len(s) for s in sets])
    found = [_pairs(sets, a, b) for a in _stretches(left, sizes) for b in _stretches(right, sizes)]
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    label = np.arange(len(sets))
    while True:
        lower = label.copy()
        np.minimum.at(lower, i, label[j])
        np.minimum.at(lower, j, label[i])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _by_task(group):
    """Batches of (hub, task, node, side, blob), sorted by the first two, to group(hub, nodes, sides, texts) for each (hub, task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        release()
        d = zstandard.ZstdDecompressor()

        def texts_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = pa.array([d.decompress(r[2]).decode() for r in rows], pa.large_string())
            return group(key[0], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), texts)

        key, rows = None, []
        for batch in batches:
            for hub, task, node, side, blob in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (hub, task) != key:
                    if rows:
                        yield from texts_of(rows)
                    key, rows = (hub, task), []
                rows.append((node, side, blob))
        if rows:
            yield from texts_of(rows)

    return run


def _linked(n: int):
    """Links (node, low) within a task: rows with side 0 or 2 against rows with side 1 or 2, by full sets."""

    def group(hub: int, nodes: np.ndarray, sides: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        if len(left) and len(right) and len(nodes) > 1:
            label = _joined([s for _, chunk in chunks(texts, lower=True) for s in shingle_sets(chunk, n)], left, right)
            keep = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(nodes[label[keep]], pa.int64())], ["a", "b"])

    return group


def _prefixes(size: int) -> tuple[int, int]:
    """How many first shingles of a set of this size one of those shared is among, if the other set of a link is at most as large, and if
    it is at least as large."""
    part, whole = SIMILARITY
    return size - -(-part * size // whole) + 1, size - -(-2 * part * size // (whole + part)) + 1


def _rare(n: int):
    """First shingles (hub, shingle, node, early, apart) of the rows with side 0 or 2 (apart), in the order of the rows with side 1."""

    def group(hub: int, nodes: np.ndarray, sides: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        def sets(rows: np.ndarray) -> Iterator[np.ndarray]:
            for _, chunk in chunks(texts.take(pa.array(rows)), lower=True):
                yield from shingle_sets(chunk, n)

        kinds, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets(np.flatnonzero(sides == 1))]), return_counts=True)
        members, found, held = np.flatnonzero(sides != 1), [], 0

        def batch() -> pa.RecordBatch:
            shingles, early, lengths, rows = (np.concatenate([f[k] for f in found]) for k in range(4))
            rows = np.repeat(rows, lengths)
            columns = [np.full(len(rows), hub), shingles.view(np.int64), nodes[rows], early, sides[rows] == 2]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hub", "shingle", "node", "early", "apart"])

        for row, s in zip(members, sets(members)):
            often = np.zeros(len(s), np.int64)
            if len(kinds):
                at = np.minimum(np.searchsorted(kinds, s), len(kinds) - 1)
                often = np.where(kinds[at] == s, counts[at], 0)
            longer, shorter = _prefixes(len(s))
            first = s[np.argsort(often, kind="stable")[:longer]]  # s is sorted, so of equal counts the least hash is first
            found.append((first, np.arange(len(first)) < shorter, [len(first)], [row]))
            held += len(first)
            if held >= BATCH:
                yield batch()
                found, held = [], 0
        if found:
            yield batch()

    return group


def _in_tasks(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """tasks (hub, task, node, side) with the nodes' texts, those of a task together."""
    full = tasks.join(texts, tasks["node"] == texts["key"]).select("hub", "task", "node", "side", "blob")
    return full.repartition("hub", "task").sortWithinPartitions("hub", "task")


def _confirm(tasks: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b): links found in tasks (hub, task, node, side)."""
    return cut(_in_tasks(tasks, texts).mapInArrow(_by_task(_linked(n)), "a bigint, b bigint"))


def _able(stars: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The rows of stars (hub, node, m, apart) that may be in a link with one apart; all others certainly aren't."""
    places = _parts("m")
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.ceil(F.col("m") / PIVOTS)) == 0
    members = stars.select("hub", _dealt(places).alias("task"), "node", F.when(F.col("apart"), 2).otherwise(0).alias("side"))
    pivots = stars.filter(pivot).select("hub", F.explode(F.sequence(F.lit(0), places - 1)).alias("task"), "node", F.lit(1).alias("side"))
    schema = "hub bigint, shingle bigint, node bigint, early boolean, apart boolean"
    first = cut(_in_tasks(members.unionByName(pivots), texts).mapInArrow(_by_task(_rare(n)), schema))
    met = first.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("rows"), F.max("early").alias("early"), F.max("apart").alias("apart"))
    met = met.filter("rows > 1 AND early AND apart").select(anew(F.col("hub")).alias("h2"), anew(F.col("shingle")).alias("s2"))
    found = first.join(met, (anew(F.col("hub")) == F.col("h2")) & (anew(F.col("shingle")) == F.col("s2")))
    found = found.select(F.col("hub").alias("h2"), F.col("node").alias("n2")).distinct()
    return cut(stars.join(found, (F.col("hub") == F.col("h2")) & (F.col("node") == F.col("n2")), "left_semi"))


def _stars(nodes: DataFrame) -> DataFrame:
    """(hub, node, m): the distinct star edges of all buckets, each hub with itself too; m is how many the hub has.

    The hub of a bucket is its member that shares buckets with most others, of equal ones the smallest id: in a family of
    edited copies that is one near their origin, which most of them are linked with.
    """
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(anew(F.col("bucket")).alias("b0"), "size")
    shared = cut(members.join(sizes, anew(F.col("bucket")) == F.col("b0")).select("bucket", "node", "size"))
    weight = shared.groupBy(F.col("node").alias("of")).agg(F.sum("size").alias("weight"))
    weighed = shared.select("bucket", "node").join(weight, F.col("node") == F.col("of"))
    best = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"))).alias("best"))
    hubs = best.select(anew(F.col("bucket")).alias("b0"), (-F.col("best.less")).alias("hub"))
    edges = shared.select("bucket", "node").join(hubs, anew(F.col("bucket")) == F.col("b0")).select("hub", "node").distinct()
    counts = edges.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(anew(F.col("hub")).alias("h0"), "m")
    return cut(edges.join(counts, anew(F.col("hub")) == F.col("h0")).select("hub", "node", "m"))


def _parts(m: str | Column) -> Column:
    return F.ceil((F.col(m) if isinstance(m, str) else m) / BLOCK).cast("int")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def near_duplicates(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component), a row for each row of docs; component is the smallest id that links reach."""
    keyed = docs.select(docs[key].cast("bigint").alias("key"), text_or_empty(docs, text).alias("the_text"))
    sets = cut(signatures(keyed, n))
    filled = sets.filter("n_shingles > 0 AND key IS NOT NULL")
    nodes = cut(filled.groupBy("d1", "d2").agg(F.min("key").alias("node"), F.first("bands").alias("bands")))
    stars = _stars(nodes)
    # they grow with the input, so they're never broadcast, though a gathered table's size is known and small ones would be
    wanted = stars.select(F.col("node").alias("want")).distinct().hint("merge")
    packed = keyed.filter("key IS NOT NULL").select("key", "the_text").mapInArrow(_pack, "key bigint, blob binary")
    texts = cut(packed.join(wanted, F.col("key") == F.col("want"), "left_semi"))
    # each block of a star with its hub: all pairs of a block are compared at once, as its texts are there
    own = F.when(F.col("hub") == F.col("node"), F.sequence(F.lit(0), _parts("m") - 1)).otherwise(F.array(_dealt(_parts("m"))))
    first = stars.select("hub", F.explode(own).alias("task"), "node", F.lit(2).alias("side"))
    labels = components(_confirm(first, texts, n), gather=True).select(F.col("node").alias("of"), "component")
    # what a larger star has outside its hub's component by now may link with members of other blocks
    large = stars.filter(F.col("m") > BLOCK).join(labels, F.col("node") == F.col("of"), "left").select("hub", "node", "m", F.coalesce("component", "node").alias("component"))
    centre = large.filter("hub = node").select(F.col("hub").alias("h0"), F.col("component").alias("theirs"))
    judged = cut(large.join(centre, F.col("hub") == F.col("h0")).select("hub", "node", "m", (F.col("component") != F.col("theirs")).alias("apart")))
    if not judged.filter("apart").isEmpty():
        open_stars = judged.filter("apart").select("hub").distinct().select(anew(F.col("hub")).alias("h1"))
        able = _able(judged.join(open_stars, anew(F.col("hub")) == F.col("h1"), "left_semi"), texts, n)
        sizes = able.groupBy("hub").agg(F.count(F.lit(1)).alias("all"), F.count_if("apart").alias("k")).filter("k > 0").select(anew(F.col("hub")).alias("h1"), "all", "k")
        both = able.join(sizes, anew(F.col("hub")) == F.col("h1"))
        places, own = _parts("all"), _parts("k")
        rows = both.filter("apart").select("hub", "node", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), places - 1)).alias("j"), _dealt(own).alias("i"))
        columns = both.select("hub", "node", F.lit(1).alias("side"), _dealt(places).alias("j"), F.explode(F.sequence(F.lit(0), own - 1)).alias("i"))
        second = rows.unionByName(columns).select("hub", (F.col("i").cast("bigint") * (1 << 31) + F.col("j")).alias("task"), "node", "side")
        so_far = labels.select(F.col("of").alias("a"), F.col("component").alias("b"))
        labels = components(so_far.union(_confirm(second, texts, n)), gather=True).select(F.col("node").alias("of"), "component")
    groups = nodes.select("d1", "d2", "node").join(labels, F.col("node") == F.col("of"), "left")
    groups = groups.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "node").alias("component"))
    rows = sets.select("key", "n_shingles", "d1", "d2")
    at = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") > 0) & F.col("key").isNotNull()
    return rows.join(groups, at, "left").select("key", "n_shingles", F.coalesce("component", "key").alias("component"))


def keep_one(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, that of its smallest id, with the columns of docs.

    Of rows that share an id one stays. Rows without an id are linked like others; they come after all ids, by a hash of their
    text, which rows of equal text share.
    """
    own, kept, rows = (free_name(docs, x) for x in ("the_key", "kept_key", "kept_rows"))
    unnamed = F.lit(1 << 62) + F.xxhash64(text_or_empty(docs, text)).bitwiseAND(F.lit((1 << 62) - 1))
    named = docs.withColumn(own, F.coalesce(docs[key].cast("bigint"), unnamed))
    found = near_duplicates(named, n, own, text).filter("component = key")
    first = cut(found.groupBy(F.col("key").alias(kept)).agg(F.count(F.lit(1)).alias(rows)))
    chosen = named.join(first, F.col(own) == F.col(kept))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if first.filter(F.col(rows) > 1).isEmpty():
        return chosen.select(*columns)
    one = chosen.filter(F.col(rows) > 1).groupBy(own).agg(F.first(F.struct(*columns)).alias("the_row"))
    return chosen.filter(F.col(rows) == 1).select(*columns).union(one.select("the_row.*"))
