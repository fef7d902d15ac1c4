"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction; a vector meets all directions that exceed its bound, the score of its LISTED-th best one, so no list
is empty or long, whatever the code. Directions are products: the space is rotated at random and parted into blocks, each block has a code of random unit
vectors, and every way to take one code word of each block is a direction, so a few thousand words make millions. A list
is decoded block by block: of two ranked lists the k best sums are among the pairs of ranks (i, j), from 1, with i * j <= k.
There are DIRECTIONS for each vector, but in few dimensions no more than leave half a list in a cap of the wanted cosine:
with more of them, two vectors at that cosine would find other directions nearer and share none.

1. Equal vectors are one node with a weight, counted before the shuffle.
2. Nodes are joined on filters. A filter's nodes are cut into blocks by a hash, and each pair of blocks is one group, so none
   holds more than two blocks, however many nodes meet a filter. Groups are dealt out to tasks by a hash of their
   directions' first words, which a vector's directions have in common; a node goes once to each task that has groups of it,
   and there are as many tasks as keep what one holds at about TASK_BYTES.
3. Each group is verified by cosines in double precision. A pair counts at the smallest filter that both have, so once; no
   pairs leave a task, only how many links each node has in a group, and its least node by links within the group.
4. Those make components.

Defined results: vectors that are null, empty or zero or hold a null, a NaN or an infinity link with nothing; vectors of
different lengths aren't linked with each other. Equal vectors link. Rows that share an id, or have none, are vectors of their
own; the component is the least id there, null if no vector of it has one. Ids are whole numbers. An empty table gives an
empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered
from .components import components

COSINE = 0.95
#: Directions for each vector, and how many a vector meets.
DIRECTIONS, LISTED = 32, 96
#: Scores of code words that are held at a time.
SCORES = 1 << 21
#: Nodes of a block; a task holds two at most.
BLOCK = 512
#: Bytes of the nodes and entries that a task of the verification holds, about, and how many entries are verified at a time.
TASK_BYTES = 3 << 25
ENTRIES = 1 << 14
#: Groups of at most so many nodes are verified together, and how many of their pairs at a time.
SMALL = 24
PAIRS = 1 << 15
SEED = 11


class Code:
    """A product code of blocks * words code words for vectors of length d."""

    def __init__(self, d: int, directions: int):
        rng = np.random.Generator(np.random.PCG64([SEED, d]))
        # blocks of few dimensions and codes of few words spread the directions unevenly
        self.blocks = min(max(1, d // 4), 2 if directions <= 1 << 30 or d < 24 else 3 if directions <= 1 << 40 else 4)
        self.words = max(2, math.ceil(directions ** (1 / self.blocks)))
        # directions of one band share the first words, so a vector's are in fewer bands than there are of them
        self.band = math.isqrt(self.words**self.blocks) if self.blocks > 1 else 1
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.edges = [d * b // self.blocks for b in range(self.blocks + 1)]
        self.code = []
        for a, b in zip(self.edges, self.edges[1:]):
            c = rng.standard_normal((self.words, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def best(self, unit: np.ndarray, listed: int = LISTED) -> np.ndarray:
        """For each unit vector the sorted numbers of the directions that score highest, a row of listed (or all) numbers."""
        step = max(1, SCORES // self.words)
        return np.concatenate([self._best(unit[k : k + step] @ self.turn, listed) for k in range(0, len(unit), step)])

    def _best(self, turned: np.ndarray, listed: int) -> np.ndarray:
        sums, ids = np.zeros((len(turned), 1)), np.zeros((len(turned), 1), np.int64)
        for a, b, c in zip(self.edges, self.edges[1:], self.code):
            scores, words = _ranked(turned[:, a:b] @ c.T, listed)
            i, j = np.array([(i, j) for i in range(sums.shape[1]) for j in range(min(scores.shape[1], listed // (i + 1)))]).T
            sums, at = _ranked(sums[:, i] + scores[:, j], listed)
            ids = np.take_along_axis(ids[:, i] * self.words + words[:, j], at, 1)
        return np.sort(ids, axis=1)


def _ranked(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores of each row in falling order, at most so many, and their places."""
    if scores.shape[1] > most:
        at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1), 1)
    return np.take_along_axis(scores, at, 1), at


def cap_share(d: int, cosine: float) -> float:
    """The share of the sphere within a cosine of a point."""
    if d == 1:
        return 0.5
    angles = np.linspace(0, math.pi, 20001)
    density = np.sin((angles[1:] + angles[:-1]) / 2) ** (d - 2)
    return float(density[angles[1:] <= math.acos(max(-1.0, min(1.0, cosine)))].sum() / density.sum())


@lru_cache(4)
def code(d: int, directions: int, cosine: float = COSINE) -> Code:
    most = LISTED / 2
    if (share := cap_share(d, cosine)) * directions > most:
        directions = max(LISTED, math.ceil(most / share))
    return Code(d, directions)


def _normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numbers(directions: int) -> str:
    """The type of the directions' numbers; codes have a few more than asked for, as all blocks have equally many words."""
    return "int" if directions <= 1 << 30 else "bigint"


def _tasks(nodes: int, copies: float, entries: int, length: float, kind: str, most: int) -> int:
    """Among how many tasks groups are dealt: most, or fewer if they have little, or more if they hold beyond TASK_BYTES. copies: of
    how many bands a node has groups."""
    node, tasks = length * np.dtype(kind).itemsize + 8 * LISTED + 64, max(1, min(most, math.ceil(entries / (4 * ENTRIES))))
    while nodes * -math.expm1(-copies / tasks) * node + entries / tasks * 64 > TASK_BYTES:
        tasks += math.ceil(tasks / 8)
    return tasks


def _listed(directions: int, kind: str, cosine: float = COSINE):
    """kind: the type in which vectors go on, the one that they had."""
    numbers = pa.list_(pa.int32() if _numbers(directions) == "int" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column(2).to_pylist()]
            lists: list = [None] * len(vectors)
            bands: list = [1] * len(vectors)
            for d in {len(v) for v in vectors}:
                rows = [k for k, v in enumerate(vectors) if len(v) == d]
                x = _normalised(np.stack([vectors[k] for k in rows]))
                made = code(d, directions, cosine)
                for k, ids in zip(rows, made.best(x)):
                    lists[k], bands[k] = ids, made.band
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, vectors)), pa.int32()), pa.array([v.astype(kind).tobytes() for v in vectors], pa.binary()), pa.array(lists, numbers), pa.array(bands, pa.int64())],
                ["node", "weight", "d", "vector", "filters", "band"],
            )

    return run


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links (i, j) reach."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, i, label[j])
        np.minimum.at(lower, j, label[i])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _unshared(group: np.ndarray, lists: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j), each of rows of one group, have no element of their lists in common."""
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    values = lists.flatten().to_numpy()
    order = np.lexsort((values, group[row]))
    row, of, values = row[order], group[row][order], values[order]
    fresh = np.append(True, (of[1:] != of[:-1]) | (values[1:] != values[:-1]))[: len(row)]
    number = np.cumsum(fresh) - 1  # of the element, over all groups; then within its group
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(row)])
    column = number - np.repeat(number[first], np.diff(np.append(first, len(row))))
    bits = np.zeros((len(sizes), (int(column.max(initial=0)) + 64) // 64), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    step = max(1, PAIRS // bits.shape[1])
    parts = [~(bits[i[k : k + step]] & bits[j[k : k + step]]).any(axis=1) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _candidates(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group, a bounded number at a time."""
    for m in np.unique(sizes).tolist():
        left, right = np.triu_indices(m, 1)
        of, step = starts[sizes == m], max(1, PAIRS // max(1, len(left)))
        for k in range(0, len(of), step) if m > 1 else ():
            base = of[k : k + step, None]
            yield (base + left).ravel(), (base + right).ravel()


class _Nodes:
    """The nodes of a task whose vectors have one length, and their entries."""

    def __init__(self, kind: str):
        self.kind, self.parts = kind, []

    def add(self, rows: pa.RecordBatch) -> None:
        """Keeps what is needed of the rows in arrays, so that a task doesn't hold its batches too."""
        vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), self.kind).reshape(rows.num_rows, -1)
        filters = rows.column("filters").flatten().to_numpy().reshape(rows.num_rows, -1)
        met = rows.column("met")
        row = np.repeat(np.arange(rows.num_rows, dtype=np.int32), met.value_lengths().to_numpy())
        held = [rows.column("node").to_numpy(), rows.column("weight").to_numpy(), vectors, filters, row, *(x.to_numpy() for x in met.flatten().flatten())]
        self.parts.append([x.copy() for x in held])

    def entries(self) -> list[np.ndarray]:
        """(row, filter, low, high, mine) of each filter that a node meets here, by filter, blocks and node."""
        first = 0
        for part in self.parts:
            part[4] += first
            first += len(part[0])
        columns = [np.concatenate([part.pop() for part in self.parts]) for _ in range(9)][::-1]  # popped, so that parts go as they are joined
        self.node, self.weight, self.vectors, self.filters, row, number, low, high, mine = columns
        order = np.lexsort((self.node[row], high, low, number))
        return [x[order] for x in (row, number, low, high, mine)]

    def before(self, row: np.ndarray, number: np.ndarray) -> pa.ListArray:
        """Of each row the filters before the one of this number."""
        filters = self.filters[row]
        lower = filters < number[:, None]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lower.sum(axis=1))), pa.int32()), pa.array(filters[lower]))


def _verify(cosine: float, kind: str):
    def linked(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, apart: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows i < j of pairs that reach the cosine; apart: only those of different blocks count."""
        found = [np.zeros((2, 0), np.int64)]
        for i, j in _candidates(starts[sizes <= SMALL], sizes[sizes <= SMALL]):
            chosen = np.einsum("kd,kd->k", x[i], x[j]) >= cosine
            found.append(np.stack([i[chosen], j[chosen]]))
        for a, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found.append(np.stack(np.nonzero(np.triu(x[a : a + m] @ x[a : a + m].T >= cosine, 1))) + a)
        i, j = np.concatenate(found, axis=1)
        chosen = ~apart[i] | (mine[i] != mine[j])
        return i[chosen], j[chosen]

    def groups(nodes: _Nodes, row: np.ndarray, number: np.ndarray, mine: np.ndarray, apart: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
        """Links of whole groups of nodes, each in the order of its nodes; starts are their first places, number is each one's filter."""
        sizes = np.diff(np.append(starts, len(row)))
        group = np.repeat(np.arange(len(starts)), sizes)
        node = nodes.node[row]
        i, j = linked(_normalised(nodes.vectors[row].astype(float)), starts, sizes, apart, mine)
        if not len(i):
            return None
        label = _lowest(len(node), i, j)
        # only rows of pairs need their other filters
        held, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        p, q = place[: len(i)], place[len(i) :]
        links, weight = np.zeros(len(held)), nodes.weight[row[held]].astype(float)
        wide = sizes[group[held]] > SMALL
        lists = nodes.before(row[held], number[held])
        for rows in [np.flatnonzero(~wide), *(np.flatnonzero(group[held] == g) for g in np.unique(group[held][wide]))]:
            at = np.full(len(held), -1)
            at[rows] = np.arange(len(rows))
            own = at[p] >= 0
            new = np.zeros(len(p), bool)
            new[own] = _unshared(group[held][rows], lists.take(pa.array(rows)), at[p[own]], at[q[own]])
            links += np.bincount(p[new], weight[q[new]], len(held)) + np.bincount(q[new], weight[p[new]], len(held))
        keep = (label[held] != held) | (links > 0)
        rows = held[keep]
        return pa.RecordBatch.from_arrays([pa.array(node[rows], pa.int64()), pa.array(links[keep].astype(np.int64)), pa.array(node[label[rows]], pa.int64())], ["node", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, _Nodes] = {}
        for batch in batches:
            for d in pc.unique(batch.column("d")).to_pylist():
                by_length.setdefault(d, _Nodes(kind)).add(batch.filter(pc.equal(batch.column("d"), d)))
        for d in sorted(by_length):
            nodes = by_length.pop(d)
            row, number, low, high, mine = nodes.entries()
            starts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            ends, a = np.append(starts, len(row)), 0
            while a < len(starts):  # whole groups, ENTRIES at a time or one
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1)
                k = slice(int(ends[a]), int(ends[b]))
                if result := groups(nodes, row[k], number[k], mine[k], low[k] != high[k], starts[a:b] - starts[a]):
                    yield result
                a = b

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component), a row for each row of vectors."""
    values = F.transform(vectors[vector], lambda v: v.cast("double"))
    rows = vectors.select(vectors[key].cast("bigint").alias("key"), values.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("v").isNotNull() & finite, F.lit(False))
    rows = rows.select("key", F.when(usable, F.col("v")).alias("v"))
    rows = rows.select("key", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))
    classes = rows.filter("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = gathered(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes, length = classes.agg(F.count(F.lit(1)), F.avg(F.size("v"))).first()
    directions = max(4096, DIRECTIONS * nodes)
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    fields = f"node bigint, weight bigint, d int, vector binary, filters array<{_numbers(directions)}>, band bigint"
    listed = cut(classes.select("node", "weight", "v").mapInArrow(_listed(directions, kind, cosine), fields))
    entries = listed.select("node", "d", "band", F.explode("filters").alias("filter"))  # each length has filters of its own
    sizes = gathered(entries.groupBy("d", "filter").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    met = sizes.agg(F.sum(F.col("m") * parts)).first()[0] or 0
    copies = listed.agg(F.avg(F.size(F.array_distinct(F.transform("filters", lambda f: F.floor(f / F.col("band"))))))).first()[0] or 0
    copies *= max(1, met / (LISTED * max(1, nodes)))  # a node of many blocks meets those of each filter
    tasks = _tasks(nodes, copies, met, length or 0, kind, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = entries.join(sizes, ["d", "filter"]).select("d", "filter", "band", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("mine"), parts.alias("parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("d", "filter", "band", "node", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    task = F.pmod(F.xxhash64("d", F.floor(F.col("filter") / F.col("band")), "low", "high"), F.lit(tasks)).cast("int")
    dealt = dealt.select("node", task.alias("task"), F.struct("filter", "low", "high", "mine").alias("entry")).repartition("node")
    full = dealt.groupBy("node", "task").agg(F.collect_list("entry").alias("met")).join(listed.drop("band"), "node")
    full = full.repartitionById(tasks, "task").select("node", "weight", "d", "vector", "filters", "met")
    found = gathered(full.mapInArrow(_verify(cosine, kind), "node bigint, links bigint, low bigint"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), gather=True)
    of = classes.select("k1", "k2", "node", "first", "weight").join(linked, "node", "left")
    of = of.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
    of = of.join(least, F.col("component") == F.col("c"))
    of = of.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    at = (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")) & F.col("v").isNotNull()
    return gathered(rows.join(of, at, "left").select("key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "key").alias("component")))
