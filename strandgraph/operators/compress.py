"""Compressed adjacency lists in five formats, node by node inside chunks of successive ids.

``G`` gaps; ``CL`` a reference list with a copy mask, then residuals; ``CB`` the mask as run lengths; ``I`` also intervals;
``final`` also each list's size before it. Lists refer to one of the ws lists before them that aren't empty, in chains of at
most mrc; as that is a recurrence, it runs in order inside a chunk, and the window starts anew at each chunk. One chunk for all
ids gives one stream; more chunks make it parallel, with the same result for the same chunk size.
"""

from __future__ import annotations

import json
from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitcodes import decode, encoder, pack, unpack
from ..functions.codes import Code, code
from . import basics
from .ordering import running_sum

SECTIONS = {"G": ("residuals",), "CL": ("reference", "residuals"), "CB": ("reference", "block_count", "blocks", "residuals"), "I": ("reference", "block_count", "blocks", "intervals", "residuals"), "final": ("size", "reference", "block_count", "blocks", "intervals", "residuals")}
DEFAULT_CODES = {"size": "gamma", "reference": "delta", "block_count": "gamma", "blocks": "nibble", "intervals": "zeta3", "residuals": "zeta2"}
CHUNK = 1 << 14


@dataclass(frozen=True)
class Format:
    """How lists are written. ws: lists to look back; mrc: longest chain; th: shortest interval; jump: ids for an index entry."""

    variant: str = "final"
    codes: dict[str, str] = field(default_factory=dict)
    ws: int = 7
    mrc: int = 3
    th: int = 3
    jump: int = 100
    chunk: int = CHUNK

    def __post_init__(self) -> None:
        if self.variant not in SECTIONS:
            raise ValueError(f"no variant {self.variant!r}; there are {', '.join(SECTIONS)}")
        for name, low in (("ws", 1), ("mrc", 1), ("th", 2), ("jump", 1), ("chunk", 1)):
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be {low} or more")
        if strange := set(self.codes) - set(SECTIONS[self.variant]):
            raise ValueError(f"variant {self.variant} has no section {', '.join(sorted(strange))}")
        for name in SECTIONS[self.variant]:
            self.code(name)

    def code(self, section: str) -> Code:
        return code(self.codes.get(section, DEFAULT_CODES[section]))


def _zigzag(a: int, b: int) -> int:
    return 2 * (b - a) if b >= a else 2 * (a - b) - 1


def _unzigzag(a: int, x: int) -> int:
    return a - (x + 1) // 2 if x & 1 else a + x // 2


@dataclass
class Encoded:
    """A written list. order: its elements as a reader gets them, copied ones first, then intervals, then residuals."""

    bits: str
    reference: int = 0
    chain: int = 0
    copied: int = 0
    mask: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)
    rest: list[int] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    sections: dict[str, int] = field(default_factory=dict)


class Writer:
    """Writes lists in ascending order of their nodes; remembers the last ws that weren't empty."""

    def __init__(self, fmt: Format):
        self.fmt = fmt
        self.put = {s: encoder(fmt.code(s)) for s in SECTIONS[fmt.variant]}
        self.window: deque = deque(maxlen=fmt.ws)

    def _gaps(self, node: int, succ: list[int]) -> str:
        if not succ:
            return ""
        put = self.put["residuals"]
        return put(_zigzag(node, succ[0])) + "".join([put(x - before - 1) for before, x in zip(succ, succ[1:])])

    def _reference(self, own: set[int]) -> tuple | None:
        best, score = None, 0
        for entry in self.window:  # oldest first
            if entry[3] >= self.fmt.mrc:
                break
            common = len(own & entry[1])
            if common > score:
                best, score = entry, common
        return best

    def write(self, node: int, succ: list[int]) -> Encoded:
        variant, put = self.fmt.variant, self.put
        if not succ:
            empty = put["size"](0) if variant == "final" else ""
            return Encoded(empty, sections={"size": len(empty)})
        if variant == "G":
            bits = self._gaps(node, succ)
            return Encoded(bits, rest=succ, order=succ, sections={"residuals": len(bits)})
        own = set(succ)
        found = self._reference(own)
        out = Encoded("")
        parts = {"reference": put["reference"](node - found[0] if found else 0)}
        kept: list[int] = []
        if found:
            out.reference, out.chain = node - found[0], found[3] + 1
            out.mask = [int(x in own) for x in found[2]]
            kept = [x for x in found[2] if x in own]
            out.copied = len(kept)
            runs, value = [0], 1
            for bit in out.mask:
                if bit == value:
                    runs[-1] += 1
                else:
                    runs.append(1)
                    value = bit
            out.blocks = runs
            if variant == "CL":
                parts["blocks"] = "".join(map(str, out.mask))
            else:
                parts["block_count"] = put["block_count"](len(runs))
                parts["blocks"] = "".join(map(put["blocks"], runs[:-1]))  # the last one is what is left
        taken = set(kept)
        rest = [x for x in succ if x not in taken]
        if variant in ("I", "final"):
            out.runs, rest = self._runs(rest)
            parts["intervals"] = self._intervals(node, out.runs)
        out.rest = rest
        parts["residuals"] = self._gaps(node, rest)
        body = "".join(parts.get(s, "") for s in ("reference", "block_count", "blocks", "intervals", "residuals"))
        if variant == "final":
            parts["size"] = put["size"](len(body))
            body = parts["size"] + body
        out.bits, out.sections = body, {s: len(b) for s, b in parts.items()}
        out.order = kept + [x for a, b in out.runs for x in range(a, b + 1)] + rest
        self.window.append((node, own, out.order, out.chain))
        return out

    def _runs(self, rest: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        runs, left, a = [], [], 0
        for k in range(1, len(rest) + 1):
            if k == len(rest) or rest[k] != rest[k - 1] + 1:
                if k - a >= self.fmt.th:
                    runs.append((rest[a], rest[k - 1]))
                else:
                    left += rest[a:k]
                a = k
        return runs, left

    def _intervals(self, node: int, runs: list[tuple[int, int]]) -> str:
        put = self.put["intervals"]
        if not runs:
            return put(0)
        lefts = [abs(runs[0][0] - node)] + [b[0] - a[1] - 2 for a, b in zip(runs, runs[1:])]
        return put(len(runs)) + str(int(runs[0][0] < node)) + "".join(map(put, lefts)) + "".join(put(b - a + 1 - self.fmt.th) for a, b in runs)


class Reader:
    """Reads lists in ascending order of their nodes; keeps the last ws that weren't empty."""

    def __init__(self, fmt: Format):
        self.fmt = fmt
        self.codes = {s: fmt.code(s) for s in SECTIONS[fmt.variant]}
        self.window: OrderedDict[int, list[int]] = OrderedDict()

    def reference(self, bits: str) -> int:
        """How far back the list refers, 0 if to none."""
        at = 0
        if self.fmt.variant == "final":
            size, at = decode(bits, at, self.codes["size"])
            if not size:
                return 0
        return decode(bits, at, self.codes["reference"])[0] if self.fmt.variant != "G" else 0

    def read(self, node: int, bits: str) -> list[int]:
        """The list in decoded order."""
        fmt, codes = self.fmt, self.codes
        at, end = 0, len(bits)

        def get(section: str) -> int:
            nonlocal at
            value, at = decode(bits, at, codes[section])
            return value

        if fmt.variant == "final":
            size = get("size")
            end = at + size
        if at == end:
            return []
        out: list[int] = []
        if fmt.variant != "G" and (back := get("reference")):
            source = self.window[node - back]
            if fmt.variant == "CL":
                mask = bits[at : at + len(source)]
                at += len(source)
                out = [x for x, bit in zip(source, mask) if bit == "1"]
            else:
                runs = [get("blocks") for _ in range(get("block_count") - 1)]
                runs.append(len(source) - sum(runs))
                place = 0
                for k, n in enumerate(runs):
                    if k % 2 == 0:
                        out += source[place : place + n]
                    place += n
        if fmt.variant in ("I", "final") and (n := get("intervals")):
            sign = bits[at] == "1"
            at += 1
            lefts = [get("intervals") for _ in range(n)]
            high = None
            for left, size in zip(lefts, [get("intervals") + fmt.th for _ in range(n)]):
                low = (node - left if sign else node + left) if high is None else high + 2 + left
                high = low + size - 1
                out += range(low, high + 1)
        before = None
        while at < end:
            value = get("residuals")
            before = _unzigzag(node, value) if before is None else before + 1 + value
            out.append(before)
        self.window[node] = out
        if len(self.window) > fmt.ws:
            self.window.popitem(last=False)
        return out


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column without nulls; faster than its to_pylist()."""
    ends = column.offsets.to_numpy()
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist()
    ends = (ends - ends[0]).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _write_chunks(fmt: Format):
    names = ("size", "reference", "block_count", "blocks", "intervals", "residuals")
    zeros = (0,) * len(names)
    types = [_ARROW.field(k).type for k in range(2, 8)] + [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, writer = None, None
        for batch in batches:
            if not len(batch):
                continue
            chunks, nodes = (batch.column(k).to_pylist() for k in range(2))
            lists = _lists(batch.column(2))
            rows = []
            for own, node, succ in zip(chunks, nodes, lists):
                if own != chunk:
                    chunk, writer = own, Writer(fmt)
                e = writer.write(node, succ)
                rows.append((len(succ), len(e.bits), pack(e.bits), node - e.reference if e.reference else None, e.chain, e.copied, *map(e.sections.get, names, zeros)))
            columns = [batch.column(0), batch.column(1), *map(pa.array, zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([*columns[:8], pa.StructArray.from_arrays(columns[8:], names)], schema=_ARROW)

    return run


_ARROW = pa.schema([("chunk", pa.int64()), ("node", pa.int64()), ("outdeg", pa.int64()), ("nbits", pa.int64()), ("bits", pa.binary()), ("ref_node", pa.int64()), ("chain", pa.int32()), ("copied", pa.int64()), ("sections", pa.struct([(s, pa.int64()) for s in ("size", "reference", "block_count", "blocks", "intervals", "residuals")]))])
_SPARK = "chunk bigint, node bigint, outdeg bigint, nbits bigint, bits binary, ref_node bigint, chain int, copied bigint, sections struct<size:bigint,reference:bigint,block_count:bigint,blocks:bigint,intervals:bigint,residuals:bigint>"


@dataclass
class Compressed:
    """A row for each id up to the greatest: (chunk, node, outdeg, nbits, bits, ref_node, chain, copied, sections)."""

    lists: DataFrame
    fmt: Format

    def decoded(self, lists: DataFrame | None = None) -> DataFrame:
        """(node, succ) with succ ascending, empty lists left out. lists: whole chunks of self.lists."""
        fmt = self.fmt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, reader = None, None
            for batch in batches:
                nodes, lists = [], []
                for own, node, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if own != chunk:
                        chunk, reader = own, Reader(fmt)
                    if succ := reader.read(node, unpack(raw, n)):
                        nodes.append(node)
                        lists.append(sorted(succ))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["node", "succ"])

        rows = (self.lists if lists is None else lists).filter("nbits > 0").select("chunk", "node", "nbits", "bits")
        return rows.repartition("chunk").sortWithinPartitions("chunk", "node").mapInArrow(run, "node bigint, succ array<bigint>")

    def edges(self) -> DataFrame:
        return self.decoded().select(F.col("node").alias("src"), F.explode("succ").alias("dst"))

    def successors(self, node: int) -> DataFrame:
        """The list of one node. Of its chunk only the list and those it refers to, mrc at most, are decoded."""
        fmt = self.fmt
        own = self.lists.filter((F.col("chunk") == node // fmt.chunk) & (F.col("node") <= node) & (F.col("nbits") > 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw = {}
            for batch in batches:
                for of, n, bits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    raw[of] = (n, bits)
            chain, reader = [], Reader(fmt)
            at = node
            while at in raw:
                chain.append((at, unpack(raw[at][1], raw[at][0])))
                back = reader.reference(chain[-1][1])
                if not back:
                    break
                at -= back
            succ: list[int] = []
            for of, bits in reversed(chain):
                succ = reader.read(of, bits)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(succ), pa.int64())], ["dst"])

        return own.select("node", "nbits", "bits").repartition(1).mapInArrow(run, "dst bigint")

    def offsets(self) -> DataFrame:
        """(node, start): the bit at which each list would start in one stream."""
        return running_sum(self.lists.select("node", "nbits"), ["node"], F.col("nbits"), "start").select("node", "start")

    def index(self) -> DataFrame:
        """The offsets of every jump-th node."""
        return self.offsets().filter(F.col("node") % self.fmt.jump == 0)

    def report(self) -> DataFrame:
        """One row: max_id, links, total bits, bytes of lists and of the index, bits a link."""
        total = self.lists.agg(F.max("node").alias("max_id"), F.sum("outdeg").alias("links"), F.sum("nbits").alias("list_bits"))
        dense = self.fmt.variant != "final"
        entries = F.col("max_id") + 2 if dense else F.floor((F.col("max_id") + 1) / self.fmt.jump) + 1
        return total.select("max_id", "links", "list_bits", F.ceil(F.col("list_bits") / 8).alias("list_bytes"), (entries * 8).cast("bigint").alias("index_bytes"), (F.col("list_bits") / F.col("links")).alias("bits_per_link"))

    def write(self, path: str) -> None:
        """Lists as Parquet under path/lists, sorted by chunk and node; the format as JSON text under path/format."""
        spark = self.lists.sparkSession
        # compress() deals chunks out by range, so files hold ranges of ids without another pass over the lists
        self.lists.sortWithinPartitions("chunk", "node").write.parquet(f"{path}/lists")
        spark.createDataFrame([(json.dumps(asdict(self.fmt), sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/format")


def compress(edges: DataFrame, fmt: Format | None = None, **options) -> Compressed:
    """Compress links (src, dst). options are those of Format."""
    fmt = fmt or Format(**options)
    ids = basics.num_ids(edges)
    lists = basics.adjacency_filled(edges, ids).select(F.expr(f"node div {fmt.chunk}").alias("chunk"), "node", "succ")
    chunks = max(1, -(-ids // fmt.chunk))
    parts = min(chunks, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.floor(F.col("chunk") / F.lit(chunks) * parts).cast("int")  # successive chunks share a partition, so none needs a sample
    dealt = lists.repartitionById(parts, own).sortWithinPartitions("chunk", "node")
    return Compressed(dealt.mapInArrow(_write_chunks(fmt), _SPARK), fmt)


def open_compressed(spark: SparkSession, path: str) -> Compressed:
    fmt = Format(**json.loads(spark.read.text(f"{path}/format").first()["value"]))
    return Compressed(spark.read.parquet(f"{path}/lists"), fmt)
