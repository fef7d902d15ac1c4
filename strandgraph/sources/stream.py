"""Compressed lists as one binary file: codes, sizes, offsets and one stream of bits, all whole numbers little-endian.

The file doesn't say its variant, nor (but for ``final``) how far references look back, so both are given when it is read. It is
one stream whose lists refer to each other, so it is read in one task. Its bits are joined to blocks of many lists by the
executors; the driver only lines the blocks up, one at a time, as a file has one writer. The Parquet form of compress.py is
the one that scales. Lists compressed in chunks make a valid stream too, as references
stay inside a chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitcodes import decode, pack, unpack
from ..functions.codes import Code
from ..operators.compress import Compressed, Format
from ..operators.ordering import cut

# Fixed values of the file format: code numbers, the codes at the head of each variant, the 64-bit numbers after them.
CODE_NUMBERS = ("unary", "gamma", "delta", "nibble", "zeta")
HEADS = {
    "G": ("residuals",),
    "CL": ("reference", None, "residuals"),
    "CB": ("reference", "block_count", "blocks", "residuals"),
    "I": ("reference", "block_count", "blocks", "intervals", "residuals", None),
    "final": ("size", "reference", "block_count", "blocks", "intervals", "residuals"),
}
NUMBERS = {v: ("max_id", "links", "bytes") for v in ("G", "CL", "CB")} | {
    "I": ("max_id", "links", "max_degree", "bytes", "th"),
    "final": ("max_id", "links", "max_degree", "bytes", "entries", "ws", "jump", "th"),
}


def _head(fmt: Format) -> bytes:
    out = bytearray()
    for section in HEADS[fmt.variant]:
        c = fmt.code(section) if section else Code("unary")
        out.append(CODE_NUMBERS.index(c.name))
        if c.k:
            out.append(c.k)
    return bytes(out)


def _parse(raw: bytes, variant: str) -> tuple[dict[str, str], dict[str, int], int]:
    """(codes, numbers, where the offsets start)."""
    at, codes = 0, {}
    for section in HEADS[variant]:
        name, at = CODE_NUMBERS[raw[at]], at + 1
        k = ""
        if name == "zeta":
            k, at = raw[at], at + 1
        if section:
            codes[section] = f"{name}{k}"
    names = NUMBERS[variant]
    return codes, dict(zip(names, struct.unpack_from(f"<{len(names)}Q", raw, at))), at + 8 * len(names)


#: Bits of a block of lists, about.
BLOCK_BITS = 1 << 22


def _blocks(step: int):
    """Sorted lists (node, nbits, bits) to blocks (first, nbits, bits, starts); starts are those of the nodes that step divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = (batch.column(k).to_numpy() for k in range(2))
            ends = np.cumsum(sizes)
            borders = [0, *(np.flatnonzero(np.diff(ends // BLOCK_BITS)) + 1).tolist(), len(nodes)]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                bits = "".join(map(unpack, batch.column(2).slice(a, b - a).to_pylist(), sizes[a:b].tolist()))
                starts = (ends[a:b] - sizes[a:b] - (ends[a] - sizes[a]))[nodes[a:b] % step == 0]
                row = {"first": int(nodes[a]), "nbits": len(bits), "bits": pack(bits), "starts": starts.astype("<i8").tobytes()}
                yield pa.RecordBatch.from_pylist([row])

    return run


def write_stream(lists: Compressed, path: str) -> None:
    """One file at path, which mustn't be there yet; any file system that Spark knows."""
    fmt, spark = lists.fmt, lists.lists.sparkSession
    made = cut(lists.lists.select("node", "outdeg", "nbits", "bits"))
    total = made.agg(F.max("node").alias("max_id"), F.sum("outdeg").alias("links"), F.max("outdeg").alias("max_degree"), F.sum("nbits").alias("bits")).first()
    if total["max_id"] is None:
        raise ValueError("there are no lists to write")
    step = fmt.jump if fmt.variant == "final" else 1
    known = total.asDict() | {"bytes": (total["bits"] + 7) // 8, "entries": (total["max_id"] + 1) // fmt.jump + 1, "ws": fmt.ws, "jump": fmt.jump, "th": fmt.th}
    ordered = made.select("node", "nbits", "bits").orderBy("node")
    blocks = cut(ordered.mapInArrow(_blocks(step), "first bigint, nbits bigint, bits binary, starts binary"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(_head(fmt) + struct.pack(f"<{len(NUMBERS[fmt.variant])}Q", *(known[n] for n in NUMBERS[fmt.variant]))))
        start = 0
        for row in blocks.select("first", "nbits", "starts").orderBy("first").toLocalIterator():
            out.write(bytearray((np.frombuffer(row["starts"], "<i8") + start).astype("<u8").tobytes()))
            start += row["nbits"]
        if (total["max_id"] + 1) % step == 0:
            out.write(bytearray(struct.pack("<Q", start)))
        held, n = 0, 0
        for row in blocks.select("first", "nbits", "bits").orderBy("first").toLocalIterator():
            held |= int.from_bytes(row["bits"], "little") << n
            n += row["nbits"]
            out.write(bytearray((held & (1 << n - n % 8) - 1).to_bytes(n // 8, "little")))
            held, n = held >> n - n % 8, n % 8
        out.write(bytearray(held.to_bytes((n + 7) // 8, "little")))
    finally:
        out.close()


def read_stream(spark: SparkSession, path: str, variant: str, ws: int = 255) -> Compressed:
    """The lists of a file. Columns that the file doesn't have (degrees, references, sections) aren't in the table."""
    whole = spark.read.format("binaryFile").load(path).select("content")
    first = whole.select(F.substring("content", 1, 128).alias("head")).first()
    if first is None:
        raise FileNotFoundError(path)
    codes, numbers, start = _parse(bytes(first["head"]).ljust(128, b"\0"), variant)
    fmt = Format(variant, codes, ws=max(1, numbers.get("ws", ws)), th=numbers.get("th", 2), jump=max(1, numbers.get("jump", 100)), chunk=1 << 62)
    entries = numbers["entries"] if variant == "final" else numbers["max_id"] + 2
    size = fmt.code("size") if variant == "final" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py()
                bits = unpack(raw[start + 8 * entries :], 8 * numbers["bytes"])
                dense = None if size else struct.unpack_from(f"<{entries}Q", raw, start)
                at, rows = 0, []
                for node in range(numbers["max_id"] + 1):
                    if dense:
                        at, end = dense[node], dense[node + 1]
                    else:
                        n, body = decode(bits, at, size)
                        end = body + n
                    rows.append((0, node, end - at, pack(bits[at:end])))
                    at = end
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return Compressed(whole.mapInArrow(run, "chunk bigint, node bigint, nbits bigint, bits binary"), fmt)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "node", "nbits", "bits"])


def stream_edges(spark: SparkSession, path: str, variant: str, ws: int = 255) -> DataFrame:
    return read_stream(spark, path, variant, ws).edges()
