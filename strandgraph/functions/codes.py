"""Integer codes as Spark expressions: bit strings, lengths, packing. All stay inside code generation.

A code is a name ("unary", "gamma", "delta", "nibble", "zeta") and, for zeta, k. Bits are strings of '0' and '1', first bit
first; packed bytes hold the first bit in the lowest place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("unary", "gamma", "delta", "nibble", "zeta")
#: Unary strings of larger values aren't built; their lengths still are.
MAX_UNARY = 1 << 20


@dataclass(frozen=True)
class Code:
    name: str
    k: int = 0

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"no code {self.name!r}; there are {', '.join(NAMES)}")
        if (self.name == "zeta") != (self.k > 0):
            raise ValueError("k is positive for zeta and 0 for the others")

    def __str__(self) -> str:
        return f"{self.name}{self.k or ''}"


def code(spec: str | Code) -> Code:
    """"zeta3" or "gamma" as a Code."""
    if isinstance(spec, Code):
        return spec
    name = spec.rstrip("0123456789")
    return Code(name, int(spec[len(name) :] or 0))


def bit_length(v: Column) -> Column:
    """The binary digits of v, 1 for 0."""
    return F.length(F.bin(v))


def zigzag(a: Column, b: Column) -> Column:
    """The signed difference b - a as a natural number."""
    return F.when(b >= a, 2 * (b - a)).otherwise(2 * (a - b) - 1)


def zigzag_inverse(a: Column, x: Column) -> Column:
    return F.when(x % 2 == 0, a + F.shiftright(x, 1)).otherwise(a - F.shiftright(x + 1, 1))


def _zeros(n: Column) -> Column:
    return F.repeat(F.lit("0"), n.cast("int"))


def _low_bits(v: Column) -> Column:
    return F.substring(F.bin(v), 2, 64)


def _gamma(v: Column) -> Column:
    return F.when(v == 0, F.lit("1")).otherwise(F.concat(_zeros(bit_length(v)), F.bin(v)))


def minimal_binary(x: Column, top: Column) -> Column:
    """x in [0, top] in one bit less than top + 1 needs, where it can: the first 2**s - (top + 1) values are the short ones."""
    z = top + 1
    s = bit_length(z)
    short = _power(s) - z
    bits = F.when(x < short, F.lpad(F.bin(x), (s - 1).cast("int"), "0")).otherwise(F.lpad(F.bin(x + short), s.cast("int"), "0"))
    return F.when((x < short) & (s == 1), F.lit("")).otherwise(bits)


def _power(n: Column) -> Column:
    """2 ** n as a long, n a column."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def bits(v: Column, spec: str | Code) -> Column:
    """The code word of v."""
    c = code(spec)
    v = v.cast("bigint")
    if c.name == "unary":
        return F.when(v < MAX_UNARY, F.concat(_zeros(v), F.lit("1"))).otherwise(F.raise_error(F.lit("unary: value too large")))
    if c.name == "gamma":
        return _gamma(v)
    if c.name == "delta":
        return F.when(v == 0, F.lit("1")).otherwise(F.concat(_gamma(bit_length(v).cast("bigint")), _low_bits(v)))
    if c.name == "nibble":
        groups = F.ceil(bit_length(v) / 3).cast("int")
        padded = F.lpad(F.bin(v), groups * 3, "0")
        group = lambda i: F.concat(F.when(i == groups, "1").otherwise("0"), F.substring(padded, (i - 1) * 3 + 1, F.lit(3)))
        return F.concat_ws("", F.transform(F.sequence(F.lit(1), groups), group))
    h = F.floor((bit_length(v + 1) - 1) / c.k)
    low = _power(h * c.k)
    y, s = v + 1 - low, (h + 1) * c.k
    short = F.when(s == 1, F.lit("")).otherwise(F.lpad(F.bin(y), (s - 1).cast("int"), "0"))
    return F.concat(_zeros(h), F.lit("1"), F.when(y < low, short).otherwise(F.lpad(F.bin(y + low), s.cast("int"), "0")))


def length(v: Column, spec: str | Code) -> Column:
    """The number of bits of v's code word, without making it."""
    c = code(spec)
    v = v.cast("bigint")
    n = bit_length(v).cast("bigint")
    if c.name == "unary":
        return v + 1
    if c.name == "gamma":
        return F.when(v == 0, F.lit(1).cast("bigint")).otherwise(2 * n)
    if c.name == "delta":
        return F.when(v == 0, F.lit(1).cast("bigint")).otherwise(2 * bit_length(n).cast("bigint") + n - 1)
    if c.name == "nibble":
        return 4 * F.ceil(n / 3)
    h = F.floor((bit_length(v + 1) - 1) / c.k).cast("bigint")
    return (h + 1) * (c.k + 1) - (v + 1 < _power(h * c.k + 1)).cast("bigint")


def packed_hex(b: Column) -> Column:
    """Upper-case hex of the bytes that hold a bit string, the last one filled up with zeros."""
    byte = lambda i: F.lpad(F.conv(F.reverse(F.rpad(F.substring(b, i * 8 + 1, F.lit(8)), 8, "0")), 2, 16), 2, "0")
    count = F.ceil(F.length(b) / 8).cast("int")
    return F.when(count == 0, F.lit("")).otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), byte)))


def pack(b: Column) -> Column:
    return F.unhex(packed_hex(b))
