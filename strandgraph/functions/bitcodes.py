"""The same integer codes in Python, for what is sequential: each code word starts where the one before it ended."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from .codes import Code, code


def _gamma(v: int) -> str:
    return f"{'0' * v.bit_length()}{v:b}" if v else "1"


def encode(v: int, c: Code) -> str:
    if v < 0:
        raise ValueError("codes hold natural numbers only")
    if c.name == "unary":
        return "0" * v + "1"
    if c.name == "gamma":
        return _gamma(v)
    if c.name == "delta":
        return _gamma(v.bit_length()) + f"{v:b}"[1:] if v else "1"
    if c.name == "nibble":
        octal = f"{v:o}"
        return "".join(f"{int(k == len(octal) - 1)}{int(d):03b}" for k, d in enumerate(octal))
    h = ((v + 1).bit_length() - 1) // c.k
    low, size = 1 << h * c.k, (h + 1) * c.k
    y = v + 1 - low
    tail = (f"{y:0{size - 1}b}" if size > 1 else "") if y < low else f"{y + low:0{size}b}"
    return "0" * h + "1" + tail


class _Words(dict):
    """The words of a code by value; those of small values are kept, so that they are one lookup."""

    def __init__(self, spec: Code):
        super().__init__()
        self.spec = spec

    def __missing__(self, v: int) -> str:
        word = encode(v, self.spec)
        if v < 1 << 16:
            self[v] = word
        return word


@lru_cache(None)
def encoder(spec: Code) -> Callable[[int], str]:
    """encode() for one code, with the words of small values kept."""
    return _Words(spec).__getitem__


def _zeros(bits: str, at: int) -> int:
    return bits.index("1", at) - at


def _read_gamma(bits: str, at: int) -> tuple[int, int]:
    n = _zeros(bits, at)
    return (int(bits[at + n : at + 2 * n], 2), at + 2 * n) if n else (0, at + 1)


def decode(bits: str, at: int, c: Code) -> tuple[int, int]:
    """(value, where the next word starts)."""
    if c.name == "unary":
        n = _zeros(bits, at)
        return n, at + n + 1
    if c.name == "gamma":
        return _read_gamma(bits, at)
    if c.name == "delta":
        n, at = _read_gamma(bits, at)
        return (int("1" + bits[at : at + n - 1], 2), at + n - 1) if n else (0, at)
    if c.name == "nibble":
        v = 0
        while True:
            v, last, at = v << 3 | int(bits[at + 1 : at + 4], 2), bits[at] == "1", at + 4
            if last:
                return v, at
    h = _zeros(bits, at)
    at += h + 1
    low, size = 1 << h * c.k, (h + 1) * c.k
    y = int(bits[at : at + size - 1] or "0", 2)
    if y < low:
        return y + low - 1, at + size - 1
    return int(bits[at : at + size], 2) - 1, at + size


def pack(bits: str) -> bytes:
    """First bit in the lowest place of the first byte."""
    return int(bits[::-1] or "0", 2).to_bytes((len(bits) + 7) // 8, "little")


def unpack(raw: bytes, n: int) -> str:
    """The first n bits of raw."""
    return f"{int.from_bytes(raw, 'little'):0{8 * len(raw)}b}"[::-1][:n] if n else ""


__all__ = ["Code", "code", "decode", "encode", "encoder", "pack", "unpack"]
