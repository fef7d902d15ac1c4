import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandgraph.functions import bitcodes, codes

# Code words of some numbers.
GOLDEN = {
    0: ("1", "1", "1", "1000", "1", "10", "100"),
    1: ("01", "01", "01", "1001", "010", "110", "1010"),
    2: ("001", "0010", "00100", "1010", "011", "111", "1011"),
    3: ("0001", "0011", "00101", "1011", "00100", "01000", "1100"),
    4: ("00001", "000100", "001100", "1100", "00101", "01001", "1101"),
    7: ("00000001", "000111", "001111", "1111", "0001000", "011000", "0100000"),
    8: ("000000001", "00001000", "000100000", "00011000", "0001001", "011001", "0100001"),
    15: ("0" * 15 + "1", "00001111", "000100111", "00011111", "000010000", "00100000", "01010000"),
    16: ("0" * 16 + "1", "0000010000", "0001010000", "00101000", "000010001", "00100001", "01010001"),
    100: ("0" * 100 + "1", "00000001100100", "000111100100", "000101001100", "0000001100101", "00010100101", "00100100101"),
}
NAMES = ("unary", "gamma", "delta", "nibble", "zeta1", "zeta2", "zeta3")


def test_golden_words(spark):
    df = spark.createDataFrame([(v,) for v in GOLDEN], "v bigint")
    for k, name in enumerate(NAMES):
        rows = df.select("v", codes.bits(F.col("v"), name).alias("b"), codes.length(F.col("v"), name).alias("n")).collect()
        for r in rows:
            assert r.b == GOLDEN[r.v][k] == bitcodes.encode(r.v, codes.code(name))
            assert r.n == len(r.b)


@given(st.integers(0, 1 << 62), st.sampled_from(["gamma", "delta", "nibble", *(f"zeta{k}" for k in range(1, 9))]))
def test_words_read_back(v, name):
    c = codes.code(name)
    word = bitcodes.encode(v, c)
    assert bitcodes.decode("1" + word + "0", 1, c) == (v, len(word) + 1)


@given(st.integers(0, 3000))
def test_unary_reads_back(v):
    assert bitcodes.decode(bitcodes.encode(v, codes.code("unary")), 0, codes.code("unary")) == (v, v + 1)


def test_large_values_agree(spark):
    values = [(1 << 31) - 1, 1 << 31, (1 << 40) + 5, (1 << 61) + 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for name in ("gamma", "delta", "nibble", "zeta1", "zeta3", "zeta7"):
        for r in df.select("v", codes.bits(F.col("v"), name).alias("b"), codes.length(F.col("v"), name).alias("n")).collect():
            assert r.b == bitcodes.encode(r.v, codes.code(name)) and r.n == len(r.b)


@settings(max_examples=20, deadline=None)
@given(st.text("01", max_size=70))
def test_packing(b):
    assert bitcodes.unpack(bitcodes.pack(b), len(b)) == b


def test_packed_expression(spark):
    words = ["", "1", "00000001", "101100011", "0" * 17 + "1"]
    df = spark.createDataFrame([(w,) for w in words], "b string")
    for r in df.select("b", codes.packed_hex(F.col("b")).alias("h")).collect():
        assert bytes.fromhex(r.h) == bitcodes.pack(r.b)


def test_bad_codes():
    for spec in ("zeta", "gamma3", "huffman"):
        with pytest.raises(ValueError):
            codes.code(spec)
    with pytest.raises(ValueError):
        bitcodes.encode(-1, codes.code("gamma"))


def test_zigzag(spark):
    df = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "a bigint, b bigint")
    z = df.select("a", "b", codes.zigzag(F.col("a"), F.col("b")).alias("z"))
    rows = z.select("a", "b", "z", codes.zigzag_inverse(F.col("a"), F.col("z")).alias("back")).collect()
    assert all(r.b == r.back for r in rows)
    assert {r.z for r in rows if r.a == 5} == {0, 1, 3, 5, 7, 9}
