from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epochweave.functions import codec
from epochweave.functions.keccak import EMPTY, keccak, keccak_many


@given(st.integers(0, (1 << 64) - 1))
def test_uleb(v):
    out = bytearray()
    codec.put_uleb(out, v)
    assert codec.read_uleb(bytes(out), 0) == (v, len(out))


@given(st.integers(0, (1 << 86) - 1), st.integers(0, (1 << 54) - 1))
def test_quick_codes(a, b):
    out = bytearray()
    codec.put_qc8(out, a)
    codec.put_qc5e(out, b, None)
    codec.put_qc5e(out, 0, 2)
    value, at = codec.read_qc8(bytes(out), 0)
    assert value == a
    assert codec.read_qc5e(bytes(out), at)[1] == b
    assert codec.read_qc5e(bytes(out), len(out) - 1) == (2, None, len(out))


def test_too_wide():
    with pytest.raises(ValueError):
        codec.put_qc8(bytearray(), 1 << 86)
    with pytest.raises(ValueError):
        codec.put_qc5e(bytearray(), 1 << 54, None)
    with pytest.raises(ValueError):
        codec.read_uleb(b"\x80" * 11, 0)
    with pytest.raises(ValueError):
        codec.read_uleb(b"\x80", 0)


items = st.recursive(st.binary(max_size=80), lambda x: st.lists(x, max_size=5), max_leaves=20)


@given(items)
def test_rlp(item):
    data = codec.rlp(item)
    assert codec.read_rlp(data) == (item, len(data))


def test_keccak():
    assert EMPTY.hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    messages = [b"x" * n for n in (0, 1, 135, 136, 137, 271, 272, 500)]
    assert keccak_many(messages) == [keccak(m) for m in messages]


def test_columns(spark):
    values = [0, -1, 1, -100, 100, 99998, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("z", codec.zigzag(F.col("v"))).withColumn("b", codec.unzigzag(F.col("z")))
    got = {r["v"]: r for r in df.collect()}
    assert all(r["b"] == v for v, r in got.items())
    assert got[-1]["z"] == 1 and got[1]["z"] == 2 and got[-100]["z"] == 199
    df = spark.createDataFrame([(0, b"\x01\x02"), (127, b""), (128, b"\xff" * 7)], "v bigint, b binary")
    rows = df.select(codec.uleb_length(F.col("v")).alias("n"), codec.little_endian(F.col("b")).alias("le"), F.hex(codec.padded_hash(F.lit(b"\xab\xcd\xef\x01"))).alias("h"), codec.aligned(F.col("v"), 32).alias("a")).collect()
    assert [r["n"] for r in rows] == [1, 1, 2]
    assert rows[0]["le"] == 513 and rows[2]["le"] == (1 << 56) - 1
    assert rows[0]["h"] == "ABCDEF01" + "0" * 56 and [r["a"] for r in rows] == [0, 128, 128]
    df = spark.createDataFrame([("abc", True), ("abc", False), ("ab", True), ("", True)], "p string, odd boolean")
    assert [r[0].hex() for r in df.select(codec.packed_nibbles(F.col("p"), F.col("odd"))).collect()] == ["0abc", "abc0", "0ab0", ""]


KEYS = [0, 1, 3, 4, 6502, 6503, 26_000, 27_000, 416_127, 416_129, 899_999, 2_097_151, 2_097_152, 8_999_999, 10**11 - 1]


def test_quick_code_lengths_of_wide_numbers(spark, tmp_path):
    """A thousand cubes of keys of larger tables pass 64 bits."""
    from epochweave.plans import queries

    size = lambda v: 1 if v in codec.GAS_LIMITS.values() else next((5 + m for m in range(3) if not v >> 38 + 8 * m), None)
    edges = [(1 << n) + d for n in (38, 46, 54, 62) for d in (-1, 0)] + [0, 30_000_000]
    df = spark.createDataFrame([(v,) for v in edges], "v bigint")
    assert [r[0] for r in df.select(codec.qc5e_length(F.col("v"), codec.GAS_LIMITS)).collect()] == [size(v) for v in edges]
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert dict(tuple(r) for r in queries.qc5e_length(spark, str(tmp_path)).collect()) == {k: size(30_000_000 if k % 3 == 0 else 1000 * k**3) for k in KEYS}


def test_uleb_lengths_of_wide_numbers(spark, tmp_path):
    """Cubes of keys of larger tables pass 64 bits."""
    from epochweave.plans import queries

    edges = [v for n in range(7, 57, 7) for v in ((1 << n) - 1, 1 << n)] + [0, 1, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in edges], "v bigint")
    for column in (F.col("v"), F.col("v").cast("decimal(38,0)")):
        assert [r[0] for r in df.select(codec.uleb_length(column)).collect()] == [max(1, -(-v.bit_length() // 7)) for v in edges]
    assert df.limit(1).select(codec.uleb_length(F.lit(Decimal(1 << 63)))).first()[0] == 10
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert dict(tuple(r) for r in queries.uleb_length(spark, str(tmp_path)).collect()) == {k: min(9, max(1, -(-(k**3).bit_length() // 7))) for k in KEYS}
