from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec


def test_fixed_layouts():
    assert [codec.unary_encode(x).hex() for x in ([5], [3, 5, 7], [3, 5, 7, 1, 2, 1, 2], [11, 1, 2], [1, 0], [])] == ["f0", "defc", "defc90", "ffc8", "", ""]
    assert [codec.vbyte_encode([x]).hex() for x in (5, 129, 255, 1055307)] == ["05", "0181", "01ff", "40b4cb"]
    assert codec.gap_encode([5, 7, 8, 10, 12, 24]).hex() == "01020102020c"
    assert codec.gap_encode([9]).hex() == "01"
    assert codec.gap_decode(bytes.fromhex("010101010101"), 5) == [5, 6, 7, 8, 9, 10]


@given(st.lists(st.integers(1, 10**9), max_size=40))
def test_vbyte_round_trip(values):
    assert codec.vbyte_decode(codec.vbyte_encode(values)) == values


@given(st.lists(st.integers(1, 300), min_size=1, max_size=40))
def test_unary_round_trip(values):
    assert codec.unary_decode(codec.unary_encode(values), len(values)) == values


@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=40, unique=True).map(sorted))
def test_gap_round_trip(values):
    assert codec.gap_decode(codec.gap_encode(values), values[0]) == values


def test_columns_take_nulls(spark):
    rows = spark.createDataFrame([([3, 9, 10],), ([],), (None,)], "d array<bigint>")
    got = rows.select(codec.gaps(F.col("d")).alias("g"), codec.decode_gaps(codec.encode_gaps(F.col("d")), F.coalesce(F.get("d", F.lit(0)), F.lit(0))).alias("b")).collect()
    assert [r["g"] for r in got] == [[1, 6, 1], [], None]
    assert [r["b"] for r in got] == [[3, 9, 10], [], None]
