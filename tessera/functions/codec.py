"""Integer codecs for posting blocks: unary, variable byte, gaps. Off by default: Parquet encodes integers itself.

The byte layouts are fixed by the published formats and must round-trip exactly. Unary writes x as x-1 ones and a zero,
high bit first, padded with zeros. Variable byte writes 7-bit groups, high group first; only the first byte of a number
has its top bit clear. Gap lists start with 1 for the first value, whose true value the block keeps as its minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unary_encode(values: Sequence[int]) -> bytes:
    """Any value below 1 makes the whole result empty, and so does an empty list."""
    array = np.asarray(values, dtype=np.int64)
    if array.size == 0 or (array < 1).any():
        return b""
    bits = np.ones(int(array.sum()), dtype=np.uint8)
    bits[np.cumsum(array) - 1] = 0
    return np.packbits(bits).tobytes()


def unary_decode(data: bytes, count: int) -> list[int]:
    """The first ``count`` values; fewer where the data ends early."""
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)) == 0)[:count]
    return np.diff(zeros, prepend=-1).tolist()


def vbyte_encode(values: Sequence[int]) -> bytes:
    """Values below 1 are left out."""
    out = bytearray()
    for value in values:
        if value is None or value < 1:
            continue
        groups = max(1, -(-int(value).bit_length() // 7))
        out.extend((value >> 7 * g & 0x7F) | (0x80 if g < groups - 1 else 0) for g in range(groups - 1, -1, -1))
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    array = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    if array.size == 0:
        return []
    starts = np.flatnonzero(array < 0x80)
    ends = np.append(starts[1:], array.size)
    position = np.arange(array.size)
    number = np.cumsum(array < 0x80) - 1
    return np.add.reduceat((array & 0x7F) << 7 * (ends[number] - 1 - position), starts).tolist()


def gap_encode(doc_ids: Sequence[int]) -> bytes:
    array = np.asarray(doc_ids, dtype=np.int64)
    if array.size == 0:
        return b""
    return vbyte_encode([1, *np.diff(array).tolist()])


def gap_decode(data: bytes, first: int) -> list[int]:
    gaps = np.asarray(vbyte_decode(data), dtype=np.int64)
    return (np.cumsum(gaps) - 1 + first).tolist() if gaps.size else []


def _column(function: Callable, kind: str) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else function(x))

    return apply


def _column2(function: Callable, kind: str) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def apply(values: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else function(a, int(b)) for a, b in zip(values, other)])

    return apply


def encode_gaps(doc_ids: Column) -> Column:
    return _column(gap_encode, "binary")(doc_ids)


def decode_gaps(data: Column, first: Column) -> Column:
    return _column2(gap_decode, "array<bigint>")(data, first)


def encode_unary(values: Column) -> Column:
    return _column(unary_encode, "binary")(values)


def decode_unary(data: Column, count: Column) -> Column:
    return _column2(unary_decode, "array<bigint>")(data, count)


def encode_vbyte(values: Column) -> Column:
    return _column(vbyte_encode, "binary")(values)


def decode_vbyte(data: Column) -> Column:
    return _column(vbyte_decode, "array<bigint>")(data)


def gaps(doc_ids: Column) -> Column:
    """Gaps of a sorted array without Python: the first is 1, the others the differences."""
    shifted = F.slice(doc_ids, F.lit(2), F.greatest(F.size(doc_ids) - 1, F.lit(0)))
    rest = F.zip_with(shifted, F.slice(doc_ids, F.lit(1), F.greatest(F.size(doc_ids) - 1, F.lit(0))), lambda a, b: a - b)
    return F.when(F.size(doc_ids) > 0, F.concat(F.array(F.lit(1).cast("bigint")), rest)).otherwise(rest)
