"""Bloom filters over 64-bit keys: a bounded broadcast that spares rows without a partner a shuffle.

A filter has ``2**BITS`` bits whatever the number of keys, 4 MB. It has no false
negatives, so what it passes is joined exactly afterwards; where there are more
keys than it can tell apart, it passes more rows and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing

BITS = 25
_U = np.uint64
_MULTIPLIERS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def _places(keys: np.ndarray) -> list[np.ndarray]:
    k = keys.view(_U) ^ (keys.view(_U) >> _U(31))
    return [(k * m) >> _U(64 - BITS) for m in _MULTIPLIERS]


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, key: int) -> bool:
        return bool(self.may_hold(np.array([key], dtype=np.int64))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in _places(keys):
            out &= (self.words[p >> _U(6)] >> (p & _U(63))) & _U(1) == 1
        return out


def bloom(keys: DataFrame, tasks: int = 8) -> Bloom:
    """The filter of the one long column of ``keys``; nulls are left out."""

    @freeing
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, dtype=bool)
        some = False
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            some |= len(k) > 0
            for p in _places(k):
                bits[p] = True
        if some:
            words = np.packbits(bits, bitorder="little").view(_U)
            at = np.flatnonzero(words)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], ["i", "w"])

    words = np.zeros(1 << (BITS - 6), dtype=_U)
    got = keys.coalesce(tasks).mapInArrow(build, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    words[got.column("i").to_numpy()] = got.column("w").to_numpy().view(_U)
    return Bloom(words)


def may_hold(df: DataFrame, shared, column: str) -> DataFrame:
    """The rows of ``df`` whose key may be in the broadcast filter; rows with a null key go."""

    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(keys.to_numpy(zero_copy_only=False)))

    return df.where(F.col(column).isNotNull() & passes(F.coalesce(F.col(column).cast("long"), F.lit(0))))
