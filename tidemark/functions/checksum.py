"""CRC-32C (Castagnoli), which Spark has no function for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: The reflected polynomial and the mask's constant (fixed values).
_POLYNOMIAL, _DELTA = 0x82F63B78, 0xA282EAD8


def _tables() -> np.ndarray:
    """Eight tables from the polynomial, so that eight bytes are folded at a time."""
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        x = i
        for _ in range(8):
            x = (x >> 1) ^ (_POLYNOMIAL if x & 1 else 0)
        t[0, i] = x
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t


_TABLES = _tables()
_LISTS = [row.tolist() for row in _TABLES]


def crc32c(data: bytes) -> int:
    """Of one string of bytes; ``b"123456789"`` gives ``0xE3069283``."""
    crc, n = 0xFFFFFFFF, len(data) // 8 * 8
    t0, t1, t2, t3, t4, t5, t6, t7 = _LISTS
    for i in range(0, n, 8):
        crc ^= int.from_bytes(data[i : i + 4], "little")
        crc = t7[crc & 255] ^ t6[crc >> 8 & 255] ^ t5[crc >> 16 & 255] ^ t4[crc >> 24] ^ t3[data[i + 4]] ^ t2[data[i + 5]] ^ t1[data[i + 6]] ^ t0[data[i + 7]]
    for b in data[n:]:
        crc = crc >> 8 ^ t0[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """Of many strings at once, a byte of each in every step."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    if longest > 4096:
        return np.array([crc32c(v) for v in values], np.int64)
    data = np.zeros((longest, len(values)), np.uint8)
    for lane, i in enumerate(order):
        data[: sizes[i], lane] = np.frombuffer(values[i], np.uint8)
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    ordered = sizes[order]
    for t in range(longest):
        m = int(np.searchsorted(-ordered, -t, "left"))
        crc[:m] = crc[:m] >> 8 ^ _TABLES[0][(crc[:m] ^ data[t, :m]) & 255]
    out = np.empty(len(values), np.int64)
    out[order] = (crc ^ 0xFFFFFFFF).astype(np.int64)
    return out


def mask(crc: int) -> int:
    """The stored form: rotated right by 15 bits, plus a constant."""
    return ((crc >> 15 | crc << 17) + _DELTA) & 0xFFFFFFFF


def unmask(masked: int) -> int:
    turned = masked - _DELTA & 0xFFFFFFFF
    return (turned >> 17 | turned << 15) & 0xFFFFFFFF


def _crc32c_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        known = values.dropna()
        out = pd.Series(index=values.index, dtype="Int64")
        out.loc[known.index] = crc32c_many([bytes(v) for v in known])
        yield out


def crc32c_column(column: str) -> Column:
    """Of a binary column; null for null."""
    return pandas_udf(_crc32c_series, LongType())(column)
