"""Hash functions as Columns: md5 with salt, seeded murmur3, uniform draws and bucket splits.

Every random choice in the package is a hash of the row's own key columns, so the result does not depend on
partitioning, retries or the number of executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the public 32-bit murmur3 algorithm.
C1, C2 = 0xCC9E2D51, 0x1B873593
ADD, FIN1, FIN2 = 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
MASK32 = 0xFFFFFFFF


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _murmur3_arrays(texts: pd.Series, seed: int) -> np.ndarray:
    """murmur3_32 of many strings at once: strings of equal byte length form one byte matrix, hashed column-wise."""
    data = texts.str.encode("utf-8")
    sizes = data.str.len().to_numpy()
    out = np.zeros(len(data), dtype=np.uint64)
    mask = np.uint64(MASK32)

    def mul(x, factor):
        return (x * np.uint64(factor)) & mask

    def rotl(x, bits):
        return ((x << np.uint64(bits)) | (x >> np.uint64(32 - bits))) & mask

    def scramble(k):
        return mul(rotl(mul(k, C1), 15), C2)

    def word(columns):
        return sum(columns[:, i].astype(np.uint64) << np.uint64(8 * i) for i in range(columns.shape[1]))

    for size in np.unique(sizes):
        where = np.flatnonzero(sizes == size)
        matrix = np.frombuffer(b"".join(data.iloc[where]), dtype=np.uint8).reshape(len(where), size)
        h = np.full(len(where), seed & MASK32, dtype=np.uint64)
        whole = size // 4 * 4
        for at in range(0, whole, 4):
            h = (rotl(h ^ scramble(word(matrix[:, at : at + 4])), 13) * np.uint64(5) + np.uint64(ADD)) & mask
        if size > whole:
            h ^= scramble(word(matrix[:, whole:]))
        h ^= np.uint64(size)
        for shift, factor in ((16, FIN1), (13, FIN2)):
            h = mul(h ^ (h >> np.uint64(shift)), factor)
        out[where] = h ^ (h >> np.uint64(16))
    return out.astype(np.int64)


def murmur3_32(value, seed: int = 0) -> Column:
    """Unsigned 32-bit murmur3 of the UTF-8 bytes of a string column, as an Arrow function: Spark's own ``hash`` treats
    the last bytes of a string differently, and the same steps as Column expressions run about fifty times slower."""

    def hashed(texts: pd.Series) -> pd.Series:
        codes, unique = pd.factorize(texts)
        hashes = _murmur3_arrays(pd.Series(unique, dtype=object), seed) if len(unique) else np.zeros(0, dtype=np.int64)
        return pd.Series(np.append(hashes, 0)[codes], dtype="Int64").where(codes >= 0)

    return F.pandas_udf(hashed, LongType())(as_column(value).cast("string"))


def murmur3_seed(text: str) -> int:
    """Plain murmur3 of a short constant (an experiment name), used as the seed of the per-user hash."""
    data = text.encode("utf-8")
    h = 0

    def scramble(k: int) -> int:
        k = k * C1 & MASK32
        return ((k << 15 | k >> 17) & MASK32) * C2 & MASK32

    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) & MASK32) * 5 + ADD & MASK32
    h ^= scramble(int.from_bytes(data[whole:], "little")) ^ len(data)
    for shift, factor in ((16, FIN1), (13, FIN2)):
        h = (h ^ h >> shift) * factor & MASK32
    return h ^ h >> 16


def salted_md5(value, salt: str) -> Column:
    """Hex md5 of salt + value: the id anonymiser."""
    return F.md5(F.concat(F.lit(salt), as_column(value).cast("string")))


def uniform(*values, seed: int = 0) -> Column:
    """Repeatable draw from [0, 1) out of 52 md5 bits of the given key columns."""
    text = F.concat_ws("|", *[as_column(v).cast("string") for v in values], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_index(size: Column, *values, seed: int = 0) -> Column:
    """Repeatable integer draw from 0 .. size-1."""
    return F.floor(uniform(*values, seed=seed) * size).cast("long")


def hash_split(key, parts: int = 2) -> Column:
    """Stable part number of a key, for public/private style splits."""
    return F.pmod(F.conv(F.substring(F.md5(as_column(key).cast("string")), 1, 13), 16, 10).cast("long"), F.lit(parts))
