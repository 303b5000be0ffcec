"""A Bloom filter with a real merge, and distinct counts that rest on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Bloom:
    """A Bloom filter for ``expected`` items at a rate ``fpp`` of false positives."""

    def __init__(self, expected: int = 100_000, fpp: float = 0.01, bits: bytes | None = None):
        self.size = max(64, int(-expected * math.log(fpp) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / expected * math.log(2)))
        self.bits = np.frombuffer(bits, np.uint8).copy() if bits is not None else np.zeros(-(-self.size // 8), np.uint8)

    def _places(self, item: str) -> np.ndarray:
        h = xxhash.xxh3_128_intdigest(item)
        a, b = h & ((1 << 64) - 1), (h >> 64) | 1
        return np.array([((a + i * b) & ((1 << 64) - 1)) % self.size for i in range(self.hashes)], np.int64)

    def add(self, item: str) -> bool:
        """Whether the item was certainly new."""
        at = self._places(item)
        mask = (1 << (at & 7)).astype(np.uint8)
        new = bool(((self.bits[at >> 3] & mask) == 0).any())
        np.bitwise_or.at(self.bits, at >> 3, mask)
        return new

    def add_all(self, h1: np.ndarray, h2: np.ndarray) -> int:
        """Add values by two 64-bit hashes each; how many different ones were certainly new before."""
        both = np.unique(np.stack([h1, h2 | np.uint64(1)], axis=1), axis=0)
        at = ((both[:, :1] + np.arange(self.hashes, dtype=np.uint64) * both[:, 1:]) % np.uint64(self.size)).astype(np.int64)
        mask = (1 << (at & 7)).astype(np.uint8)
        new = int(((self.bits[at >> 3] & mask) == 0).any(axis=1).sum())
        np.bitwise_or.at(self.bits, at >> 3, mask)
        return new

    def __contains__(self, item: str) -> bool:
        at = self._places(item)
        return bool(((self.bits[at >> 3] & (1 << (at & 7)).astype(np.uint8)) != 0).all())

    def merge(self, other: Bloom) -> Bloom:
        """The filter of both sets; ``self`` changes."""
        self.bits |= other.bits
        return self

    def to_bytes(self) -> bytes:
        return self.bits.tobytes()


def bloom_counts(df: DataFrame, keys: list[str], column: str, name: str = "uv", expected: int = 100_000, fpp: float = 0.01, buckets: int = 16) -> DataFrame:
    """Distinct values per key, counting a value only if the key's filter has certainly not seen it: never too many.

    A key's values are dealt by hash into ``buckets``, each with a filter of its own, so that no task takes a whole key;
    equal values meet in one bucket, and the buckets' counts add up. A task holds one filter at a time.
    """
    per_bucket = max(64, expected // buckets)
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.pmod(F.hash(column), F.lit(buckets)).alias("_b"), F.xxhash64(F.lit(1), column).alias("_h1"), F.xxhash64(F.lit(2), column).alias("_h2"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bloom, n = None, None, 0
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in [*keys, "_b"]), strict=True))
            h1, h2 = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("_h1", "_h2"))
            lo = 0
            while lo < len(own):
                hi = lo + 1
                while hi < len(own) and own[hi] == own[lo]:
                    hi += 1
                if own[lo] != key:
                    if key is not None:
                        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*key[:-1], n), arrow, strict=True)], schema=arrow)
                    key, bloom, n = own[lo], Bloom(per_bucket, fpp), 0
                n += bloom.add_all(h1[lo:hi], h2[lo:hi])
                lo = hi
        if key is not None:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*key[:-1], n), arrow, strict=True)], schema=arrow)

    counted = rows.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b").mapInArrow(run, schema)
    return counted.groupBy(*keys).agg(F.sum("_n").alias(name))


def approx_distinct(column: Column, rsd: float = 0.01) -> Column:
    """The built-in sketch: partial, mergeable and fit for streams."""
    return F.approx_count_distinct(column, rsd)
