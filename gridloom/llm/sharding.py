"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

Law: ``rows``. Row ``r`` of ``n`` goes to position ``p = permute(r, n)``; its shard is ``p mod shards`` and its slot
``p div shards``, so shards differ by one row at most and slots have no gaps. Both can be computed from ``r``, ``n``
and the seed alone, and ``unpermute`` leads back from a slot to the row number.

Row numbers follow the order of (doc_id, crc32, size), whatever the partitioning: equal rows are interchangeable, a
null id comes first, a null text counts as empty, an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix, stored

ROUNDS = 8


def _halves(n: int) -> tuple[np.uint64, np.uint64]:
    a = int(np.ceil(np.sqrt(max(n, 1))))
    while a * a < n:
        a += 1
    return np.uint64(a), np.uint64(-(-max(n, 1) // a))


def _round(x: np.ndarray, seed: int, i: int, m: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1342543DE82EF95) % 2**64)) % m


def _feistel(x: np.ndarray, a: np.uint64, b: np.uint64, seed: int, back: bool) -> np.ndarray:
    """A permutation of 0..a*b-1: the halves take turns at adding a keyed function of the other."""
    left, right = x // b, x % b
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            f = _round(left, seed, i, b)
            right = (right + (b - f if back else f)) % b
        else:
            f = _round(right, seed, i, a)
            left = (left + (a - f if back else f)) % a
    return left * b + right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    a, b = _halves(n)
    out = _feistel(np.asarray(x, np.uint64), a, b, seed, back)
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = _feistel(out[beyond], a, b, seed, back)
    return out


def permute(rows: np.ndarray, n: int, seed: int = 20) -> np.ndarray:
    """Positions of row numbers 0..n-1: a bijection; values past ``n`` are walked on along their cycle."""
    return _walk(rows, n, seed, False)


def unpermute(positions: np.ndarray, n: int, seed: int = 20) -> np.ndarray:
    return _walk(positions, n, seed, True)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int], int]:
    """Rows with ``__pid`` and ``__pos``; first row number of each partition; count. The global row number is
    start[__pid] + __pos. Only one count for each partition reaches the driver."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.lit((1 << 33) - 1)
    kept = stored(dealt.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().bitwiseAND(low).alias("__pos")), "rows")
    start, n = {}, 0
    for pid, count in sorted(map(tuple, kept.groupBy("__pid").count().collect())):
        start[pid] = n
        n += count
    return kept, start, n


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot`` for each row of ``docs (doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    kept, start, n = numbered(slim, ["doc_id", "text_crc32", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.array([start[p] for p in b.column("__pid").to_numpy()], np.int64)
            row = first + b.column("__pos").to_numpy()
            p = permute(row, n, seed).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(row), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    return kept.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
