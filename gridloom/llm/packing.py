"""Best-fit packing with certified bin counts.

Documents become token ids plus one end id, longer ones are cut into pieces of the capacity, and the pieces go into as
few sequences as can be found. Each group of pieces is packed by best-fit decreasing and its bin count compared with
the largest lower bound of a family of dual-feasible functions. Where a group has a gap, or the total exceeds the bound
over all pieces, the pieces of its loose bins are exchanged with those of other groups and packed again, until the
total is certified, a round saves nothing or ``rounds`` are done; pieces of one length are placed in the order of rows.

Only (id, length, checksum) rows move; a group holds about ``group_items`` rows at any input size. A null text is empty
and so is one piece of the end id; repeated rows are pieces of their own; an empty table gives no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import mapped, stored, texts, unstore

CAPACITY = 4096
END_ID = 1
_CACHES: dict[str, _WordIds] = {}


# How a vocabulary must treat text for its ids to be those of chunks in a row.
_BY_CHUNKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None,
}


class _WordIds(dict):
    """Ids of space-free chunks as little-endian bytes. The vocabulary drops white space and case, so ids of a text are
    those of its chunks in a row (``by_chunks``; a text of another vocabulary is encoded whole), and a chunk that is one word and a full stop or comma has those of the two. Chunks of
    usual length are remembered, up to a fixed number; a single word goes straight to the vocabulary's merges."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        told = json.loads(whole.to_str())
        self.by_chunks = all(told[k] == v for k, v in _BY_CHUNKS.items()) and told["model"]["type"] == "BPE"
        self.encode, self.merge, self.most = whole.encode, whole.model.tokenize, most
        self.stops = {c: self._whole(c) for c in ".,"}
        # The vocabulary's own letters for the bytes 128 and up, in order: printable ones stand for themselves.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]

    def _whole(self, chunk: str) -> bytes:
        ids = self.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.merge(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 24:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        stem, stop = (chunk[:-1], chunk[-1]) if chunk[-1:] in self.stops else (chunk, "")
        # Latin letters only, where lower case is one letter for one and nothing is left to compose.
        if not stem.isalpha() or not stem.isascii() and (max(stem) >= "\u0250" or "\u0130" in stem):
            return self._keep(chunk, self._whole(chunk))
        word = stem.lower()
        ids = self.get(word)
        if ids:
            return self._keep(chunk, ids + self.stops[stop] if stop else ids)
        ids = self._keep(word, self._word(word))  # most rare words come once: another spelling is remembered the next time
        return ids + self.stops[stop] if stop else ids


def token_bytes(text: str | None, path: str) -> bytes:
    """The text's ids and the end id, as little-endian unsigned 32-bit."""
    cache = _CACHES.get(path) or _CACHES.setdefault(path, _WordIds(path))
    if text and not cache.by_chunks:
        return cache._whole(text) + struct.pack("<I", END_ID)
    chunks = text.replace("\n", " ").split(" ") if text else []
    return b"".join(map(cache.__getitem__, chunks)) + struct.pack("<I", END_ID)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``. ``tokenizer``: a file; by default the public package's, found by
    each worker."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("word_bpe_49k.json"))
        step = 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b, "text"), strict=True):
                ids = token_bytes(text, path)
                rows += [(doc_id, at // step, at // 4, (len(ids[at : at + step])) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(slim, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces of lengths 0..capacity (``counts`` of each) need at least: the best of the dual-feasible
    functions u^(k) (rounding to k-ths) and U^(e) (dropping the small, filling up the large)."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 33):
        up = (k + 1) * x
        whole = up % capacity == 0
        # k * capacity times the function's value, so that all stays in integers
        f = np.where(whole, k * x, (up // capacity) * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    for e in np.flatnonzero(counts[: capacity // 2 + 1]):
        f = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((counts * f).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free space of each bin. Bins wait in stacks by free space; a bit set of
    the stacks in use gives the tightest that fits."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        where[i], offset[i] = b, capacity - room
        free[b] = left = room - n
        if left:
            if not stacks[left]:
                used |= 1 << left
            stacks[left].append(b)
    return where, offset, np.array(free, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = 32_768, rounds: int = 6) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    names = items.columns
    base = stored(items.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    tally = {int(r[0]): r[1] for r in base.groupBy("length").count().collect()}  # a row for each length at most
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in tally.items():
        counts[n] = c
    bound = lower_bound(counts, capacity)
    columns = base.columns
    schema = StructType([*base.schema.fields, *(StructField(n, LongType()) for n in ("sequence_id", "offset", "__free", "__gap"))])

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__item", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        where, offset, free = best_fit_decreasing(lengths, capacity)
        gap = len(free) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 24) + where, offset=offset, __free=free[where], __gap=gap)[schema.names]

    def packed(rows: DataFrame, number: int, n: int) -> DataFrame:
        groups = max(1, -(-n // group_items))
        key = (F.lit(number << 32) + F.pmod(F.xxhash64("__item", F.lit(number)), F.lit(groups))).alias("__group")
        dealt = rows.select(*columns, key)
        return stored(dealt.groupBy("__group").applyInPandas(lambda k, r: fill(k, r[columns]), schema), "packed")

    def bins(rows: DataFrame) -> int:
        return rows.where("offset = 0").count()

    done: list[DataFrame] = []
    now = packed(base, 0, int(counts.sum()))
    fixed, open_bins = 0, bins(now)
    loose = (F.col("__gap") > 0) & (F.col("__free") > 0) | (F.col("__free") >= capacity // 8)
    for number in range(1, rounds):
        if fixed + open_bins <= bound:
            break
        pool = now.where(loose)
        n, before = pool.count(), bins(pool)
        if n == 0:
            break
        again = packed(pool, number, n)
        after = bins(again)
        if after >= before:
            unstore(again)
            break
        done.append(now.where(~loose))
        fixed += open_bins - before
        now, open_bins = again, after
    out = now
    for d in done:
        out = out.unionByName(d)
    return out.select(*names, "sequence_id", "offset")


def best_fit_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of ``docs (doc_id, text)``."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
