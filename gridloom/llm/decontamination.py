"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters, digits and non-ASCII characters in lower case, so punctuation and line breaks do not
hide a match. A document and a test item that share a window of ``min_tile`` tokens (a seed) are compared: the longest
common unmarked run is found by running Karp-Rabin hashes of a searched length, its tokens are compared, it is marked in
both, and so on down to ``min_tile``. The share of the item's tokens under tiles decides, so passages whose sentences
have been put in another order count.

The test set comes to the workers in blocks of at most ``block_bytes``, each of which meets all documents; documents
are not shuffled. Tokens are numbered by the block's vocabulary, so equal numbers are equal tokens, and all others of a
document stand for none. Null and empty texts and items shorter than ``min_tile`` match nothing; repeated rows count each
and null ids are kept; of runs of one length the first in the item, then in the document, is marked first; a very long
text is tokenised whole, and only its parts that share seeds with an item are tiled with it; an empty table gives no
rows. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mapped, mix, texts

_TABLE = bytes(c if chr(c).isascii() and chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of all windows of a sequence: sums of token hashes times powers of a base, modulo 2^64. Two sums
    and a power of the base's inverse give that of any window, whatever its length."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        with np.errstate(over="ignore"):
            powers, self.undo = (np.full(n + 1, x, np.uint64) for x in (_BASE, _UNDO))
            powers[0] = self.undo[0] = 1
            powers, self.undo = np.cumprod(powers), np.cumprod(self.undo)
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.total[1:])

    def windows(self, starts: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[starts + k] - self.total[starts]) * self.undo[starts]


def _clear(mark: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of ``k`` without a marked token."""
    total = np.concatenate([[0], np.cumsum(mark)])
    return np.flatnonzero(total[k:] == total[:-k])


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of token numbers: ``(doc start, item start, length)``, longest first."""
    doc_mark, item_mark, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    doc_runs, item_runs = Running(doc), Running(item)

    def windows(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, i = _clear(doc_mark, k), _clear(item_mark, k)
        return d, doc_runs.windows(d, k), i, item_runs.windows(i, k)

    high = min(len(doc), len(item))
    while high >= min_tile:
        low, top = min_tile - 1, high  # a common run of low tokens is known (or low is below the least)
        while low < top:
            k = (low + top + 1) // 2
            _, dh, _, ih = windows(k)
            low, top = (k, top) if np.isin(ih, dh).any() else (low, k - 1)
        if low < min_tile:
            break
        d, dh, i, ih = windows(low)
        order = np.argsort(dh, kind="stable")
        d, dh = d[order], dh[order]
        first, last = np.searchsorted(dh, ih, "left"), np.searchsorted(dh, ih, "right")
        for at, a, b in zip(i.tolist(), first.tolist(), last.tolist(), strict=True):
            if item_mark[at : at + low].any():
                continue
            for s in d[a:b].tolist():
                if not doc_mark[s : s + low].any() and (doc[s : s + low] == item[at : at + low]).all():
                    doc_mark[s : s + low] = item_mark[at : at + low] = True
                    tiles.append((s, at, low))
                    break
        # What is left is shorter, but for runs that only hash alike.
        high = low - 1
    return tiles


class _Block:
    """Test items and their seeds: hashes of the windows of ``min_tile`` tokens."""

    def __init__(self, rows: list[tuple[int, str]], min_tile: int, coverage: float) -> None:
        self.min_tile, self.coverage = min_tile, coverage
        self.vocabulary: dict[bytes, int] = {}
        number = lambda t: self.vocabulary.setdefault(t, len(self.vocabulary) + 1)
        split = [(i, tokens(t)) for i, t in rows]
        self.items = [(i, np.fromiter(map(number, ts), np.int64, len(ts))) for i, ts in split if len(ts) >= min_tile]
        seeds = [Running(x).windows(np.arange(len(x) - min_tile + 1), min_tile) for _, x in self.items]
        key = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], owner[order], place[order]

    def _covered(self, n: int, starts: np.ndarray) -> np.ndarray:
        """Which of ``n`` tokens the windows at ``starts`` cover."""
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.min_tile, -1)
        return np.cumsum(edge[:n]) > 0

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, item tokens, covered tokens, tiles)`` of each item whose coverage reaches the threshold."""
        words = tokens(text)
        if len(words) < self.min_tile or not len(self.key):
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        starts = _clear(ids == 0, self.min_tile)
        if not len(starts):
            return []
        w = Running(ids).windows(starts, self.min_tile)
        hit = self.key[np.minimum(np.searchsorted(self.key, w), len(self.key) - 1)] == w
        if not hit.any():
            return []
        starts = starts[hit]
        seen, which = np.unique(w[hit], return_inverse=True)
        low, high = np.searchsorted(self.key, seen, "left"), np.searchsorted(self.key, seen, "right")
        count = high - low
        seed = np.repeat(np.arange(len(seen)), count)
        found = np.arange(len(seed)) - np.repeat(np.cumsum(count) - count, count) + low[seed]
        order = np.argsort(self.owner[found], kind="stable")
        seed, found = seed[order], found[order]
        owners, first = np.unique(self.owner[found], return_index=True)
        out = []
        for k, a, b in zip(owners.tolist(), first.tolist(), [*first[1:].tolist(), len(found)], strict=True):
            item_id, item = self.items[k]
            least = self.coverage * len(item)
            if self._covered(len(item), self.place[found[a:b]]).sum() < least:
                continue
            # The parts of the document under these seeds, with a token that matches none between them.
            mine = np.zeros(len(seen), bool)
            mine[seed[a:b]] = True
            part = self._covered(len(ids), starts[mine[which]])
            tiles = tile(np.where(part, ids, 0)[part | np.concatenate([[False], part[:-1]])], item, self.min_tile)
            covered = sum(n for _, _, n in tiles)
            if covered >= least:
                out.append((item_id, len(item), covered, len(tiles)))
        return out


_BUILT: dict[tuple, _Block] = {}


def _built(sent: Broadcast, min_tile: int, coverage: float) -> _Block:
    """The block of a broadcast, which a worker's tasks build once; one is held."""
    name, rows = sent.value
    key = (name, min_tile, coverage)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _Block(rows, min_tile, coverage)
    return _BUILT[key]


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The test set's rows, broadcast in blocks of about ``block_bytes``; an item longer than a block is still one item."""
    slim = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        yield docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in slim.where(part == number).collect()]))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 4, coverage: float = 0.6, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, item_id, item_tokens, covered, coverage, tiles`` of each document and item that match."""
    sources = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def meet(sent: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _built(sent, min_tile, coverage)
            for b in batches:
                got = [(doc, *m, m[2] / m[1]) for doc, text in zip(b.column("doc_id").to_pylist(), texts(b, "text"), strict=True) for m in block.matches(text)]
                columns = list(zip(*got, strict=True)) if got else [()] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "item_tokens", "covered", "tiles", "coverage"])

        return mapped(sources, find, "doc_id long, item_id long, item_tokens long, covered long, tiles long, coverage double")

    return reduce(DataFrame.unionByName, map(meet, _blocks(docs, benchmark, block_bytes)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 4, coverage: float = 0.6, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``docs`` that match no test item, with their columns; no row is shuffled."""

    def rest(kept: DataFrame, sent: Broadcast) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _built(sent, min_tile, coverage)
            for b in batches:
                yield b.filter(pa.array([not block.matches(t) for t in texts(b, "text")], pa.bool_()))

        return mapped(kept, clean, kept.schema)

    return reduce(rest, _blocks(docs, benchmark, block_bytes), docs)
