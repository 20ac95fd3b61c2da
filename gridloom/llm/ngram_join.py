"""N-gram Jaccard self-join as a blocked sparse matrix product.

Rows are documents, columns the hashes of their distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased;
a shorter text is one shingle). Documents with equal sets are one class, and classes are multiplied:

1. One pass keeps the id, class and set size of each document, and counts columns in ``CELLS`` cells by their hash: sums
   over all tasks, of one size whatever the table's. Columns in cells that stand out are called frequent, and go last in
   every document's column order.
2. A second pass emits, for each class, the leading columns that any partner at the threshold must share one of. They
   are dealt by column; columns with one class are dropped, those of many rows are salted.
3. Within frequent and long columns, which whole groups of near copies share, classes first meet a few chosen ones, and
   links unite most of such a group. Rounds go on until few pairs are left or a round does not halve them.
4. The product is accumulated over the leading columns. In a long column only classes outside its largest component meet
   the others, so what is united is not multiplied again. A pair whose count stays below the bound that the two sizes
   imply is discarded.
5. For the pairs that are left the product goes on over all columns, block by block; a pair is discarded as soon as what
   is left of the smaller row cannot bring its count to the bound. The whole overlaps decide, and components follow.

No bound drops a pair that links: with sizes a, b and overlap o >= 75 (a + b) / 175, the leading columns of one of the
two all lie within the other's range, so at least min over both of (leading columns - (size - o)) are shared.

Shingles are 64-bit hashes, equal ones taken for equal. Classes have two such hashes: where one is that of different
sets, the other tells them apart. Null texts and texts without words have no shingles and link with nothing; repeated
rows and ids give one row each, in the component of their text; a null id links like any other, a component takes its
smallest id that is not null (null if it has none); very long texts are sets like others, of as many columns as they
have; of chosen classes that are equal the smallest hash is taken, which no result depends on; an empty table gives no
rows. Columns other than doc_id and text are not read, and keep their names and values in ``without_near_copies``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_words, components, free_name, mapped, mix, stored, texts, unstore, window_hashes, word_hashes

WIDTH = 5
SKETCH_BITS = 1024
CELLS, CELL_BLOCK = 1 << 21, 1 << 16
LONG = 256  # rows of a column past which its classes first meet chosen ones
PART = 1024  # rows of a frequent column that share a salt, about
COLUMN_BLOCKS = 8

_NONE: frozenset[int] = frozenset()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(window_hashes(word_hashes(ascii_words(text)), WIDTH))


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two 63-bit hashes of the whole set."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(mix(shingles))
        one = mix(np.add.reduce(mix(shingles + np.uint64(0x51ED27))) + x * np.uint64(3) + np.uint64(len(shingles)))
        two = mix(np.add.reduce(mix(shingles + np.uint64(0xA0761D))) * np.uint64(5) + x)
    return int(one >> np.uint64(1)), int(two >> np.uint64(1))


def class_of(shingles: np.ndarray, shared: frozenset[int] = _NONE) -> int:
    """The set's first hash, or the second where different sets have the first (``shared``)."""
    one, two = set_hashes(shingles)
    return two if one in shared else one


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its hash, out of ``SKETCH_BITS``; bits that one set has alone are shingles it has alone."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[(shingles >> np.uint64(7)) % np.uint64(SKETCH_BITS)] = True
    return np.packbits(bits).view(np.int64)


def leading(n: int) -> int:
    """Columns that must be emitted for a set of size n: a partner shares at least ceil(75 n / 100)."""
    return n - -(-75 * n // 100) + 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest numbers that hold them, compressed."""
    width = np.min_scalar_type(int(counts.max()))
    return bytes([width.itemsize]) + zlib.compress(counts.astype(width).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as (doc_id, class and its other hash, size), and this task's counts of columns by cell, in blocks."""
    names = ["doc_id", "text_hash", "sig", "other", "n", "block", "cells"]
    counts = np.zeros(CELLS, np.uint32)
    for b in batches:
        sigs, others, sizes, held, size = [], [], [], [], 0
        for text in texts(b, "text"):
            s = shingle_set(text)
            one, two = set_hashes(s) if len(s) else (None, None)
            sigs.append(one)
            others.append(two)
            sizes.append(len(s))
            held.append(s)
            size += len(s)
            if size > 500_000:
                np.add.at(counts, cell_of(np.concatenate(held)), 1)
                held, size = [], 0
        if size:
            np.add.at(counts, cell_of(np.concatenate(held)), 1)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sigs, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    made = [(i, _packed(part)) for i, part in enumerate(counts.reshape(-1, CELL_BLOCK)) if part.any()]
    none = pa.nulls(len(made), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([i for i, _ in made], pa.int32()), pa.array([c for _, c in made], pa.binary())], names=names)


def cell_levels(counts: DataFrame, least: int) -> np.ndarray:
    """A number for each cell: 0 where its columns are rare, else the logarithm to base 2, rounded up, of how far its count
    is above the usual one. Frequent are cells that stand out by ``least`` and by six standard deviations of chance."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELL_BLOCK, np.int64)
        for raw in rows["cells"]:
            total += _unpacked(raw)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "cells": [_packed(total)]})

    blocks = CELLS // CELL_BLOCK
    deals = int((counts.count() / blocks) ** 0.5 / 8) + 1  # so that no group holds the rows of all tasks
    if deals > 1:
        dealt = counts.groupBy("block", F.pmod(F.xxhash64("cells"), F.lit(deals)))
        counts = dealt.applyInPandas(lambda rows: added(rows[["block", "cells"]]), "block int, cells binary")
    total = np.zeros(CELLS, np.int64)
    for block, raw in counts.groupBy("block").applyInPandas(added, "block int, cells binary").collect():  # ``blocks`` rows at most
        total[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] = _unpacked(raw)
    usual = float(np.median(total))
    above = total - usual
    return np.where(above >= max(least, 6 * usual**0.5), np.ceil(np.log2(np.maximum(above, 1))) + 1, 0).astype(np.uint8)


def parts_of(levels: np.ndarray) -> np.ndarray:
    """Over how many salts a frequent column is dealt."""
    return np.maximum(1, (1 << np.maximum(levels.astype(np.int64) - 1, 0)) // PART).astype(np.int32)


def blocks(docs: DataFrame, levels: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """``col, salt, parts, sig, n, pos, often``: the leading columns of each class. ``parts`` is 0 for rare columns, else the
    number of salts of the frequent one, ``pos`` the column's place in the class's order and ``often`` the number of its
    frequent leading columns. A class with frequent ones has one more row, with its ``sketch`` and, as ``pos``, the share of
    its columns that are rare, in thousandths. A task skips classes it has met; what others repeat changes nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["col", "salt", "parts", "sig", "n", "pos", "often", "sketch"]

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(r[0]) for r in rows])
        each = lambda k, kind: pa.array(np.repeat(np.array([r[k] for r in rows]), size), kind)
        parts = np.concatenate([r[1] for r in rows])
        sig = np.repeat(np.array([r[2] for r in rows], np.int64), size)
        pos = np.arange(len(sig)) - np.repeat(np.cumsum(size) - size, size)
        salt = sig % np.maximum(parts, 1)
        yield pa.RecordBatch.from_arrays([_long(np.concatenate([r[0] for r in rows])), *(pa.array(x.astype(np.int32)) for x in (salt, parts)), pa.array(sig), each(3, pa.int32()), pa.array(pos.astype(np.int32)), each(4, pa.int32()), pa.nulls(len(sig), pa.list_(pa.int64()))], names=names)
        if drawn := [(r[2], r[3], r[5], r[6]) for r in rows if r[4]]:
            sigs, sizes, sketches, apart = zip(*drawn, strict=True)
            own, empty, none = pa.array(sigs, pa.int64()), pa.nulls(len(sigs), pa.int32()), pa.array([0] * len(sigs), pa.int32())
            yield pa.RecordBatch.from_arrays([own, none, none, own, pa.array(sizes, pa.int32()), pa.array(apart, pa.int32()), empty, pa.array(sketches, pa.list_(pa.int64()))], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        met: set[int] = set()
        for b in batches:
            rows, size = [], 0
            for text in texts(b, "text"):
                s = shingle_set(text)
                if not len(s) or (sig := class_of(s, shared)) in met:
                    continue
                if len(met) >= 250_000:
                    met.clear()
                met.add(sig)
                lead = leading(len(s))
                lv = level[cell_of(s)]
                f = lv > 0
                rare = s[~f][:lead]
                hot, own = s[f][: lead - len(rare)], lv[f][: lead - len(rare)]
                rows.append((np.concatenate([rare, hot]), np.concatenate([np.zeros(len(rare), np.int32), parts_of(own)]), sig, len(s), len(hot), sketch(s) if len(hot) else None, 1000 * int((~f).sum()) // len(s)))
                size += len(rare) + len(hot)
                if size > 200_000:
                    yield from out(rows)
                    rows, size = [], 0
            if rows:
                yield from out(rows)

    return mapped(docs.select("text"), emit, "col long, salt int, parts int, sig long, n int, pos int, often int, sketch array<long>")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of columns that at least two classes have, all of frequent columns, and the sketches. ``long``: in a column
    that is frequent or has more than ``LONG`` rows. A rare column has no more rows than a cell may have unnoticed."""
    span = "over (partition by col, salt)"
    told = entries.select("*", F.expr(f"min(sig) {span} <> max(sig) {span}").alias("several"), F.expr(f"count(*) {span}").alias("rows"))
    told = told.where("several or parts > 0 or sketch is not null")
    return told.select(*entries.columns, F.expr(f"sketch is null and (parts > 0 or rows > {LONG})").alias("long"))


def _fits(a: str, b: str) -> Column:
    """The sizes alone allow a link."""
    return (F.col(a) * 100 >= F.col(b) * 75) & (F.col(b) * 100 >= F.col(a) * 75)


def plausible(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sketches don't rule a link out: a set of n has at most n less the bits it has alone
    in common with the other. Classes without a sketch stay."""
    sketches = shared.where("sketch is not null").select("sig", "n", "sketch").dropDuplicates(["sig"])
    both = pairs.join(sketches.toDF("a", "n", "x"), "a", "left").join(sketches.toDF("b", "m", "y"), "b", "left")

    def alone(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, c: t + c)

    overlap = F.ceil((F.col("n") + F.col("m")) * 75 / F.lit(175))
    enough = (F.col("n") - alone("x", "y") >= overlap) & (F.col("m") - alone("y", "x") >= overlap)
    return both.where(F.coalesce(enough, F.lit(True))).select("a", "b")


def _first() -> Column:
    """The smallest (doc_id, text_hash), null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))


def accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of rows ``a, b, x, y`` those that link: the product of each pair accumulated over blocks of columns. A pair
    leaves once what is left of the smaller row cannot bring it to the bound."""
    for batch in batches:
        columns, owners, sizes = [], [], []
        for name in ("x", "y"):
            lists = batch.column(name)
            offsets = lists.offsets.to_numpy()
            columns.append(lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64))
            sizes.append(np.diff(offsets).astype(np.int64))
            owners.append(np.repeat(np.arange(batch.num_rows), sizes[-1]))
        need = -(-75 * (sizes[0] + sizes[1]) // 175)
        count, rest = np.zeros(batch.num_rows, np.int64), np.stack(sizes)
        alive = rest.min(axis=0) >= need
        column_blocks = [(c >> np.uint64(61)).astype(np.int8) for c in columns]
        for block in range(COLUMN_BLOCKS):
            here = [np.flatnonzero((k == block) & alive[o]) for k, o in zip(column_blocks, owners, strict=True)]
            h = np.concatenate([c[at] for c, at in zip(columns, here, strict=True)])
            o = np.concatenate([o[at] for o, at in zip(owners, here, strict=True)])
            order = np.lexsort((h, o))
            h, o = h[order], o[order]
            twice = (h[1:] == h[:-1]) & (o[1:] == o[:-1])  # a column that both rows have: sets have it once each
            count += np.bincount(o[1:][twice], minlength=batch.num_rows)
            for k in (0, 1):
                rest[k] -= np.bincount(owners[k][here[k]], minlength=batch.num_rows)
            alive &= count + rest.min(axis=0) >= need
        link = alive & (100 * count >= 75 * (sizes[0] + sizes[1] - count))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(link)) for c in ("a", "b")], names=["a", "b"])


def linked(pairs: DataFrame, docs: DataFrame, census: DataFrame, shared: frozenset[int], small: int = 500_000) -> DataFrame:
    """Those of ``pairs (a, b)`` of classes whose whole rows link. Each class is read from one of its documents; their
    ids and hashes are broadcast where they are at most ``small``, and else joined by shuffle."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    chosen = stored(census.join(ids, "sig", "left_semi").groupBy("sig").agg(_first().alias("k")).select("sig", F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")), "chosen")
    wanted = F.broadcast(chosen) if chosen.count() <= small else chosen
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    own = own.join(wanted, own["doc_id"].eqNullSafe(wanted["__id"]) & (own["text_hash"] == wanted["__hash"])).select("sig", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            sigs, sets = [], []
            for sig, text in zip(b.column("sig").to_pylist(), texts(b, "text"), strict=True):
                if sig in met:  # a row that repeats, or copies without ids
                    continue
                s = shingle_set(text)
                if len(s) and class_of(s, shared) == sig:  # equal hashes of other texts
                    if len(met) >= 250_000:
                        met.clear()
                    met.add(sig)
                    sigs.append(sig)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "shingles"])

    sets = stored(mapped(own, spread, "sig long, shingles array<long>").dropDuplicates(["sig"]), "sets")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    edges = stored(mapped(both.select("a", "b", "x", "y"), accumulated, "a long, b long"), "edges")
    for t in (sets, chosen, pairs):
        unstore(t)
    return edges


def _with_component(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("comp", F.col("sig"))
    return entries.join(roots.withColumnsRenamed({"node": "sig", "root": "comp"}), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def _majority(rows: DataFrame) -> DataFrame:
    """``col, rows, major, most`` of ``rows (col, comp)``: each column's rows, largest component and its rows. Both steps
    add up within tasks first."""
    counts = rows.groupBy("col", "comp").agg(F.count("*").alias("c"))
    return counts.groupBy("col").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "comp")).alias("top")).select("col", "rows", F.col("top.comp").alias("major"), F.col("top.c").alias("most"))


def long_links(shared: DataFrame, docs: DataFrame, census: DataFrame, same: frozenset[int], few: int = 16) -> DataFrame | None:
    """Components by links within long columns: in each round the classes of each salt of a column meet one drawn from it,
    by a rank that is one for all columns, and the drawn ones of a column meet each other. Copies of one text have the
    text's columns and few of their own, so first the class with the smallest share of rare columns is drawn, which is
    nearest to all of its group, and then any. Rounds end when at most ``few``
    pairs a row are left to the product, or a round does not halve them."""
    apart = shared.where("sketch is not null").groupBy("sig").agg(F.min("pos").alias("apart"))
    rows = shared.where("long").select("col", "salt", "sig", "n").distinct().join(apart, "sig", "left")
    rows = stored(rows.select("col", "salt", "sig", "n", F.coalesce("apart", F.lit(1000)).alias("apart")), "long")
    total = rows.count()
    roots, left, number = None, None, 0
    while total:
        now = _with_component(rows, roots)
        open_columns = stored(_majority(now).where("rows > most"), "open")
        before, left = left, open_columns.agg(F.coalesce(F.sum(F.col("rows").cast("double") * (F.col("rows") - F.col("most"))), F.lit(0.0))).first()[0]
        if left <= few * total or (before is not None and left > before / 2):
            unstore(open_columns)
            break
        now = now.join(open_columns.select("col"), "col", "left_semi")
        rank = F.struct((F.lit(0) if number else F.col("apart")).alias("apart"), F.xxhash64("sig", F.lit(number)).alias("h"))
        drawn = now.groupBy("col", "salt").agg(F.min(F.struct(rank.alias("r"), "sig", "n", "comp")).alias("p"))
        first = drawn.groupBy("col").agg(F.min("p").alias("q"))
        met = [now.join(drawn, ["col", "salt"]).select("p", F.struct("sig", "n", "comp").alias("o")), drawn.join(first, "col").select(F.col("q").alias("p"), F.struct("p.sig", "p.n", "p.comp").alias("o"))]
        pairs = met[0].unionByName(met[1]).where((F.col("p.comp") != F.col("o.comp")) & _fits("p.n", "o.n"))
        pairs = pairs.select(F.least("p.sig", "o.sig").alias("a"), F.greatest("p.sig", "o.sig").alias("b")).distinct()
        found = linked(plausible(pairs, shared), docs, census, same)
        unstore(open_columns)
        if not found.head(1):
            break
        roots, number = components(_with_stars(found, roots)), number + 1
    unstore(rows)
    return roots


def _with_stars(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``edges`` and, in place of those that gave ``roots``, one from each node to its root."""
    return edges if roots is None else edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def product_pairs(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs of classes of different components whose overlap on leading columns reaches the bound of their sizes.

    Overlaps are accumulated over rare columns; what frequent ones could add is counted in full. A frequent column is
    multiplied only where it can be the first that a linking pair shares: all the overlap then lies from there on, so at
    least that many columns follow in either. In long columns the rows outside the largest component (a pair of different
    components has one) meet all rows, dealt by salt."""
    columns = ["col", "salt", "parts", "sig", "n", "pos", "often", "long"]
    rows = stored(_with_component(shared.where("sketch is null").select(*columns).distinct(), roots), "product")
    overlap = F.ceil((F.col("n") + F.col("m")) * 75 / F.lit(175))
    first = (F.col("parts") == 0) | ((F.col("n") - F.col("pos") >= overlap) & (F.col("m") - F.col("place") >= overlap))
    right = {"sig": "b", "n": "m", "comp": "d", "pos": "place", "often": "as_often"}
    differ = (F.col("comp") != F.col("d")) & _fits("n", "m") & first
    short = rows.where("not long").drop("salt", "parts", "long")
    met = short.withColumnRenamed("sig", "a").join(short.withColumnsRenamed(right), "col").withColumn("parts", F.lit(0)).where(differ & (F.col("a") < F.col("b")))
    wide = rows.where("long")
    major = stored(_majority(wide).where("rows > most"), "major")
    minor = wide.drop("salt").join(major.select("col", "major"), "col").where("comp <> major").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)))
    others = wide.join(major.select("col", F.col("major").alias("their_major")), "col").drop("parts", "long").withColumnsRenamed(right)
    # Two rows outside the largest component meet from both sides, of which one counts.
    crossed = minor.withColumnRenamed("sig", "a").join(others, ["col", "salt"]).where(differ & ((F.col("d") == F.col("their_major")) | (F.col("a") < F.col("b"))))
    kept = ["a", "b", "n", "m", "often", "as_often", "parts"]
    turned = {"a": "b", "b": "a", "n": "m", "m": "n", "often": "as_often", "as_often": "often"}
    sides = [F.when(F.col("a") < F.col("b"), F.col(c)).otherwise(F.col(turned.get(c, c))).alias(c) for c in kept]
    both = met.select(*kept).unionByName(crossed.select(*kept)).select(*sides)
    counted = both.groupBy("a", "b", "n", "m", "often", "as_often").agg(F.sum((F.col("parts") == 0).cast("int")).alias("c"))

    def bound(n: str) -> Column:
        return F.col(n) - F.ceil(F.col(n) * 75 / F.lit(100)) + 1 - (F.col(n) - overlap)

    return counted.where(F.col("c") + F.least("often", "as_often") >= F.least(bound("n"), bound("m"))).select("a", "b")


def jaccard_components(docs: DataFrame, least_frequent: int = 48) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, root`` for each row of ``docs (doc_id, text)``; ``root`` is one for
    all documents of a component, null without words."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = slim.withColumn("text_hash", F.xxhash64("text"))
    seen = stored(mapped(hashed, _census, "doc_id long, text_hash long, sig long, other long, n long, block int, cells binary"), "census")
    rows = seen.where("block is null")
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"), F.min("other").alias("least"), F.max("other").alias("most"))
    classes = stored(classes, "classes")
    # Different sets with one hash: a handful in 10^10.
    same = frozenset(r.sig for r in classes.where("least <> most").select("sig").collect())
    if same:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*same), F.col("other")).otherwise(F.col("sig")))
        classes = stored(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low")), "classes")
    census = rows.select("doc_id", "text_hash", "sig", "n")
    levels = cell_levels(seen.where("block is not null").select("block", "cells"), least_frequent)
    shared = stored(_shared(blocks(slim, levels, same)), "shared")
    roots = long_links(shared, slim, census, same)
    rest = linked(plausible(product_pairs(shared, roots), shared), slim, census, same)
    unstore(shared)
    joined = classes.join(components(_with_stars(rest, roots)).withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    low = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(joined.join(low, "root").select("sig", "component_id", "root"), "named")
    out = census.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "root")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their columns: of each component that with the smallest id (null ids last), and all texts without words."""
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = jaccard_components(docs).where("root is not null").groupBy("root").agg(_first().alias("k"))
    own, text = free_name(docs, "id"), free_name(docs, "hash")
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    worded = docs.where(~wordless).select("*", F.col("doc_id").cast("long").alias(own), F.xxhash64("text").alias(text))
    same = worded[own].eqNullSafe(kept["kept_id"]) & (worded[text] == kept["kept_hash"])
    one = worded.join(kept, same, "left_semi").dropDuplicates([own, text]).select(*docs.columns)
    return one.unionByName(docs.where(wordless))
