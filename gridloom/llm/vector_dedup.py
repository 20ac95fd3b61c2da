"""Near-duplicate vectors by product quantisation with coarse inverted lists.

Equal vectors are one class, and classes are indexed whole:

1. Coarse centroids and the codebooks of the residuals' subspaces are fitted to a bounded sample (``sample`` rows, chosen
   by hash). Every class goes to its nearest centroid's list with the codes of its residual and the length of the error
   that the codes leave.
2. A class probes each list whose cell a partner may lie in. With cosine at least t a partner lies within
   r = sqrt(2 - 2 t); it is in another cell only if it crosses the plane between the two centroids, so lists whose plane
   is farther than r are skipped. No list that can hold a partner is, whatever the directions a group varies in.
3. Neighbouring lists are joined in bins of about ``block`` classes. A larger list has centroids of its own, one for each
   ``block`` classes, and is split and probed by them in the same way, so the number of lists in all grows with the table
   and their size does not. What is still larger is dealt in pieces, and the classes that probe a part in blocks, so a
   group of near copies of any size is many small groups. Within one, the
   asymmetric distances to the codes are one product with the vectors they stand for; the triangle inequality with the
   stored error drops what cannot link, and the rest is compared by exact cosine.

Only counts and a spanning forest leave a group, not pairs. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different lengths do not link (each length has an index of its own);
repeated rows count each; a null id is read as -1; an empty table gives no rows. Of lists equally near the first counts.
Classes are 64-bit hashes of the vector. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType, IntegerType, StructField, StructType

from gridloom.llm.common import components, stored, unstore

CODES = 64  # codewords of a subspace
WIDTH = 4  # dimensions of a subspace
MOST_PARTS = 4096  # of one list; past that (8 million classes in a list) parts are dealt in pieces


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as double-precision vectors of length 1."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gaps(c: np.ndarray) -> np.ndarray:
    """Distances between the rows."""
    return np.sqrt(np.maximum(0, (c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * c @ c.T))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's rounds from ``k`` rows drawn without repeats; an empty centre stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids (lists, dim) and codebooks (subspaces, codewords, width) over residuals padded with zeros."""

    centroids: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Quantiser:
        centroids = k_means(x, lists)
        rest = _split(x - centroids[_nearest(x, centroids)])
        books = np.zeros((rest.shape[1], CODES, WIDTH))
        for m in range(rest.shape[1]):
            made = k_means(rest[:, m], CODES)
            books[m, : len(made)], books[m, len(made) :] = made, made[0]
        return Quantiser(centroids, books)

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        rest = _split(x - self.centroids[near])
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(rest.shape[1])], axis=1)
        made = self.books[np.arange(rest.shape[1])[None, :], codes]
        return codes.astype(np.uint8), np.sqrt(((rest - made) ** 2).sum(axis=(1, 2)))

    def tables(self, x: np.ndarray, lst: int) -> np.ndarray:
        """Squared distances of the residuals to ``lst`` from each codeword: (rows, subspaces, codewords)."""
        rest = _split(x - self.centroids[lst])
        cross = np.einsum("bmw,mkw->bmk", rest, self.books, optimize=True)
        return (rest**2).sum(axis=2)[:, :, None] - 2 * cross + (self.books**2).sum(axis=2)[None]

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that ``codes`` in ``lists`` stand for, single precision."""
        made = self.books[np.arange(codes.shape[1])[None, :], codes].reshape(len(codes), -1)
        return (made[:, : self.centroids.shape[1]] + self.centroids[lists]).astype(np.float32)

    def probes(self, x: np.ndarray, near: np.ndarray, reach: float, gaps: np.ndarray) -> np.ndarray:
        """Which lists each row probes: (rows, lists). ``gaps``: distances between the centroids."""
        away = (self.centroids**2).sum(axis=1)[None] - 2 * x @ self.centroids.T
        return away - away[np.arange(len(x)), near][:, None] <= 2 * reach * gaps[near] + 1e-6


def _split(rest: np.ndarray) -> np.ndarray:
    """Rows padded and cut into subspaces: (rows, subspaces, width)."""
    parts = -(-rest.shape[1] // WIDTH)
    padded = np.zeros((len(rest), parts * WIDTH))
    padded[:, : rest.shape[1]] = rest
    return padded.reshape(len(rest), parts, WIDTH)


def reach_of(cosine: float) -> float:
    """How far apart two unit vectors of at least this cosine are at most."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def bins_of(sizes: np.ndarray, centroids: np.ndarray, block: int) -> np.ndarray:
    """The bin of each list: each takes its nearest free lists while they have at most ``block`` classes together."""
    bins, free, made = np.full(len(sizes), -1), np.ones(len(sizes), bool), 0
    for start in np.argsort(-sizes, kind="stable").tolist():
        if not free[start]:
            continue
        near = np.argsort(((centroids - centroids[start]) ** 2).sum(axis=1), kind="stable")
        near = np.concatenate([[start], near[free[near] & (near != start)]])
        some = near[: max(1, int(np.searchsorted(np.cumsum(sizes[near]), block, side="right")))]
        bins[some], free[some], made = made, False, made + 1
    return bins


def _usable(column: str) -> str:
    return f"coalesce(size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0), false)"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def index(classes: DataFrame, quantiser: Quantiser, dim: int, reach: float) -> DataFrame:
    """``node, copies, vec, list, codes, miss, probes`` of ``classes (node, copies, embedding)``."""
    sent = classes.sparkSession.sparkContext.broadcast(quantiser)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        c = q.centroids
        gaps = _gaps(c)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                raw = _matrix(part.column("embedding"), dim)
                x = unit(raw)
                near = _nearest(x, c)
                codes, miss = q.encode(x, near)
                row, lst = np.nonzero(q.probes(x, near, reach, gaps))
                bounds = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(near.astype(np.int32)), pa.array([v.tobytes() for v in codes], pa.binary()), pa.array(miss), pa.ListArray.from_arrays(pa.array(bounds), pa.array(lst.astype(np.int32)))],
                    names=["node", "copies", "vec", "list", "codes", "miss", "probes"],
                )

    return classes.select("node", "copies", "embedding").mapInArrow(assign, "node long, copies long, vec binary, list int, codes binary, miss double, probes array<int>")


def _spanning(hits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Joins the labels of the columns that share a row of ``hits``; labels are positions of columns."""
    top = len(labels)
    while True:
        low = np.where(hits, labels[None], top).min(axis=1)
        new = np.minimum(labels, np.where(hits, low[:, None], top).min(axis=0))
        if (new == labels).all():
            return labels
        to = np.arange(top + 1)
        np.minimum.at(to, labels, new)  # all that shared a label follow it
        labels = to[new]


def compare(rows: pd.DataFrame, quantiser: Quantiser, cosine: float, kind: str, step: int = 256) -> pd.DataFrame:
    """``node, links, root`` of a part of a bin and a block of classes that probe it: the copies linked with each
    prober, and edges of a spanning forest. ``kind``: the number format of the vectors' bytes."""
    own = rows["codes"].notna().to_numpy()
    listed, asking = rows[own], rows[~own]
    nodes, copies, asks = listed["node"].to_numpy(), listed["copies"].to_numpy(), asking["node"].to_numpy()
    if not len(nodes) or not len(asks):
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    x = unit(np.frombuffer(b"".join(listed["vec"]), kind).reshape(len(nodes), -1))
    q = unit(np.frombuffer(b"".join(asking["vec"]), kind).reshape(len(asks), -1))
    codes = np.frombuffer(b"".join(listed["codes"]), np.uint8).reshape(len(nodes), -1)
    made = quantiser.decoded(listed["list"].to_numpy(np.int64), codes)
    # What a distance must not exceed, less the part of it that a row of the list has by itself.
    near = ((reach_of(cosine) + listed["miss"].to_numpy()) ** 2 - (made.astype(np.float64) ** 2).sum(axis=1) - 1 + 1e-3).astype(np.float32)
    labels, first = np.arange(len(nodes)), np.full(len(asks), -1)
    links = np.zeros(len(asks), np.int64)
    for at in range(0, len(asks), step):
        some = q[at : at + step]
        hits = (some * -2).astype(np.float32) @ made.T <= near[None]
        r, c = np.nonzero(hits)
        for i in range(0, len(r), 65_536):
            a, b = r[i : i + 65_536], c[i : i + 65_536]
            hits[a, b] = (np.einsum("ij,ij->i", some[a], x[b]) >= cosine) & (asks[at + a] != nodes[b])
        links[at : at + step] = hits @ copies
        found = np.flatnonzero(hits.any(axis=1))
        if len(found):
            labels = _spanning(hits[found], labels)
            first[at + found] = hits[found].argmax(axis=1)
    linked = np.flatnonzero(first >= 0)
    met = np.flatnonzero(np.bincount(labels, minlength=len(labels))[labels] > 1)
    out_node = np.concatenate([asks[linked], nodes[met]])
    out_root = np.concatenate([nodes[labels[first[linked]]], nodes[labels[met]]])
    return pd.DataFrame({"node": out_node, "links": np.concatenate([links[linked], np.zeros(len(met), np.int64)]), "root": out_root})


def _spread(rows: DataFrame, subs: DataFrame, kind: str, reach: float | None) -> DataFrame:
    """``rows (bin, node, vec, ...)`` with the part of their bin that they lie in, or, given a ``reach``, each part that a
    partner may lie in. ``subs``: ``bin, deal, centres`` for each deal of a bin's rows, which is one group."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])

    def place(rows: pa.Table, subs: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema_of.empty_table()
        dim = len(rows.column("vec")[0].as_py()) // np.dtype(kind).itemsize
        centres = np.frombuffer(subs.column("centres")[0].as_py(), np.float64).reshape(-1, dim)
        q = Quantiser(centres, np.zeros((0, CODES, WIDTH)))
        gaps = _gaps(centres)
        row, part = [], []
        for at in range(0, rows.num_rows, 2048):
            x = unit(np.frombuffer(b"".join(rows.column("vec").slice(at, 2048).to_pylist()), kind).reshape(-1, dim))
            near = _nearest(x, centres)
            r, p = (np.arange(len(x)), near) if reach is None else np.nonzero(q.probes(x, near, reach, gaps))
            row.append(at + r)
            part.append(p)
        return rows.take(pa.array(np.concatenate(row))).append_column("part", pa.array(np.concatenate(part).astype(np.int32))).cast(schema_of)

    schema_of = to_arrow_schema(schema)
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64("node", F.lit(3)), F.col("__deals"))).groupBy("bin", "__deal")
    return dealt.cogroup(subs.groupBy("bin", "deal")).applyInArrow(lambda x, y: place(x.drop_columns(["__deal"]), y), schema)


def _links(indexed: DataFrame, quantiser: Quantiser, cosine: float, block: int, kind: str) -> DataFrame:
    """``node, links, root`` found between the classes of ``indexed`` and the bins they probe."""
    spark = indexed.sparkSession
    # At most a row for each list, and the lists are bounded.
    sizes = np.zeros(len(quantiser.centroids), np.int64)
    for lst, n in indexed.groupBy("list").count().collect():
        sizes[lst] = n
    bins = bins_of(sizes, quantiser.centroids, block)
    held = np.bincount(bins, weights=sizes).astype(np.int64)
    bin_of = F.lit(bins.tolist())
    probed = F.array_distinct(F.transform("probes", lambda p: F.get(bin_of, p)))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = [F.lit(None).cast(kind_of).alias(n) for n, kind_of in (("list", "int"), ("codes", "binary"), ("miss", "double"))]
    listed = indexed.select(F.get(bin_of, F.col("list")).alias("bin"), "node", "copies", "vec", "list", "codes", "miss")
    probing = indexed.select(F.explode(probed).alias("bin"), "node", "copies", "vec", *none)
    large = [(b, min(-(-n // block), MOST_PARTS)) for b, n in enumerate(held.tolist()) if n > block]
    if large:
        asking = dict(probing.groupBy("bin").count().collect())
        split = F.broadcast(spark.createDataFrame([(b, n, -(-int(held[b]) // (8 * block)), -(-asking[b] // (8 * block))) for b, n in large], "bin int, __parts int, __own int, __asked int"))
        # A sample of each large bin, at most 16 rows for each of its parts.
        share = F.lit(float(1 << 30)) * 16 * F.col("__parts") / F.lit(held.astype(float).tolist())[F.col("bin")]
        some = listed.join(split, "bin").where(F.pmod(F.xxhash64("node", F.lit(4)), F.lit(1 << 30)) < share)

        def centres(rows: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.frombuffer(b"".join(rows.sort_values("node")["vec"]), kind).reshape(len(rows), -1))
            return pd.DataFrame({"bin": rows["bin"].iloc[:1], "centres": [k_means(x, int(rows["__parts"].iloc[0])).tobytes()]})

        subs = stored(some.select("bin", "node", "vec", "__parts").groupBy("bin").applyInPandas(centres, "bin int, centres binary"), "centres")
        own, asked = (subs.join(split.select("bin", c), "bin").select("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)).alias("deal"), "centres") for c in ("__own", "__asked"))
        deals = lambda rows, c: rows.join(split.select("bin", F.col(c).cast("long").alias("__deals")), "bin")
        is_large = F.col("bin").isin([b for b, _ in large]) if len(large) <= 1000 else F.get(F.lit((held > block).tolist()), F.col("bin"))
        listed = listed.where(~is_large).withColumn("part", F.lit(0)).unionByName(_spread(deals(listed.where(is_large), "__own"), own, kind, None).drop("__deals"))
        probing = probing.where(~is_large).withColumn("part", F.lit(0)).unionByName(_spread(deals(probing.where(is_large), "__asked"), asked, kind, reach_of(cosine)).drop("__deals"))
        listed, probing = stored(listed, "listed"), stored(probing, "probing")
    else:
        listed, probing = (rows.withColumn("part", F.lit(0)) for rows in (listed, probing))
    # A row for each part: one for about ``block`` classes.
    counts = listed.groupBy("bin", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    asks = probing.groupBy("bin", "part").agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("blocks"))
    deal = stored(counts.join(asks, ["bin", "part"]), "deal")
    deal = F.broadcast(deal) if deal.count() <= 500_000 else deal
    mine, his = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(n)).cast("int") for s, n in ((1, "pieces"), (2, "blocks")))
    columns = ["bin", "part", "piece", "block", "node", "copies", "vec", "list", "codes", "miss"]
    listed = listed.join(deal, ["bin", "part"]).withColumn("piece", mine).withColumn("block", F.explode(each("blocks"))).select(*columns)
    probing = probing.join(deal, ["bin", "part"]).withColumn("block", his).withColumn("piece", F.explode(each("pieces"))).select(*columns)
    sent = spark.sparkContext.broadcast(quantiser)

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        return compare(rows, sent.value, cosine, kind)

    return listed.unionByName(probing).groupBy("bin", "part", "piece", "block").applyInPandas(met, "node long, links long, root long")


def _sample(classes: DataFrame, dim: int, n: int, take: int) -> np.ndarray:
    """About ``take`` vectors, chosen by a hash: rows of a matrix."""
    chosen = classes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, take / n)) + 1)
    got = chosen.select("node", "embedding").toArrow().sort_by("node").column("embedding").combine_chunks()
    return unit(_matrix(got, dim)) if len(got) else unit(np.ones((1, dim)))


def near_vectors(table: DataFrame, cosine: float = 0.95, per_list: int = 128, most_lists: int = 4096, sample: int = 65_536, block: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``table (vec_id, embedding)``. ``sample``: the most rows that
    lists and codebooks are fitted to, and the driver holds (at most 256 MB of them)."""
    slim = table.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)).alias("vec_id"), "embedding")
    rows = slim.withColumn("node", F.when(F.expr(_usable("embedding")), F.xxhash64("embedding")))
    grouped = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    classes = stored(grouped.withColumn("dim", F.size("embedding")), "vectors")
    found = None
    for dim, n in classes.groupBy("dim").count().collect():
        some = classes.where(F.col("dim") == dim)
        lists = max(1, min(most_lists, n // per_list))
        take = min(sample, (256 << 20) // (8 * dim), 16_384 if lists <= 512 else 32 * lists)
        quantiser = Quantiser.fit(_sample(some, dim, n, take), lists)
        indexed = stored(index(some, quantiser, dim, reach_of(cosine)), "index")
        got = _links(indexed, quantiser, cosine, block, kind)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    joined = classes.select("node", "low", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(low, "root").join(counts, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(named, "named")
    unstore(found)
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
