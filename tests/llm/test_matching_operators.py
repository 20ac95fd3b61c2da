"""Joins, near-duplicate vectors, archives and the pipeline, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections import defaultdict
from random import Random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common, ngram_join, queries, vector_dedup, warc


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_join(rows):
    sets = defaultdict(set)
    for i, text in rows:
        sets[i].add(shingles(text))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    links = [(a, b) for n, (a, x) in enumerate(flat) for b, y in flat[:n] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return roots_of(sets, links)


def near_texts(n, seed):
    r = Random(seed)
    words = [f"w{i}" for i in range(400)]
    common_line = " ".join(r.choices(words, k=30))
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(r.choices(words, k=r.randint(1, 60))) + (" " + common_line if kind > 0.8 else "")
        texts.append(text)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 48), (2, 3), (3, 2)])
def test_join_equals_all_pairs(spark, seed, least):
    rows = near_texts(260, seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two three four five"), (906, "one"), (906, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("n", F.lit("x"))
    got = ngram_join.jaccard_components(docs, least_frequent=least).collect()
    want = plain_join(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)


def test_one_of_each_group_stays(spark):
    rows = near_texts(120, 7) + [(900, None), (901, ""), (906, "one"), (906, "one"), (907, "ONE")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, root string")
    kept = ngram_join.without_near_copies(docs)
    want = plain_join(rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_documents_without_ids_link_and_stay(spark):
    texts = [t for _, t in near_texts(150, 5)] + ["alone without an id", "one", "ONE"]
    texts = [f"{t} w{k % 7}" if k % 5 == 0 else t for k, t in enumerate(texts)]
    ids = [None if k % 3 == 0 or k >= 120 else k for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    components = defaultdict(list)
    for k, root in plain_join(list(enumerate(texts))).items():
        components[root].append(k)
    low = {k: min((ids[m] for m in ks if ids[m] is not None), default=None) for ks in components.values() for k in ks}
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(((ids[k], len(shingles(t)), low[k]) for k, t in enumerate(texts)), key=key)
    kept = [(r.doc_id, r.text) for r in ngram_join.without_near_copies(docs).collect()]
    assert sorted((i for i, _ in kept if i is not None)) == sorted({i for i in low.values() if i is not None})
    at = {t: root for root, ks in components.items() for t in (texts[k] for k in ks)}
    assert sorted(at[t] for _, t in kept) == sorted(components)


def test_join_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(none).count() == 0 and ngram_join.without_near_copies(none).count() == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, 8, dtype=np.uint64)]))
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        alone = sum(int(v).bit_count() for v in (x & ~y).view(np.uint64))
        assert len(np.intersect1d(a, b)) <= len(a) - alone


def test_accumulated_products_are_the_overlaps():
    rng = np.random.default_rng(7)
    pairs = []
    for i in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 80)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.8, 0.95, 1.0])], rng.integers(0, 2**64, int(rng.integers(0, 9)), dtype=np.uint64)]))
        pairs.append((i, 1000 + i, a, b))
    want = [(i, j) for i, j, a, b in pairs if 100 * (o := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - o)]
    kind = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), *(pa.array([p[k].view(np.int64) for p in pairs], kind) for k in (2, 3))], names=["a", "b", "x", "y"])
    got = [tuple(r.values()) for b in ngram_join.accumulated(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()]
    assert got == want and 50 < len(want) < 290


def test_cells_are_counted_over_all_tasks(spark):
    """A column that is once in each of many tasks stands out."""
    rng = np.random.default_rng(9)
    tasks = []
    for _ in range(60):
        counts = np.zeros(ngram_join.CELLS, np.int64)
        np.add.at(counts, rng.integers(0, ngram_join.CELLS, 20_000), 1)
        counts[12345] += 1
        counts[777_777] += 200
        tasks += [(i, ngram_join._packed(c)) for i, c in enumerate(counts.reshape(-1, ngram_join.CELL_BLOCK)) if c.any()]
    levels = ngram_join.cell_levels(spark.createDataFrame(tasks, "block int, cells binary"), 48)
    assert np.flatnonzero(levels).tolist() == [12345, 777_777] and ngram_join.parts_of(levels[[12345, 777_777]]).tolist() == [1, 16]


def test_sets_with_one_hash_are_told_apart():
    a, b = np.arange(5, dtype=np.uint64), np.arange(6, dtype=np.uint64)
    one, two = ngram_join.set_hashes(a)
    assert ngram_join.class_of(a) == one and ngram_join.class_of(a, frozenset([one])) == two != one
    assert ngram_join.class_of(b, frozenset([one])) == ngram_join.set_hashes(b)[0]


def test_leading_columns_of_linking_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**40, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**40, int(rng.integers(0, 4)), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= 75 * (len(a) + len(b) - o):
            assert len(np.intersect1d(a[: ngram_join.leading(len(a))], b[: ngram_join.leading(len(b))]))


# Vectors.


def plain_vectors(rows, cosine=0.95):
    usable = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            usable[k] = x / np.linalg.norm(x)
    pairs = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and float(usable[a] @ usable[b]) >= cosine]
    n = defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    roots = roots_of(range(len(rows)), pairs)
    low = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        low[roots[k]] = min(low[roots[k]], i)
    return sorted((i, n[k], low[roots[k]]) for k, (i, _) in enumerate(rows))


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.08]) * np.linalg.norm(base)
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, []), (2006, [1.0, 0.0]), (2007, [2.0, 0.01]), (2008, rows[0][1]), (2008, rows[0][1]), (2009, [x * 3 for x in rows[0][1]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x")).withColumn("list", F.lit(0))
    got = vector_dedup.near_vectors(table, per_list=40, block=64).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_on_the_table(spark, sf_dir):
    got = queries.QUERIES["op7_product_quantisation"](spark, sf_dir).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = sum(n for _, n, _ in plain_vectors(rows))
    assert sum(r.n_links for r in got) >= 0.9 * want


@pytest.mark.parametrize(("rank", "dim", "apart"), [(1, 64, 1.5), (2, 64, 0.5), (3, 128, 0.4)])
def test_hot_group_that_varies_along_few_directions(spark, rank, dim, apart):
    rng = np.random.default_rng(rank)
    base, ways = rng.normal(size=dim), rng.normal(size=(rank, dim))
    hot = base / np.linalg.norm(base) + apart * rng.uniform(-1, 1, size=(700, rank)) @ (ways / np.linalg.norm(ways, axis=1)[:, None])
    x = np.concatenate([hot, rng.normal(size=(1400, dim))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(table, per_list=30, block=256).collect()}
    unit = vector_dedup.unit(x)
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))


@pytest.mark.parametrize("dim", [8, 96])
def test_lists_past_the_first_level_are_split(spark, dim):
    """Three lists at the first level, about a hundred parts below them."""
    rng = np.random.default_rng(dim)
    near = rng.normal(size=(300, dim))
    x = np.concatenate([near, near[rng.integers(300, size=1500)] + 0.12 / np.sqrt(dim) * rng.normal(size=(1500, dim)) * np.linalg.norm(near, axis=1).mean(), rng.normal(size=(1200, dim))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(table, most_lists=3, block=32).collect()}
    unit = vector_dedup.unit(x)
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_dedup.near_vectors(only_bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_table_distances_are_those_of_the_codes():
    rng = np.random.default_rng(2)
    x = vector_dedup.unit(rng.normal(size=(500, 10)))
    q = vector_dedup.Quantiser.fit(x, 4)
    near = vector_dedup._nearest(x, q.centroids)
    codes, miss = q.encode(x, near)
    made = q.books[np.arange(codes.shape[1])[None], codes].reshape(len(x), -1)[:, :10] + q.centroids[near]
    lst = int(near[0])
    own = near == lst
    table = q.tables(x[:5], lst)
    far = sum(table[:, m].take(codes[own][:, m], axis=1) for m in range(codes.shape[1]))
    assert np.allclose(far, ((x[:5, None] - made[own][None]) ** 2).sum(axis=2), atol=1e-9)
    assert np.allclose(miss, np.sqrt(((x - made) ** 2).sum(axis=1)), atol=1e-9)


# Archives.


def test_warc_query(spark, sf_dir):
    got = {r.page_id: r for r in queries.QUERIES["op10_warc_zstd"](spark, sf_dir).collect()}
    first = {}
    pages = sorted((r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    for i, raw in pages:
        first.setdefault(raw, i)
    for i, raw in pages:
        refers = first[raw] if first[raw] != i else None
        want = (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers)
        assert tuple(got[i]) == want


def test_warc_awkward_pages(spark):
    pages = spark.createDataFrame([(2, None, None), (1, "http://a/ü?q=1 2", ""), (3, "http://b/", "héllo\r\n\r\nx"), (4, "http://b/", "héllo\r\n\r\nx"), (4, "http://b/", "héllo\r\n\r\nx")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    rows = warc.round_trip(spark, pages).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id != 4) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert [(r.record_type, r.refers_to, r.payload) for r in rows if r.page_id == 4] == [("revisit", 3, b"")] * 2
    assert next(r.payload for r in rows if r.page_id == 3).decode() == "héllo\r\n\r\nx"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_common_payloads_are_looked_up(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("p"), (F.col("id") % 900).cast("string"))).alias("html"))
    got = {r.page_id: r.refers_to for r in warc.described(pages).collect()}
    first = {}
    for r in sorted(pages.collect()):
        want = first.setdefault(r.html, r.page_id)
        assert got[r.page_id] == (None if want == r.page_id else want)


def test_files_that_no_attempt_owns_up_to_are_not_read(spark, tmp_path):
    """As a lost attempt leaves them: whole files, and one cut short."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html")).repartition(3)
    folder = tmp_path / "archives"
    first = warc.write_archives(pages, str(folder), roll_bytes=3000)
    assert first.count() > 3 and first.agg(F.sum("records")).first()[0] == 400
    again = warc.write_archives(pages, f"file:{folder}", roll_bytes=2000)
    next(folder.glob("*.zst")).with_name("part-lost-00000.warc.zst").write_bytes(b"cut")
    for manifest in (first, again):
        assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(400))
    with pytest.raises(Exception, match="records and not"):
        warc.read_archives(first.withColumn("records", F.col("records") + 1)).collect()


@pytest.mark.parametrize(("path", "uri"), [("s3a://b/k", "s3://b/k"), ("/x/y", "file:///x/y"), ("file:/x", "file:///x"), ("file:///x", "file:///x"), ("hdfs://h:8020/x", "hdfs://h:8020/x"), ("abfss://c@a.dfs.core.windows.net/x", "abfss://c@a.dfs.core.windows.net/x")])
def test_paths_of_shared_stores(path, uri):
    assert warc.arrow_uri(path) == uri


def test_unknown_stores_are_refused():
    with pytest.raises(ValueError, match="oss"):
        warc.arrow_uri("oss://b/k")


def archive(dictionary=b"", records=()):
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(**({"dict_data": made} if made else {}))
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(pack.compress(r) for r in records)


def record(payload=b"abc", page=1):
    return warc.record_bytes(page, "http://a/", payload, warc.payload_digest(payload), None)


def test_dictionaries_in_the_leading_frame():
    words = [b"<html><body>page %d about things</body></html>" % i * 20 for i in range(64)]
    d = zstandard.train_dictionary(2048, words).as_bytes()
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(archive(d, [record(w, i) for i, w in enumerate(words)])))] == words
    packed = zstandard.ZstdCompressor().compress(d)
    frame = warc.dictionary_frame(packed) + archive(d, [record(words[0])])[8 + len(d) :]
    assert next(warc.read_archive(io.BytesIO(frame)))["payload"] == words[0]


@pytest.mark.parametrize(
    "bad",
    [
        archive(records=[record()])[:-3],
        archive(records=[record() + b"x"]),
        archive(records=[record().replace(b"Content-Length: 3", b"Content-Length: 4")]),
        archive(records=[record().replace(b"WARC-Date", b"WARC-Dale")]),
        archive(records=[b"HTTP/1.1 200 OK\r\n\r\n"]),
        archive(records=[record() + record()]),
        b"garbage that is no frame",
        struct.pack("<II", warc.DICTIONARY_MAGIC, 100) + b"short",
        archive(records=[record().replace(b"abc", b"abd")]),
    ],
)
def test_bad_archives_are_refused(bad):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(bad)))


# The pipeline.


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = common.stored(stage(spark, docs, sf_dir), name)
        assert made.columns == docs.columns and dict(made.dtypes) == dict(docs.dtypes)
        ids = {r.doc_id for r in made.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == made.count()
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in made.select("doc_id", "text").collect()]
            assert plain_join(rows) == {i: i for i, _ in rows}
        docs = made
    assert 0.5 * n < docs.count() < n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    made = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(made.columns) and made.count() > 0
