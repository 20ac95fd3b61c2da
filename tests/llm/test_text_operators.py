"""Operators that read one text at a time, against plain versions of their contracts, and on awkward tables."""

from __future__ import annotations

import functools
import re
import struct
import time
import zlib
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridloom.llm import decontamination, packing, pii, queries, secrets, sharding, token_counts, toxicity

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", StringType()), StructField("size", LongType())])
LONG = "lorem ipsum 12 a@b.org dolor " * 20_000


def awkward(spark):
    """Null and empty texts, a very long one, repeated rows, null ids and columns whose names operators use."""
    return spark.createDataFrame([(1, None, "x", 1), (2, "", "y", None), (3, LONG, None, 3), (4, "same text here for all", "z", 4), (4, "same text here for all", "z", 4), (5, " \n\t ", "w", 5), (None, "no id", "v", 6)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Personal data.


def plain_pii(text):
    out = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and pii.luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out


def test_pii_rules_on_random_texts():
    r = Random(5)
    for _ in range(1500):
        text = "".join(r.choice(["a", "Z", "1", "4111 1111 1111 1111", "@", ".", "-", "+", " ", "(", ")", "192.168.0.1", "x@y.com", "0", "256", "é", "\n", "+1 (555) 123-4567"]) for _ in range(r.randint(1, 30)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_on_held_out_sentences():
    field = pii.trained()
    hit = wanted = found = 0
    for text, spans in pii.sentences(200, seed=99):
        got = set(pii.field_spans(text, field))
        wanted, found, hit = wanted + len(spans), found + len(got), hit + len(got & set(spans))
    assert hit / wanted > 0.9 and hit / found > 0.9


@pytest.mark.parametrize("value", ["john.smith [at] example [dot] com", "john at example dot com", "mary (at) sample (dot) org", "GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 0012"])
@pytest.mark.parametrize("around", ["please write to {} for the rest", "{}", "the account: {}\nand more of the text"])
def test_values_with_chunks_of_letters_only(value, around):
    text = around.format(value)
    at = text.index(value)
    assert (at, at + len(value)) in {s[1:] for s in pii.field_spans(text, pii.trained())}


@pytest.mark.parametrize("text", ["we met at noon and left at the dot of six", "look at the dot on the map", "the year 2019 was good", "chapter 12 begins at page 340"])
def test_plain_words_around_hints_are_left(text):
    assert pii.field_spans(text, pii.trained()) == []


@pytest.mark.parametrize("text", ["call 555-1234 now", "12 4111 1111 3-4", "+1 (415) 555-0199, x"])
def test_field_decoding_is_the_best_of_all_segmentations(text):
    field = pii.trained()
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    segments = field.lattice(text, tokens)
    score = {(i, j): s for (i, j, _), s in zip(segments, field.scores(segments), strict=True)}

    @functools.cache
    def best(at, last):
        if at == len(tokens):
            return 0.0
        out = field.t[last, 0] + best(at + 1, 0)
        for j in range(at + 1, len(tokens) + 1):
            for y in range(1, len(pii.KINDS) + 1) if (at, j) in score else ():
                out = max(out, field.t[last, y] + score[at, j][y - 1] + best(j, y))
        return out

    total, last, at = 0.0, 0, 0
    first, end = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
    for a, b, y in field.decode(text, tokens):
        for _ in range(at, first[a]):
            total, last = total + field.t[last, 0], 0
        total, last, at = total + field.t[last, y] + score[first[a], end[b]][y - 1], y, end[b]
    for _ in range(at, len(tokens)):
        total, last = total + field.t[last, 0], 0
    assert total == pytest.approx(best(0, 0))


@pytest.mark.parametrize("text", ["see 1.2.3.4² there", "call ٣٤٥-٦٧٨-٩٠١٢ or ５５５-1234", "①②③.④.5.6", "1.2.3.4\u0663"])
def test_digits_of_other_scripts_are_no_digits(text):
    assert [s for s in pii.all_spans(text, pii.trained())[0]] == plain_pii(text)


def test_very_long_runs_take_time_in_proportion():
    field, r = pii.trained(), Random(4)
    took = []
    for n in (20_000, 80_000):
        for text in ("7" * n, ",".join(str(r.randint(0, 9999)) for _ in range(n // 5)), " ".join(f"{r.randint(201, 989)}-555-{r.randint(1000, 9999)}" for _ in range(n // 13))):
            began = time.process_time()
            assert pii.base_spans(text) == plain_pii(text) or n > 20_000
            pii.field_spans(text, field)
            took.append(time.process_time() - began)
    assert all(late < 16 * early + 1 for early, late in zip(took[:3], took[3:], strict=True))


def test_spans_found_one_by_one_are_those_of_the_whole_run():
    field = pii.trained()
    found = pii.field_spans(" ".join(f"{200 + i}-555-{1000 + i}" for i in range(500)), field)
    assert [e - s for k, s, e in found if k == "phone"] == [12] * 500


def test_meeting_spans():
    r = Random(2)
    for _ in range(200):
        spans = [("x", a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 6)))]
        meets = pii.meeting(spans)
        for a in range(0, 70, 3):
            b = a + r.randint(1, 8)
            assert meets(a, b) == any(a < y and x < b for _, x, y in spans)


def test_pii_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op1_semi_markov_pii"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        base = plain_pii(r.text or "")
        row = got[r.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        spans = set(row.spans.split(",")) if row.spans else set()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= spans


def test_pii_redaction_keeps_columns_and_awkward_rows(spark):
    made = pii.redact(awkward(spark))
    assert made.columns == ["doc_id", "text", "score", "size"]
    rows = made.collect()
    assert len(rows) == 7 and "a@b.org" not in next(r.text for r in rows if r.doc_id == 3)
    assert pii.redact(empty(spark)).count() == 0 and pii.find_pii(empty(spark)).count() == 0
    assert pii.find_pii(awkward(spark)).where("size(base) = 0").count() == 6


# Secrets.


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_rules_on_random_texts():
    r = Random(6)
    for _ in range(1500):
        text = "".join(r.choice(["password", "API_key", "apikey", "TOKEN", ":", "=", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "x", "é", "\n", "Secret = ", "-", "/"]) for _ in range(r.randint(1, 20)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_random_keys_are_found_and_identifiers_are_not(spark):
    r = Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = [(i, f"see {''.join(r.choice(letters) for _ in range(44))} end") for i in range(60)]
    names = [(100 + i, f"see getUserIndexPath{i}FirstTestPage and /data/config/value_{i}/main_table_page end") for i in range(60)]
    got = {x.doc_id: [s.kind for s in x.spans] for x in secrets.find_secrets(spark.createDataFrame(keys + names, "doc_id long, text string")).collect()}
    assert sum("random" in got[i] for i, _ in keys) >= 45
    assert sum("random" in got[i] for i, _ in names) <= 3


def test_secrets_of_awkward_tables(spark):
    assert secrets.find_secrets(awkward(spark)).where("size(spans) = 0").count() == 7
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_battery_accepts_random_symbols():
    rng = np.random.default_rng(4)
    low = [min(secrets.battery("".join(rng.choice(list(secrets.ALPHABETS["hex"]), 64)), "hex")) for _ in range(300)]
    assert np.mean(np.array(low) < 0.01) < 0.08


# Token counts.


def test_counts_are_greedy_longest_matches(spark, sf_dir):
    pieces = token_counts.vocabulary()
    known, longest = set(pieces), max(map(len, pieces))

    def plain(word):
        rest, n = b" " + word, 0
        while rest:
            k = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in known), 0)
            if not k:
                return 1
            rest, n = rest[k:], n + 1
        return n

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).unionByName(awkward(spark).select("doc_id", "text"), allowMissingColumns=True)
    rows = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").collect()
    got = token_counts.token_counts(docs).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(w := (r.text or "").encode().split()), sum(map(plain, w))) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_unspellable_words_count_once():
    a = token_counts.Automaton([b" ", b"a", b" ab", b"bc"])
    assert [a[w] for w in (b"a", b"ab", b"abc", b"abbc", b"z", b"")] == [2, 1, 1, 2, 1, 1]


# Decontamination.


def plain_tiles(doc, item, least):
    dm, im, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not dm[i + k] and not im[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return tiles
        for i, j in found:
            if not any(dm[i : i + best]) and not any(im[j : j + best]):
                dm[i : i + best] = [True] * best
                im[j : j + best] = [True] * best
                tiles.append(best)


def test_tiling_covers_what_plain_greedy_tiling_covers():
    r = Random(3)
    for _ in range(150):
        item = [r.randint(0, 9) for _ in range(r.randint(3, 25))]
        doc = [r.randint(0, 9) for _ in range(r.randint(0, 20))] + item[5:] + item[:5] + [r.randint(0, 9) for _ in range(5)]
        got = sorted(n for _, _, n in decontamination.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3))
        assert got == sorted(plain_tiles(doc, item, 3))


def test_matches_are_those_of_plain_tiling_of_all_pairs():
    r = Random(8)
    words = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(words, k=r.randint(2, 14)))) for i in range(12)]
    items.append((99, items[3][1]))
    block = decontamination._Block(items, 3, 0.6)
    some = 0
    for _ in range(150):
        cut = r.choice(items)[1].split()
        at = r.randrange(len(cut))
        doc = " ".join([*r.choices([*words, "other"], k=r.randint(0, 15)), *cut[at:], "other", *cut[:at], *r.choices(words, k=5)])
        want = []
        for i, text in items:
            item = text.split()
            tiles = plain_tiles(doc.split(), item, 3) if len(item) >= 3 else []
            if tiles and sum(tiles) >= 0.6 * len(item):
                want.append((i, len(item), sum(tiles), len(tiles)))
        assert sorted(block.matches(doc)) == sorted(want)
        some += len(want)
    assert some > 100


def test_running_hashes_are_those_of_equal_windows():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3, 300)
    runs = decontamination.Running(ids)
    for k in (1, 2, 5, 9):
        starts = np.arange(len(ids) - k + 1)
        seen = {}
        for s, h in zip(starts.tolist(), runs.windows(starts, k).tolist(), strict=True):
            assert seen.setdefault(h, tuple(ids[s : s + k])) == tuple(ids[s : s + k])
        assert len(seen) == len({tuple(ids[s : s + k]) for s in starts})


def test_reordered_passages_are_caught_and_clean_texts_left(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect() if len(decontamination.tokens(r.text)) >= 15][:8]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        cut = len(w) // 3
        docs += [(2 * i, "prelude words " + text + " after"), (2 * i + 1, " ".join(w[2 * cut :] + ["filler"] + w[:cut] + ["between", "these"] + w[cut : 2 * cut]).upper())]
    docs += [(1000, "a clean text about nothing in particular that nobody tests"), (1001, None), (1002, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("coverage", F.lit("clash"))
    got = {(r.doc_id // 2, r.item_id) for r in decontamination.contaminated(table, bench).collect()}
    assert {(i, items[i][0]) for i in range(len(items))} <= got
    kept = decontamination.decontaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}
    one_block, many = decontamination.contaminated(table, bench).collect(), decontamination.contaminated(table, bench, block_bytes=600).collect()
    assert sorted(map(tuple, one_block)) == sorted(map(tuple, many))
    assert decontamination.contaminated(awkward(spark), bench.limit(0)).count() == 0 and decontamination.decontaminated(awkward(spark), bench.limit(0)).count() == 7


# Sharding.


@pytest.mark.parametrize("n", [0, 1, 2, 17, 1000, 4099])
def test_permutation_is_a_bijection(n):
    rows = np.arange(n, dtype=np.uint64)
    p = sharding.permute(rows, n)
    assert sorted(p.tolist()) == list(range(n)) and (sharding.unpermute(p, n) == rows).all()


def test_shards_of_rows(spark, sf_dir):
    got = queries.QUERIES["op5_feistel_shards"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = np.bincount([r.shard for r in got], minlength=16)
    assert sizes.max() - sizes.min() <= 1 and len(got) == len(texts)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shards_do_not_depend_on_partitions(spark):
    docs = awkward(spark)
    one, two = (sorted(map(str, sharding.feistel_shards(docs.repartition(n), 3).collect())) for n in (1, 5))
    assert one == two and len(one) == 7
    assert sharding.feistel_shards(empty(spark)).count() == 0


# Toxicity.


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    made = queries.QUERIES["op6_nnpu_toxicity"](spark, big).where("held_out")
    rows = made.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit / max(1, sum(r.toxic for r in rows)) > 0.8 and hit / max(1, sum(r.predicted for r in rows)) > 0.85


def test_toxicity_of_awkward_tables(spark):
    labels = spark.createDataFrame([(i, i % 2 if i else None) for i in range(12)], "doc_id long, toxic int")
    made = toxicity.toxicity(awkward(spark), labels)
    assert made.count() == 7 and made.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    none = toxicity.not_toxic(awkward(spark), labels.limit(0))
    assert none.count() == 7 and none.columns == ["doc_id", "text", "score", "size"]


def test_labels_of_held_out_rows_change_no_score(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity(docs, labels).collect())) == sorted(map(tuple, toxicity.toxicity(docs, turned).collect()))


def test_risk_estimator_separates_planted_words():
    r = Random(2)
    base = [f"w{i}" for i in range(300)]
    text = lambda bad: sorted(set(r.choices(base, k=40) + (["vile", "foul"] if bad else [])))
    model = toxicity.fit([text(True) for _ in range(60)], [text(i % 10 == 0) for i in range(600)], 0.1)
    assert model.score("a vile and foul thing") > 0.7 > 0.5 > model.score("w1 w2 w3")
    assert toxicity.fit([], [["a"]], 0.1).score("a") < 1e-6


def test_weights_are_those_of_plain_dense_steps():
    """Adam on the risk of dense matrices, with its gradient by differences."""
    rng = np.random.default_rng(6)
    dense_p, dense_u, prior, decay = (rng.random((12, 4)) < 0.5).astype(float), (rng.random((30, 4)) < 0.2).astype(float), 0.2, 1e-3

    def risk(w, parts):
        zp, zu = dense_p @ w[:-1] + w[-1], dense_u @ w[:-1] + w[-1]
        low = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        return prior * np.log1p(np.exp(-zp)).mean() + (low if parts else 0), low

    w, m, v = np.zeros(5), np.zeros(5), np.zeros(5)
    for step in range(1, 41):
        both = risk(w, True)[1] >= 0
        g = np.array([(risk(w + d, both)[0] - risk(w - d, both)[0]) / 2e-6 for d in np.eye(5) * 1e-6])
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    got = toxicity.descend(np.nonzero(dense_p), np.nonzero(dense_u), (12, 30), 4, prior, steps=40, decay=decay)
    assert np.allclose(got, w, atol=1e-3)


def test_boundary_is_where_recall_squared_over_share_is_best():
    r = Random(4)
    for _ in range(60):
        p, u = [float(r.randint(2, 6)) for _ in range(15)], [float(r.randint(0, 4)) for _ in range(40)]
        got = toxicity.boundary(np.array(p), np.array(u), 1e9)
        worth = lambda cut, p=p, u=u: (sum(x >= cut for x in p) / len(p)) ** 2 / max(sum(x >= cut for x in u) / len(u), 1 / len(u))
        assert worth(got) == pytest.approx(max(worth(c) for c in {*p, *u}))
        assert toxicity.boundary(np.array(p), np.array(u), 1.5) == min(got, 1.5)
    assert toxicity.boundary(np.array([1.0, 2.0]), np.array([1.0, 2.0, 2.0]), 0.0) == 3.0


def test_scores_are_those_of_a_plain_pass(spark, sf_dir):
    """The query against the model, row by row in one process; samples smaller than the table are the lowest hashes."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    trains = [i for i in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    share = {r.doc_id: r.s for r in docs.select("doc_id", toxicity._share().alias("s")).collect()}
    some = [i for i in trains if share[i] < 0.95 * 4000 / len(trains)]
    model = toxicity.fit([sorted(toxicity.words(rows[i])) for i in trains if known.get(i) == 1], [sorted(toxicity.words(rows[i])) for i in some], sum(known.values()) / len(known))
    for r in queries.QUERIES["op6_nnpu_toxicity"](spark, sf_dir).collect():
        assert r.score == pytest.approx(model.score(rows[r.doc_id]), abs=1e-6) and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_words_of_long_texts_for_the_fit_are_bounded():
    text = " ".join("abcdefghij"[i // 100 % 10] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10] for i in range(1000))
    assert len(toxicity.some_words(text, 100)) == 100 and toxicity.some_words(text, 1000) == sorted(toxicity.words(text))
    assert set(toxicity.some_words(text, 100)) <= set(toxicity.some_words(text + " zzz", 101))


# Packing.


def test_tokens_equal_the_whole_text_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    r = Random(1)
    parts = ["Hello", "world.", "ÉCOLE", "naïve,", "ﬁne", "İstanbul", "é", "日本", "x1", "don't", "...", "a.b", " ", "\t", "\r\n", "🙂", "ß", "Ǆ", "12,345", "<|endoftext|>", "end.,"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice([" ", "  ", "\n", ""]) for _ in range(r.randint(0, 12)))
        ids = [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert packing.token_bytes(text, path) == struct.pack(f"<{len(ids)}I", *ids), text


def test_rare_words_are_remembered_once():
    """A word that comes once takes one place in the memory; another spelling is kept when the word comes again."""
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    ids = packing._WordIds(path)
    whole = {c: ids._whole(c) for c in ("Thheatth.", "thheatth", "thheatth,")}
    assert ids["Thheatth."] == whole["Thheatth."] and set(ids) == {"thheatth"}
    assert [ids[c] for c in whole] == list(whole.values()) and set(ids) == set(whole)


def test_texts_of_other_vocabularies_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"?": 0, "one": 7, "two words": 8, "a": 9}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    other.save(str(tmp_path / "t.json"))
    assert packing.token_bytes("one|two words|A|a", str(tmp_path / "t.json")) == struct.pack("<5I", 7, 8, 0, 9, packing.END_ID)
    assert packing.token_bytes(None, str(tmp_path / "t.json")) == struct.pack("<I", packing.END_ID)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_close_to_its_bound(spark, sf_dir):
    rows = packing.best_fit_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    n = check_packing(rows, 4096)
    counts = np.bincount([r.length for r in rows], minlength=4097)
    assert n <= packing.lower_bound(counts, 4096) + 1
    for doc_id in {r.doc_id for r in rows}:
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == doc_id)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 4096 for _, _, n in own[:-1])
        assert [s for _, s, _ in own] == [4096 * i for i in range(len(own))]


def test_groups_exchange_what_does_not_fit(spark):
    r = Random(4)
    items = spark.createDataFrame([(i, r.randint(1, 100)) for i in range(3000)], "id long, length long")
    made = packing.pack(items, 100, group_items=200)
    rows = made.collect()
    assert sorted(x.id for x in rows) == list(range(3000))
    n = check_packing(rows, 100)
    bound = packing.lower_bound(np.bincount([x.length for x in rows], minlength=101), 100)
    assert bound <= n <= bound * 1.03


def test_lower_bounds_hold():
    r = Random(9)
    for _ in range(60):
        lengths = np.array([r.randint(1, 30) for _ in range(r.randint(1, 40))])
        _, _, free = packing.best_fit_decreasing(lengths, 30)
        assert packing.lower_bound(np.bincount(lengths, minlength=31), 30) <= len(free)
    assert packing.lower_bound(np.bincount([16] * 7, minlength=31), 30) == 7


def test_packing_of_awkward_tables(spark):
    rows = packing.best_fit_sequences(awkward(spark)).collect()
    check_packing(rows, 4096)
    assert [(r.length, r.ids_crc32) for r in rows if r.doc_id == 1] == [(1, zlib.crc32(struct.pack("<I", 1)))]
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert packing.best_fit_sequences(empty(spark)).count() == 0
