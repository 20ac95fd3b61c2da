"""The pipeline against a plain version of its five stages, over a small corpus with awkward rows."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontamination, packing, pii, toxicity
from tests.llm.test_matching_operators import near_texts, roots_of, shingles
from tests.llm.test_text_operators import check_packing, plain_tiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __hash string, __toxicity double, component_id string, score int"


def lettered(text):
    """The made-up words in letters alone, as the classifier reads them."""
    return text and re.sub(r"\b[wqnt]\d+\b", lambda m: m[0][0] + m[0][1:].translate(str.maketrans("0123456789", "bcdfghjkmp")), text)


def corpus():
    r = Random(12)
    calm = [f"w{i}" for i in range(400)]
    rows = near_texts(300, 9)
    toxic = [(1000 + i, " ".join(r.choices(calm, k=30) + ["vileword", "foulword", "hateword"])) for i in range(40)]
    items = [(i, " ".join(f"q{r.randint(0, 400)}" for _ in range(20))) for i in range(6)]
    leaks = [(2000 + i, f"{' '.join(r.choices(calm, k=9))} {' '.join(t.split()[8:] + ['x'] + t.split()[:8])}") for i, t in items]
    people = [(3000 + i, f"write to joe{i}@mail.example or +44 20 7946 {1000 + i}, {' '.join(r.choices(calm, k=12))}") for i in range(8)]
    long = [(3500, " ".join(f"n{r.randint(0, 10**6)}" for _ in range(4000)))]
    odd = [(4000, None), (4001, ""), (4001, ""), (4002, "  \t"), (None, "no id but a text of its own"), (4004, "again and again the same row"), (4004, "again and again the same row")]
    return [(i, lettered(t)) for i, t in rows + toxic + leaks + people + long + odd], {i for i, _ in toxic}, [(i, lettered(t)) for i, t in items]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, toxic, items = corpus()
    spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "h", 0.5, "c", 3) for i, t in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i, _ in rows if i is not None] + [(None, 0, 1), (77777, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_stages(rows, model, items):
    rows = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    yield rows
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for k, root in roots_of(range(len(rows)), links).items():
        groups[root].append(rows[k])
    rows = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    yield rows

    def leaks(text):
        doc = decontamination.tokens(text)
        return any(len(it := decontamination.tokens(t)) >= 4 and sum(plain_tiles(doc, it, 4)) >= 0.6 * len(it) for _, t in items)

    rows = [(i, t) for i, t in rows if len(t or "") > 9000 or not leaks(t)]  # the long text holds no word of an item
    yield rows
    field = pii.trained()

    def masked(text):
        out, at = [], 0
        for kind, start, end in sorted((s for spans in pii.all_spans(text, field) for s in spans), key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    rows = [(i, t and masked(t)) for i, t in rows]
    yield rows
    whole, out = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), []
    for i, t in rows:
        ids = [*(whole.encode(t, add_special_tokens=False).ids if t else []), packing.END_ID]
        for at in range(0, len(ids), 4096):
            cut = ids[at : at + 4096]
            out.append((i, at // 4096, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    yield out


def by_nulls_last(r):
    return tuple((x is None, x) for x in r)


def test_pipeline_equals_a_plain_version(spark, folder):
    rows, toxic, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    *kept, pieces = plain_stages(rows, model, items)
    assert not {i for i, _ in kept[0]} & toxic and len(kept[0]) == len(rows) - len(toxic)
    assert len(kept[1]) < len(kept[0]) and {i for i, _ in kept[1]} - {i for i, _ in kept[2]} == {2000 + i for i, _ in items}
    assert not any("@mail" in (t or "") for _, t in kept[3]) and max(p for _, p, *_ in pieces) > 0
    for (name, stage), before, after in zip(corpus_pipeline.STAGES[:-1], [rows, *kept], kept, strict=False):
        given = spark.createDataFrame([(i, t, None, "s", 0, 1, "h", 0.5, "c", 3) for i, t in before], SCHEMA)
        if name == "toxicity":
            given = docs
        made = stage(spark, given, folder)
        assert made.columns == docs.columns, name
        assert sorted(((r.doc_id, r.text) for r in made.collect()), key=by_nulls_last) == sorted(after, key=by_nulls_last), name
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=by_nulls_last) == sorted(pieces, key=by_nulls_last)
    assert check_packing(packed, 4096) == packing.lower_bound(np.bincount([n for _, _, _, n, _ in pieces], minlength=4097), 4096)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
