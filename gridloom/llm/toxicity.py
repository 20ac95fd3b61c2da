"""Toxicity by non-negative learning from positive and unlabelled text.

A linear model over words and word stems is trained in numpy from confirmed toxic texts and unlabelled ones with the
class-prior-corrected risk of Kiryo et al. (2017): prior * loss(positive, 1) + max(0, loss(unlabelled, 0) - prior *
loss(positive, 0)); where the part in max() would fall below zero, only the positives move the weights. Three things are
not of that estimator: only features that are far more frequent in positives than in unlabelled text get a weight; none
of the weights is below zero, so the length of a text has no pull on its score; and the boundary comes from a second
estimate on the same samples (``boundary``), or is the model's own where that is lower. About a tenth of the positives
here has nothing toxic in it; boundaries at the least corrected risk, whose zero-one form was tried too, let such texts
draw in clean ones.

Labels are read from rows whose crc32(doc_id as text) mod 3 is not 1; the others are held out. The fit uses at most
``positives`` and ``unlabelled`` texts, those with the lowest hashes of their ids, and of each at most ``most_words``
distinct words, those with the lowest hashes (documented bounds: the driver holds some 250 MB of them at most); class
prior and scores cover all rows, and scores whole texts of any length. Null and empty texts get the score of a text
without features; a document labelled twice counts as toxic if one label says so, null labels are ignored; without
positives each score is 0, and without features that tell them apart no text is called toxic; repeated rows count each;
rows with null ids are scored like others and held in the folds that train (their remainder is not 1), without labels; an
empty table gives no rows. Of boundaries that do equally well the lowest is taken. Language, source, id and labels are no
inputs of a score; further columns are not read, and keep their names and values in ``not_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import free_name, mapped, mix, texts, word_hashes

STEMS = (3, 4, 5)
THRESHOLD = 0.7
RAREST = 0.02  # share of the positive texts that a feature must be in
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    """The word, and its stems marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Model:
    """Weights of words and stems, and a bias; a text's score is the logistic function of the sum over its words."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.bias = bias
        self.whole = {f: w for f, w in weights.items() if not f.endswith("*")}
        self.stem = {f[:-1]: w for f, w in weights.items() if f.endswith("*")}
        self.known = {f[: STEMS[0]] for f in (*self.whole, *self.stem)}

    def score(self, text: str | None) -> float:
        z, first, known, stem = self.bias, STEMS[0], self.known, self.stem
        for w in words(text):
            if w[:first] in known:
                z += self.whole.get(w, 0.0) + sum(stem.get(w[:k], 0.0) for k in STEMS if len(w) > k)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _matrix(docs: list[list[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for r, ws in enumerate(docs):
        for w in ws:
            for f in features(w):
                if (c := index.get(f)) is not None:
                    rows.append(r)
                    cols.append(c)
    return np.array(rows, np.int64), np.array(cols, np.int64)


def without_copies(docs: list[list[str]], bands: int = 8, rows: int = 3) -> list[list[str]]:
    """One of each family of near copies, so copies don't pose as evidence: texts are of one family that share a band of
    minimal word hashes, or are joined by such texts."""
    factors = np.random.default_rng(1).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple, int] = {}
    for i, ws in enumerate(docs):
        h = word_hashes([w.encode("utf-8", "surrogatepass") for w in ws])
        with np.errstate(over="ignore"):
            low = mix(h[None, :] * factors[:, None]).min(axis=1) if len(h) else factors * np.uint64(0)
        for b in range(bands):
            a, c = find(i), find(first.setdefault((b, *low[b * rows : (b + 1) * rows].tolist()), i))
            parent[max(a, c)] = min(a, c)
    return [ws for i, ws in enumerate(docs) if parent[i] == i]


Rows = tuple[np.ndarray, np.ndarray]


def descend(positive: Rows, unlabelled: Rows, sizes: tuple[int, int], features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-2) -> np.ndarray:
    """Weights, the bias last, by Adam's steps on the non-negative risk. Rows are (text, feature) coordinates."""
    (pr, pc), (ur, uc) = positive, unlabelled
    w = np.zeros(features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(rows: np.ndarray, cols: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, g[rows], features), g.sum()) / len(g)

    for step in range(1, steps + 1):
        zp = np.bincount(pr, w[pc], sizes[0]) + w[-1]
        zu = np.bincount(ur, w[uc], sizes[1]) + w[-1]
        loss = lambda z: np.logaddexp(0, z).mean()  # noqa: E731  of label 0
        negative = loss(zu) - prior * loss(zp)
        low = gradient(ur, uc, sigmoid(zu)) - prior * gradient(pr, pc, sigmoid(zp))
        g = prior * gradient(pr, pc, sigmoid(zp) - 1) + (low if negative >= 0 else 0)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # the features speak for label 1
    return w


def boundary(positive: np.ndarray, unlabelled: np.ndarray, own: float) -> float:
    """The sum from which a text is called toxic: where recall^2 / share called toxic is best (Lee and Liu, 2003), midway to
    the next lower sum, or the model's ``own`` boundary where that is lower. Calling all texts toxic is worth 1: a model
    that does no better calls none so."""
    zp, zu = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.concatenate([zp, zu]))
    above = lambda z: 1 - np.searchsorted(z, cuts) / len(z)
    worth = above(zp) ** 2 / np.maximum(above(zu), 1 / len(zu))
    best = int(np.argmax(worth))
    return float(min((cuts[best] + cuts[best - 1]) / 2, own) if best and worth[best] > 1.05 else cuts[-1] + 1)


def fit(positive: list[list[str]], unlabelled: list[list[str]], prior: float) -> Model:
    """Trains on lists of distinct words."""
    if not positive or not unlabelled or not prior:
        return Model({}, -500.0)
    prior = min(max(prior, 1e-4), 0.9)
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    seen = Counter(f for ws in positive for f in {f for w in ws for f in features(w)})
    seen = {f: n for f, n in seen.items() if n >= max(4, RAREST * len(positive))}
    free = Counter(f for ws in unlabelled for f in {f for w in ws for f in features(w) if f in seen})
    # A feature of toxic texts alone is 1 / prior times as frequent in positives as in unlabelled text. Chosen are those
    # with a good part of that ratio, and a likelihood ratio that chance does not give among all features.
    chosen, ratio, least = [], 1 + 0.35 * (1 / prior - 1), 1 + math.log(1 + len(seen))
    for f, n in seen.items():
        want = len(positive) * (free[f] + 0.5) / len(unlabelled)
        if n >= ratio * want and n * math.log(n / want) - n + want >= least:
            chosen.append(f)
    chosen.sort()
    index = {f: i for i, f in enumerate(chosen)}
    p, u = _matrix(positive, index), _matrix(unlabelled, index)
    w = descend(p, u, (len(positive), len(unlabelled)), len(chosen), prior)
    middle = boundary(np.bincount(p[0], w[p[1]], len(positive)), np.bincount(u[0], w[u[1]], len(unlabelled)), -w[-1])
    return Model(dict(zip(chosen, w[:-1].tolist(), strict=True)), math.log(THRESHOLD / (1 - THRESHOLD)) - middle)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def _share(doc_id: str = "doc_id") -> Column:
    """A uniform number in [0, 1) that belongs to the id."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(6)), F.lit(1 << 30)) / (1 << 30)


def some_words(text: str | None, most: int) -> list[str]:
    """The text's distinct words in order; of more than ``most`` those with the lowest hashes."""
    found = sorted(words(text))
    if len(found) <= most:
        return found
    h = word_hashes([w.encode("utf-8", "surrogatepass") for w in found])
    return [found[i] for i in np.sort(np.argsort(h, kind="stable")[:most])]


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 4000, most_words: int = 4096) -> Model:
    """A model from bounded samples; one scan of the documents."""
    fold = F.coalesce(remainder() != 1, F.lit(True))
    known = labels.where(fold & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return Model({}, -500.0)
    # The lowest hashes; the share spares the sort most rows.
    ids = [r[0] for r in known.where((F.col("toxic") == 1) & (_share() < 2 * positives / toxic)).orderBy(_share(), "doc_id").limit(positives).select("doc_id").collect()]
    spark = docs.sparkSession
    # At most ``positives`` ids, so the broadcast is bounded.
    picked = F.broadcast(spark.createDataFrame([(i, True) for i in ids], "doc_id long, __positive boolean"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold & F.col("text").isNotNull())
    total = docs.where(fold).count()
    free = _share() < 0.95 * unlabelled / max(total, 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("positive"), b.column("free"), pa.array([some_words(t, most_words) for t in texts(b, "text")], pa.list_(pa.string()))], names=["positive", "free", "words"])

    sample = slim.join(picked, "doc_id", "left").select("text", F.coalesce("__positive", F.lit(False)).alias("positive"), free.alias("free")).where("positive or free")
    rows = mapped(sample, split, "positive boolean, free boolean, words array<string>").toArrow()
    known: dict[str, str] = {}  # each word is held once
    texts_of = {"positive": [], "free": []}
    for b in rows.to_batches(max_chunksize=64):
        for r in b.to_pylist():
            ws = [known.setdefault(w, w) for w in r["words"]]
            for name, found in texts_of.items():
                if r[name]:
                    found.append(ws)
    return fit(texts_of["positive"], texts_of["free"], toxic / n)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of each text in a last column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(column, pa.array([sent.value.score(t) for t in texts(b, "text")], pa.float64()))

    return mapped(docs, score, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs (doc_id, text)``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(slim, train(docs, labels, positives, unlabelled))
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 4000) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with their columns."""
    name = free_name(docs, "toxicity")
    return scored(docs, train(docs, labels, positives, unlabelled), name).where(F.col(name) < THRESHOLD).drop(name)
