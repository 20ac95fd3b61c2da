"""Secrets by rules and a battery of randomness tests.

Rules find assignments to secret-like names, access keys and long hexadecimal runs. Other unbroken runs of key
characters are candidates: their encoding is inferred (hexadecimal, base 32, 36 or 64), and a chi-squared test of the
alphabet's uniformity, a runs test and a serial-correlation test ask whether their symbols look drawn at random. The
combined statistic is turned into a p-value under the opposite hypothesis, that the run is made of words as identifiers
and paths are, by the statistic's distribution over made-up runs of that length and encoding. Candidates of the whole
table then share one false-discovery level (Benjamini-Hochberg, weighted by length: long runs tell more), so a corpus
without secrets reports next to none.

Null and empty texts have no spans; repeated rows count each; an empty table gives no rows; columns other than doc_id
and text are not read. Offsets are code points, ends exclusive; an assignment's span is the whole match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mapped, stored, texts

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = tuple(x.encode() for x in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_TABLE = bytes(49 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
SHORTEST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_RUN_TABLE = bytes(49 if chr(c).isascii() and chr(c).isalnum() or chr(c) in "+/_=-" else 32 for c in range(256))

# The alphabets in the order of their digits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BANDS = (20, 24, 32, 48, 64)
WEIGHTS = (0.5, 0.75, 1.0, 1.25, 1.5)  # of the bands' shares of the false-discovery level; their mean is 1
GRID = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three rules, by start, then kind as listed; of each kind leftmost and not overlapping."""
    raw = text.encode("utf-8", "surrogatepass")
    out: list[Span] = []
    if b":" in raw or b"=" in raw:
        low = raw.lower()
        if any(n in low for n in _NAMES):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"1" * 32 in raw.translate(_HEX_TABLE):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Unbroken runs of key characters that mix digits and letters and meet no rule's span."""
    if b"1" * SHORTEST not in text.encode("utf-8", "surrogatepass").translate(_RUN_TABLE):
        return []
    out = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        run = m.group().rstrip("=")
        if len(run) >= SHORTEST and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(s < b[2] and b[1] < e for b in base):
            out.append((s, s + len(run)))
    return out


def encoding(run: str) -> str:
    """The smallest of the alphabets that spells the run."""
    low = run.replace("-", "").replace("_", "")
    if all(c in "0123456789abcdef" for c in low) or all(c in "0123456789ABCDEF" for c in low):
        return "hex"
    return next((k for k in ("base32", "base36") if all(c in ALPHABETS[k] for c in low)), "base64")


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    return _normal_tail(((max(x, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(run: str, kind: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, under the hypothesis that the symbols are random."""
    alphabet = ALPHABETS[kind]
    text = run.lower() if kind == "hex" else run.replace("-", "+").replace("_", "/")
    v = np.array([alphabet.find(c) for c in text if c in alphabet], float)
    n, k = len(v), len(alphabet)
    if n < 8:
        return 0.0, 0.0, 0.0
    # Uniformity over parts of the alphabet of about five expected each; classes of characters for the large one.
    if kind == "base64":
        share, part = np.array([26, 26, 10, 2]) / 64, np.searchsorted([26, 52, 62], v, side="right")
    else:
        parts = min(k, max(2, n // 5))
        share, part = np.bincount(np.arange(k) * parts // k, minlength=parts) / k, (v * parts // k).astype(int)
    seen = np.bincount(part.astype(int), minlength=len(share))
    uniform = _chi_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), len(share) - 1)
    # Repeats of single symbols: too many for the alphabet's size speak against it.
    same = np.bincount(v.astype(int), minlength=k)
    pairs, want = float((same * (same - 1) / 2).sum()), n * (n - 1) / 2 / k
    uniform = min(1.0, 2 * min(uniform, _normal_tail((pairs - want) / math.sqrt(want * (1 - 1 / k)))))
    high = v >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9)))
    else:
        runs = 0.0
    d = v - v.mean()
    r = float((d[1:] * d[:-1]).sum() / max(float((d * d).sum()), 1e-9))
    serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return uniform, min(runs, 1.0), min(serial, 1.0)


def statistic(run: str) -> float:
    """Fisher's combination of the battery, a term for changes of character class and one for letters that follow each
    other as in words: small where the run looks random."""
    kind = encoding(run)
    fisher = -2 * sum(math.log(max(p, 1e-12)) for p in battery(run, kind))
    if kind == "hex":
        return fisher
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run]
    turns = sum(x != y for x, y in zip(classes, classes[1:], strict=False)) / (len(run) - 1)
    want = 0.55 if kind == "base64" else 0.3
    vowels = sum(c in "aeiouAEIOU" for c in run) / max(1, sum(c.isalpha() for c in run))
    return fisher + 40 * max(0.0, want - turns) + 30 * max(0.0, vowels - 0.25)


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


@cache
def reference(n: int = 300, seed: int = 11) -> dict[tuple[str, int], np.ndarray]:
    """The statistic's sorted values over made-up runs of words, digits and joints, by encoding and band of length."""
    r = Random(seed)
    # Parts that identifiers and paths are made of.
    words = "get set user name list index file path data config value test main core util base node tree item page table field query result order count total first last next error state event model view page home image style script content version build release feed face dead beef cafe".split()
    out = {}
    for number, low in enumerate(BANDS):
        top = BANDS[number + 1] if number + 1 < len(BANDS) else 128
        for kind in ALPHABETS:
            got = []
            while len(got) < n:
                run, style, aim = "", r.choice(["camel", "snake", "path", "upper", "flat"]), r.randint(low, top - 1)
                while len(run) < aim:
                    part = r.choice(words) if r.random() < 0.75 else str(r.choice([r.randint(0, 99), r.randint(1990, 2030), 10 ** r.randint(2, 5), 1234567890 // 10 ** r.randint(0, 8)]))
                    run += {"camel": part.capitalize(), "snake": part + "_", "path": part + "/", "upper": part.upper() + "_", "flat": part}[style]
                run = run[:aim].rstrip("_/")
                if kind == "hex":
                    run = "".join(c for c in run.lower() * 4 if c in ALPHABETS["hex"])[: len(run)] or "0" * low
                elif kind == "base32":
                    run = "".join(c for c in run.upper() if c in ALPHABETS["base32"]) + "2222"
                elif kind == "base36":
                    run = run.lower()
                got.append(statistic(run))
            out[kind, number] = np.sort(got)
    return out


def text_like_p(run: str, ref: dict[tuple[str, int], np.ndarray]) -> float:
    """Share of made-up runs that look at least as random; below the smallest of them the lower tail is carried on by a
    normal fit, so that the level can be met in a table of any size."""
    known = ref[encoding(run), band(len(run))]
    s = statistic(run)
    below = int(np.searchsorted(known, s, side="right"))
    if below > 5:
        return (below + 1) / (len(known) + 1)
    root = np.sqrt(np.maximum(known, 0))
    z = (root.mean() - math.sqrt(max(s, 0))) / max(float(root.std()), 1e-9)
    return min((below + 1) / (len(known) + 1), _normal_tail(z))


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("cell", pa.int32())])


def _cell(p: float) -> int:
    """p on a grid of logarithms from 1 down to 1e-20, rounded up; the level is found on the grid."""
    return min(GRID - 1, int(-math.log10(max(p, 1e-20)) * GRID / 20))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found``: the rules' spans, and candidates with their band and p-value's cell."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = reference()
        for b in batches:
            base, found = [], []
            for text in texts(b, "text"):
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found.append([{"start": s, "end": e, "band": band(e - s), "cell": _cell(text_like_p(text[s:e], ref))} for s, e in (candidates(text, spans) if text else ())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "base", "found"])

    schema = f"doc_id long, base {_SPANS}, found array<struct<start:int,end:int,band:int,cell:int>>"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, schema)


def least_cells(tally: dict[tuple[int, int], int], level: float) -> list[int]:
    """The first cell of each band that passes: the largest common threshold t with (sum of weight * t * candidates) at
    most ``level`` times the candidates below their band's threshold."""
    total = sum(n * WEIGHTS[b] for (b, _), n in tally.items())
    grid = [10 ** (-20 * c / GRID) for c in range(GRID)]
    for c in range(GRID):
        first = [next((x for x in range(GRID) if grid[x] <= min(1.0, w * grid[c])), GRID) for w in WEIGHTS]
        passed = sum(n for (b, x), n in tally.items() if x >= first[b])
        if passed and total * grid[c] <= level * passed:
            return first
    return [GRID] * len(BANDS)


def find_secrets(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs (doc_id, text)``; added spans are of kind ``random``.

    One pass over the texts; what it found is kept in the shared store while the level's threshold is set from a table
    of at most bands times cells counts."""
    seen = stored(scan(docs), "secrets")
    counts = seen.select(F.explode("found").alias("f")).groupBy("f.band", "f.cell").count().collect()
    first = least_cells({(r[0], r[1]): r[2] for r in counts}, level)
    ok = F.array(*map(F.lit, first))
    added = F.transform(F.filter("found", lambda f: f.cell >= F.element_at(ok, f.band + 1)), lambda f: F.struct(F.lit("random").alias("kind"), f.start.alias("start"), f.end.alias("end")))
    order = F.array_sort(F.concat("base", added), lambda x, y: F.when(x.start != y.start, x.start - y.start).otherwise(_rank(x) - _rank(y)))
    return seen.select("doc_id", "base", order.alias("spans"))


def _rank(span: Column) -> Column:
    return F.when(span.kind == "assign", 0).when(span.kind == "access", 1).when(span.kind == "hex", 2).otherwise(3)


def span_text(column: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
