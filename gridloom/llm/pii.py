"""Personal data by rules and a semi-Markov conditional random field.

Rules find e-mail addresses, IP addresses, card and telephone numbers. The field then reads the space-free chunks that
hold a digit, an at-sign (also in brackets, as ``[at]``) or a spelt dot, with up to ``AROUND`` neighbouring chunks on
either side: every run of at most ``MAX_TOKENS`` tokens with a digit or an at is a candidate segment, scored as a whole (its shape, digit count, separators, checksums, neighbours), and
dynamic programming over segments of bounded length picks boundaries and types together. Segments that meet no rule's
span are added, so forms that rules miss (telephone numbers without a plus, cards that stand next to other digits,
national ids, account numbers, masked e-mail addresses) are found too.

The field is trained here on sentences made from templates, by the exact gradient of its conditional likelihood.
Null and empty texts have no spans; repeated rows count each; a null id is kept; an empty table gives no rows; columns
other than doc_id and text pass through ``redact`` and are not read elsewhere. Offsets are code points, ends exclusive.
A text of any length is read whole: the rules take time in proportion to it, and decoding moves along a stretch with the
last ``MAX_TOKENS`` tokens and the segments chosen so far in memory. Of segmentations that score the same, the one with
no segment, then the shorter segment and the type listed first, is taken.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mapped, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "account")
MAX_TOKENS = 16
MAX_CHARS, MAX_DIGITS = 96, 34  # of a segment: the longest account numbers have 34 characters
AROUND = 2  # chunks that a stretch takes in on either side of a hint
WIDEST = 40  # characters of such a chunk at most
BITS = 13
# Endings of addresses in plain words ("john at example dot com") that are no common English words.
ENDINGS = frozenset("com org net edu gov mil info biz io co uk de fr es nl eu ca au jp ch se".split())

Span = tuple[str, int, int]
Facts = tuple[str, str, bool, bool, int, bool, bool]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# From the start of a run of digits and without going back: no other start in the run could match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|(?<!\S)at[ \t][^\s]{1,40}[ \t][\[(]?dot[\])]?(?!\S)|(?<!\S)dot(?!\S)")
_LAST = re.compile(r"\w*\W*$")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _count(s: str) -> int:
    return sum(map(s.count, "0123456789"))


def base_spans(text: str) -> list[Span]:
    """Spans of the four rules, by kind as listed, then start; of each kind leftmost and not overlapping."""
    out: list[Span] = []
    at = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        # What stands before an at-sign can only match up to it: the run of its characters to the left.
        start = m.start()
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            at = m.end()
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        a, b = m.span()
        # 19 digits and what stands between them
        if 13 <= b - a <= 37 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", a, b))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= _count(m.group()) <= 15]
    return out


def _shape(s: str) -> str:
    return re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>" if len(m[0]) < 7 else "<+>", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", s)))


def _key(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> (32 - BITS)


_ZERO = str.maketrans("123456789", "0" * 9)
_SPELT = re.compile(r"[A-Za-z0-9._-]+ ?([\[(]?)at[\])]? ?[A-Za-z0-9-]+ ?[\[(]?dot[\])]? ?([A-Za-z]+)")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?")


def facts(text: str, start: int, end: int, before: str, glued: tuple[bool, bool], size: int) -> Facts:
    """All that the features of a segment of ``size`` tokens read: its characters with zeros for digits, what stands
    around it, and whether its digits pass a card's checksum and its parts are below 256."""
    s = text[start:end]
    masked = s.translate(_ZERO)
    n = masked.count("0")
    card = 13 <= n <= 19 and n == len(s) - s.count(" ") - s.count("-") and luhn(s.replace(" ", "").replace("-", ""))
    parts = s.split(".") if masked.count(".") == 3 else []
    octets = bool(parts) and all(p.isascii() and p.isdigit() and len(p) < 9 and int(p) <= 255 for p in parts)
    return masked, before, *glued, size, card, octets


def segment_features(told: Facts) -> list[int]:
    """Hashed features of a segment as a whole."""
    s, before, left, right, size, card, octets = told
    n = s.count("0")
    # A spelt address has a form of its own, or it would share that of any few words; plain words need a known ending.
    m = _SPELT.fullmatch(s)
    spelt = ("spelt" if m[1] or m[2].lower() in ENDINGS else "words") if m else ""
    seps = spelt or "".join(sorted({c for c in s if not c.isalnum()}))
    out = [_key("b"), _key("shape", spelt or _shape(s)), _key("n", spelt or n), _key("seps", seps), _key("glue", left, right), _key("n+seps", n, seps), _key("tokens", spelt or size), _key("ends", s[0].isalnum(), s[-1].isalnum(), s[0] in "+(")]
    out += [_key("word", before), _key("word+n", before, n), _key("at", "@" in s, "." in s.partition("@")[2]), _key("letters", spelt or any(c.isalpha() for c in s))]
    return [*out, _key("luhn", card), _key("octets", octets), _key("spelt", spelt), _key("iban", bool(_ACCOUNT.fullmatch(s)))]


def ending(text: str, tokens: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int, Facts]]]]:
    """For each token its bounds and the candidates that end with it, the shortest first: ``(tokens, start, facts)`` of
    those with a digit or an at, of at most ``MAX_TOKENS`` tokens, ``MAX_CHARS`` characters and ``MAX_DIGITS`` digits, that
    begin with a letter, a digit, a plus or a bracket and end with a letter or a digit."""
    last: deque[tuple[int, str, bool, bool, int, bool]] = deque(maxlen=MAX_TOKENS)
    before_end = -1
    for a, b in tokens:
        if before_end == a:
            before = text[max(last[-1][0], a - 24) : a].lower()
        else:
            before = _LAST.search(text, max(0, a - 24), a).group().lower()
        first = text[a]
        plain = first.isascii() and first.isalnum()
        hint = first in "0123456789@" or text[a:b].lower() == "at"
        last.append((a, before.translate(_ZERO), a > 0 and not text[a - 1].isspace(), hint, b - a if plain and first.isdigit() else 0, plain or first in "+("))
        before_end = b
        if not plain:
            yield a, b, []
            continue
        right = b < len(text) and not text[b].isspace() and text[b] not in ".,;:!?"
        found, hinted, digits = [], False, 0
        for size, (start, word, left, own, n, begins) in enumerate(reversed(last), 1):
            hinted, digits = hinted or own, digits + n
            if b - start > MAX_CHARS or digits > MAX_DIGITS:
                break
            if hinted and begins:
                found.append((size, start, facts(text, start, b, word, (left, right), size)))
        yield a, b, found


class Field:
    """A zeroth-order semi-Markov field: weights of segment features by type, and of transitions between types.

    Type 0 is "none", whose segments are single tokens of score 0."""

    def __init__(self) -> None:
        self.w = np.zeros((len(KINDS) + 1, 1 << BITS))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.known: dict[Facts, list[float] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    @staticmethod
    def lattice(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
        """Candidate segments of a stretch, by end: ``(first token, end token, features)``."""
        return [(j - size, j, segment_features(told)) for j, (_, _, found) in enumerate(ending(text, tokens), 1) for size, _, told in found]

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        return np.array([self.w[1:, f].sum(axis=1) for _, _, f in segments]).reshape(len(segments), len(KINDS))

    def worth(self, told: Facts) -> list[float] | None:
        """The scores of a candidate by type; none where it can be in no best segmentation: whatever the types beside
        it, as many tokens of type 0 would score no less. Known ones are remembered, up to a fixed number."""
        if told in self.known:
            return self.known[told]
        score, t = self.w[1:, segment_features(told)].sum(axis=1), self.t
        gain = score + (t[:, 1:] - t[:, :1]).max(axis=0) + np.maximum(0, (t[1:] - t[:1]).max(axis=1)) - (told[4] - 1) * t[0, 0]
        if len(self.known) >= 50_000:
            self.known.clear()
        out = self.known[told] = score.tolist() if gain.max() > 0 else None
        return out

    def decode(self, text: str, tokens: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation: ``(start, end, type)`` of the typed segments."""
        t, kinds = self.t.tolist(), range(1, len(KINDS) + 1)
        # After each of the last tokens the best (score, type, chosen segments), by type of the last one; segments are
        # linked to those before them, so only chosen ones are held.
        now: list[tuple] = [(0.0, 0, None)]
        past: deque[list[tuple]] = deque([now], maxlen=MAX_TOKENS)
        for _, end, found in ending(text, tokens):
            best: dict[int, tuple] = {0: max(((v + t[z][0], 0, chosen) for v, z, chosen in now), key=lambda s: s[0])}
            for size, start, told in found:
                if (score := self.worth(told)) is None:
                    continue
                for y in kinds:
                    value, chosen = max(((v + t[z][y], chosen) for v, z, chosen in past[-size]), key=lambda s: s[0])
                    if y not in best or value + score[y - 1] > best[y][0]:
                        best[y] = (value + score[y - 1], y, (chosen, start, end, y))
            now = list(best.values())
            past.append(now)
        out, chosen = [], max(now, key=lambda s: s[0])[2]
        while chosen:
            chosen, *segment = chosen
            out.append(tuple(segment))
        return out[::-1]

    def step(self, n: int, segments: list[tuple[int, int, list[int]]], gold: list[tuple[int, int, int]], rate: float) -> float:
        """One ascent step on the conditional log-likelihood of a stretch of ``n`` tokens, by forward and backward sums."""
        score = self.scores(segments)
        kinds = len(KINDS) + 1
        lse = np.logaddexp.reduce
        a, b = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        a[0, 0], b[n] = 0, 0
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(segments):
            ends[j].append(k)
            starts[i].append(k)
        with np.errstate(invalid="ignore"):
            for j in range(1, n + 1):
                a[j, 0] = lse(a[j - 1] + self.t[:, 0])
                for k in ends[j]:
                    a[j, 1:] = np.logaddexp(a[j, 1:], lse(a[segments[k][0]][:, None] + self.t[:, 1:], axis=0) + score[k])
            z = lse(a[n])
            for i in range(n - 1, -1, -1):
                b[i] = self.t[:, 0] + b[i + 1, 0]
                for k in starts[i]:
                    b[i] = np.logaddexp(b[i], lse(self.t[:, 1:] + (score[k] + b[segments[k][1], 1:])[None, :], axis=1))
            dt = np.zeros_like(self.t)
            for i in range(n):
                dt[:, 0] -= np.exp(a[i] + self.t[:, 0] + b[i + 1, 0] - z)
            for k, (i, j, f) in enumerate(segments):
                p = np.exp(a[i][:, None] + self.t[:, 1:] + (score[k] + b[j, 1:])[None, :] - z)
                dt[:, 1:] -= p
                np.subtract.at(self.w, (slice(1, None), f), rate * p.sum(axis=0)[:, None])
        by, like, last, done = {(i, j): k for k, (i, j, _) in enumerate(segments)}, 0.0, 0, 0
        for i, j, y in [*gold, (n, n, 0)]:
            for _ in range(done, i):
                dt[last, 0] += 1
                like += self.t[last, 0]
                last = 0
            if y:
                k = by[i, j]
                dt[last, y] += 1
                like += self.t[last, y] + score[k, y - 1]
                np.add.at(self.w, (y, segments[k][2]), rate)
                last = y
            done = j
        self.t += rate * dt
        return float(z - like)


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """Made-up sentences with their spans: templates of personal data, and of numbers that are none."""
    r = Random(seed)
    # Words around the data, by what they point at.
    word = "the a of and on in with for is was erat thing onre delos heit que ment version release page total order item room year chapter".split()
    cue = {"phone": "call tel phone fax mobile", "id": "ssn id passport social", "account": "iban account", "email": "mail email contact write", "card": "card visa", "ip": "host ip server"}

    def d(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def name() -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        stem = r.choice("3456") + d(14)
        whole = next(stem + c for c in "0123456789" if luhn(stem + c))
        return r.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), "-".join(whole[i : i + 4] for i in range(0, 16, 4))])

    def spelt() -> str:
        a, b = r.choice([(" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        return r.choice([name(), f"{name()}.{name()}", f"{name()}{d(2)}"]) + a + name() + b + r.choice(["com", "org", "net"])

    def bank() -> str:
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))

    area = lambda: str(r.randint(201, 989))
    make = {
        "email": lambda: r.choice([f"{name()}.{d(2)}@{name()}.com", f"{name()}[at]{name()}.com", f"{name()}[at]{name()}[dot]org", f"{name()}(at){name()}(dot)net", spelt(), spelt(), spelt(), spelt()]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{d(1)} ({area()}) 555-{d(4)}", f"({area()}) 555-{d(4)}", f"{area()}-555-{d(4)}", f"{area()}.555.{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"0{d(2)} {d(4)} {d(4)}"]),
        "id": lambda: f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        "account": lambda: r.choice("DE FR ES GB NL".split()) + d(2) + r.choice(["", " "]).join(["", *([d(4)] if r.random() < 0.6 else [bank()]), d(4), d(4), d(4), *([d(2)] if r.random() < 0.3 else [])]),
    }
    none = [
        lambda: f"{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: d(r.randint(1, 9)), lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}", lambda: f"{r.randint(1, 999)},{d(3)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: d(r.choice([11, 12, 15, 16, 20, 24])), lambda: f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"#{d(5)}",
        lambda: f"{name()}{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"pp. {d(3)}-{d(3)}", lambda: f"{d(1)} + {d(2)} - {d(3)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))), lambda: f"@{name()}", lambda: f"{name()} at {d(2)}:{d(2)}", lambda: f"at the dot {name()}", lambda: f"{name()} at {r.choice(word)} dot {r.choice([*word, name()])}", lambda: f"{bank()} {d(4)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16)),
    ]
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            if text or r.random() < 0.8:
                text += " ".join(r.choice(word) for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.3:
                    text += r.choice(cue[kind].split()) + r.choice([": ", " "])
                value = make[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice([" ", ", ", ". "])
            else:
                text += r.choice(none)() + r.choice([" ", ", ", ". "])
        yield text + r.choice(word), spans


@cache
def trained(n: int = 400, epochs: int = 6, seed: int = 7) -> Field:
    """The field, fitted to ``n`` made-up sentences; the same on every machine."""
    field, rows = Field(), []
    for text, spans in sentences(n, seed):
        for a, b in stretches(text):
            tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
            first, last = {x: k for k, (x, _) in enumerate(tokens)}, {y: k + 1 for k, (_, y) in enumerate(tokens)}
            gold = [(first[x], last[y], KINDS.index(kind) + 1) for kind, x, y in spans if a <= x < b]
            if all(j - i <= MAX_TOKENS for i, j, _ in gold):
                rows.append((len(tokens), field.lattice(text, tokens), gold))
    for epoch in range(epochs):
        for row in rows:
            field.step(*row, rate=0.25 / (1 + 0.4 * epoch))
        field.w *= 0.98
    return field


def _beside(text: str, at: int, step: int) -> int:
    """The far end of the chunks, ``AROUND`` at most, that follow ``at`` (or come before, for a ``step`` of -1), each one
    white-space character away and on the same line."""
    back = step < 0
    for _ in range(AROUND):
        space = at - 1 if back else at
        if not 0 <= space < len(text) or text[space] == "\n" or not text[space].isspace():
            break
        start = end = space if back else space + 1
        while (end > 0 if back else end < len(text)) and not text[end - 1 if back else end].isspace() and abs(end - start) <= WIDEST:
            end += step
        if not 0 < abs(end - start) <= WIDEST:
            break
        at = end
    return at


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a hint and those around them, one white-space character apart and on one line. Runs whose hints
    are more than ``AROUND`` chunks apart stay two, and the second starts where the first ends."""
    begin = end = -1
    seen = 0
    for m in _HINT.finditer(text) if "at" in text or "@" in text or "dot" in text or _DIGIT.search(text) else ():
        if m.end() <= seen:
            continue
        a, b = m.span()
        while a > seen and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        near = _beside(text, a, -1)
        joined = end >= 0 and near <= seen + 1 and text[seen] != "\n"
        seen, b = b, _beside(text, b, 1)
        if joined:
            end = max(end, b)
            continue
        if end >= 0:
            yield begin, end
        begin, end = max(near, end), b
    if end >= 0:
        yield begin, end


def field_spans(text: str, field: Field) -> list[Span]:
    """Typed segments of the whole text."""
    tokens = lambda a, b: (m.span() for m in _TOKEN.finditer(text, a, b))
    return [(KINDS[y - 1], start, end) for a, b in stretches(text) for start, end, y in field.decode(text, tokens(a, b))]


def meeting(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether start..end meets one of the spans, by one look into their union."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def meets(start: int, end: int) -> bool:
        at = bisect_left(starts, end) - 1
        return at >= 0 and ends[at] > start

    return meets


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and those with the field's that meet none of them, by kind as listed, then start."""
    base = base_spans(text)
    meets = meeting(base)
    added = [s for s in field_spans(text, field) if not meets(s[1], s[2])]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: arrays of (kind, start, end) for each row of ``docs (doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for text in texts(b, "text"):
                x, y = all_spans(text or "", sent.value)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in x])
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in y])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, _SPAN_TYPE), pa.array(spans, _SPAN_TYPE)], names=["doc_id", "base", "spans"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def _masked(text: str | None, field: Field) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(all_spans(text, field)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans by that of the first."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([_masked(t, sent.value) for t in texts(b, "text")], b.schema.field(place).type)
            yield b.set_column(place, b.schema.field(place), done)

    return mapped(docs, mask, docs.schema)


def span_text(column: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
