"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links (Song et al., "Fast WordPiece Tokenization", 2021). Each node knows
how many tokens are popped when the match fails there and which node goes on with the rest, so the greedy longest-match
length of a word takes one pass over its bytes and no piece is built.

A word is a run of bytes other than ASCII white space; the pieces are those of the word with one space in front. A word
that the vocabulary cannot spell counts as one unknown token. Null and empty texts have no words; repeated rows are
counted each; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mapped, texts

_COUNTERS: dict[str | None, Automaton] = {}


class Automaton(dict):
    """Greedy piece counts of words; those of usual length are remembered, up to a fixed number."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" ", most: int = 300_000) -> None:
        self.prefix, self.most = prefix, most
        self.go: dict[int, int] = {}  # node * 256 + byte -> node
        token, parent, byte = [False], [0], [0]
        for piece in vocabulary:
            node = 0
            for c in piece:
                at = node * 256 + c
                node = self.go.get(at, 0)
                if not node:
                    node = self.go[at] = len(token)
                    token.append(False)
                    parent.append(at // 256)
                    byte.append(c)
            token[node] = node != 0
        depth = [0] * len(token)
        for v in range(1, len(token)):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.popped = [-1] * len(token), [0] * len(token)
        for v in sorted(range(1, len(token)), key=depth.__getitem__):
            if token[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, n = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and (to := self.go.get(z * 256 + byte[v])) is None:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = to, n

    def __missing__(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        node = n = 0
        for c in self.prefix + word:
            while (to := go.get(node * 256 + c)) is None and node >= 0:
                n += popped[node]
                node = fail[node]
            if node < 0:
                break
            node = to
        while node > 0:
            n += popped[node]
            node = fail[node]
        if node < 0:
            n = 1
        if len(word) <= 24:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file (base64 and rank a line); by default the public package's byte-level one."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of each row of ``docs (doc_id, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _COUNTERS.get(path)
        if pieces is None:
            pieces = _COUNTERS[path] = Automaton(vocabulary(path))
        for b in batches:
            words, tokens = [], []
            for text in texts(b, "text"):
                found = text.encode("utf-8", "surrogatepass").split() if text else []
                words.append(len(found))
                tokens.append(sum(map(pieces.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n_words long, n_tokens long")
