"""Token counts of greedy longest-match word pieces, by a linear-time automaton that never builds the pieces.

The vocabulary (bytes of every piece; all 256 single bytes are added, so any text can be cut) is a trie. After Song et
al. (2021), a node v that the scan leaves has a failure link f(v) and a count F(v) of the pieces popped on the way:
the greedy pieces that v's string begins with, until what remains is the string of the node f(v). A scan follows an
edge for each byte or fails over, so a word of n bytes takes at most 2n steps, and the count is the sum of F.

Texts are cut into words by the vocabulary's own pattern first. The vocabulary file is a parameter (lines of base64
and rank); it is read on the driver, must not exceed `max_vocab` pieces, and is sent to the executors.

Defined cases: a null or empty text has no tokens; any bytes can be cut; a very long word takes linear time; repeated
rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textsieve.llm.bytehash import slices
from textsieve.llm.common import texts

#: Fixed value: the pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 200_000
BATCH_BYTES = 8 << 20


def read_vocab(path: str = DEFAULT_VOCAB, max_vocab: int = 1_000_000) -> list[bytes]:
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    if len(pieces) > max_vocab:
        raise ValueError(f"{path} has {len(pieces)} pieces, more than max_vocab={max_vocab}")
    return pieces


class LongestMatch:
    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        ends, parent, label = [False], [0], [0]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            node = 0
            for b in piece:
                if b not in edges[node]:
                    edges[node][b] = len(edges)
                    edges.append({})
                    ends.append(False)
                    parent.append(node)
                    label.append(b)
                node = edges[node][b]
            ends[node] = node != 0
        self.edges, self.fail, self.popped = edges, [-1] * len(edges), [0] * len(edges)
        level = list(edges[0].values())
        while level:  # parents before children
            for v in level:
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                u = parent[v]
                f, n = self.fail[u], self.popped[u]
                while f >= 0 and label[v] not in edges[f]:
                    n += self.popped[f]
                    f = self.fail[f]
                if f >= 0:
                    self.fail[v], self.popped[v] = edges[f][label[v]], n
            level = [c for v in level for c in edges[v].values()]

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for b in word:
            while b not in edges[node]:
                total += popped[node]
                node = fail[node]
            node = edges[node][b]
        while node:
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, vocab: list[bytes] | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab if vocab is not None else read_vocab())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words, seen = LongestMatch(sent.value), regex.compile(pattern), {}
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            out = [[], [], []]
            for text in batch.column(1).to_pylist():
                tokens = n = 0
                for m in words.finditer(text) if len(text) > 1 << 20 else words.findall(text):
                    w = m if isinstance(m, str) else m[0]
                    k = seen.get(w)
                    if k is None:
                        k = automaton.count(w.encode())
                        if len(w) <= 64:
                            if len(seen) >= CACHE:
                                seen.clear()
                            seen[w] = k
                    tokens += k
                    n += 1
                for column, x in zip(out, (len(text.encode()), n, tokens), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
