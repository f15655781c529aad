"""Byte-pair encoding and decoding, with the encodings of shared word prefixes computed once in a trie.

The encoding of a word's first k symbols is that of some shorter prefix and one last token. Which token is last depends
on the prefix alone: of all tokens that end there it is the only one that is *compatible* with the last token of what
precedes it, that is, no merge crosses the border between both before they are complete. So distinct words are put into
a trie, a depth-first walk carries the last token of every depth, each node adds its own from these, and a word's tokens
are read backwards from its end. A prefix that many words share is worked on once; the tokens of a node cost as many
lookups as the longest token has symbols, however long the word is.

Two tokens are compatible unless a piece at the right edge of the first and one at the left edge of the second are both
there when the merge of the two has its turn: every token is built by one merge of a rank, its edge pieces live from
their own rank up to that of the piece that takes them in. This needs merges whose parts are made by earlier merges, as
training gives them; other files are refused. Tokens that their own merges do not lead to never come out and are left
out of the lookups.

The vocabulary file is a parameter (JSON of the `tokenizers` format: NFC, white space to one space, lower case, the
pattern below, bytes, word ends); it is read on the driver, must not exceed `max_vocab` tokens, and is sent to the
executors. Special tokens are found in the raw text, longest first. Characters that Python's Unicode tables don't know yet
are left to the file's own normaliser and splitter, which may be newer.

Defined cases: a null or empty text has no tokens and decodes to the empty text; texts are encoded whole, in pieces of
bounded size between white space where they are long; repeated rows are encoded each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.bytehash import slices
from textsieve.llm.common import texts

DEFAULT_VOCAB = "/opt/tokenizers/word_bpe_49k.json"
#: Fixed value: the pattern that belongs to the file; what it leaves out is white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BATCH_BYTES = 4 << 20
CACHE = 400_000
NEVER = 1 << 60
SHORT = (2, 1)
ENDS = "ends"  # symbols are single characters
_SPACE = regex.compile(r"[\x20\t\n\r]")


def byte_characters() -> list[str]:
    """The character that stands for each byte in the file: itself if it is visible, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _sizes(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """By the last three symbols of texts, the sizes of the tokens of three symbols and more that may end there, largest first, then 2 and 1."""
    sizes: dict[str, set[int]] = {}
    for text in table:
        if len(text) > 2:
            sizes.setdefault(text[-3:], set()).add(len(text))
    return {end: (*sorted(found, reverse=True), 2, 1) for end, found in sizes.items()}


class Bpe:
    """Tables of one vocabulary. Words and tokens are bytes as Latin-1 text; a token ends a word or stands inside one."""

    def __init__(self, spec: dict, max_vocab: int = 1_000_000):
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        if len(vocab) > max_vocab:
            raise ValueError(f"the vocabulary has {len(vocab)} tokens, more than max_vocab={max_vocab}")
        self.inner: dict[str, int] = {}  # text to id, of tokens inside words
        self.final: dict[str, int] = {}  # of tokens that end words
        self.rank: dict[int, int] = {}  # rank of the merge that makes a token, -1 for single symbols
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}  # two ids to the rank of their merge
        self.pairs: dict[tuple[int, int], bool] = {}
        text: dict[str, tuple[str, bool]] = {}
        for b, c in enumerate(byte_characters()):
            for name, ends in ((c, False), (c + suffix, True)):
                if name not in vocab:
                    raise ValueError(f"no token for the single symbol {name!r}")
                text[name], self.rank[vocab[name]] = (chr(b), ends), -1
                (self.final if ends else self.inner)[chr(b)] = vocab[name]
        reached = set(self.rank)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a not in text or b not in text or text[a][1] or a + b in text or a + b not in vocab:
                raise ValueError(f"merge {r} of {a!r} and {b!r} does not follow from earlier ones")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            text[a + b] = (text[a][0] + text[b][0], text[b][1])
            self.merges[left, right], self.rank[new], self.parts[new] = r, r, (left, right)
            if left in reached and right in reached and self._crossing(left, right) == r:
                reached.add(new)
                (self.final if text[b][1] else self.inner)[text[a + b][0]] = new
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.inner_sizes, self.final_sizes = _sizes(self.inner), _sizes(self.final)

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int, int]]:
        """(piece, rank that makes it, rank that takes it in) along the left (0) or right (1) edge, from the token inwards."""
        end = NEVER
        while True:
            born = self.rank[token]
            yield token, born, end
            if born < 0:
                return
            token, end = self.parts[token][side], born

    def _crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b, NEVER without one. At equal ranks the leftmost goes first."""
        first, right = NEVER, list(self._edge(b, 0))
        for x, born, end in self._edge(a, 1):
            for y, also_born, also_end in right:
                r = self.merges.get((x, y))
                if r is not None and max(born, also_born) < r < end and r <= also_end:
                    first = min(first, r)
        return first

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self._crossing(a, b) == NEVER
        return found

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words that are not empty, by a depth-first walk of their trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node.setdefault(ENDS, []).append(word[-1])  # a word's last symbol is another one than the same inside a word
        last: list[tuple[int, int]] = []  # the last token of the path's first 1, 2, ... symbols, and its length
        near, known, compatible = self.longest, self.pairs, self.compatible

        def place(recent: str, depth: int, table: dict[str, int], sizes: dict[str, tuple[int, ...]]) -> tuple[int, int]:
            for size in sizes.get(recent[-3:], SHORT):
                if size <= depth:
                    token = table.get(recent[-size:])
                    if token is not None:
                        if size == depth:
                            return token, size
                        before = last[depth - size - 1][0]
                        fits = known.get((before, token))
                        if compatible(before, token) if fits is None else fits:
                            return token, size
            raise ValueError(f"no token ends {recent!r}")

        path: list[str] = []
        todo = [(0, "", "", trie)]
        while todo:
            depth, symbol, recent, node = todo.pop()
            if depth:
                del last[depth - 1 :], path[depth - 1 :]
                last.append(place(recent, depth, self.inner, self.inner_sizes))
                path.append(symbol)
            for c in node.pop(ENDS, ()):
                token, size = place((recent + c)[-near:], depth + 1, self.final, self.final_sizes)
                ids, k = [token], depth + 1 - size
                while k:
                    token, size = last[k - 1]
                    ids.append(token)
                    k -= size
                yield "".join(path) + c, ids[::-1]
            todo += [(depth + 1, c, (recent + c)[-near:], below) for c, below in node.items()]


class Splitter:
    """Words of a text as the file's normaliser and pattern give them, and the ids of special tokens, in order."""

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words, self.known, self.spec, self.library = regex.compile(PATTERN), set(), spec, None

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words as Latin-1 text, and ids of special tokens."""
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            for piece in _bounded(part):
                yield [w if w.isascii() else w.encode().decode("latin-1") for w in self._words(piece)]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return self._by_file(text)
        if len(self.known) < CACHE:
            self.known |= new
        # capital sigma becomes the same small letter at a word's end as anywhere
        return self.words.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def _by_file(self, text: str) -> list[str]:
        """For characters that Python's tables don't know."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        bytes_of = {c: chr(b) for b, c in enumerate(byte_characters())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return ["".join(map(bytes_of.__getitem__, w)).encode("latin-1").decode() for w, _ in found]


def _bounded(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about `most` characters that begin at an ASCII space or line end (a longer word makes a longer piece)."""
    lo = 0
    while len(text) - lo > most:
        hi = _SPACE.search(text, lo + most)
        if hi is None:
            break
        yield text[lo : hi.start()]
        lo = hi.start()
    yield text[lo:] if lo else text


def read_vocab(path: str = DEFAULT_VOCAB) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode(docs: DataFrame, spec: dict | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs: the token ids of its text."""
    spec = spec or read_vocab()
    sent = docs.sparkSession.sparkContext.broadcast((Bpe(spec), spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, rest = sent.value
        splitter, cache = Splitter(rest), {}  # word to its ids, four bytes each
        special = {i: np.int32(i).tobytes() for i in splitter.special.values()}
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            found = [list(splitter.pieces(text)) for text in batch.column(1).to_pylist()]
            words = {w for pieces in found for p in pieces if isinstance(p, list) for w in p}
            if len(cache) + len(words) > CACHE:
                cache.clear()
            gc.disable()  # the trie has many small objects and no cycles
            cache.update((w, np.array(ids, np.int32).tobytes()) for w, ids in bpe.encode(words - cache.keys()))
            gc.enable()
            out, ends = [], [0]
            for pieces in found:
                out.append(b"".join([b"".join(map(cache.__getitem__, p)) if isinstance(p, list) else special[p] for p in pieces]))
                ends.append(ends[-1] + len(out[-1]) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, spec: dict | None = None) -> DataFrame:
    """Rows (doc_id, ids) with decoded: the tokens' strings, special ones included, joined by one space. Unknown and null ids are left out; null ids give the empty text."""
    spec = spec or read_vocab()
    names = {i: t for t, i in (spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}).items()}
    sent = encoded.sparkSession.sparkContext.broadcast([names.get(i) for i in range(max(names) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(sent.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            ids, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
            known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table))), False)
            strings = table.take(ids.filter(known))
            row = row[known.to_numpy(zero_copy_only=False)][strings.is_valid().to_numpy(zero_copy_only=False)]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), strings.drop_null()), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, joined], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
