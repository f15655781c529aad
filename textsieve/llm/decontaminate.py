"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. A window is `window` consecutive words of
an item; an item of fewer words (but not none) is one window. The automaton of all items is streamed over a document's
words; wherever the length matched so far reaches a window, its words are hit and the window's items are noted.
Only runs of words in which every neighbouring pair occurs in some item are streamed, as no window can lie elsewhere.

Items come to the driver in blocks of at most `block_words` words, so that an automaton has a bounded size; with more
items than one block holds, the texts pass through the blocks one after the other and written hits are united.

Defined cases: a null or empty text has no words; a null or wordless item has no windows; items with a null id mark
words but are never named; repeated items count once; repeated rows are documents of their own; a very long text is
one part of its own; empty tables give no rows or no hits; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from textsieve.llm.bytehash import ALNUM, mix, raw, slices, word_hashes
from textsieve.llm.common import Workspace, limit_batches
from textsieve.sources.scratch import spread

BATCH_BYTES = 4 << 20
_SPAN = StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("from", LongType()), StructField("to", LongType())])
FOUND = [StructField("n_words", LongType()), StructField("hits", ArrayType(_SPAN)), StructField("items", ArrayType(LongType()))]
_FOUND_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("from", pa.int64()), ("to", pa.int64())]))),
    pa.field("items", pa.list_(pa.int64())),
]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class SuffixAutomaton:
    """Of many sequences of word hashes; maps windows to items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int):
        self.window, self.length, self.link, self.next = window, [0], [-1], [{}]
        words = [(i, [int(x) for x in h]) for i, h in items if len(h)]
        for _, seq in words:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.short = sorted({len(seq) for _, seq in words if len(seq) < window})
        self.least = min([min(len(seq), window) for _, seq in words], default=window)
        self.found: dict[tuple[int, int], set] = {}
        for i, seq in words:
            n = min(len(seq), window)
            state = 0
            for k, w in enumerate(seq):
                state = self.next[state][w]
                if k + 1 >= n:
                    self.found.setdefault((self.suffix(state, n), n), set()).add(i)
        self.pairs = np.unique(np.concatenate([pair_hashes(h) for _, h in items if len(h) > 1] or [np.empty(0, np.uint64)]))
        self.words = np.unique(np.concatenate([h for _, h in items if len(h)] or [np.empty(0, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.pairs >> np.uint64(44)).astype(np.int64)] = True

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(edges)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def suffix(self, state: int, n: int) -> int:
        """The state of the last n words of what `state` stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def runs(self, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
        """From, to of the word runs that can hold a window."""
        if len(h) == 0:
            return
        good = np.zeros(len(h), bool)  # word i and the next are neighbours in some item
        if len(h) > 1:
            p = pair_hashes(h)
            k = np.flatnonzero(self.maybe[(p >> np.uint64(44)).astype(np.int64)] & (owner[1:] == owner[:-1]))
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, p[k]), len(self.pairs) - 1)
                good[k[self.pairs[at] == p[k]]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + 1
        if self.least > 1:
            long = ends - starts >= self.least
            yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)
            return
        alone = np.isin(h, self.words) & ~good
        alone[1:] &= ~good[:-1]
        i = np.flatnonzero(alone)
        yield from sorted([*zip(starts.tolist(), ends.tolist(), strict=True), *zip(i.tolist(), (i + 1).tolist(), strict=True)])

    def matches(self, h: list[int]) -> Iterator[tuple[int, int, set]]:
        """From, to, items of each occurrence of a window in a run of words."""
        state = n = 0
        for k, w in enumerate(h):
            while w not in self.next[state]:
                state = self.link[state]
                if state < 0:
                    break
                n = self.length[state]
            if state < 0:
                state = n = 0
                continue
            state, n = self.next[state][w], n + 1
            for size in (*self.short, self.window):
                if n >= size and (items := self.found.get((self.suffix(state, size), size))):
                    yield k + 1 - size, k + 1, items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    now, size = [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        data, offsets = raw(pa.array([row["text"]]))
        h, _ = word_hashes(data, offsets, ALNUM)
        if now and size + len(h) > block_words:
            yield now
            now, size = [], 0
        now.append((row["item_id"], h))
        size += len(h)
    yield now


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, names: list[str], max_coverage: float | None = None) -> DataFrame:
    """docs with n_words, hits and items under the given names at the end. With max_coverage, rows of more coverage go and
    hits are cut from the text of the others. One pass in Python over parts of bounded size; docs has the column text.

    If the items fill more than one block, each block is run on its own over the texts first and its hits are written, so
    that one automaton at a time is in memory; the pass then reads the hits by a hash of the text.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    automata = (SuffixAutomaton(block, window) for block in _blocks(benchmark, block_words))
    first, second = next(automata), next(automata, None)
    columns = docs.columns
    out = StructType([*(StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema)), *FOUND])
    rows = spread(docs).toDF(*(f"c{k}" for k in range(len(columns))))
    at = columns.index("text")
    if second is None:
        sent = spark.sparkContext.broadcast(first)
        found = rows.mapInArrow(_matcher(sent, at, False, max_coverage), out)
    else:
        work = Workspace(spark, "blocks")
        mark = F.xxhash64(F.coalesce(f"c{at}", F.lit("")))
        once = rows.select(F.col(f"c{at}").alias("text"), mark.alias("mark"))
        parts = []
        for k, automaton in enumerate(chain((first, second), automata)):
            sent = spark.sparkContext.broadcast(automaton)
            part = once.mapInArrow(_matcher(sent, 0, False, None), StructType([StructField("text", StringType()), StructField("mark", LongType()), *FOUND]))
            parts.append(work.write(part.where("size(hits) > 0").select("mark", "hits", "items").dropDuplicates(["mark"]), f"block{k}"))
            sent.destroy()
        every = reduce(DataFrame.union, parts).groupBy("mark").agg(F.flatten(F.collect_list("hits")).alias("old_hits"), F.flatten(F.collect_list("items")).alias("old_items"))  # a row per block and text
        every = work.write(every, "every")
        joined = rows.withColumn("mark", mark).join(every, "mark", "left").select(*rows.columns, "old_hits", "old_items")
        found = joined.mapInArrow(_matcher(None, at, True, max_coverage), out)
    return found.toDF(*columns, *names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs with n_words, hits (maximal runs of hit words: first, last word and bytes from, to) and items (ids, sorted).

    Columns of docs with these three names are replaced.
    """
    names = ["n_words", "hits", "items"]
    return _scan(docs.select(*(docs[c] for c in docs.columns if c not in names)), benchmark, window, block_words, names)


def _matcher(sent, at: int, given: bool, max_coverage: float | None):
    """sent: the automaton, or none if the last two columns (given) have the hits and items."""

    def found_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = sent.value if sent is not None else None
        n = batch.num_columns - 2 * given
        data, offsets = raw(batch.column(at))
        h, owner, froms, tos = word_hashes(data, offsets, ALNUM, spans=True)
        begins = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        masks: dict[int, np.ndarray] = {}
        items: dict[int, set] = {}
        mask_of = lambda d: masks.setdefault(d, np.zeros(begins[d + 1] - begins[d], bool))
        if automaton is not None:
            for i, j in automaton.runs(h, owner):
                d = int(owner[i])
                for a, b, named in automaton.matches(h[i:j].tolist()):
                    mask_of(d)[a + i - begins[d] : b + i - begins[d]] = True
                    items.setdefault(d, set()).update(named)
        if given:
            for d in np.flatnonzero(batch.column(n).is_valid().to_numpy(zero_copy_only=False)).tolist():
                for s in batch.column(n)[d].as_py():
                    mask_of(d)[s["first"] : s["last"] + 1] = True
                items[d] = set(batch.column(n + 1)[d].as_py())
        hits, named, keep, texts = [], [], [], batch.column(at)
        new: dict[int, str] = {}
        for d in range(batch.num_rows):
            if d not in masks:
                hits.append([])
                named.append([])
                keep.append(True)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], masks[d].view(np.int8), [0]))))
            a, b = edge[::2], edge[1::2] - 1
            f, t = froms[begins[d] + a] - offsets[d], tos[begins[d] + b] - offsets[d]
            hits.append([{"first": w, "last": x, "from": y, "to": z} for w, x, y, z in zip(a.tolist(), b.tolist(), f.tolist(), t.tolist(), strict=True)])
            named.append(sorted(x for x in items[d] if x is not None))
            keep.append(max_coverage is None or masks[d].sum() <= max_coverage * len(masks[d]))
            if max_coverage is not None and keep[-1]:  # hits begin and end between characters
                whole = data[offsets[d] : offsets[d + 1]]
                cut = [whole[i:j].tobytes() for i, j in zip([0, *t.tolist()], [*f.tolist(), len(whole)], strict=True)]
                new[d] = b"".join(cut).decode()
        if new:
            pieces, last = [], 0  # unchanged stretches are shared, not copied
            for d, text in sorted(new.items()):
                pieces += [texts.slice(last, d - last), pa.array([text], texts.type)]
                last = d + 1
            texts = pa.concat_arrays([*pieces, texts.slice(last)])
        kinds = [f.type for f in _FOUND_ARROW]
        columns = [texts if k == at else batch.column(k) for k in range(n)] + [pa.array(np.diff(begins), kinds[0]), pa.array(hits, kinds[1]), pa.array(named, kinds[2])]
        made = pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(n)] + [f.name for f in _FOUND_ARROW])
        return made if all(keep) else made.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, BATCH_BYTES):
                yield found_in(part)

    return run


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """docs without those of whose words more than max_coverage are hit; from the others the hit spans are cut.

    A cut goes from the first byte of the first hit word to the end of the last; the column n_chars, if there is one,
    follows the new text. Documents without a hit stay as they are, null texts too.
    """
    names, extra = docs.columns, [f"_found{k}" for k in range(3)]  # the columns go by position, so that no name can clash
    found = _scan(docs, benchmark, window, block_words, extra, max_coverage)
    if "n_chars" not in names:
        return found.drop(*extra)
    n_chars = F.when(F.size(extra[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).drop(*extra)
