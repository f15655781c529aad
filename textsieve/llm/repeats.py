"""Periodic runs of words: every maximal stretch that repeats with its smallest period, and text without the repeats.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least
max(least, times * q) words. After Bannai et al. (2017), each run has a place where a longest Lyndon word of length q
begins, under one of two opposite orders of the words. A stack of Lyndon words, scanned from right to left under both
orders, gives these lengths; each is a candidate period, which is extended to both sides. Suffixes are compared, and
stretches extended, by their longest common extension: a binary search over rolling hashes, whose answer is verified on
the words themselves. There is no suffix array.

With `times` of 4, a run's words occur four times in it, so texts are cut at words that are rarer in their document,
and only pieces of `least` words or more are scanned. This drops no run.

Texts are worked on whole, one at a time; the rows keep their place, so nothing is shuffled. Time is n log n in the words
of a text even where it is one word all through.

Defined cases: a null or empty text has no words and no run; repeated rows are worked on each; a null id is kept (its
number for the planted repeats of the digest is that of the empty text); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.bytehash import slices
from textsieve.llm.common import texts

BATCH_BYTES = 4 << 20
PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
NEAR = 64
RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions of two places of a sequence of numbers, to the right and to the left.

    Equal stretches have equal hashes, so the search never stops early; the stretch that it finds is then compared itself.
    What was found for the same distance a few places further right is continued word by word.
    """

    def __init__(self, w: list[int]):
        self.w, self.raw, self.sums, self.powers = w, array("i", w).tobytes(), [0], [1]
        sums, powers, h, p = self.sums, self.powers, 0, 1
        for x in w:
            h = (h * BASE + x + 1) % PRIME
            p = p * BASE % PRIME
            sums.append(h)
            powers.append(p)
        self.at: dict[int, tuple[int, int]] = {}  # of each distance, the last place asked for and its extension

    def _same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _search(self, most: int, same: Callable[[int], bool]) -> int:
        """The largest n up to most with same(n), which holds for 1; the span is doubled first."""
        low, high = 1, 2
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            n = (low + high) // 2
            low, high = (n, high) if same(n) else (low, n)
        return low

    def right(self, i: int, j: int) -> int:
        """Number of equal words from i and from j on, for i < j."""
        w = self.w
        if j >= len(w) or w[i] != w[j]:
            return 0
        later, known = self.at.get(j - i, (0, 0))
        gap = later - i
        if 0 < gap <= NEAR and w[i:later] == w[j : j + gap]:
            n = gap + known
        else:
            n = self._search(len(w) - j, lambda n: self._same(i, j, n))
            if self.raw[4 * i : 4 * (i + n)] != self.raw[4 * j : 4 * (j + n)]:
                n = next(k for k in range(n) if w[i + k] != w[j + k])
        self.at[j - i] = i, n
        return n

    def left(self, i: int, j: int) -> int:
        """Number of equal words up to and including i and j, for i < j."""
        w = self.w
        if i < 0 or w[i] != w[j]:
            return 0
        n = self._search(i + 1, lambda n: self._same(i - n + 1, j - n + 1, n))
        if self.raw[4 * (i - n + 1) : 4 * (i + 1)] != self.raw[4 * (j - n + 1) : 4 * (j + 1)]:
            n = next(k for k in range(n) if w[i - k] != w[j - k])
        return n


def lyndon_ends(w: list[int], x: Extensions, order: int) -> Iterator[tuple[int, int]]:
    """(i, end of the longest Lyndon word that begins at i) from right to left, under the order of numbers (1) or its opposite (-1).

    The end is where the next smaller suffix begins; a suffix that another one begins with is the smaller one.
    """
    n = len(w)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        a, j = w[i], i + 1
        while j < n:
            b = w[j]
            if a == b:
                k = x.right(i, j)
                if j + k == n:
                    break
                less = w[i + k] < w[j + k] if order > 0 else w[i + k] > w[j + k]
            else:
                less = a < b if order > 0 else a > b
            if not less:
                break
            j = ends[j]  # the Lyndon word at j joins the one at i
        ends[i] = j
        yield i, j


def runs_of(w: list[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, times * period) numbers, by start, then period. times is 2 or more."""
    n, found = len(w), set()
    if n < least:
        return []
    x = Extensions(w)
    for order in (1, -1):
        reach: dict[int, tuple[int, int]] = {}  # of each period, the last stretch that was extended
        for i, j in lyndon_ends(w, x, order):
            p = j - i
            # the first Lyndon word of a run begins in the run's first period, so (times - 1) * p words and one more follow
            if j >= n or w[i] != w[j] or i + times * p - p >= n:
                continue
            start, end = reach.get(p, (n, n))
            if start <= i and j < end:
                continue
            after, before = x.right(i, j), x.left(i - 1, j - 1)
            reach[p] = start, end = i - before, j + after
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """The runs of a list of words."""
    counts = Counter(words)
    number = {word: k for k, (word, c) in enumerate(counts.items()) if c >= times}
    if not number:
        return []
    found, piece = [], []
    for i, k in enumerate(map(number.get, [*words, None])):
        if k is not None:
            piece.append(k)
        elif piece:
            if len(piece) >= least:
                found += [(i - len(piece) + s, n, p) for s, n, p in runs_of(piece, least, times)]
            piece = []
    return found


def dropped(n: int, runs: list[tuple[int, int, int]]) -> bytearray:
    """1 for each word that a run holds after its first period."""
    marks = bytearray(n)
    for start, length, period in runs:
        marks[start + period : start + length] = b"\1" * (length - period)
    return marks


def plant(words: list, doc_id: int | None) -> list:
    """Words of one document in ten are made periodic from some word on, by a rule of its id."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, by start, then period, and its words without those that a
    run holds after its first period, joined by one space. Words are cut at ASCII white space. With planted, some texts are
    made periodic first, as `plant` does, so that long periods occur."""
    if times < 2:
        raise ValueError("times must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            counts, runs, kept = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()  # bytes are cut at the six ASCII spaces only
                words = plant(words, doc_id) if planted else words
                found = text_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join([w for w, out in zip(words, dropped(len(words), found), strict=True) if not out] if found else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _ARROW), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of the longest run (ties: smallest start, then period) its figures, null without a run; hashes of all runs and of the text that is left."""
    longest = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (a, r) -> if(a is null or r.length > a.length, r, a))")
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    one = found.withColumn("r", longest)
    exponent = F.expr("1000 * r.length div r.period")
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", exponent.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
