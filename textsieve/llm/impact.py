"""Ranked lexical search over a bit-sliced impact index.

Documents are put into blocks of `BLOCK` places. For every term of a block the index has one bitmap a bit of the term's
impact, so that bit s of place p says whether the impact of the term in document p has that bit. A query's scores of all
documents of a block are then added at once: the bitmaps of a term are multiplied by its weight (shifted additions) and
added to the sum with bitwise carry arithmetic. The k best places are found from the most significant bitmap down: places
with the bit are sure while they are k or fewer, else the search goes on among them. No score is ever read but those of
the places found.

A term's impact in a document with tf of n terms is (10^9 tf) div (1000 tf + 8 m), m being 25 + (75 n N) div L, for N
documents that have terms and L terms in all; its weight is floor(1000 ln((2 N + 2) / (2 df + 1))) times its repeats in
the query. So an impact has at most 20 bits, and weights need not be known to the index.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z become a-z. The index is a table, a row a
block, with the bitmaps of a term as the byte columns that are not empty. It is built in one pass without a shuffle, may
be limited to the terms that are asked for (a list of at most `max_terms` is sent out; with more, all terms are indexed),
and always holds all documents. Queries come to the driver in blocks of `query_terms` terms; each task keeps the k best of
each query, which meet in a window a query.

Defined cases: null and empty texts have no terms and are never found; queries without terms find nothing; repeated rows
are documents, or queries, of their own; a null doc_id comes after all others at equal scores; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from textsieve.llm.bytehash import slices
from textsieve.llm.common import Workspace, ascii_lower, limit_batches, texts
from textsieve.sources.scratch import spread

BLOCK = 2048
BITS = 20
BATCH_BYTES = 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The bytes of terms, A-Z as a-z, all others as spaces.
_BYTES = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_BLOCKS = "doc_ids array<long>, terms array<string>, counts array<int>, slices array<binary>"


@dataclass
class ImpactIndex:
    """blocks: doc_ids of the places, terms, in how many places each is, its bitmaps. df: (term, df)."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    @property
    def df(self) -> DataFrame:
        each = self.blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        return each.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms_of(text.as_buffer().to_pybytes()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def _bitmaps(term: np.ndarray, place: np.ndarray, impact: np.ndarray) -> list[bytes]:
    """Of each term 0, 1, ...: the columns of eight places in which it is, a byte each, then for every bit the bytes of these columns."""
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    column = term * (BLOCK // 8) + (place >> 3)
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    data = np.empty((BITS, len(starts)), np.uint8)
    for s in range(BITS):
        data[s] = np.bitwise_or.reduceat((((impact >> s) & 1) << (place & 7)).astype(np.uint8), starts)
    at = (column[starts] % (BLOCK // 8)).astype(np.uint8)
    cuts = np.flatnonzero(np.diff(term[starts], prepend=-1)).tolist()
    return [at[i:j].tobytes() + data[:, i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(starts)], strict=True)]


def _unpacked(data: bytes) -> list[int]:
    """A term's bitmaps, least significant first."""
    n = len(data) // (BITS + 1)
    table = np.zeros((BITS, BLOCK // 8), np.uint8)
    table[:, np.frombuffer(data, np.uint8, n)] = np.frombuffer(data, np.uint8, n * BITS, n).reshape(BITS, n)
    return [int.from_bytes(row.tobytes(), "little") for row in table]


def add(total: list[int], more: list[int], shift: int = 0) -> None:
    """Adds numbers, given as bitmaps of their bits, to those of total, times 2^shift."""
    total += [0] * (shift + len(more) - len(total))
    carry = 0
    for k, x in enumerate(more, shift):
        t = total[k]
        differ = t ^ x
        total[k], carry = differ ^ carry, (t & x) | (differ & carry)
    k = shift + len(more)
    while carry:
        if k == len(total):
            total.append(0)
        total[k], carry, k = total[k] ^ carry, total[k] & carry, k + 1


def times(bits: list[int], weight: int) -> list[int]:
    out: list[int] = []
    for shift in range(weight.bit_length()):
        if weight >> shift & 1:
            add(out, bits, shift)
    return out


def top(total: list[int], k: int) -> list[tuple[int, int]]:
    """(place, number) of the k largest numbers above 0, equal ones by place."""
    some, sure = reduce(int.__or__, total, 0), 0
    for bits in reversed(total):
        if (sure | some).bit_count() <= k:
            break
        having = sure | (some & bits)
        if having.bit_count() > k:
            some &= bits
        else:
            sure, some = having, some & ~bits
    found = []
    for bitmap, most in ((sure, k), (some, k - sure.bit_count())):
        for _ in range(min(most, bitmap.bit_count())):
            place = (bitmap & -bitmap).bit_length() - 1
            bitmap &= bitmap - 1
            found.append((place, sum((x >> place & 1) << s for s, x in enumerate(total))))
    return sorted(found, key=lambda x: (-x[1], x[0]))


def build_index(docs: DataFrame, terms: DataFrame | None = None, max_terms: int = 1_000_000, work: Workspace | None = None) -> ImpactIndex:
    """The index of docs, written; of the given terms (term) alone if there are any and not more than max_terms."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "impact")
    rows = texts(docs)
    sizes = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = sizes[0] or 0, sizes[1] or 0
    wanted = None
    if terms is not None:
        found = [r["term"].encode() for r in terms.select("term").where("term is not null").distinct().limit(max_terms + 1).toLocalIterator()]
        wanted = spark.sparkContext.broadcast(set(found)) if len(found) <= max_terms else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = wanted.value if wanted else None, []
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                every = terms_of(text.as_buffer().to_pybytes())
                counts = Counter(every)
                if asked is not None:
                    counts = {t: counts[t] for t in counts.keys() & asked}
                if counts:
                    held.append((doc_id, len(every), counts))
                if len(held) == BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[tuple[int | None, int, dict[bytes, int]]]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        number: dict[bytes, int] = {}
        term, place, tf, m = [], [], [], []
        for p, (_, n, counts) in enumerate(held):
            term += [number.setdefault(t, len(number)) for t in counts]
            place += [p] * len(counts)
            tf += counts.values()
            m.append(25 + 75 * n * n_docs // n_terms)
        term, place, tf = np.array(term, np.int64), np.array(place, np.int64), np.array(tf, np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.array(m, np.int64)[place])
        columns = [pa.array([x], kind) for x, kind in (
            ([x[0] for x in held], pa.list_(pa.int64())), ([t.decode() for t in number], pa.list_(pa.string())),
            (np.bincount(term).tolist(), pa.list_(pa.int32())), (_bitmaps(term, place, impact), pa.list_(pa.binary())),
        )]
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "terms", "counts", "slices"])

    return ImpactIndex(work.write(rows.mapInArrow(run, _BLOCKS), "blocks"), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, term, n): the terms of each row of items (item_id, text), with their repeats."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(items["text"], F.lit(""))), F.lit(TERM), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("row"), items["item_id"].alias("item_id"), found.alias("terms"))
    return rows.select("row", "item_id", F.explode("terms").alias("term")).groupBy("row", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def search(index: ImpactIndex, queries: DataFrame, k: int = 10, query_terms: int = 500_000, work: Workspace | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of each query's k best documents of those with a score above 0.

    queries: as item_terms gives them, written. Equal scores go by doc_id. The index must hold the queries' terms.
    """
    spark = queries.sparkSession
    work = work or Workspace(spark, "search")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("n")
    weighted = queries.join(index.df, "term").select("row", "item_id", "term", weight.alias("w")).where("w > 0")
    asked = weighted.groupBy("row", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))  # the terms of one query
    kind = queries.schema["item_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def found_by(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[int, bool, int | None]]] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    ids = batch.column(0)[r].as_py()
                    here = {t: i for i, t in enumerate(batch.column(1)[r].as_py())}
                    maps, products = batch.column(2)[r].values, {}
                    for q, (_, _, terms) in enumerate(sent.value):
                        total: list[int] = []
                        for x in terms:
                            if x[0] in here:
                                if x not in products:
                                    products[x] = times(_unpacked(maps[here[x[0]]].as_py()), x[1])
                                add(total, products[x])
                        if total:
                            more = [(-score, ids[p] is None, ids[p]) for p, score in top(total, k)]
                            best[q] = sorted([*best.get(q, ()), *more], key=lambda x: (x[0], x[1], x[2] or 0))[:k]
            out = [(sent.value[q][0], sent.value[q][1], x[2], -x[0]) for q, xs in best.items() for x in xs]
            for i in range(0, len(out), 1 << 16):
                columns = zip(*out[i : i + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), arrow_kind, pa.int64(), pa.int64()), strict=True)], ["row", "item_id", "doc_id", "score"])

        return run

    schema = StructType([StructField("row", LongType()), StructField("item_id", kind), StructField("doc_id", LongType()), StructField("score", LongType())])
    blocks = spread(index.blocks.select("doc_ids", "terms", "slices"))
    parts, now = [], []

    def ask(some: list) -> None:
        parts.append(blocks.mapInArrow(found_by(spark.sparkContext.broadcast(some)), schema))

    size = 0
    for q in asked.toLocalIterator():
        if now and size + len(q["terms"]) > query_terms:
            ask(now)
            parts[-1] = work.write(parts[-1], f"part{len(parts)}")
            now, size = [], 0
        now.append((q["row"], q["item_id"], [(x["term"], x["w"]) for x in q["terms"]]))
        size += len(q["terms"])
    ask(now)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for every row of items."""
    work = Workspace(docs.sparkSession, "impact")
    limit_batches(docs.sparkSession)
    queries = work.write(item_terms(items), "queries")
    index = build_index(docs, queries.select("term"), work=work)
    return search(index, queries, k, work=work)
