"""What the operators of this subpackage share: written tables, connected components, row handling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.sources.scratch import Scratch, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAP_BITS = 26


class Workspace(Scratch):
    """A folder of written tables under the shared folder; see Scratch."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        limit_batches(spark)

    def again(self) -> Workspace:
        """Another folder beside this one, for steps whose tags repeat."""
        return Workspace(self.spark, "part")


def limit_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch for Python workers, as rows may be long; the setting bounds memory, not results."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and int(now) <= most):
        spark.conf.set(key, str(most))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table has is left out."""
    limit_batches(docs.sparkSession)
    docs = spread(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *(docs[c] for c in more))


def bitmap(keys: DataFrame) -> tuple[int, DataFrame]:
    """Bits and the table (w, m) of a bitmap of 64-bit keys k, 64 bits a row: 16 bits a key or more, 2^MAP_BITS in all at most.

    It only spares work: with more keys it fills up, lets other keys through and keeps its size.
    """
    bits = min(max(16 * keys.count(), 1 << 10).bit_length(), MAP_BITS)
    at = F.shiftrightunsigned("k", 64 - bits)
    placed = keys.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    return bits, placed.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m"))


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not among keys (k), rows whose key may be), without moving rows: the bitmap is sent out, 2^(MAP_BITS - 6) rows at most."""
    bits, words = bitmap(keys)
    words = F.broadcast(words.select(F.col("w").alias("__w"), F.col("m").alias("__m")))
    at = F.shiftrightunsigned(key, 64 - bits)
    placed = rows.withColumn("__at", at)
    placed = placed.join(words, F.shiftright("__at", 6) == F.col("__w"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(__m, cast(__at & 63 as int)) & 1"), F.lit(0).cast("long")) == 1
    return placed.where(~hit).select(*rows.columns), placed.where(hit).select(*rows.columns)


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds rid, one value per row; it is stable only once the result has been written."""
    return df.withColumn("rid", F.monotonically_increasing_id())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with b the smallest node that a reaches, for all edges of a task, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(found), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found[i : i + (1 << 16)]], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(edges: DataFrame, work: Workspace, few_edges: int = 1 << 16) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots themselves: root is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al. 2014) until no edge changes. Each step is an aggregation and
    a join over edges, written to the shared folder; only a count comes to the driver. few_edges edges or less are joined
    in one task.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = work.write(edges.where("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "cc0")
    if now.count() <= few_edges:
        return now.coalesce(1).mapInArrow(_joined, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    step, seen = 0, None
    while True:
        step += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins read plain exchanges on both sides, whose hot partitions Spark can split
        low = work.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"low{step}")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.write(large, f"large{step}")
        small_low = work.write(large.groupBy("a").agg(F.min("b").alias("m")), f"small{step}")
        small = large.join(small_low, "a").select("b", "m", "a")
        turned = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = work.write(turned, f"cc{step}")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        changed, seen = mark != seen, mark  # the same edges have the same count and sum of hashes
        work.drop(f"cc{step - 1}", f"low{step}", f"large{step}", f"small{step}")
        now = after
        if not changed:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
