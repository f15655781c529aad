"""Text files read in byte ranges: many tasks a file, with tags that run over line ends and over range borders.

Sentences end at line ends, so a file needs no row of its own; only a tag (a "<" and the next ">" with something between)
can hold a line end. After a ">" no tag is open, whatever stood before. So each range is summed up by whether it leaves a
tag open, and these sums, a row a range, tell every range the state in which it begins. A "<" that no ">" of its file
follows opens nothing, as in the whole text. Lines that a tag connects become one row; its inside is left out, and such a row
is cut after a sentence end, so that it never grows beyond a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsieve.functions.text import TAGS
from textsieve.sources.scratch import Scratch

ROWS = "path string, block long, at long, before boolean, value string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the rows of a range, in order, their number and whether a tag is open before them: null where only the
    ranges before can tell."""
    block, at, last = None, 0, -1
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True))
        event = np.array(pc.fill_null(pc.cast(batch.column("event"), pa.int8()), -1))
        starts = [i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else block)]
        numbers, before = np.empty(len(keys), np.int64), np.empty(len(keys), np.int8)
        for i, j in zip([0, *starts], [*starts, len(keys)], strict=True):
            if i in starts:
                at, last = 0, -1
            if i == j:
                continue
            numbers[i:j] = np.arange(at, at + j - i)
            told = np.maximum.accumulate(np.where(event[i:j] >= 0, np.arange(j - i), -1))
            after = np.where(told >= 0, event[i:j][told], last)
            before[i:j] = np.append(last, after[:-1])
            at, last = at + j - i, int(after[-1])
        block = keys[-1] if keys else block
        states = pa.array(before > 0, mask=before < 0)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(numbers), states, batch.column("value")], ["path", "block", "at", "before", "value"])


def _valid(value: Column) -> Column:
    """Bytes that are not UTF-8 are dropped; in such lines replacement characters are too."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def read_text_lines(spark: SparkSession, paths: str | Sequence[str], drop_tags: bool = True) -> DataFrame:
    """(doc_id, text), a row for each line or lines that a tag connects; doc_id sorts in the order of the text.

    A file is read in ranges of spark.sql.files.maxPartitionBytes: first, at once, for the state and the number of lines of each
    range and (if tags are to go) for the lines that tags connect, which are written; then for all others. If that setting
    changes before the rows are read, ranges that begin elsewhere are refused. Rows do not depend on the ranges. Their sentences are those of the whole
    text. Lines end with a line feed, a carriage return or both; one line must fit a row (2 GB). An empty file gives no
    rows, blank lines give none.
    """
    value = _valid(F.col("value"))
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))
    tail = F.substring_index("value", ">", -1)
    event = F.when(tail.contains("<"), True).when(F.col("value").contains(">"), False)
    rows = lines.withColumn("event", event if drop_tags else F.lit(None).cast("boolean")).mapInArrow(_numbered, ROWS)
    keep = Scratch(spark, "lines")
    # one row a range; written, so that Spark knows its size when it chooses the join
    order = F.monotonically_increasing_id()
    seen = lines.select("path", "block", order.alias("i"), event.alias("event"), F.col("value").contains(">").alias("closes"))
    blocks = seen.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max(F.when(F.col("event").isNotNull(), F.struct("i", "event"))).alias("e"), F.max(F.when(F.col("closes"), F.col("i"))).alias("c"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    blocks = blocks.withColumns({"base": base, "enters": F.coalesce(F.last("e.event", True).over(earlier), F.lit(False))})
    blocks = blocks.withColumn("last_close", F.max(F.col("base") + F.col("c") - F.col("first")).over(Window.partitionBy("path")))
    blocks = keep.write(blocks.select("path", "block", "base", "enters", "last_close"), "blocks")
    known = F.coalesce("base", F.raise_error(F.lit("the ranges of the files have changed since their lines were counted")).cast("long"))
    rows = rows.join(blocks, ["path", "block"], "left").withColumn("line", known + F.col("at"))
    if not drop_tags:
        return _named(rows.select("path", "line", F.lit(0).alias("piece"), F.col("value").alias("text")))

    joined = F.coalesce("before", "enters") & (F.col("line") <= F.coalesce("last_close", F.lit(-1)))
    opens = tail.contains("<") & (F.col("line") < F.coalesce("last_close", F.lit(-1)))
    kept = F.when(F.col("opens"), F.left("value", F.length("value") - F.length(tail) + F.instr(tail, "<") - 1)).otherwise(F.col("value"))
    rows = rows.withColumns({"joined": joined, "opens": opens}).where("not joined or value like '%>%'")  # else inside a tag as a whole
    rows = rows.withColumn("text", kept).withColumn("text", F.when(F.col("joined"), F.expr("substring(text, instr(text, '>') + 1)")).otherwise(F.col("text")))
    # a row that goes on a sentence is cut where that ends; a full stop before white space is in no verse reference
    plain = F.regexp_replace("text", TAGS, " ")
    pieces = F.when(F.col("joined"), F.split(plain, r"(?<=[.!?])(?=\s)", 2)).otherwise(F.array("text"))
    rows = rows.select("path", "block", "line", "joined", "opens", F.posexplode(pieces).alias("piece", "text"), F.size(pieces).alias("m"))
    rows = rows.withColumns({"joined": F.col("joined") & (F.col("piece") == 0), "opens": F.col("opens") & (F.col("piece") == F.col("m") - 1)}).drop("m")
    alone = rows.where("not joined and not opens").select("path", "line", "piece", "text")
    tied = keep.write(rows.where("joined or opens"), "tied")
    here = Window.partitionBy("path", "block").orderBy("line", "piece")
    start = F.when(~F.col("joined"), F.struct("line", "piece"))
    tied = tied.withColumn("start", F.last(start, True).over(here))
    carried = tied.groupBy("path", "block").agg(F.max("start").alias("s")).withColumn("carried", F.last("s", True).over(earlier)).drop("s")
    tied = tied.join(carried, ["path", "block"]).withColumn("start", F.coalesce("start", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("line", "piece", "text")))
    whole = tied.groupBy("path", "start").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    return _named(alone.unionByName(whole.select("path", "start.line", "start.piece", "text")))


def _named(rows: DataFrame) -> DataFrame:
    doc_id = F.concat("path", F.lit("#"), F.lpad(F.col("line").cast("string"), 14, "0"), F.lit("."), F.col("piece").cast("string"))
    return rows.where(F.col("text").rlike(r"\S")).select(doc_id.alias("doc_id"), "text")
