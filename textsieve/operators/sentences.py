"""Documents to sentences: one narrow plan without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.functions.text import TOKEN_CLASS, sentence_tokens, uniform
from textsieve.sources.scratch import Scratch, spread


def text_to_sentences(docs: DataFrame, min_tokens: int = 6, max_tokens: int = 80, drop_tags: bool = True, drop_verse_refs: bool = True, drop_numeric: bool = True, token_class: str = TOKEN_CLASS) -> DataFrame:
    """(doc_id, sent_pos, tokens) of every sentence with min_tokens to max_tokens tokens; sent_pos counts all parts."""
    found = sentence_tokens(F.col("text"), token_class, drop_tags, drop_verse_refs, drop_numeric)
    # tokens come out of the generator, so that the filter reads them and does not compute them again (outer, as Spark
    # would infer a filter on the array, which computes it twice)
    parts = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode_outer(found).alias("sent_pos", "tokens"))
    return parts.where(F.size("tokens").between(min_tokens, max_tokens))


def sentence_ids(sentences: DataFrame) -> DataFrame:
    """Adds sent_id: s0, s1, ... in text order, for ids of any type.

    Documents are counted, range-partitioned by id, and numbered inside their range; only the ranges' sums meet in one
    place. No sort of sentences over the whole table.
    """
    keep = Scratch(sentences.sparkSession, "ids")
    per_doc = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ranges = keep.write(per_doc.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    offsets = ranges.join(before, "part").select("doc_id", (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_pos")) - 1
    return sentences.join(offsets, "doc_id").withColumn("sent_id", F.concat(F.lit("s"), (F.col("offset") + place).cast("string"))).drop("offset")


def documents(*given: DataFrame | None) -> DataFrame:
    """(doc_id, text) of all inputs that are given, ids as text; ValueError without any."""
    parts = [d.select(F.col("doc_id").cast("string").alias("doc_id"), "text") for d in given if d is not None]
    if not parts:
        raise ValueError("no input: give docx, txt or parquet documents")
    return reduce(DataFrame.unionByName, parts)


def corpus(docx: DataFrame | None = None, txt: DataFrame | None = None, **options) -> DataFrame:
    """Sentences of both kinds of input, (doc_id, text) each; ValueError without any."""
    return text_to_sentences(documents(docx, txt), **options)


def split_train_test(sentences: DataFrame, train_frac: float = 0.75, seed: int = 7) -> DataFrame:
    """Adds is_train, drawn per sentence from a hash, so it needs neither a shuffle nor an order."""
    return sentences.withColumn("is_train", uniform(str(seed), F.lit("split"), F.col("doc_id"), F.col("sent_pos")) < train_frac)


def split_exact(sentences: DataFrame, train_frac: float = 0.75, seed: int = 7) -> DataFrame:
    """Adds is_train to exactly floor(n * train_frac) of n sentences, those with the lowest draws.

    Draws are range-partitioned and numbered inside their range; only the ranges' counts meet in one place.
    """
    keep, keys = Scratch(sentences.sparkSession, "split"), ["doc_id", "sent_pos"]
    drawn = sentences.select(*keys, uniform(str(seed), F.lit("split"), F.col("doc_id"), F.col("sent_pos")).alias("draw"))
    ranges = keep.write(drawn.repartitionByRange("draw", *keys).withColumn("part", F.spark_partition_id()), "draws")
    sums = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy(F.lit(0))).alias("n"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("draw", *keys))
    chosen = ranges.join(before, "part").select(*keys, (rank <= F.floor(F.col("n") * train_frac)).alias("is_train"))
    return sentences.join(chosen, keys)


def ranked(words: DataFrame, column: str = "w", start: Column | int = 1) -> DataFrame:
    """Adds rank in code point order. Words are numbered inside groups of equal first two characters; only the groups' counts are ordered in one place."""
    grouped = words.withColumn("_p", F.substring(column, 1, 2))
    counts = grouped.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return grouped.join(before, "_p").withColumn("rank", F.col("_base") + inside - 1 + start).drop("_p", "_n", "_base")
