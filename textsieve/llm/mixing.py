"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Targets: sources in code point order, the null source last, carry the given weights in turn and share all words; a
target stops at `max_epochs` times its source's words and the excess is shared again by weight. Blocks of
`block` words are then allotted: to sources by the highest quotients target / (2k - 1), and within a source to its
shards by their words in the same way. A shard holds its documents in an order drawn from the seed; whole passes come
first, and what is left of its quota is a run of blocks, on the ring of its blocks, that begins at a block drawn from
the seed. A document takes as many words as the chosen blocks cover.

Sources meet in one task where targets are shared out, and the shards of a source (one per `shard_words` words) where its
blocks are.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import Workspace, texts

#: Source tables of at most so many rows are sent to all executors; larger ones are joined by shuffling.
SMALL_TABLE = 20_000


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def capped_targets(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Adds target to (source, source_size): shares of the sum by weight, none above max_epochs times its source.

    With the sources in order of cap / weight, those below the water level stop at their caps; the level is fixed
    where the rest, sharing what is left, all stay under their own caps. One row per source meets in the windows.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("place")
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("w_all", F.sum("w").over(all_rows))
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.when(F.col("left") / F.col("w_left") * F.col("w") < F.col("cap"), F.col("left") / F.col("w_left")))
    rows = rows.withColumn("level", F.first("level", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return rows.select("source", "source_size", "place", target.alias("target"))


def sainte_lague(parties: DataFrame, claim: str, seats: Column, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds seats_won: `seats` (the same in a group) by the highest quotients claim / (2k - 1), ties by `order` (no nulls).

    Only seats that can be in doubt are listed: a divisor a little above and one a little below the exact one bound
    each party's seats, and the bounds of n parties leave 2n + 1 quotients at most to rank.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_sum", F.sum(F.col(claim).cast("double")).over(g)).withColumn("_seats", seats)
    rounded = lambda k: F.floor(F.col(claim) * k / F.col("_sum") + 0.5)
    low = F.when((F.col("_sum") > 0) & (F.col("_seats") > F.col("_n") / 2), rounded(F.col("_seats") - F.col("_n") / 2)).otherwise(F.lit(0))
    high = F.when(F.col("_sum") > 0, rounded(F.col("_seats") + F.col("_n") / 2) + 1).otherwise(F.lit(0))
    p = p.withColumn("_low", F.greatest(low.cast("long") - 1, F.lit(0).cast("long"))).withColumn("_high", F.when(F.col(claim) > 0, high.cast("long")).otherwise(F.lit(0).cast("long")))
    p = p.withColumn("_open", F.col("_seats") - F.sum("_low").over(g))
    k = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>"))
    doubt = p.select(*group, *order, "_open", claim, F.explode(k).alias("_k"))
    rank = F.row_number().over(g.orderBy((F.col(claim) / (2 * F.col("_k") - 1)).desc(), *order, "_k"))
    won = doubt.withColumn("_rank", rank).where("_rank <= _open").groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_more"))
    return p.join(won, [*group, *order], "left").select(*parties.columns, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("seats_won"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, block: int = 64, shard_words: int = 1 << 20, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, shard, epochs) for every row of docs."""
    return _mixed(docs, weights, max_epochs, block, shard_words, seed).drop("draw")


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, block: int = 64, shard_words: int = 1 << 20, seed: int = 7) -> DataFrame:
    """mix_sources with the text of each row beside it; a text without words comes as the empty one.

    Texts are moved once, to the rows that the mix made of them; rows without words take nothing and are not joined.
    """
    work = Workspace(docs.sparkSession, "mixed")
    mixed = work.write(_mixed(docs, weights, max_epochs, block, shard_words, seed), "rows")
    some, empty = mixed.where("size > 0"), mixed.where("size = 0").withColumn("text", F.lit(""))
    keyed = texts(docs, "source").select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), _draw(seed).alias("_draw"), "text")
    repeated = some.groupBy("doc_id", "source", "draw").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    keyed = keyed.dropDuplicates(["_id", "_source", "_draw"]) if repeated else keyed
    same = some["doc_id"].eqNullSafe(keyed["_id"]) & (some["draw"] == keyed["_draw"]) & some["source"].eqNullSafe(keyed["_source"])
    return some.join(keyed, same).drop("_id", "_source", "_draw").unionByName(empty).drop("draw")


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _mixed(docs: DataFrame, weights: Sequence[float], max_epochs: int, block: int, shard_words: int, seed: int) -> DataFrame:
    work = Workspace(docs.sparkSession, "mix")
    sized = texts(docs, "source").select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    # rows that repeat in full are one row with a number of copies until the end, so that they make no hot shard
    sized = work.write(sized.groupBy("doc_id", "source", "size", "draw").agg(F.count(F.lit(1)).alias("copies")), "sized")
    weight = F.col("size") * F.col("copies")
    totals = work.write(sized.groupBy("source").agg(F.sum(weight).alias("source_size")), "totals")
    targets = capped_targets(totals, weights, max_epochs)
    n_blocks = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    won = sainte_lague(targets.withColumn("_blocks", n_blocks), "target", F.col("_blocks"), [], ["place"]).drop("_blocks")
    sources = won.select("source", "place", "source_size", "target", F.col("seats_won").alias("blocks"), F.ceil((F.col("source_size") + 1) / shard_words).cast("long").alias("shards"))
    sources = work.write(sources, "sources")
    few = sources.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
    hint = F.broadcast if few else (lambda x: x)
    s = sources.select(F.col("source").alias("_source"), "place", "source_size", "target", "shards")
    placed = sized.join(hint(s), sized["source"].eqNullSafe(s["_source"])).drop("_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards")))
    shards = placed.groupBy("place", "shard").agg(F.sum(weight).alias("shard_size"))
    b = sources.select("place", "blocks")
    shards = sainte_lague(work.write(shards.join(hint(b), "place"), "shards"), "shard_size", F.col("blocks"), ["place"], ["shard"])
    # a quota in words; whole passes over the shard first, then a run of blocks on its ring
    quota = F.least(F.col("seats_won") * block, F.col("shard_size") * max_epochs)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "place", "shard"), F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))) * block
    shards = shards.withColumn("quota", quota).withColumn("epochs", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0)))
    shards = work.write(shards.select("place", "shard", "shard_size", "epochs", (F.col("quota") - F.col("epochs") * F.col("shard_size")).alias("rest"), start.alias("start")), "quotas")
    h = F.broadcast if shards.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else (lambda x: x)
    order = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumn("first", F.sum(weight).over(order) - weight).join(h(shards), ["place", "shard"])
    # each copy its own place, in two steps so that no array is long
    at = at.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1024)))).withColumn("left", F.least(F.col("copies") - F.col("k") * 1024, F.lit(1024)) - 1)
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left")))).withColumn("from", F.col("first") + (F.col("k") * 1024 + F.col("j")) * F.col("size"))
    at = at.withColumn("to", F.col("from") + F.col("size"))
    overlap = lambda lo, hi: F.greatest(F.least(F.col("to"), hi) - F.greatest(F.col("from"), lo), F.lit(0))
    end = F.col("start") + F.col("rest")
    part = overlap(F.col("start"), F.least(end, F.col("shard_size"))) + F.when(end > F.col("shard_size"), overlap(F.lit(0), end - F.col("shard_size"))).otherwise(F.lit(0))
    return at.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source", "shard", F.col("epochs").cast("long").alias("epochs"), "draw")
