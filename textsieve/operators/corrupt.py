"""Labelled synthetic errors. Draws are hashes of seed, sentence and purpose, so every sentence is independent of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.functions.text import levenshtein_limit, uniform
from textsieve.operators.sentences import ranked
from textsieve.sources.scratch import Scratch

DELETIONS = "array<struct<pos:int,token:string,left:string,right:string>>"


def _draw(seed: int, purpose: str):
    return uniform(str(seed), F.lit(purpose), F.col("doc_id"), F.col("sent_pos"))


def with_deletions(sentences: DataFrame, p_delete: float, seed: int, max_events: int = 2) -> DataFrame:
    """Adds deletions (at most one; pos in the clean sentence) and kept, the tokens left. Sentences under six tokens stay."""
    n = F.size("tokens")
    happens = (n >= 6) & (_draw(seed, "delete") < p_delete) & F.lit(max_events > 0)
    pos = F.floor(_draw(seed, "delete_at") * n).cast("int")
    x = sentences.withColumn("_d", F.when(happens, pos))
    one = F.struct(F.col("_d").alias("pos"), F.get("tokens", F.col("_d")).alias("token"), F.when(F.col("_d") > 0, F.get("tokens", F.greatest(F.col("_d") - 1, F.lit(0)))).alias("left"), F.get("tokens", F.col("_d") + 1).alias("right"))
    kept = F.when(F.col("_d").isNull(), F.col("tokens")).otherwise(F.filter("tokens", lambda t, i: i != F.col("_d")))
    return x.withColumn("deletions", F.when(F.col("_d").isNull(), F.array().cast(DELETIONS)).otherwise(F.array(one).cast(DELETIONS))).withColumn("kept", kept).drop("_d")


def _without(rest: Column) -> Column:
    """A string with none, one or two of its characters left out."""
    n = F.length(rest)
    cut = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
    one = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: cut(rest, i))).otherwise(F.array().cast("array<string>"))
    # of each pair of places the later one goes first
    two = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: cut(cut(rest, j), i))))
    return F.array_distinct(F.concat(F.array(rest), one, F.when(n > 1, two).otherwise(F.array().cast("array<string>"))))


def _part(rest: Column, size: Column, k: int, shift: Column) -> Column:
    """Third k of a string of `size` characters, cut from rest `shift` places later; null where it would begin before rest."""
    first = F.floor(size * k / 3).cast("int")
    last = F.floor(size * (k + 1) / 3).cast("int")
    return F.when(first + shift >= 0, F.substring(rest, first + shift + 1, last - first))


def near_pairs(targets: DataFrame, words: DataFrame, max_dist: int = 2, deletions_up_to: int = 24) -> DataFrame:
    """(target, w): words of the same first character within max_dist (at most 2) edits of a target.

    Both meet on hashed keys. What follows the first character of a short word gives its strings with up to two characters
    left out: strings within two edits share one. A longer target gives its three thirds, of which two edits leave one as it
    is, at most two places away; a word gives what stands there for each length that a target may have.
    The keys are dealt out by a shuffle: the plan's estimate takes them for as few as the words, and Spark would collect
    them in the driver to send them out.
    """
    if max_dist > 2:
        raise ValueError("max_dist must be 2 or less")
    rest = lambda c: F.substring(c, 2, 1 << 30)
    split = lambda df, c: df.select(F.col(c), F.substring(c, 1, 1).alias("_f"), rest(F.col(c)).alias("_r")).withColumn("_n", F.length("_r"))
    t, w = split(targets.select("target").distinct(), "target"), split(words.select("w"), "w")
    deleted = lambda df, c, most: df.where(F.col("_n") <= most).select(c, F.explode(F.transform(_without(F.col("_r")), lambda x: F.xxhash64(F.col("_f"), x))).alias("_h")).hint("merge")
    short = deleted(t, "target", deletions_up_to).join(deleted(w, "w", deletions_up_to + 2), "_h").select("target", "w")
    thirds = t.where(F.col("_n") > deletions_up_to).select("target", F.explode(F.array(*(F.xxhash64(F.lit(k), "_f", "_n", _part(F.col("_r"), F.col("_n"), k, F.lit(0))) for k in range(3)))).alias("_h"))
    sizes = w.where(F.col("_n") > deletions_up_to - 2).withColumn("_m", F.explode(F.sequence(F.col("_n") - 2, F.col("_n") + 2))).where(F.col("_m") > deletions_up_to)
    shifted = sizes.withColumn("_d", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    parts = F.array(*(F.when((p := _part(F.col("_r"), F.col("_m"), k, F.col("_d"))).isNotNull(), F.xxhash64(F.lit(k), "_f", "_m", p)) for k in range(3)))
    long = thirds.join(shifted.select("w", F.explode(parts).alias("_h")).hint("merge"), "_h").select("target", "w")
    near = short.unionByName(long).where("w <> target").distinct()
    return near.where(F.substring("w", 1, 1) == F.substring("target", 1, 1)).where(levenshtein_limit(F.col("target"), F.col("w"), max_dist).isNotNull())


def words_before(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """asked (w, n) with before: how many words of the vocabulary have the first character of w, n characters, and come before w.

    Words are counted by their first character and length and by how they go on for three characters; only inside such a
    group are they put in order.
    """
    group = ["_f", "n", "_p"]
    keyed = lambda df: df.withColumn("_f", F.substring("w", 1, 1)).withColumn("_p", F.substring("w", 1, 4))
    words = keyed(vocab.select("w", F.length("w").alias("n")))
    wanted = keyed(asked.select("w", "n").distinct())
    counts = words.groupBy(*group).agg(F.count(F.lit(1)).alias("c"))
    ask = wanted.select(*group).distinct().withColumn("c", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    both = counts.withColumn("asked", F.lit(False)).unionByName(ask).groupBy(*group).agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))
    base = both.withColumn("base", F.sum("c").over(Window.partitionBy("_f", "n").orderBy("_p")) - F.col("c")).where("asked").select(*group, "base")
    rows = words.join(base.select(*group).hint("merge"), group, "left_semi").select(*group, "w", F.lit(1).alias("one")).unionByName(wanted.select(*group, "w", F.lit(0).alias("one")))
    inside = F.coalesce(F.sum("one").over(Window.partitionBy(*group).orderBy("w").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    # a word of the group itself is counted at its own place too
    ordered = rows.withColumn("upto", inside).withColumn("own", F.max("one").over(Window.partitionBy(*group, "w"))).where("one = 0")
    return ordered.join(base.hint("merge"), group).select("w", "n", (F.col("base") + F.col("upto") - F.col("own")).alias("before"))


def confusable(targets: DataFrame, vocab: DataFrame, seed: int, max_dist: int = 2, max_checks: int = 2000) -> DataFrame:
    """(target, choice): of each target's first max_checks candidates in vocabulary order (same first character, length within max_dist, not itself) one within max_dist edits, by hash; null if none.

    Near words come from an index of hashed parts. Whether one is among the first max_checks follows from counts of the words
    before it; those are not listed.
    """
    keep = Scratch(targets.sparkSession, "confusable")
    near = keep.write(near_pairs(targets, vocab, max_dist), "near")
    pairs = near.withColumn("n", F.explode(F.sequence(F.length("target") - max_dist, F.length("target") + max_dist)))
    before = pairs.join(words_before(pairs, vocab).hint("merge"), ["w", "n"]).groupBy("target", "w").agg(F.sum("before").alias("before"))
    in_vocab = vocab.select(F.col("w").alias("target"), F.lit(1).alias("_own"))
    place = F.col("before") - F.when(F.col("target") < F.col("w"), F.coalesce("_own", F.lit(0))).otherwise(0)
    first = before.join(in_vocab.hint("merge"), "target", "left").where(place < max_checks)
    best = first.groupBy("target").agg(F.min(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "target", "w")), "w")).alias("m")).select("target", F.col("m.w").alias("choice"))
    return targets.select("target").distinct().join(best, "target", "left")


def corrupt_corpus(sentences: DataFrame, vocab: DataFrame, p_delete: float = 0.15, p_substitute: float = 0.15, max_events: int = 2, prefer_confusable: bool = True, seed: int = 42) -> DataFrame:
    """(doc_id, sent_pos, tokens, tokens_corrupted, substitutions, deletions).

    At most one deletion, then at most one substitution (while events are left and three tokens) by a confusable word if
    preferred and there is one, else by the vocabulary word at a drawn rank, or the next one if that is the original.
    """
    x = with_deletions(sentences, p_delete, seed, max_events)
    n = F.size("tokens") - F.size("deletions")  # so that kept is not worked out where nothing happens
    left = F.lit(max_events) - F.size("deletions")
    happens = (F.size("tokens") >= 6) & (left > 0) & (n >= 3) & (_draw(seed, "substitute") < p_substitute)
    x = x.withColumn("_s", F.when(happens, F.floor(_draw(seed, "substitute_at") * n).cast("int")))
    size = vocab.agg(F.count(F.lit(1)).alias("_v"))
    events = x.where("_s is not null").crossJoin(F.broadcast(size)).where("_v > 0").select("doc_id", "sent_pos", F.get("kept", F.col("_s")).alias("orig"), "_v", F.floor(_draw(seed, "word") * F.col("_v")).alias("_r"))
    numbered = ranked(vocab.select("w"), "w", 0)
    events = events.join(numbered.select(F.col("rank").alias("_r"), F.col("w").alias("_w0")).hint("merge"), "_r")
    events = events.withColumn("_r2", (F.col("_r") + 1) % F.col("_v")).join(numbered.select(F.col("rank").alias("_r2"), F.col("w").alias("_w1")).hint("merge"), "_r2")
    new = F.when(F.col("_w0") == F.col("orig"), F.col("_w1")).otherwise(F.col("_w0"))
    if prefer_confusable:
        choice = confusable(events.select(F.col("orig").alias("target")), vocab, seed)
        events = events.join(choice.select(F.col("target").alias("orig"), "choice"), "orig", "left")
        new = F.coalesce("choice", new)
    events = events.select("doc_id", "sent_pos", new.alias("_new"))
    # only sentences in which a word is replaced are shuffled to it
    met = x.where("_s is not null").join(events, ["doc_id", "sent_pos"], "left")
    y = met.unionByName(x.where("_s is null").withColumn("_new", F.lit(None).cast("string")))
    subs = "array<struct<pos:int,orig:string,new:string>>"
    one = F.array(F.struct(F.col("_s").alias("pos"), F.get("kept", F.col("_s")).alias("orig"), F.col("_new").alias("new"))).cast(subs)
    changed = F.when(F.col("_new").isNull(), F.col("kept")).otherwise(F.transform("kept", lambda t, i: F.when(i == F.col("_s"), F.col("_new")).otherwise(t)))
    return y.select("doc_id", "sent_pos", "tokens", changed.alias("tokens_corrupted"), F.when(F.col("_new").isNull(), F.array().cast(subs)).otherwise(one).alias("substitutions"), "deletions")
