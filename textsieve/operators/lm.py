"""Interpolated trigram model as count tables, and scores of tokens and gaps.

Raw text is aggregated once, to n-grams of the highest order that is asked for; lower orders are sums of these. Trigrams are
nearly as many as tokens, so what needs only words or pairs does not count them. The model of reversed text follows
from the same tables, so no second pass is made: what precedes in it is what comes after here, and the padding changes
sides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.sources.scratch import Scratch

BOS, EOS = "<s>", "</s>"
FREQUENT = 1 << 18  # words that may be sent to all tasks


@dataclass(frozen=True)
class LmParams:
    alpha: float = 0.1
    lambdas: tuple[float, float, float] = (0.6, 0.3, 0.1)  # of trigram, bigram, unigram
    order: int = 3

    def __post_init__(self):
        if self.order != 3:
            raise ValueError("order must be 3")
        if abs(sum(self.lambdas) - 1) > 1e-6:
            raise ValueError("lambdas must sum to 1")


@dataclass
class NgramModel:
    """uni (w, c), bi (w1, w, c), tri (w2, w1, w, c) and one row of stats (n_total, v_size, n_sent); no tables above the order that was counted."""

    params: LmParams = field(default_factory=LmParams)
    uni: DataFrame | None = None
    bi: DataFrame | None = None
    tri: DataFrame | None = None
    stats: DataFrame | None = None

    def require_fit(self) -> None:
        if self.uni is None:
            raise RuntimeError("the model is not fitted")

    @property
    def vocab(self) -> DataFrame:
        self.require_fit()
        return self.uni.select("w")

    @property
    def vocab_full(self) -> DataFrame:
        """Words without the padding markers."""
        return self.vocab.where(~F.col("w").isin(BOS, EOS))

    def written(self, keep: Scratch) -> NgramModel:
        """The same model with all its tables written; that of the highest order must be one already.

        Lookups read them as they are: no table is summed again, and small ones are sent out after a check of their size.
        """
        self.require_fit()
        bi = keep.write(self.bi, "bigrams") if self.tri is not None else self.bi
        uni = keep.write(self.uni, "unigrams") if self.bi is not None else self.uni
        return NgramModel(self.params, uni, bi, self.tri, keep.write(statistics(uni), "stats"))

    def save(self, path: str) -> None:
        self.require_fit()
        for name in ("uni", "bi", "tri", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, params: LmParams | None = None) -> NgramModel:
        return cls(params or LmParams(), *(spark.read.parquet(f"{path}/{name}") for name in ("uni", "bi", "tri", "stats")))


def padded(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BOS), F.lit(BOS)), tokens, F.array(F.lit(EOS)))


def fit(sentences: DataFrame, params: LmParams | None = None, keep: Scratch | None = None, order: int = 3) -> NgramModel:
    """The count tables up to `order`. With keep, the highest is written there, so that no table that follows from it counts the text again."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    kept = lambda table, tag: keep.write(table, tag) if keep else table
    if order < 3:
        p = sentences.select(padded(F.col("tokens")).alias("t"))
    if order == 1:
        uni = kept(p.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")), "unigrams")
        return NgramModel(params or LmParams(), uni, stats=statistics(uni))
    if order == 2:
        pairs = p.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("t")), lambda i: F.struct(F.element_at("t", i - 1).alias("w1"), F.element_at("t", i).alias("w")))).alias("g"))
        bi = kept(pairs.groupBy("g.w1", "g.w").agg(F.count(F.lit(1)).alias("c")), "bigrams")
        # every unigram but the first padding is the end of one bigram
        uni = bi.groupBy("w").agg(F.sum("c").alias("c")).withColumn("c", F.when(F.col("w") == BOS, 2 * F.col("c")).otherwise(F.col("c")))
        return NgramModel(params or LmParams(), uni, bi, stats=statistics(uni))
    tri = kept(trigrams(sentences), "trigrams")
    # every bigram but the padding's own is the end of one trigram; every unigram but the first padding of one bigram
    first = (F.col("w2") == BOS) & (F.col("w1") == BOS)
    both = lambda own, padding: tri.select(F.inline(F.when(first, F.array(own, padding)).otherwise(F.array(own))))
    pair = lambda x, y: F.struct(F.col(x).alias("w1"), F.col(y).alias("w"), F.col("c").alias("c"))
    bi = both(pair("w1", "w"), pair("w2", "w1")).groupBy("w1", "w").agg(F.sum("c").alias("c"))
    uni = both(F.struct("w", "c"), F.struct(F.lit(BOS).alias("w"), (2 * F.col("c")).alias("c"))).groupBy("w").agg(F.sum("c").alias("c"))
    return NgramModel(params or LmParams(), uni, bi, tri, statistics(uni))


def trigrams(sentences: DataFrame) -> DataFrame:
    """(w2, w1, w, c) of the padded text. Where a semi-join with few words follows, which are sent out, Spark counts only what that leaves."""
    p = sentences.select(padded(F.col("tokens")).alias("t"))
    each = p.select(F.explode(F.transform(F.sequence(F.lit(3), F.size("t")), lambda i: F.struct(F.element_at("t", i - 2).alias("w2"), F.element_at("t", i - 1).alias("w1"), F.element_at("t", i).alias("w")))).alias("g"))
    return each.select("g.*").groupBy("w2", "w1", "w").agg(F.count(F.lit(1)).alias("c"))


def statistics(uni: DataFrame) -> DataFrame:
    return uni.agg(F.sum("c").alias("n_total"), F.count(F.lit(1)).alias("v_size"), F.sum(F.when(F.col("w") == EOS, F.col("c"))).alias("n_sent"))


def contexts(sentences: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, idx, x, y, z): all runs of three of the padded sentence and a null behind it, so that the word idx is the z of
    run idx, after its two words to the left, and the x of run idx + 2, before its two words to the right."""
    t = F.col("t")
    row = F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.struct((i - 1).alias("idx"), F.element_at(t, i).alias("x"), F.element_at(t, i + 1).alias("y"), F.element_at(t, i + 2).alias("z")))
    p = sentences.select(*keys, F.concat(padded(F.col("tokens")), F.array(F.lit(None).cast("string"))).alias("t"))
    return p.select(*keys, F.explode(row).alias("_x")).select(*keys, "_x.*")


def _interpolated(params: LmParams, p3: Column, p2: Column, p1: Column) -> Column:
    a, b, c = params.lambdas
    return a * p3 + b * p2 + c * p1


def count_of(df: DataFrame, table: DataFrame, name: str, **on: str) -> DataFrame:
    """Left join of a count table; unseen n-grams count 0. on: table column = df column."""
    t = table.select(*(F.col(k).alias(v) for k, v in on.items()), F.col("c").alias(name))
    return df.join(t, list(on.values()), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def run_probabilities(runs: DataFrame, model: NgramModel, direction: str = "both") -> DataFrame:
    """Adds pf, the probability of z after x and y, and pb, that of x before y and z in reversed text, to distinct rows (x, y, z).

    Rows that have their count _t are not looked up again. Both come from the same counts, as reversed text has the same runs; at a sentence's end y is the end marker and z null. Of
    "forward" or "backward" alone the other one is null.
    """
    model.require_fit()
    a = model.params.alpha
    r = runs if "_t" in runs.columns else count_of(runs, model.tri, "_t", w2="x", w1="y", w="z")
    r = count_of(count_of(r, model.bi, "_xy", w1="x", w="y"), model.bi, "_yz", w1="y", w="z")
    for column in [c for c, unused in (("x", "forward"), ("y", ""), ("z", "backward")) if unused != direction]:
        r = with_counts(r.withColumn("w", F.col(column)), model.uni).withColumnRenamed("c", f"_{column}").drop("w")
    r = r.crossJoin(F.broadcast(model.stats))
    last, av = F.col("y") == EOS, a * F.col("v_size")
    low = lambda u: (F.col(u) + a) / (F.col("n_total") + av)
    ahead = _interpolated(model.params, (F.col("_t") + a) / (F.col("_xy") + av), (F.col("_yz") + a) / (F.col("_y") + av), low("_z"))
    t, b2, u1 = F.when(last, F.col("_xy")).otherwise(F.col("_t")), F.when(last, F.col("n_sent")).otherwise(F.col("_yz")), F.when(last, 2 * F.col("n_sent")).otherwise(F.col("_y"))
    back = _interpolated(model.params, (t + a) / (b2 + av), (F.col("_xy") + a) / (u1 + av), low("_x"))
    none = F.lit(None).cast("double")
    return r.select("x", "y", "z", (none if direction == "backward" else ahead).alias("pf"), (none if direction == "forward" else back).alias("pb"))


def frequent_words(uni: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """The most frequent words, all counts from a least one on and at most `most` words, which may be sent to all tasks, and the others."""
    each = uni.groupBy("c").agg(F.count(F.lit(1)).alias("m")).select("c", F.sum("m").over(Window.orderBy(F.col("c").desc())).alias("m"))
    least = each.where(F.col("m") <= most).agg(F.min("c")).first()[0]
    return (uni.where(F.col("c") >= least), uni.where(F.col("c") < least)) if least is not None else (uni.where("false"), uni)


def rare_counts(tokens: DataFrame, top: DataFrame, rest: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, c) of tokens (keys, idx, w) outside top, found among the rest; only these are shuffled."""
    return tokens.join(F.broadcast(top.select("w")), "w", "left_anti").join(rest.select("w", "c"), "w").select(*keys, "idx", "c")


def with_counts(tokens: DataFrame, uni: DataFrame, most: int = FREQUENT) -> DataFrame:
    """tokens (w, ...) with c, how often the word is in uni, 0 if never. Only tokens of less frequent words are shuffled."""
    top, rest = frequent_words(uni, most)
    sent = F.broadcast(top.select("w", "c"))
    if rest.isEmpty():
        return tokens.join(sent, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    few = tokens.join(F.broadcast(top.select("w")), "w", "left_anti").join(rest.select("w", "c"), "w", "left")
    return tokens.join(sent, "w").unionByName(few.withColumn("c", F.coalesce("c", F.lit(0))))


def _run_counts(sentences: DataFrame, model: NgramModel, own: bool, most: int, keep: Scratch) -> DataFrame:
    """Rows of sentences (_s, ...) with us, the counts of the tokens and of the end, and runs, (p, c3, c2) of each run of three of contexts():
    how often it and its first two words stand in the model's text.

    Words go as short codes: frequent ones by their number, others by 63 bits of a hash. Runs are dealt out by their first
    two words (that of the padding alone by the third), so one shuffle finds both counts; the counts come back by sentence.
    What is shuffled lies in few numbers: the sentence and the place in one, two frequent words in one.
    """
    top, rest = frequent_words(model.uni, most)
    codes = keep.write(top.select("w", "c", F.row_number().over(Window.orderBy(F.col("c").desc(), "w")).cast("long").alias("k")), "codes")
    bits = int(sentences.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0] + 2).bit_length()
    hashed = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.xxhash64(c).bitwiseOR(F.lit(-1 << 63)))

    def coded(rows: DataFrame) -> DataFrame:
        """(p, a, b, z) and the rest: a and b stand for the first two words, b is 0 where a holds both and -1 for the padding."""
        for c in "xyz":
            rows = rows.join(F.broadcast(codes.select(F.col("w").alias(c), F.col("k").alias(f"_k{c}"))), c, "left")
        x, y, z = (F.coalesce(f"_k{c}", hashed(c)) for c in "xyz")
        pad, both = (F.col("x") == BOS) & (F.col("y") == BOS), F.col("_kx").isNotNull() & F.col("_ky").isNotNull()
        first = F.when(pad, z).when(both, F.shiftleft(x, 31) + y).otherwise(x)
        return rows.select("p", *(["n"] if "n" in rows.columns else []), first.alias("a"), F.when(pad, -1).when(both, 0).otherwise(y).alias("b"), z.alias("z"))

    n = F.lit(1)
    rows = contexts(sentences, "_s").select((F.shiftleft("_s", bits) + F.col("idx")).alias("p"), "x", "y", "z")
    rows = coded(rows if own else rows.withColumn("n", F.lit(0).cast("long")))
    if not own:  # the end's own bigrams are the start of no trigram
        n = F.col("n")
        ends = model.bi.where(F.col("w") == EOS).select(F.col("w1").alias("x"), F.col("w").alias("y"), F.lit(None).cast("string").alias("z"), "c")
        counts = model.tri.select(F.col("w2").alias("x"), F.col("w1").alias("y"), F.col("w").alias("z"), "c").unionByName(ends)
        rows = rows.unionByName(coded(counts.select(F.lit(None).cast("long").alias("p"), "x", "y", "z", F.col("c").alias("n"))))
    c3 = rows.repartition("a", "b").withColumn("c3", F.sum(n).over(Window.partitionBy("a", "b", "z")))
    # naming c3 here keeps the order of both windows, so that one sort does
    c2 = c3.withColumn("c2", F.sum(F.when(F.col("c3") >= 0, n)).over(Window.partitionBy("a", "b")))
    # a frequent word's count follows from its number
    met = c2.where(F.col("p").isNotNull()).join(F.broadcast(codes.select(F.col("k").alias("z"), F.col("c").alias("u"))), "z", "left")
    s = F.shiftright("p", bits)
    met = keep.write(met.select("p", "c3", "c2", "u"), "met")  # so that the first shuffle is gone before the second one
    found = met.repartition(s).groupBy(s.alias("_s")).agg(F.sort_array(F.collect_list(F.struct("p", "c3", "c2", "u"))).alias("runs"))
    # a text takes half as many bytes as an array of words
    text = sentences.withColumn("tokens", F.array_join("tokens", "\0")).join(found, "_s")
    out = text.withColumn("tokens", F.when(F.col("tokens") == "", F.array().cast("array<string>")).otherwise(F.split("tokens", "\0")))
    rare = F.lit(None).cast("map<int,bigint>")
    if not rest.isEmpty():
        each = rare_counts(sentences.select("_s", F.posexplode("tokens").alias("idx", "w")), top, rest, "_s")
        out = out.join(each.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("idx", "c"))).alias("_rare")), "_s", "left")
        rare = F.col("_rare")
    return out.withColumn("us", F.transform("runs", lambda r, i: F.coalesce(r["u"], rare[i], F.lit(0))))


def numbered(sentences: DataFrame, keep: Scratch) -> DataFrame:
    """Sentences with a number _s. Those without one are written with it, so that every step sees the same numbers."""
    return sentences if "_s" in sentences.columns else keep.write(sentences.withColumn("_s", F.monotonically_increasing_id()), "numbered")


def scored_sentences(sentences: DataFrame, model: NgramModel, direction: str = "both", keys: tuple[str, ...] = ("doc_id", "sent_pos"), own: bool = False, most: int = FREQUENT) -> DataFrame:
    """(_s, keys, tokens, scored): a row a sentence, with (idx, w, c, surprisal) of each token, c its count."""
    model.require_fit()
    keep = Scratch(sentences.sparkSession, "surprisal")
    met = _run_counts(numbered(sentences, keep).select("_s", *keys, "tokens"), model, own, most, keep).crossJoin(F.broadcast(model.stats))
    a = model.params.alpha
    av, n_sent = a * F.col("v_size"), F.col("n_sent")
    run = lambda i: F.element_at("runs", i + 1)
    u = lambda i: F.element_at("us", i + 1)
    low = lambda c: (c + a) / (F.col("n_total") + av)

    def ahead(i: Column) -> Column:
        pair = F.when(i == 0, n_sent).otherwise(run(i)["c2"])
        before = F.when(i == 0, 2 * n_sent).otherwise(F.element_at("us", F.greatest(i, F.lit(1))))
        return _interpolated(model.params, (run(i)["c3"] + a) / (pair + av), (run(i + 1)["c2"] + a) / (before + av), low(u(i)))

    def back(i: Column) -> Column:
        last, pair = i == F.size("tokens") - 1, run(i + 2)["c2"]
        t = F.when(last, pair).otherwise(run(i + 2)["c3"])
        b2 = F.when(last, n_sent).otherwise(F.element_at("runs", F.least(i + 4, F.size("runs")))["c2"])
        u1 = F.when(last, 2 * n_sent).otherwise(u(i + 1))
        return _interpolated(model.params, (t + a) / (b2 + av), (pair + a) / (u1 + av), low(u(i)))

    surprisal = {"forward": lambda i: -F.log(ahead(i)), "backward": lambda i: -F.log(back(i))}
    both = lambda i: (surprisal["forward"](i) + surprisal["backward"](i)) / 2
    each = F.transform("tokens", lambda w, i: F.struct(i.alias("idx"), w.alias("w"), u(i).alias("c"), surprisal.get(direction, both)(i).alias("surprisal")))
    return met.select("_s", *keys, "tokens", each.alias("scored"))


def token_surprisal(sentences: DataFrame, model: NgramModel, direction: str = "both", keys: tuple[str, ...] = ("doc_id", "sent_pos"), own: bool = False, most: int = FREQUENT) -> DataFrame:
    """(keys, idx, w, surprisal): -log p of each token, forward, backward, or the mean of both.

    All counts that a sentence asks for come back to it, and both directions follow from the same ones. own: the sentences
    are those of the model, so they count themselves and of its tables only words are read. most: words sent to all tasks.
    """
    rows = scored_sentences(sentences, model, direction, keys, own, most).select(*keys, F.explode("scored").alias("_x"))
    return rows.select(*keys, "_x.idx", "_x.w", "_x.surprisal")


def gaps(sentences: DataFrame, *keys: str, **each: Column) -> DataFrame:
    """One row per pair of adjacent tokens: gap_idx, left, right, and by name what arrays hold at its place."""
    t = F.col("tokens")
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct((i - 1).alias("gap_idx"), F.element_at(t, i).alias("left"), F.element_at(t, i + 1).alias("right"), *(F.get(x, i - 1).alias(name) for name, x in each.items())))
    return sentences.where(F.size(t) > 1).select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.*")


def gap_scores(sentences: DataFrame, model: NgramModel, keys: tuple[str, ...] = ("doc_id", "sent_pos"), own: bool = False, most: int = FREQUENT) -> DataFrame:
    """(keys, gap_idx, left, right, gap_score): the mean of -log P(right | left) and -log P(left | right) in reversed text.

    For real words that is (ln(U(l) + aV) + ln(U(r) + aV)) / 2 - ln(B(l, r) + a); distinct pairs are scored once. own: the
    sentences are those of the model, so its bigrams are the distinct pairs and the text is not searched for them. Two of the
    `most` most frequent words go to their score and come back as one number.
    """
    model.require_fit()
    keep = Scratch(sentences.sparkSession, "gaps")
    rows = gaps(sentences, *keys)
    scored = own_pair_scores(model) if own else _pair_scores(count_of(rows.select("left", "right").distinct(), model.bi, "_b", w1="left", w="right"), model)
    top = frequent_words(model.uni, most)[0]
    codes = keep.write(top.select("w", F.row_number().over(Window.orderBy(F.col("c").desc(), "w")).cast("long").alias("k")), "codes")

    def coded(pairs: DataFrame, *others: str) -> DataFrame:
        for side in ("left", "right"):
            pairs = pairs.join(F.broadcast(codes.select(F.col("w").alias(side), F.col("k").alias(f"_{side}"))), side, "left")
        both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
        text = (F.when(both, "").otherwise(F.col(side)).alias(side) for side in ("left", "right"))
        return pairs.select(*others, F.when(both, F.shiftleft("_left", 31) + F.col("_right")).otherwise(0).alias("_g"), *text)

    found = coded(rows, *keys, "gap_idx").join(coded(scored, "gap_score").hint("merge"), ["_g", "left", "right"])
    for side, code in (("left", F.shiftright("_g", 31)), ("right", F.col("_g").bitwiseAND(F.lit((1 << 31) - 1)))):
        found = found.withColumn("_k", code).join(F.broadcast(codes.select(F.col("k").alias("_k"), F.col("w").alias("_w"))), "_k", "left")
        found = found.withColumn(side, F.coalesce("_w", side)).drop("_k", "_w")
    return found.select(*keys, "gap_idx", "left", "right", "gap_score")


def labelled_gap_scores(sentences: DataFrame, labels: Column, model: NgramModel) -> DataFrame:
    """(gap_score, label), unrounded, of all gaps of sentences whose array of labels holds one for them. Equal pairs are counted and shuffled as one."""
    model.require_fit()
    one = F.col("label") == 1
    rows = gaps(sentences, label=labels).where("label is not null").groupBy("left", "right").agg(F.count(F.when(~one, 1)).alias("_0"), F.count(F.when(one, 1)).alias("_1"))
    scored = _pair_scores(count_of(rows, model.bi, "_b", w1="left", w="right"), model, "_0", "_1")
    both = F.concat(*(F.array_repeat(F.lit(k), F.col(f"_{k}").cast("int")) for k in (0, 1)))
    return scored.select("gap_score", F.explode(both).alias("label"))


def _pair_scores(pairs: DataFrame, model: NgramModel, *others: str) -> DataFrame:
    """(left, right, others, gap_score) of pairs with their count _b. Only pairs with a less frequent word are shuffled to it."""
    a = model.params.alpha
    for side in ("left", "right"):
        counted = with_counts(pairs.withColumn("w", F.col(side)), model.uni)
        pairs = counted.withColumn(f"_{side}", F.col("c")).drop("w", "c")
    av = a * F.col("v_size")
    score = (F.log(F.col("_left") + av) + F.log(F.col("_right") + av)) / 2 - F.log(F.col("_b") + a)
    return pairs.crossJoin(F.broadcast(model.stats)).select("left", "right", *others, score.alias("gap_score"))


def own_pair_scores(model: NgramModel) -> DataFrame:
    """(left, right, gap_score) of all pairs of adjacent tokens in the text that the model was fitted on."""
    model.require_fit()
    pairs = model.bi.where((F.col("w1") != BOS) & (F.col("w") != EOS))
    return _pair_scores(pairs.select(F.col("w1").alias("left"), F.col("w").alias("right"), F.col("c").alias("_b")), model)


def best_pair_scores(sentences: DataFrame, model: NgramModel, top_n: int, digits: int = 6, few: int = 1 << 10, most: int = FREQUENT) -> DataFrame:
    """(left, right, gap_score), rounded, of the pairs of adjacent tokens with the top_n highest scores, equal ones included.

    The sentences are those of the model, of which only words are read. The pairs of the `few` most frequent words are
    counted first; the least of their top_n best scores bounds all others. A pair's score is at most what it would be if
    it stood once, so pairs are counted only where that reaches the bound. If over `most` words reach it, all pairs are.
    """
    model.require_fit()
    keep, a = Scratch(sentences.sparkSession, "pairs"), model.params.alpha
    each = gaps(sentences).select("left", "right")
    uni = model.uni.where(~F.col("w").isin(BOS, EOS))
    rounded = lambda pairs: _pair_scores(pairs, model).withColumn("gap_score", F.round("gap_score", digits) + 0.0)
    best = lambda scored: scored.orderBy(F.col("gap_score").desc()).limit(top_n)
    counted = lambda pairs: pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("_b"))

    def among(words: DataFrame) -> DataFrame:
        """The pairs of two of these words, which are sent out, with their counts l and r."""
        x = each.join(F.broadcast(words.select(F.col("w").alias("left"), F.col("c").alias("l"))), "left")
        return x.join(F.broadcast(words.select(F.col("w").alias("right"), F.col("c").alias("r"))), "right")

    known = keep.write(frequent_words(uni, few)[0], "few")
    least = best(rounded(counted(among(known)))).agg(F.min("gap_score"), F.count(F.lit(1))).first()
    v, highest = model.stats.first()["v_size"], uni.agg(F.max("c")).first()[0]
    pairs = None
    if least[1] == top_n:
        # (l + av) (r + av) of a pair that stands once and reaches the bound, a little less for what rounding changes
        product = ((1 + a) * math.exp(least[0] - 2 * 10.0**-digits)) ** 2
        words = uni.where(F.col("c") >= product / (highest + a * v) - a * v)
        if words.count() <= most:
            pairs = among(words).where((F.col("l") + a * v) * (F.col("r") + a * v) >= product)
    scored = keep.write(rounded(counted(each if pairs is None else pairs)), "scored")
    return scored.join(F.broadcast(best(scored).agg(F.min("gap_score").alias("_least"))), F.col("gap_score") >= F.col("_least")).drop("_least")


def own_run_scores(model: NgramModel) -> DataFrame:
    """(x, y, w, surprisal) of all runs of two words or paddings and a token in the text that the model was fitted on, forward."""
    runs = model.tri.where(F.col("w") != EOS).select(F.col("w2").alias("x"), F.col("w1").alias("y"), F.col("w").alias("z"), F.col("c").alias("_t"))
    scored = run_probabilities(runs, model, "forward")
    return scored.select("x", "y", F.col("z").alias("w"), (-F.log("pf")).alias("surprisal"))


def bigram_neglogprob(pairs: DataFrame, model: NgramModel) -> DataFrame:
    """Adds neglogprob, -log P(right | left) without interpolation, to rows (left, right)."""
    model.require_fit()
    a = model.params.alpha
    x = count_of(count_of(pairs, model.bi, "_b", w1="left", w="right"), model.uni, "_l", w="left").crossJoin(F.broadcast(model.stats))
    return x.select(*pairs.columns, (-F.log((F.col("_b") + a) / (F.col("_l") + a * F.col("v_size")))).alias("neglogprob"))


def top_frequent_vocab(model: NgramModel, top_n: int = 5000) -> DataFrame:
    """(w, c) of the top_n most frequent words, equal counts by word descending."""
    model.require_fit()
    return model.uni.where(~F.col("w").isin(BOS, EOS)).orderBy(F.col("c").desc(), F.col("w").desc()).limit(top_n)
