"""What steps leave on disk and what they shuffle: less than before, with the same rows."""

import math
import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from textsieve.operators import features, lm, skipgram, suggest
from textsieve.sources.scratch import SHUFFLES_GO, Scratch

from .test_models import plain_suggestions


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO)
    table = Scratch(spark, "t").write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(3, "n"), "rows")
    assert not shuffle_files(spark) - before
    assert sorted((r["k"], r["n"]) for r in table.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(SHUFFLES_GO) == setting


@pytest.mark.parametrize("per_block", [2, 7, 1000])
def test_places_in_blocks_share_lists(spark, per_block):
    """The lists of a word go to a block once, however many of its places name it; any blocks give the same rows."""
    rng = random.Random(5)
    s = spark.createDataFrame([(i, 0, [f"w{int(12 * rng.random() ** 2):02}" for _ in range(rng.randrange(2, 9))]) for i in range(80)], "doc_id long, sent_pos int, tokens array<string>")
    keep = Scratch(spark, "t")
    model = lm.fit(s, keep=keep).written(keep)
    words = lm.top_frequent_vocab(model, 9)
    targets = keep.write(suggest.replacement_targets(s.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("idx"))).select("doc_id", "idx", *suggest.PLACE, "current"), "targets")
    uni, bi, tri, st = {r["w"]: r["c"] for r in model.uni.collect()}, {(r["w1"], r["w"]): r["c"] for r in model.bi.collect()}, {(r["w2"], r["w1"], r["w"]): r["c"] for r in model.tri.collect()}, model.stats.first()
    candidates, got = [x["w"] for x in words.collect()], {}
    for doc, idx, rank, word, score in sorted(map(tuple, suggest.suggest(targets, ["doc_id", "idx"], model, words, per_block=per_block).collect())):
        got.setdefault((doc, idx), []).append((score, word))
        assert rank == len(got[doc, idx])
    for r in targets.collect():
        assert got[r["doc_id"], r["idx"]] == plain_suggestions((uni, bi, tri, st), candidates, (r["l2"], r["l1"], r["r1"]), r["current"], 5)
    places = suggest._in_blocks(targets.select(*suggest.PLACE).distinct(), per_block)
    numbered = words.select(F.col("w").alias("candidate"), (F.row_number().over(suggest.Window.orderBy("w")) - 1).alias("hi"))
    lists = suggest._block_lists(keep.write(places, "places"), numbered, model, keep)
    once = sum(places.select("block", *on).distinct().count() for on in (["l1"], ["r1"], ["l2", "l1"], ["l1", "r1"]))
    assert lists.count() == lists.select("block", "key").distinct().count() <= once
    assert places.groupBy("block").count().agg(F.max("count")).first()[0] <= 6 * per_block


@pytest.mark.parametrize("most", [0, 4, 100])
def test_pairs_are_counted_once_for_both_directions(spark, most):
    rng = random.Random(most)
    s = spark.createDataFrame([(i, 0, [f"w{int(9 * rng.random() ** 2)}" for _ in range(rng.choice([0, 1, 2, 7, 12]))]) for i in range(60)], "doc_id long, sent_pos int, tokens array<string>")
    codes, pairs = skipgram.coded_pairs(s, 3, Scratch(spark, "t"), most)
    word = {r["code"]: r["w"] for r in codes.collect()}
    rows = [(word[r["a"]], word[r["b"]], r["n"]) for r in pairs.collect()]
    want = {(r["w"], r["x"]): r["n"] for r in skipgram.context_pairs(s, 3).collect()}
    assert len(rows) == len({frozenset((a, b)) for a, b, _ in rows}) < len(want)
    assert {(a, b): n for a, b, n in rows} | {(b, a): n for a, b, n in rows} == want


def test_vectors_do_not_depend_on_what_shares_a_task(spark):
    rng = random.Random(2)
    s = spark.createDataFrame([(i, 0, [f"{'ab'[i % 2]}w{int(30 * rng.random() ** 2)}" for _ in range(10)]) for i in range(80)], "doc_id long, sent_pos int, tokens array<string>")
    p = skipgram.SkipGramParams(dim=4, epochs=2, bucket=50, least_blocks=12, pairs_per_block=200)
    want = None
    for cores, most in ((16, 1000), (1, 1000), (1, 7)):
        # 2 x cores tasks at least; words beyond `most` go by their hash
        with mock.patch.object(type(spark.sparkContext), "defaultParallelism", cores), mock.patch.object(skipgram, "PER_TASK", 5):
            found = skipgram.train_skipgram(s, p, most)
        rows = {r["w"]: r["vec"] for r in found.vectors.collect()}
        if most == 1000:
            want = want or (rows, found.losses)
            assert (rows, found.losses) == want
        assert rows.keys() == want[0].keys()


def noisy(spark, ids):
    rng = random.Random(4)
    texts = [[f"w{int(9 * rng.random() ** 2)}" for _ in range(rng.choice([0, 1, 2, 7, 12]))] for _ in ids]
    d = lambda t: [(2, t[2], t[1], t[3])] if len(t) > 5 and t[0] < "w3" else []
    rows = [(k, i % 2, t, [x for j, x in enumerate(t) if not d(t) or j != 2], d(t)) for i, (k, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, sent_pos int, tokens array<string>, tokens_corrupted array<string>, deletions array<struct<pos:int,token:string,left:string,right:string>>")


@pytest.mark.parametrize("ids", [range(90), [*range(40), *range(40), *[None] * 4]])
@pytest.mark.parametrize("shown", ["tokens", "tokens_corrupted"])
def test_labels_stay_with_their_gaps(spark, ids, shown):
    keep = Scratch(spark, "t")
    c = keep.write(noisy(spark, ids), "c")
    model = lm.fit(c.select("doc_id", "sent_pos", "tokens"), keep=keep, order=2).written(keep)
    got = features.matched_gap_scores(c, model, shown)
    scores = lm.gap_scores(c.select("doc_id", "sent_pos", F.col(shown).alias("tokens")), model).withColumn("gap_score", F.round("gap_score", 6) + 0.0)
    want = features.matched_scores(scores, features.gap_labels(c), ["doc_id", "sent_pos", "gap_idx"], "gap_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("label = 1").count()
    joined = "sent_pos" in got._jdf.queryExecution().executedPlan().toString()
    assert joined == (None in ids)  # only ids that repeat take the join


@pytest.mark.parametrize("most", [0, 4, 100])
def test_gap_scores_by_any_way(spark, most):
    keep = Scratch(spark, "t")
    s = keep.write(noisy(spark, range(60)).select("doc_id", "sent_pos", "tokens"), "s")
    model = lm.fit(s, keep=keep, order=2).written(keep)
    uni, bi, st = {r["w"]: r["c"] for r in model.uni.collect()}, {(r["w1"], r["w"]): r["c"] for r in model.bi.collect()}, model.stats.first()
    av = 0.1 * st["v_size"]
    score = lambda x, y: (math.log(uni[x] + av) + math.log(uni[y] + av)) / 2 - math.log(bi[x, y] + 0.1)
    want = sorted((r["doc_id"], r["sent_pos"], i, x, y, round(score(x, y), 9)) for r in s.collect() for i, (x, y) in enumerate(zip(r["tokens"], r["tokens"][1:], strict=False)))
    for own in (True, False):
        got = lm.gap_scores(s, model, own=own, most=most).collect()
        assert sorted((*r[:5], round(r[5], 9)) for r in got) == want


def test_runs_meet_word_counts_without_a_shuffle(spark):
    keep = Scratch(spark, "t")
    s = lm.numbered(noisy(spark, range(60)).select("doc_id", "sent_pos", "tokens"), keep)
    model = lm.fit(s, keep=keep).written(keep)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    shown = plan(lm.own_run_scores(model))
    # all words are frequent, so that their counts are sent out
    assert shown.count("strategy=broadcast") >= 3 and sorted(map(tuple, lm.own_run_scores(model).select("x", "y", "w").collect())) == sorted((r["w2"], r["w1"], r["w"]) for r in model.tri.where("w <> '</s>'").collect())
    # what counts the runs of sentences is written before they go back
    assert "Window" not in plan(lm.scored_sentences(s, model, own=True))
