"""What queries need of the model, and no more: orders that are not counted, pairs and runs scored without the text."""

from unittest import mock

import pytest
from pyspark.sql import functions as F

from textsieve.operators import corrupt, lm, report
from textsieve.plans import catalog
from textsieve.sources.scratch import Scratch


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def s(spark):
    texts = ["a b a b c", "b a", "c", "a a a a", "d c b a b"]
    return spark.createDataFrame([(i, 0, t.split()) for i, t in enumerate(texts)], "doc_id long, sent_pos int, tokens array<string>")


def test_lower_orders_are_equal(spark, s):
    full, pairs, words = (lm.fit(s, order=k, keep=Scratch(spark, "t")).written(Scratch(spark, "t")) for k in (3, 2, 1))
    assert pairs.tri is None and words.bi is None and words.tri is None
    assert shown(full.uni.select("w", "c")) == shown(pairs.uni.select("w", "c")) == shown(words.uni.select("w", "c"))
    assert shown(full.bi.select("w1", "w", "c")) == shown(pairs.bi.select("w1", "w", "c"))
    assert shown(full.stats) == shown(pairs.stats) == shown(words.stats)
    with pytest.raises(ValueError):
        lm.fit(s, order=4)
    assert lm.fit(s.limit(0), order=1).uni.count() == lm.fit(s.limit(0), order=2).bi.count() == 0


def test_own_scores_are_equal(s):
    model = lm.fit(s)
    assert shown(lm.gap_scores(s, model, own=True)) == shown(lm.gap_scores(s, model))
    each = lm.token_surprisal(s, model, "forward").select("w", F.round("surprisal", 9).alias("v"))
    assert shown(each.distinct()) == shown(lm.own_run_scores(model).select("w", F.round("surprisal", 9).alias("v")).distinct())


@pytest.mark.parametrize("n", [1, 3, 100])
def test_best_rows_with_ties(spark, n):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "doc_id long, x int").withColumn("sent_pos", F.lit(0)).withColumn("idx", F.lit(0))
    scored = rows.select("x").distinct().withColumn("v", F.floor(F.col("x") / 2))
    found = report.among_best(rows, scored, ["x"], "v", n)
    assert shown(report.top_rows(found.select("doc_id", "v", "sent_pos", "idx"), "v", "idx", n)) == shown(report.top_rows(rows.join(scored, "x").select("doc_id", "v", "sent_pos", "idx"), "v", "idx", n))


@pytest.mark.parametrize("name, most", [("unigrams", 1), ("lm_stats", 1), ("top_vocab", 1), ("bigrams", 2), ("token_freq_len", 1), ("corrupt_deletions", 1), ("token_labels", 1), ("gap_scores", 2), ("bigram_neglogprob", 2), ("matched_scores", 2), ("suggest_insertions", 2)])
def test_queries_count_no_higher_order(spark, small, name, most):
    orders, plain = [], lm.fit
    with mock.patch.object(lm, "fit", lambda *a, **k: orders.append(k.get("order", 3)) or plain(*a, **k)):
        catalog.QUERIES[name](spark, small)
    assert orders == [most]


def test_few_places_move_few_trigrams(spark, small):
    """Trigrams are cut to the asked ones before they are counted."""
    s, model = catalog._corpus_of_pairs(spark, small)
    asked = model.tri.join(F.broadcast(spark.createDataFrame([("a", "b")], "w2 string, w1 string")), ["w2", "w1"], "left_semi")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_keys_of_near_words_are_not_sent_out(spark, tmp_path):
    """A small written table of words has many keys, which the plan's estimate does not know."""
    spark.createDataFrame([(f"w{i:05d}",) for i in range(500)], "w string").write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w"))
    near = corrupt.near_pairs(words.select(F.col("w").alias("target")), words)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
