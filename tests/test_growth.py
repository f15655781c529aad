"""Steps whose time or shuffled bytes decide whether a query fits larger tables: same rows as the plain way, and the plan that makes them cheap."""

import random

import pytest
from pyspark.sql import functions as F

from textsieve.functions import text
from textsieve.operators import corrupt, features, lm
from textsieve.operators.sentences import text_to_sentences
from textsieve.sources.scratch import Scratch

PIECES = ["a", "Bc", "ж", "Ꙋ", "б҃г", "҃", "ⷠ", "7", "x9", "é", "ß", "K", "İ", "😀", "­", " ", "﻿", " ", "\x00", "\t", " ", " ", " ", "\n", "\n\n\n\n", "\r", ".", "!?", ";", ":", "·", "1:23", "38.9a", "<b>", "<", ">", "|", "—", "“", "»", '"', "-", "_", "'"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("tags", "verses", "numeric"), [(True, True, True), (False, False, False), (True, False, True)])
def test_tokens_of_whole_texts(spark, tags, verses, numeric):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.randrange(40)))) for i in range(3000)] + [(3000, None), (3001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = F.split(text.normalize_raw(F.col("text"), tags, verses), text.SENTENCE_ENDS)
    want = docs.select(F.transform(parts, lambda p: text.tokenize(p, drop_numeric=numeric)).alias("t"))
    got = docs.select(text.sentence_tokens(F.col("text"), drop_tags=tags, drop_verse_refs=verses, drop_numeric=numeric).alias("t"))
    assert got.collect() == want.collect()
    assert "regexp_extract_all" not in plan(text_to_sentences(docs))  # tries the class at every character


def test_labels_and_corruption_move_few_rows(spark):
    rows = [(i % 200 if i else None, i // 200, [f"w{(i * k) % 17}" for k in range(1, 9)]) for i in range(800)]
    keep = Scratch(spark, "t")
    s = keep.write(spark.createDataFrame(rows, "doc_id long, sent_pos int, tokens array<string>"), "s")
    vocab = s.select(F.explode("tokens").alias("w")).distinct()
    found = corrupt.corrupt_corpus(s, vocab, 0.5, 0.5, 2, False, 8)
    assert "Union" in plan(found)  # sentences that stay as they are pass by
    c = keep.write(found, "c")
    assert c.count() == 800 and 0 < c.where(F.size("substitutions") > 0).count() < 800
    assert c.where("size(substitutions) = 0 and size(deletions) = 0 and tokens <> tokens_corrupted").count() == 0
    labels = features.gap_labels(c)
    assert "Exchange" not in plan(labels)
    marked = features.located_gaps(c).where("gap_idx is not null and doc_id is not null").select("doc_id", "sent_pos", "gap_idx")
    assert labels.where("label = 1").select("doc_id", "sent_pos", "gap_idx").exceptAll(marked).count() == 0 == marked.count() - labels.where("label = 1").count()
    assert labels.count() == c.agg(F.sum(F.size("tokens_corrupted") - 1)).first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_best_pairs_by_any_way(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 0, [f"w{int(40 * rng.random() ** (1 + seed))}" for _ in range(rng.randrange(12))]) for i in range(60)]
    s = spark.createDataFrame(rows, "doc_id long, sent_pos int, tokens array<string>")
    keep = Scratch(spark, "t")
    other = Scratch(spark, "t")
    model = lm.fit(s, keep=keep, order=1).written(keep)
    every = lm.own_pair_scores(lm.fit(s, keep=other, order=2).written(other)).collect()
    for few, most, top_n in ((3, 1000, 5), (10, 1000, 5), (10, 2, 5), (1000, 1000, 20), (10, 1000, 5000)):
        least = sorted((round(r["gap_score"], 6) for r in every), reverse=True)[:top_n][-1]
        want = sorted((r["left"], r["right"], round(r["gap_score"], 6)) for r in every if round(r["gap_score"], 6) >= least)
        got = lm.best_pair_scores(s, model, top_n, few=few, most=most).collect()
        assert sorted((r["left"], r["right"], round(r["gap_score"], 6)) for r in got) == want
