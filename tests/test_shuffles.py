"""Counts and vectors that reach tokens in two ways, by what is sent to all tasks and by a shuffle: any share of each gives the same rows."""

import math
import random
from collections import Counter
from unittest import mock

import pytest
from pyspark.sql import functions as F

from textsieve.operators import embed, features, lm, ml
from textsieve.sources.scratch import Scratch

S = "doc_id long, sent_pos int, tokens array<string>"
TEXTS = [t.split() for t in ["a b a b c", "b a", "c", "a a a a", "d c b a b", "", "a b", "a b a b c"]]


def brute(texts, asked, direction):
    """Surprisal by the definition; the backward model is the forward one of really reversed text."""
    if direction == "both":
        return [[(x + y) / 2 for x, y in zip(a, b, strict=True)] for a, b in zip(brute(texts, asked, "forward"), brute(texts, asked, "backward"), strict=True)]
    if direction == "backward":
        return [x[::-1] for x in brute([t[::-1] for t in texts], [t[::-1] for t in asked], "forward")]
    pad = lambda t: ["<s>", "<s>", *t, "</s>"]
    c = [Counter(tuple(pad(t)[i : i + k]) for t in texts for i in range(len(t) + 4 - k)) for k in (1, 2, 3)]
    n, av = sum(c[0].values()), 0.1 * len(c[0])
    p = lambda x, y, z: 0.6 * (c[2][x, y, z] + 0.1) / (c[1][x, y] + av) + 0.3 * (c[1][y, z] + 0.1) / (c[0][y,] + av) + 0.1 * (c[0][z,] + 0.1) / (n + av)
    return [[-math.log(p(*pad(t)[i : i + 3])) for i in range(len(t))] for t in asked]


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize(("own", "most"), [(True, 0), (True, 3), (True, 100), (False, 0), (False, 3), (False, 100)])
def test_surprisal_by_any_way(spark, direction, own, most):
    s = spark.createDataFrame([(7, 0, t) for t in TEXTS], S)  # ids that repeat do not mix sentences up
    model = lm.fit(s, order=1 if own else 3, keep=Scratch(spark, "t"))
    asked = TEXTS if own else [["a", "b", "z"], ["z"], ["c", "a"], []]
    shown = s if own else spark.createDataFrame([(7, 0, t) for t in asked], S)
    got = lm.scored_sentences(shown, model, direction, own=own, most=most).select("tokens", "scored").collect()
    want = sorted((t, [round(x, 9) for x in v]) for t, v in zip(asked, brute(TEXTS, asked, direction), strict=True))
    assert sorted((r["tokens"], [round(x["surprisal"], 9) for x in r["scored"]]) for r in got) == want
    counts = Counter(w for t in TEXTS for w in t)
    assert all(x["c"] == counts[x["w"]] and r["tokens"][x["idx"]] == x["w"] for r in got for x in r["scored"])


@pytest.mark.parametrize("most", [0, 4, 100])
def test_outliers_by_any_way(spark, most):
    rng = random.Random(most)
    words = [f"w{i}" for i in range(12)]
    s = spark.createDataFrame([(i, 0, [words[int(12 * rng.random() ** 2)] for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(30)], S)
    vectors = spark.createDataFrame([(w, [0.0, 0.0] if w == "w3" else None if w == "w5" else [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for w in words if w != "w2"], "w string, vec array<double>")
    rows = s.select(F.col("doc_id"), F.posexplode("tokens").alias("i", "w")).join(vectors, "w", "left")
    want = {(r["doc_id"], r["i"]): r["outlier"] for r in embed.neighbour_outliers(rows, "doc_id", "i", "vec").collect()}
    with mock.patch.object(embed, "CHUNK", 7):
        got = {(r["doc_id"], r["token_idx"]): r["ft_outlier"] for r in embed.token_outliers(s, vectors, most=most).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    model = lm.fit(s, order=1, keep=Scratch(spark, "t"))
    each = features.token_features(s, model, vectors, own=True).collect()
    assert {(r["doc_id"], r["token_idx"]): r["ft_outlier"] for r in each} == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("most", [0, 4, 100])
def test_counts_by_any_way(spark, most):
    s = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], S)
    uni, counts = lm.fit(s, order=1).uni.where("w <> 'd'"), Counter(w for t in TEXTS for w in t if w != "d")
    got = lm.with_counts(s.select("doc_id", F.posexplode("tokens").alias("i", "w")), uni, most).collect()
    assert sorted((r["doc_id"], r["i"], r["w"], r["c"]) for r in got) == [(k, i, w, counts[w]) for k, t in enumerate(TEXTS) for i, w in enumerate(t)]


def test_scaler_of_counted_rows(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 3), (4.0, 5.0, 1), (None, 5.0, 2)], "a double, b double, n int")
    each = rows.select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    shown = lambda df: {r["feature"]: (r["mean"], r["std"]) for r in df.collect()}
    got, want = shown(ml.scaler_stats(rows, ("a", "b"), "n")), shown(ml.scaler_stats(each, ("a", "b")))
    assert got == {k: pytest.approx(v) for k, v in want.items()} and want["b"] == (5.0, 1.0)
