"""Nearest vectors on rows of other kinds than the given ones."""

import numpy as np
from pyspark.sql import functions as F

from textsieve.llm import ann


def recall(spark, x, rerank):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(rows, F.col("vec_id") % 10 == 0, rerank=rerank).collect()}
    unit, hit, asked = x / np.sqrt((x * x).sum(1, keepdims=True)), 0, range(0, len(x), 10)
    for q in asked:
        s = unit @ unit[q]
        s[q] = -2
        hit += sum((q, int(i)) in got for i in np.argsort(-s, kind="stable")[:5])
    return hit / (5 * len(asked))


def test_nearest_in_narrow_crowds_and_for_queries_off_the_crowd(spark, monkeypatch):
    """Crowds that codes can't tell apart (recall 0.11 by the highest sums alone), and queries unlike all other rows (0.87 with cells chosen for the crowd)."""
    rng = np.random.default_rng(2)
    crowds = rng.normal(size=(3, 16))[rng.integers(0, 3, 600)] + 0.03 * rng.normal(size=(600, 16))
    assert recall(spark, crowds, rerank=16) == 1
    monkeypatch.setattr(ann, "CELL", 64)
    x = rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(900, 16))
    x[::10] = rng.normal(size=(90, 16))
    assert recall(spark, x, rerank=256) >= 0.95
