"""Masked-language-model scores of words: the interface, with the model as a pluggable function.

A loader is called once per Python worker and gives a scorer with two methods: word_nll(tokens) -> (nll, nll per
subtoken), each a list with a number per word, and topk(tokens, idx, k) -> list of words. No model is shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    def word_nll(self, tokens: list[str]) -> tuple[list[float], list[float]]: ...

    def topk(self, tokens: list[str], idx: int, k: int) -> list[str]: ...


def pll_word_nll(sentences: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """Adds nll and nll_norm, arrays with a number per word."""

    @F.pandas_udf("nll array<double>, nll_norm array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for b in batches:
            yield pd.DataFrame([dict(zip(("nll", "nll_norm"), scorer.word_nll(list(t)), strict=True)) for t in b], columns=["nll", "nll_norm"])

    return sentences.withColumn("_s", score("tokens")).select(*sentences.columns, "_s.nll", "_s.nll_norm")


def topk_word_replacements(rows: DataFrame, load: Callable[[], Scorer], k: int = 5) -> DataFrame:
    """Adds replacements to rows (tokens, idx)."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load()
        for tokens, idx in batches:
            yield pd.Series([scorer.topk(list(t), int(i), k) for t, i in zip(tokens, idx, strict=True)])

    return rows.withColumn("replacements", found("tokens", "idx"))


def first_sentences(sentences: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """The first n sentences, shorter ids first, for a look at a model. The limit is the point of it."""
    return sentences.orderBy(F.length(order), order).limit(n)


def most_surprising(sentences: DataFrame, load: Callable[[], Scorer], keys: list[str], words: int = 3, k: int = 5) -> DataFrame:
    """The words of each sentence with the highest nll per subtoken, with replacements."""
    x = pll_word_nll(sentences, load).select(*keys, "tokens", F.posexplode("nll_norm").alias("idx", "nll_norm"))
    order = Window.partitionBy(*keys).orderBy(F.col("nll_norm").desc(), "idx")
    return topk_word_replacements(x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= words), load, k)
