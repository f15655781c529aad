"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Tokens are runs of ASCII letters, digits and non-ASCII characters after A-Z became a-z. A token stands for itself and for
its first four, five and six bytes, so that forms of a known stem count; all are hashed to 2^20 buckets, which gives the
model a fixed size. A bucket's score is its log-odds between toxic and clean documents under an informative Dirichlet
prior (Monroe et al. 2008) in proportion to its frequency, shrunk by its standard error; buckets met in fewer than
`least` documents or with odds above 0 and below `weak` score 0. A token takes the one of its scores that is furthest from 0, less a drift that makes clean
text lose score; in the log-odds it counts once in a document, in the scan every occurrence scores. A linear scan (Ruzzo and Tompa 1999) finds every maximal segment; by Karlin and Altschul
(1990) a segment of score S in n tokens has the E-value K n exp(-lambda S). lambda solves E[exp(lambda s)] = 1 over the tokens
of clean documents, K comes from the clean documents' best segments. A logistic curve maps the best segment's and all significant
segments' evidence to a probability.

Learning uses a bounded sample: of each label the `sample` rows with the smallest hash of the id.

Defined cases: a null or empty text scores as one without a segment; null labels or ids are not learned from; an id
labelled twice counts as toxic if one label says so; without rows of both labels every score is the share of toxic
labels (0 without any); repeated rows score alike; an empty table gives no rows; other columns are carried along
unread and never enter a score.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.bytehash import ALNUM, raw, slices, word_hashes
from textsieve.llm.common import fold, limit_batches, texts

BITS = 20
PREFIXES: tuple[int, ...] = (4, 5, 6)
BATCH_BYTES = 4 << 20
LAMBDAS = tuple(0.05 * 1.25**k for k in range(24))
_TOKENS_AT, _TOTAL, _DOCS, _BEST, _LOG_N = range(len(LAMBDAS), len(LAMBDAS) + 5)
SEGMENTS = "array<struct<first:int,last:int,score:double,e_value:double>>"


@dataclass
class ToxicityModel:
    score: np.ndarray  # by bucket
    drift: float = 0.05
    decay: float = 1.0  # lambda
    size: float = 1.0  # K
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    e_max: float = 0.01
    constant: float | None = None

    def tokens(self, buckets: np.ndarray) -> np.ndarray:
        """Scores of tokens, given the buckets of each in a column. Every occurrence scores, wherever its document had the token before."""
        s = self.score[buckets]
        return np.take_along_axis(s, np.abs(s).argmax(0)[None], 0)[0] - self.drift

    def features(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        base = np.log(self.size * max(n, 1))
        evidence = [self.decay * s - base for _, _, s in segments]
        strong = sum(x for x in evidence if x > -np.log(self.e_max))
        return float(max(evidence, default=-base)), float(np.log1p(strong))

    def probability(self, segments: list[tuple[int, int, float]], n: int) -> float:
        if self.constant is not None:
            return self.constant
        a, b = self.features(segments, n)
        w = self.weights
        return float(1 / (1 + np.exp(-np.clip(w[0] + w[1] * a + w[2] * b, -500, 500))))


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments, in linear time; only positive tokens open or extend one."""
    at = np.flatnonzero(x > 0)
    if len(at) == 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(x)))
    stack: list[list] = []  # first, last, sum before, sum to, index of the nearest earlier one with a smaller sum before
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        now = [i, i, left, right, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= now[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= now[3]:
                now[4] = j
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3], -1]
            before = stack[j][4]
            del stack[j:]
            j = before
    return [(a, b, r - le) for a, b, le, r, _ in stack]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens (a row each for the token and its beginnings), and where each document's begin (n + 1)."""
    data, offsets = raw(column)
    h, owner = word_hashes(data, offsets, ALNUM, prefixes=PREFIXES)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(owner, np.arange(len(offsets)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
        bucket, begins = _tokens(batch.column(0))
        for d, toxic in enumerate(batch.column(1).to_pylist()):
            n[toxic, np.unique(bucket[:, begins[d] : begins[d + 1]])] += 1
            docs[toxic] += 1
    k = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(n[0, k], docs[0])), pa.array(np.append(n[1, k], docs[1]))], ["bucket", "clean", "toxic"])


def _logistic(x: np.ndarray, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted, penalised logistic regression by Newton steps, each halved until the loss falls."""
    w, penalty = np.zeros(3), np.array([1e-3, 1e-2, 1e-2])
    loss = lambda v: float(np.sum(weight * (np.logaddexp(0, x @ v) - t * (x @ v))) + np.sum(penalty * v * v) / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - penalty * w)
        while np.abs(step).max() > 1e-9 and not loss(w + step) <= loss(w):
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000, prior: float = 500.0, shrink: float = 1.5, weak: float = 1.5, drift: float = 0.05, least: int = 3, folds: tuple[int, ...] = (1, 2, 3, 4)) -> ToxicityModel:
    """A model from the labelled documents among docs whose ids are in the training folds (crc32 modulo 5)."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold().isin(*folds))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        return ToxicityModel(np.zeros(1 << BITS), constant=float(share.get(1, 0) > 0))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    ids = {t: [r["doc_id"] for r in picked.where(F.col("toxic") == t).collect()] for t in (0, 1)}  # 2 * sample rows at most
    picked = docs.sparkSession.createDataFrame([(i, t) for t in ids for i in ids[t]], "doc_id long, toxic int")
    rows = texts(docs).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    found = rows.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= least).toPandas()  # 2^BITS rows at most
    size = found[found.bucket < 0].iloc[0] if len(found) else None
    if size is None or not size.clean or not size.toxic:
        return ToxicityModel(np.zeros(1 << BITS), constant=share[1] / (share[0] + share[1]))
    y = np.zeros((2, 1 << BITS))
    found = found[found.bucket >= 0]
    y[0, found.bucket], y[1, found.bucket] = found.clean, found.toxic
    n = y.sum(1)
    # pseudo-counts: 1 and prior * frequency, in the classes' proportions, so that without evidence the odds are even
    alpha = [(1 + prior * y.sum(0) / y.sum()) * n[k] / n.sum() for k in (0, 1)]
    odds = [np.log((y[k] + alpha[k]) / (n[k] + alpha[k].sum() - y[k] - alpha[k])) for k in (0, 1)]
    delta, error = odds[1] - odds[0], np.sqrt(1 / (y[0] + alpha[0]) + 1 / (y[1] + alpha[1]))
    score = np.sign(delta) * np.maximum(np.abs(delta) - shrink * error, 0) * (y.sum(0) > 0)
    model = ToxicityModel(np.where((score > 0) & (score < weak), 0, score).astype(np.float32), drift)
    while True:
        sent = docs.sparkSession.sparkContext.broadcast(model)
        sums = rows.where("toxic = 0").mapInArrow(_sums(sent), "k int, value double").groupBy("k").agg(F.sum("value").alias("value"))
        found = {r["k"]: r["value"] for r in sums.collect()}  # a few numbers
        n_clean = max(found.get(_TOKENS_AT, 0.0), 1.0)
        mean = found.get(_TOTAL, 0.0) / n_clean
        if mean < 0 or not found.get(_TOKENS_AT):
            break
        model.drift += mean + drift  # clean text must lose score
    power = np.array([found.get(k, 0.0) for k in range(len(LAMBDAS))]) / n_clean
    above = np.flatnonzero(power >= 1)
    k = int(above[0]) if len(above) else len(LAMBDAS) - 1
    if k and power[k] > power[k - 1]:  # between the last below 1 and the first above
        part = np.clip((1 - power[k - 1]) / (power[k] - power[k - 1]), 0, 1)
        model.decay = float(LAMBDAS[k - 1] + part * (LAMBDAS[k] - LAMBDAS[k - 1]))
    else:
        model.decay = LAMBDAS[k]
    n_docs = max(found.get(_DOCS, 0.0), 1.0)
    model.size = float(np.exp((model.decay * found.get(_BEST, 0.0) - found.get(_LOG_N, 0.0)) / n_docs - np.euler_gamma))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    best = rows.mapInArrow(_features(sent), "toxic int, strongest double, evidence double").toPandas()  # three numbers for each of 2 * sample rows at most
    x = np.column_stack([np.ones(len(best)), best.strongest, best.evidence])
    t = best.toxic.to_numpy(float)
    weight = np.where(t > 0, share[1] / max(t.sum(), 1), share[0] / max((1 - t).sum(), 1))  # the sample's labels back to their shares
    weight *= len(t) / weight.sum()
    model.weights = tuple(float(v) for v in _logistic(x, t, weight))
    return model


def _sums(sent):
    """(k, value): for a part of the texts, sums over tokens of exp(lambda * score) for each lambda (k from 0), then of what the last numbers name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = sent.value, np.zeros(_LOG_N + 1)
        for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
            bucket, begins = _tokens(batch.column(0))
            x = model.tokens(bucket)
            sizes = np.diff(begins)
            best = [max((s for *_, s in maximal_segments(x[i:j])), default=0.0) for i, j in zip(begins[:-1], begins[1:], strict=True)]
            sums += [*(np.exp(v * x).sum() for v in LAMBDAS), len(x), x.sum(), batch.num_rows, sum(best), np.log(np.maximum(sizes, 1)).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["k", "value"])

    return run


def _features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
            bucket, begins = _tokens(batch.column(0))
            x = model.tokens(bucket)
            found = [model.features(maximal_segments(x[i:j]), int(j - i)) for i, j in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], ["toxic", "strongest", "evidence"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with toxic_score and toxic_segments (every significant one: first and last token, score, E-value).

    Columns of docs with these two names are replaced.
    """
    limit_batches(docs.sparkSession)
    own = docs.select(*(docs[c] for c in docs.columns if c not in ("toxic_score", "toxic_segments")))
    out = own.select("*", F.lit(0.0).alias("toxic_score"), F.array().cast(SEGMENTS).alias("toxic_segments"))
    sent, at = docs.sparkSession.sparkContext.broadcast(model), own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
            bucket, begins = _tokens(batch.column(at))
            x, k = m.tokens(bucket), batch.num_columns
            scores, spans = [], []
            for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                g, n = maximal_segments(x[i:j]), j - i
                scores.append(m.probability(g, n))
                e = [(a, b, s, float(m.size * n * np.exp(-m.decay * s))) for a, b, s in g]
                spans.append([{"first": a, "last": b, "score": s, "e_value": v} for a, b, s, v in e if v <= m.e_max])
            columns = [batch.column(c) for c in range(k - 2)] + [pa.array(scores, pa.float64()), pa.array(spans, batch.schema.field(k - 1).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return out.mapInArrow(run, out.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(texts(docs), fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_segments").cast("long").alias("n_segments"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more. Without usable labels of both kinds there is nothing to tell them
    apart by: all stay, and a warning says so."""
    model = fit_toxicity(docs, labels)
    if model.constant is not None:
        warnings.warn("no documents dropped: labels of both kinds are needed to learn toxicity", stacklevel=2)
        return docs
    names = docs.columns
    plain = docs.select(*(docs[c].alias(f"_{k}") for k, c in enumerate(names)), docs["text"].alias("text"))
    kept = score_toxicity(plain, model).where(F.col("toxic_score") < threshold)
    return kept.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(names)))
