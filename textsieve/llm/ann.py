"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length 1, so that the largest inner product is the largest cosine. Each pair of dimensions is one
of 16 codewords (four bits). Codewords and codes minimise |r|^2 + (eta - 1) (r.x)^2 for the residual r of x: error along
x, which moves large inner products, counts eta times (Guo et al. 2020). Both are found by coordinate descent over the
subspaces; codewords on a bounded sample, codes for every row.

Rows lie in cells, by the nearest of up to MAX_CELLS centroids that are fitted on the sample, about CELL rows each. A query
is sent to as many of its nearest cells as hold the wanted share (`coverage`) of the neighbours that ASKED drawn queries have
in the sample; one that meets less than k rows there goes to all. Cells meet their queries by a shuffle; large ones are dealt out to chunks of about
CHUNK rows and QUERIES queries, so no cell is too large for a task.

In a chunk a search adds up, for each row, the entries of the query's tables (one per subspace, 8 bits an entry) that the
row's codes name. The `rerank` rows with the highest sums, and all that tie with the last, are measured on the original
vectors in double precision, and then every row whose sum does not rule out that it is among the k best. A window over the chunks' k best picks the k best of all.

Defined cases: null, zero, non-finite vectors or such with null components take no part, neither do those of another
length than most vectors have; rows with a query's own id are not its candidates; a query id that repeats counts with its
least vector; equal scores go by the smaller id; rows with a null id are neither queries nor candidates; repeated rows are
candidates each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import Workspace

CODES = 16
MAX_CELLS, CELL, CHUNK, QUERIES, ASKED = 4096, 1024, 8192, 2048, 512


class Quantiser:
    def __init__(self, dim: int, threshold: float = 0.2):
        self.dim, self.subspaces = dim, (dim + 1) // 2
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.codebook = np.zeros((self.subspaces, CODES, 2))

    def split(self, x: np.ndarray) -> np.ndarray:
        if self.dim % 2:
            x = np.concatenate([x, np.zeros((len(x), 1))], 1)
        return x.reshape(len(x), self.subspaces, 2)

    def fit(self, x: np.ndarray, rounds: int = 4, seed: int = 5) -> Quantiser:
        """x: unit vectors."""
        s, rng = self.split(x), np.random.default_rng(seed)
        for m in range(self.subspaces):
            c = s[rng.choice(len(s), CODES, replace=len(s) < CODES), m]
            for _ in range(6):
                near = ((s[:, m, None] - c) ** 2).sum(2).argmin(1)
                for k in range(CODES):
                    if (near == k).any():
                        c[k] = s[near == k, m].mean(0)
            self.codebook[m] = c
        for _ in range(rounds):
            codes = self.encode(x)
            along = self._along(s, codes)
            for m in range(self.subspaces):
                rest = along.sum(1) - along[:, m]
                for k in range(CODES):
                    own = codes[:, m] == k
                    if own.any():
                        y = s[own, m]
                        t = rest[own] + (y * y).sum(1)
                        left = own.sum() * np.eye(2) + (self.eta - 1) * y.T @ y
                        self.codebook[m, k] = np.linalg.solve(left, y.sum(0) + (self.eta - 1) * (t[:, None] * y).sum(0))
                along[:, m] = ((s[:, m] - self.codebook[m, codes[:, m]]) * s[:, m]).sum(1)
        return self

    def _along(self, s: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's part of r.x."""
        return np.stack([((s[:, m] - self.codebook[m, codes[:, m]]) * s[:, m]).sum(1) for m in range(self.subspaces)], 1)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        s = self.split(x)
        codes = np.stack([((s[:, m, None] - self.codebook[m]) ** 2).sum(2).argmin(1) for m in range(self.subspaces)], 1).astype(np.uint8)
        along = self._along(s, codes)
        total = along.sum(1)
        for _ in range(passes):
            for m in range(self.subspaces):
                r = s[:, m, None] - self.codebook[m]
                part = (r * s[:, m, None]).sum(2)
                rest = total - along[:, m]
                codes[:, m] = ((r * r).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(1)
                along[:, m] = np.take_along_axis(part, codes[:, m : m + 1].astype(int), 1)[:, 0]
                total = rest + along[:, m]
        return codes

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, subspaces, CODES) in 8 bits, and of each query the step of its entries and what is added to their sum."""
        t = np.einsum("qmd,mkd->qmk", self.split(q), self.codebook)
        least = t.min(2, keepdims=True)
        step = np.maximum((t - least).max((1, 2)), 1e-12) / 255
        return np.round((t - least) / step[:, None, None]).astype(np.uint8), step, least.sum((1, 2))

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector's residual the part along the vector and the length of the rest."""
        s, along, square = self.split(x), np.zeros(len(x)), np.zeros(len(x))
        for m in range(self.subspaces):
            r = s[:, m] - self.codebook[m, codes[m]]
            along += (r * s[:, m]).sum(1)
            square += (r * r).sum(1)
        return along, np.sqrt(np.maximum(square - along * along, 0))


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def unpack(packed: np.ndarray, subspaces: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :subspaces]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


@dataclass
class Cells:
    """Centroids of unit vectors, and how many cells a query is sent to."""

    centroids: np.ndarray
    probes: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, coverage: float, rounds: int = 8, seed: int = 9, ids: np.ndarray | None = None, asked: np.ndarray | None = None, asked_ids: np.ndarray | None = None) -> Cells:
        """x: the sample's unit vectors; rows: of the whole table; asked: unit vectors of drawn queries (rows of the sample if there are none)."""
        k = min(MAX_CELLS, max(1, rows // CELL), max(1, len(x) // 8))
        rng = np.random.default_rng(seed)
        out = cls(x[rng.choice(len(x), k, replace=False)].copy())
        for _ in range(rounds if k > 1 else 0):
            own = out.order(x, 1)[:, 0]
            sums = np.zeros_like(out.centroids)
            np.add.at(sums, own, x)
            length = np.sqrt((sums * sums).sum(1))
            out.centroids[length > 0] = sums[length > 0] / length[length > 0, None]
        if k > 1:  # in which of its nearest cells a query's true neighbours lie
            if asked is None or not len(asked):
                drawn = rng.choice(len(x), min(len(x), 256), replace=False)
                ids, asked, asked_ids = np.arange(len(x)), x[drawn], drawn
            own, places = out.order(x, 1)[:, 0], out.order(asked, k).argsort(1)
            score = asked @ x.T
            score[asked_ids[:, None] == ids] = -2
            near = np.argpartition(-score, min(5, len(x) - 1), 1)[:, :5]
            rank = np.take_along_axis(places, own[near], 1)
            out.probes = int(np.quantile(rank, coverage, method="higher")) + 1
        return out

    def order(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest cells of each row, nearest first."""
        score = x @ self.centroids.T
        if k == 1:
            return score.argmax(1)[:, None]
        return np.argsort(-score, 1, kind="stable")[:, :k]


def _vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, is_query, vec binary of doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become nan
            good = np.isfinite(flat).all(1) & flat.any(1)
            vec = [x.tobytes() for x in np.ascontiguousarray(flat[good])]
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(vec, pa.binary())], ["vec_id", "is_query", "vec"])

    return rows.where(F.size("embedding") == dim).mapInArrow(run, "vec_id long, is_query boolean, vec binary")


def _encoded(sent, dim: int):
    """Adds each row's code and cell, and the cells that it is sent to as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, cells = sent.value
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            x = _unit(_matrix(batch.column("vec"), dim))
            codes, order = pack(quantiser.encode(x)), cells.order(x, cells.probes)
            near = [o if q else None for o, q in zip(order.tolist(), batch.column("is_query").to_pylist(), strict=True)]
            columns = [batch.column("vec_id"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(order[:, 0], pa.int32()), pa.array(near, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "code", "cell", "near"])

    return run


def _best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, quantiser: Quantiser, k: int, rerank: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, score) of each query's k best rows; codes by subspace.

    The `rerank` highest sums give a k-th best score s. A row of score s or more has a coded score of at least
    s (1 - a) - sqrt(1 - s^2) b, with a and b its residual along and across the vector; all rows that reach it are measured.
    """
    (tables, step, least), lengths, sizes = quantiser.tables(_unit(queries)), np.sqrt((queries * queries).sum(1)), np.sqrt((x * x).sum(1))
    along, across = quantiser.residuals(_unit(x), codes)
    slack, lowest = step * (quantiser.subspaces / 2) + 1e-9, -(1 - along) / np.maximum(np.hypot(1 - along, across), 1e-300)
    for b in range(0, len(q_ids), 64):
        sums = np.zeros((min(64, len(q_ids) - b), len(ids)), np.uint16 if quantiser.subspaces <= 256 else np.uint32)
        for m in range(quantiser.subspaces):
            sums += tables[b : b + 64, m][:, codes[m]]
        floor = np.partition(sums, -rerank, 1)[:, -rerank] if len(ids) > rerank else np.zeros(len(sums), sums.dtype)
        for j in range(len(sums)):
            own, chosen = ids == q_ids[b + j], sums[j] >= floor[j]
            measure = lambda rows, q=b + j: (x[rows] * queries[q]).sum(1) / (sizes[rows] * lengths[q])
            near = np.flatnonzero(chosen & ~own)
            score = measure(near)
            if len(near) < len(ids) - own.sum():
                least_score = np.partition(score, -k)[-k] - 1e-9 if len(near) >= k else -1.0
                at = np.clip(least_score, lowest, 1.0)
                reach = sums[j] * step[b + j] + least[b + j] + slack[b + j] >= at * (1 - along) - np.sqrt(1 - at * at) * across
                more = np.flatnonzero(reach & ~chosen & ~own)
                near, score = np.concatenate([near, more]), np.concatenate([score, measure(more)])
            for i in np.lexsort((ids[near], -score))[:k]:
                yield int(q_ids[b + j]), int(ids[near[i]]), float(score[i])


def _searched(sent, dim: int, k: int, rerank: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        quantiser = sent.value[0]
        matrix = lambda v: np.frombuffer(b"".join(map(bytes, v)), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(map(bytes, rows["code"])), np.uint8).reshape(len(rows), -1)
        found = _best(queries["query_id"].to_numpy(), matrix(queries["vec"]), rows["vec_id"].to_numpy(), matrix(rows["vec"]), unpack(codes, quantiser.subspaces).T.astype(np.intp), quantiser, k, rerank)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, is_query: Column, work: Workspace, sample: int = 20_000, coverage: float = 0.98):
    """(rid, vec_id, vec, code, cell, near) of every row that takes part, and the broadcast quantiser and cells, fitted on `sample` rows (none without rows)."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    rows = rows.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 1
    usable = work.write(_vectors(rows, dim), "vectors")
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec_id", "vec").toArrow()
    if not len(drawn):
        return None, None, dim
    # queries may be of another kind than most rows, so they are drawn by themselves
    asked = usable.where("is_query").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(ASKED).select("vec_id", "vec").toArrow()
    x, q = _unit(_matrix(drawn.column("vec"), dim)), _unit(_matrix(asked.column("vec"), dim)) if len(asked) else None
    cells = Cells.fit(x, usable.count(), coverage, ids=drawn.column("vec_id").to_numpy(), asked=q, asked_ids=asked.column("vec_id").to_numpy())
    sent = vectors.sparkSession.sparkContext.broadcast((Quantiser(dim).fit(x), cells))
    index = usable.mapInArrow(_encoded(sent, dim), "vec_id long, vec binary, code binary, cell int, near array<int>")
    return work.write(index.withColumn("rid", F.monotonically_increasing_id()), "index"), sent, dim


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, rerank: int = 256, coverage: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest. is_query: a condition on vec_id."""
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "ann")
    index, sent, dim = build_index(vectors, is_query, work, coverage=coverage)
    out = "query_id long, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.where("near is not null").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("vec", "near")).alias("q"))
    queries = work.write(queries.select("query_id", "q.vec", "q.near"), "queries")
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # MAX_CELLS rows at most

    def search(asked: DataFrame, tag: str) -> DataFrame:
        each = asked.select("query_id", "vec", F.explode("near").alias("cell"))
        asking = {r["cell"]: r["count"] for r in each.groupBy("cell").count().collect()}
        plan = [(c, math.ceil(n / CHUNK), math.ceil(asking[c] / QUERIES)) for c, n in counts.items() if c in asking]
        plan = F.broadcast(spark.createDataFrame(plan, "cell int, chunks int, q_chunks int"))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = index.join(plan, "cell").select("cell", part("rid", "chunks").alias("chunk"), upto("q_chunks").alias("q_chunk"), "vec_id", "vec", "code")
        each = each.join(plan, "cell").select("cell", part("query_id", "q_chunks").alias("q_chunk"), upto("chunks").alias("chunk"), "query_id", "vec")
        keys = ["cell", "chunk", "q_chunk"]
        found = rows.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(_searched(sent, dim, k, rerank), out)
        return work.write(found, tag)

    if not queries.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search(queries, "found")
    if len(counts) > 1:
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = work.write(queries.join(enough, "query_id", "left_anti"), "short")
        if short.limit(1).count():
            every = F.array(*(F.lit(c) for c in sorted(counts)))
            found = found.join(short, "query_id", "left_anti").unionByName(search(short.withColumn("near", every), "found_all"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
