"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Components are quantised to floor(256 x).  Candidates come in blocks; a block keeps, for each dimension, its
vectors sorted by that component.  For a query, the lists are read in order, from the end that its sign
favours, all to the same depth.  A vector's score lies between what was read of it plus the worst, and plus
the next unread, value of each list it was not yet read in.  Reading stops when no vector but k has an upper
bound that reaches the k-th best lower bound, or else at the lists' ends, where bounds are scores; then the
vectors left get their final scores.  The k-th best score of a task's earlier blocks is a lower bound from
the start.

Queries go in broadcast blocks of ``QUERY_BLOCK``, one after the other, so what is broadcast at once is bounded;
each task returns at most k rows for a query.  Vectors that are null or hold null or non-finite components, and
rows with a null id, take no part.  Shorter vectors count as padded with zeros.  Rows that share the query's id are its own.
Ties go to the smaller id; repeated rows each take a rank; an empty table gives no rows; other columns are
ignored.  Scores are exact below 2**53.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, table

QUERY_BLOCK = 4096
BLOCK = 8192
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    sound = F.expr("forall(_e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    q = F.expr("transform(_e, x -> floor(256 * x))")
    return (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_e"))
        .where("vec_id is not null and _e is not null")
        .where(sound)
        .select("vec_id", q.cast("array<bigint>").alias("v"))
    )


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


class Lists:
    """A block's vectors and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        by_dim = np.ascontiguousarray(values.T)
        self.up = np.argsort(by_dim, axis=1, kind="stable")
        self.ranked = np.take_along_axis(by_dim, self.up, axis=1)

    def top(self, query_id: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all vectors that may be among the k best with a score of ``floor`` or more."""
        n, (plus, minus) = len(self.ids), (np.flatnonzero(q > 0), np.flatnonzero(q < 0))
        dims = np.concatenate([plus, minus])
        w = q[dims]
        worst = np.concatenate([q[plus] * self.ranked[plus, 0], q[minus] * self.ranked[minus, -1]])
        best = np.concatenate([q[plus] * self.ranked[plus, -1], q[minus] * self.ranked[minus, 0]])
        if best.sum() < floor or n == 0:
            return self.ids[:0], np.zeros(0)
        got, unread = np.zeros(n), np.ones((len(dims), n), dtype=np.float32)
        own, at = self.ids == query_id, 0
        alive = np.flatnonzero(~own) if own.any() else np.arange(n)
        line = np.arange(len(dims))[:, None]
        for depth in DEPTHS:
            to = min(n, max(at + 1, int(np.ceil(depth * n))))
            rows = np.concatenate([self.up[plus, n - to : n - at], self.up[minus, at:to]])
            read = np.concatenate([self.ranked[plus, n - to : n - at], self.ranked[minus, at:to]]) * w[:, None]
            got += np.bincount(rows.ravel(), weights=read.ravel(), minlength=n)
            unread[line, rows] = 0
            at = to
            if at == n:
                break
            following = np.concatenate([q[plus] * self.ranked[plus, n - 1 - at], q[minus] * self.ranked[minus, at]])
            # Bounds are in single precision but for what was read: a margin keeps them on the safe side.
            margin = 1e-5 * np.abs(np.stack([worst, following])).sum() + 1e-6
            left = unread[:, alive] if 4 * len(alive) < n else unread
            mine = slice(None) if left is not unread else alive
            upper = got[alive] + (following.astype(np.float32) @ left)[mine] + margin
            if len(alive) > k:
                lower = got[alive] + (worst.astype(np.float32) @ left)[mine] - margin
                floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
            alive = alive[upper >= floor]
            if len(alive) <= k:
                break
        scores = self.values[alive] @ q
        keep = scores >= floor
        alive, scores = alive[keep], scores[keep]
        order = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][order], scores[order]


def _search(queries: tuple[np.ndarray, np.ndarray], k: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    q_ids, q_values = queries
    found: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)

    def block(ids: list, rows: list) -> None:
        width = max(q_values.shape[1], 1)
        lists = Lists(np.array(ids, dtype=np.int64), matrix(rows, width))
        for i, (query_id, q) in enumerate(zip(q_ids, q_values, strict=True)):
            near, scores = lists.top(query_id, q, k, floor[i])
            if len(near):
                found[i] = sorted([*found[i], *zip(-scores, near.tolist(), strict=True)])[:k]
                if len(found[i]) == k:
                    floor[i] = max(floor[i], -found[i][-1][0])

    ids, rows = [], []
    for frame in frames:
        for vec_id, v in zip(frame["vec_id"], frame["v"], strict=True):
            ids.append(vec_id)
            rows.append(v)
            if len(ids) == BLOCK:
                block(ids, rows)
                ids, rows = [], []
    if ids:
        block(ids, rows)
    out = [(int(q), vec, int(-s)) for q, own in zip(q_ids, found, strict=True) for s, vec in own]
    if out:
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that meets ``is_query``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.cut(quantised(vectors, id_col, vec_col), "quantised")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def search(block: list) -> DataFrame:
        """The block's results, written, so that its broadcast can go before the next."""
        ids = np.array([r.vec_id for r in block], dtype=np.int64)
        sent = spark.sparkContext.broadcast((ids, matrix([r.v for r in block], max(width, 1))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return _search(sent.value, k, frames)

        found = rows.mapInPandas(run, "query_id long, vec_id long, score long")
        found = scratch.cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ranked")
        sent.destroy()
        return found

    out, block = None, []
    for r in rows.where(is_query).distinct().toLocalIterator():
        block.append(r)
        if len(block) == query_block:
            out, block = search(block) if out is None else out.union(search(block)), []
    if block or out is None:
        out = search(block) if out is None else out.union(search(block))
    return out


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
