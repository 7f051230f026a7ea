"""Exact top-k inner product search: MaxScore over shards of integer vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``(vec_id, terms)``: floor(scale * x) of every component, whole finite vectors only."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    vector = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    whole = vector.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    terms = whole.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("terms"))
    return terms.groupBy("vec_id").agg(F.min("terms").alias("terms"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, probe: int = 1024, dense: int = 64):
    """The k best candidates of each query in one shard: (query row, candidate row, score).

    A term is a dimension and the sign of the query's weight; its bound is the largest
    contribution any vector of the shard makes above the smallest one. A first probe
    gives each query a threshold. Terms are non-essential while their bounds together
    can't lift a vector over it; the essential ones are summed for all vectors of the
    shard, and the others term by term for the vectors that are still competitive.
    """
    if not len(q) or not len(c):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    high, low = c.max(0), c.min(0)
    top, base = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    gain = top - base
    floor = base.sum(1)

    sample = np.linspace(0, len(c) - 1, min(len(c), probe)).astype(int)
    first = q @ c[sample].T
    first[q_ids[:, None] == c_ids[sample][None, :]] = -np.inf
    threshold = np.full(len(q), -np.inf)
    if len(sample) > k:
        threshold = np.partition(first, len(sample) - k, axis=1)[:, len(sample) - k]

    order = np.argsort(-gain, axis=1, kind="stable")
    sorted_gain = np.take_along_axis(gain, order, 1)
    after = np.cumsum(sorted_gain[:, ::-1], 1)[:, ::-1]  # bound of term i and all later ones
    essential = floor[:, None] + after >= threshold[:, None]
    n_essential = essential.sum(1)
    mask = np.zeros(q.shape, bool)
    np.put_along_axis(mask, order, essential, 1)
    rest_base = np.where(mask, 0, base).sum(1)
    rest_gain = np.where(mask, 0, gain).sum(1)

    partial = np.where(mask, q, 0) @ c.T
    partial[q_ids[:, None] == c_ids[None, :]] = -np.inf
    competitive = partial >= (threshold - rest_base - rest_gain)[:, None]
    # where many vectors are competitive, all other terms are probed at once
    many = competitive.sum(1) * dense > len(c)
    if many.any():
        partial[many] += np.where(mask[many], 0, q[many]) @ c.T
        competitive[many] = partial[many] >= threshold[many, None]
        n_essential = np.where(many, q.shape[1], n_essential)
    qi, ci = np.nonzero(competitive)
    score = partial[qi, ci]
    live = np.isfinite(score)
    qi, ci, score = qi[live], ci[live], score[live]
    for place in range(int(n_essential.min()), q.shape[1]):
        open_ = place >= n_essential[qi]
        dim = order[qi, place]
        score = score + np.where(open_, q[qi, dim] * c[ci, dim], 0)
        left = np.where(place + 1 < q.shape[1], after[qi, min(place + 1, q.shape[1] - 1)], 0)
        # smallest contributions of the terms that are still to come
        to_come = _base_after(base, order, place)[qi]
        keep = ~open_ | (score + to_come + left >= threshold[qi])
        qi, ci, score = qi[keep], ci[keep], score[keep]
    rank = np.lexsort((c_ids[ci], -score, qi))
    qi, ci, score = qi[rank], ci[rank], score[rank]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    best = place < k
    return qi[best], ci[best], score[best]


def _base_after(base: np.ndarray, order: np.ndarray, place: int) -> np.ndarray:
    return np.take_along_axis(base, order[:, place + 1 :], 1).sum(1)


def _exact(q: list, c: list, k: int, q_ids, c_ids):
    """Whole numbers of any size, for values that doubles can't hold exactly."""
    out = []
    for i, a in enumerate(q):
        best = [(-sum(int(x) * int(y) for x, y in zip(a, b, strict=False)), c_ids[j]) for j, b in enumerate(c) if c_ids[j] != q_ids[i]]
        out += [(q_ids[i], j, -s) for s, j in sorted(best)[:k]]
    return out


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 20, shard_rows: int = 16384, block_rows: int = 4096, step: int = 256
) -> DataFrame:
    """The ``k`` highest inner products of each query among ``vectors``, itself excluded.

    Both tables are ``(vec_id, terms)`` from ``quantised``. Shards of vectors meet blocks
    of queries by key, each in a group of bounded size; the shards' lists are merged by
    rank. Ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do
    null ids; of rows with one id the smallest vector counts; a shorter vector has
    zeros in the dimensions it lacks; a query without other vectors gives no row.
    """
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    c = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        c = c.sort_values("vec_id")
        q_ids, c_ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        width = max(1, max(map(len, q["terms"])), max(map(len, c["terms"])))
        qm, cm = _matrix(q["terms"], width), _matrix(c["terms"], width)
        if width * max(1.0, np.abs(qm).max()) * max(1.0, np.abs(cm).max()) >= 2.0**51:
            return pd.DataFrame(_exact(list(q["terms"]), list(c["terms"]), k, q_ids, c_ids), columns=["query_id", "vec_id", "score"])
        out = []
        for i in range(0, len(qm), step):
            qi, ci, score = search_block(qm[i : i + step], q_ids[i : i + step], cm, c_ids, k)
            out.append(pd.DataFrame({"query_id": q_ids[i + qi], "vec_id": c_ids[ci], "score": score.astype(np.int64)}))
        return pd.concat(out)

    hits = q.groupBy("shard", "block").cogroup(c.groupBy("shard", "block")).applyInPandas(search, HIT)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
