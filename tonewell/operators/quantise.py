"""Vector and residual quantisation of embedding tables.

A codebook is model-sized (codes * dimensions). Wherever one meets the driver, its
bytes are checked against ``MAX_BOOK_BYTES`` first; it is shipped to the tasks, where each Arrow batch is one matrix
product. The vectors themselves are never shuffled to be encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.functions.hashing import uniform
from tonewell.operators.scans import take_smallest

# Bytes of a codebook, as doubles, that the driver and each task may hold.
MAX_BOOK_BYTES = 1 << 28
# Distances are compared after rounding: equal ones take the lowest code.
DIGITS = 9
# Dimensions of a decoded vector that are summed side by side in one row.
DECODE_WIDTH = 32


def check_book(codes: int, dims: int) -> None:
    if 8 * codes * dims > MAX_BOOK_BYTES:
        raise ValueError(f"a codebook has at most {MAX_BOOK_BYTES} bytes, not {codes} codes of {dims} numbers")


def codebook_matrix(codebook: DataFrame, code: str = "code", vector: str = "vector") -> np.ndarray:
    """Codes in order as a matrix; a table too large for a codebook is refused before it is read."""
    size = codebook.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    check_book(size["n"], size["d"] or 0)
    rows = codebook.select(code, vector).collect()
    rows.sort(key=lambda r: r[0])
    return np.array([r[1] for r in rows], dtype=np.float64)


def _nearest(values: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the closest code; |x|^2 is the same for all codes and left out."""
    scores = (book * book).sum(1)[None, :] - 2.0 * values @ book.T
    return np.round(scores, DIGITS).argmin(1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def quantise(df: DataFrame, vector: str, book: np.ndarray, out: str = "code") -> DataFrame:
    """Nearest code of each vector."""
    shared = df.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf(T.IntegerType())
    def nearest(column: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype="int32")
        return pd.Series(_nearest(_stack(column), shared.value).astype("int32"))

    return df.withColumn(out, nearest(F.col(vector)))


def dequantise(codes: DataFrame, codebook: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Code vectors by a lookup join on the code (and codebook) columns."""
    return codes.join(codebook, list(keys))


def rvq_encode(
    df: DataFrame, vector: str, books: Sequence[np.ndarray], n_q: int | None = None
) -> DataFrame:
    """Residual stages in one pass: columns ``codes`` and ``errors`` (mean squared error per stage)."""
    shared = df.sparkSession.sparkContext.broadcast(list(books[: n_q or len(books)]))
    schema = T.StructType(
        [
            T.StructField("codes", T.ArrayType(T.IntegerType())),
            T.StructField("errors", T.ArrayType(T.DoubleType())),
        ]
    )

    @F.pandas_udf(schema)
    def encode(column: pd.Series) -> pd.DataFrame:
        if len(column) == 0:
            return pd.DataFrame({"codes": [], "errors": []})
        residual = _stack(column)
        codes, errors = [], []
        for book in shared.value:
            picked = _nearest(residual, book)
            residual = residual - book[picked]
            codes.append(picked.astype("int32"))
            errors.append((residual**2).mean(1))
        return pd.DataFrame({"codes": list(np.stack(codes, 1)), "errors": list(np.stack(errors, 1))})

    return df.withColumn("__r", encode(F.col(vector))).select("*", "__r.codes", "__r.errors").drop("__r")


def rvq_decode(codes: DataFrame, books: DataFrame, item: str) -> DataFrame:
    """Sum of the code vectors over the stages: (item, dim, value).

    ``codes``: (item, q, code); ``books``: (q, code, dim, value), model-sized. The sums of
    ``DECODE_WIDTH`` dimensions are the columns of one group: a group for each number
    takes ten times the memory.
    """
    names = [f"__v{i}" for i in range(DECODE_WIDTH)]
    place, block = F.pmod("dim", F.lit(DECODE_WIDTH)), F.floor(F.col("dim") / F.lit(DECODE_WIDTH))
    wide = books.groupBy("q", "code", block.alias("__block")).agg(
        *[F.sum(F.when(place == i, F.col("value"))).alias(name) for i, name in enumerate(names)]
    )
    sums = codes.join(wide, ["q", "code"]).groupBy(item, "__block").agg(*[F.sum(name).alias(name) for name in names])
    cells = sums.select(item, "__block", F.posexplode(F.array(*names)).alias("__place", "value"))
    dim = (F.col("__block") * F.lit(DECODE_WIDTH) + F.col("__place")).cast(books.schema["dim"].dataType)
    # Books have no null values: a null is a dimension that the codes of the item do not have.
    return cells.filter(F.col("value").isNotNull()).select(item, dim.alias("dim"), "value")


def commitment_error(encoded: DataFrame) -> DataFrame:
    """Mean squared error per stage: (q, error)."""
    stages = encoded.select(F.posexplode("errors").alias("q", "e"))
    return stages.groupBy("q").agg(F.avg("e").alias("error"))


def init_centroids(df: DataFrame, vector: str, key: str, k: int, seed) -> np.ndarray:
    """k random rows; drawn with replacement when there are fewer than k rows."""
    check_book(k, df.agg(F.max(F.size(vector))).first()[0] or 0)
    rows = take_smallest(df.select(key, vector), k, uniform(seed, F.col(key)), [F.col(key)])
    picked = rows.withColumn("__u", uniform(seed, F.col(key))).collect()
    picked.sort(key=lambda r: (r["__u"], r[key]))
    values = np.array([r[vector] for r in picked], dtype=np.float64)
    if len(values) < k:
        digests = [hashlib.md5(f"{seed}|repeat|{i}".encode()).hexdigest() for i in range(k)]
        values = values[[int(d, 16) % len(values) for d in digests]]
    return values


def assignment_stats(df: DataFrame, vector: str, book: np.ndarray) -> DataFrame:
    """(code, dim, n, s): rows per code and sum per dimension under the nearest code.

    Each task adds its batches up before anything is shuffled, so a hot code is
    one partial row per task and dimension.
    """
    shared = df.sparkSession.sparkContext.broadcast(book)
    schema = "code int, n bigint, sums array<double>"

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        counts = np.zeros(len(centres), dtype=np.int64)
        sums = np.zeros_like(centres)
        for batch in batches:
            if len(batch) == 0:
                continue
            values = _stack(batch[vector])
            codes = _nearest(values, centres)
            counts += np.bincount(codes, minlength=len(centres))
            np.add.at(sums, codes, values)
        used = np.flatnonzero(counts)
        # A split without rows, as a file of few row groups has, yields nothing: Arrow refuses an empty list column.
        if len(used):
            yield pd.DataFrame({"code": used.astype("int32"), "n": counts[used], "sums": list(sums[used])})

    parts = df.select(vector).mapInPandas(partials, schema)
    cells = parts.select("code", "n", F.posexplode("sums").alias("dim", "s"))
    return cells.groupBy("code", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def packed_stats(stats: DataFrame) -> DataFrame:
    """(code, n, sums): the sums of a code as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "s")))
    return stats.groupBy("code").agg(F.max("n").alias("n"), F.transform(ordered, lambda x: x["s"]).alias("sums"))


def kmeans(df: DataFrame, vector: str, start: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd iterations: (means, counts of the last assignment).

    One packed row per code comes back in each iteration, a checked number of bytes,
    so the plan does not grow with the iterations and needs no checkpoint. An empty
    cluster keeps its mean.
    """
    means = np.array(start, dtype=np.float64)
    check_book(*means.shape)
    counts = np.zeros(len(means), dtype=np.int64)
    for _ in range(iterations):
        counts = np.zeros(len(means), dtype=np.int64)
        fresh = means.copy()
        for row in packed_stats(assignment_stats(df, vector, means)).toLocalIterator():
            counts[row["code"]] = row["n"]
            fresh[row["code"]] = np.array(row["sums"]) / row["n"]
        means = fresh
    return means, counts


def book_table(spark, book: np.ndarray, q: int | None = None) -> DataFrame:
    """(code, vector) or (q, code, vector) of a codebook matrix."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(book)]
    table = spark.createDataFrame(rows, "code int, vector array<double>")
    return table if q is None else table.withColumn("q", F.lit(q))


def long_books(spark, books: Sequence[np.ndarray]) -> DataFrame:
    """(q, code, dim, value) of several codebooks."""
    frames = [
        book_table(spark, b, q).select("q", "code", F.posexplode("vector").alias("dim", "value"))
        for q, b in enumerate(books)
    ]
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table


def laplace_smooth(df: DataFrame, value: str, n: int, eps: float = 1e-5) -> DataFrame:
    """(x + eps) / (sum + n * eps); the total is one row joined by a constant key."""
    total = df.agg(F.sum(value).alias("__t")).withColumn("__one", F.lit(1))
    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    smooth = (F.col(value) + F.lit(eps)) / (F.col("__t") + F.lit(n * eps))
    return joined.withColumn("smoothed", smooth).withColumn("total", F.col("__t")).drop("__one", "__t")


def codebook_ema(
    state: DataFrame, stats: DataFrame, decay: float, codes: int, eps: float = 1e-5
) -> DataFrame:
    """Next codebook state after one batch.

    ``state``: (code, dim, cluster_size, embed_avg); ``stats`` as returned by
    ``assignment_stats``. Columns of the result: code, dim, cluster_size,
    embed_avg, embed. Codes without a batch row decay.
    """
    joined = state.join(stats, ["code", "dim"], "left")
    size = F.col("cluster_size") * decay + F.coalesce(F.col("n"), F.lit(0)) * (1 - decay)
    avg = F.col("embed_avg") * decay + F.coalesce(F.col("s"), F.lit(0.0)) * (1 - decay)
    moved = joined.select("code", "dim", size.alias("cluster_size"), avg.alias("embed_avg"))
    sizes = laplace_smooth(moved.filter(F.col("dim") == 0).select("code", "cluster_size"), "cluster_size", codes, eps)
    smooth = sizes.select("code", (F.col("smoothed") * F.col("total")).alias("__size"))
    return (
        moved.join(smooth, "code")
        .withColumn("embed", F.col("embed_avg") / F.col("__size"))
        .drop("__size")
    )


def expire_codes(
    state: DataFrame, batch: DataFrame, vector: str, key: str, codes: int, threshold: float, seed
) -> DataFrame:
    """Codes with a cluster size below the threshold take a random batch vector; 0 is off.

    ``state``: (code, vector, cluster_size). Code i takes the i-th random row; a
    batch with fewer rows is reused from the start.
    """
    if threshold == 0:
        return state
    picked = init_centroids(batch, vector, key, codes, seed)
    fresh = book_table(state.sparkSession, picked).withColumnRenamed("vector", "__fresh")
    joined = state.join(fresh, "code", "left")
    dead = F.col("cluster_size") < F.lit(threshold)
    return joined.withColumn("vector", F.when(dead, F.col("__fresh")).otherwise(F.col("vector"))).drop("__fresh")


def codebook_usage(codes: DataFrame, bins: int, by: Sequence[str] = ("q",)) -> DataFrame:
    """Count of every code per codebook, zero for the unused ones."""
    counts = codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))
    books = codes.select(*by).distinct()
    every = books.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*by, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def bandwidth(n_q: Column, bins: Column, fps: Column) -> Column:
    """Kilobits per second of n_q codebooks."""
    return n_q * F.log2(bins) * fps / F.lit(1000.0)
