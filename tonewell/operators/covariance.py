"""Mean, covariance and Fréchet distance of embedding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.operators import block_matrices

# Open groups per task before the partial sums are handed on.
FLUSH_GROUPS = 64


def gram(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Sums of products per group: (by, i, j, s) for i <= j.

    Index -1 stands for the constant 1, so (-1, -1) is the row count and (-1, j)
    the sum of dimension j. Each task adds its Arrow batches up as one matrix
    product per group; only dim * dim partial sums per task are shuffled.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_groups: dict = {}

        def rows(group, matrix):
            i, j = np.triu_indices(matrix.shape[0])
            return pd.DataFrame({by: [group] * len(i), "i": i - 1, "j": j - 1, "s": matrix[i, j]})

        for batch in batches:
            for group, part in batch.groupby(by, dropna=False):
                values = np.stack(part["__v"].to_numpy()).astype(np.float64)
                values = np.hstack([np.ones((len(values), 1)), values])
                product = values.T @ values
                open_groups[group] = open_groups.get(group, 0) + product
            if len(open_groups) > FLUSH_GROUPS:
                for group, matrix in open_groups.items():
                    yield rows(group, matrix)
                open_groups.clear()
        for group, matrix in open_groups.items():
            yield rows(group, matrix)

    kind = df.schema[by].dataType
    schema = T.StructType(
        [
            T.StructField(by, kind),
            T.StructField("i", T.IntegerType()),
            T.StructField("j", T.IntegerType()),
            T.StructField("s", T.DoubleType()),
        ]
    )
    parts = df.select(by, F.col(vector).alias("__v")).mapInPandas(partials, schema)
    return parts.groupBy(by, "i", "j").agg(F.sum("s").alias("s"))


def embedding_mean_cov(df: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, i, j, n, mean_i, mean_j, cov) for i <= j, sample covariance."""
    sums = gram(df, vector, by)
    counts = sums.filter((F.col("i") == -1) & (F.col("j") == -1)).select(by, F.col("s").alias("n"))
    firsts = sums.filter((F.col("i") == -1) & (F.col("j") >= 0)).select(
        by, F.col("j").alias("k"), F.col("s").alias("t")
    )
    left = firsts.select(by, F.col("k").alias("i"), F.col("t").alias("ti"))
    right = firsts.select(by, F.col("k").alias("j"), F.col("t").alias("tj"))
    pairs = sums.filter(F.col("i") >= 0)
    joined = pairs.join(counts, by).join(left, [by, "i"]).join(right, [by, "j"])
    cov = F.when(F.col("n") > 1, (F.col("s") - F.col("ti") * F.col("tj") / F.col("n")) / (F.col("n") - 1))
    return joined.select(
        by,
        "i",
        "j",
        F.col("n").cast("bigint").alias("n"),
        (F.col("ti") / F.col("n")).alias("mean_i"),
        (F.col("tj") / F.col("n")).alias("mean_j"),
        cov.alias("cov"),
    )


def _dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    size = int(rows["j"].max()) + 1
    mean, cov = np.zeros(size), np.zeros((size, size))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    cov[i, j] = cov[j, i] = rows["cov"].to_numpy()
    mean[i] = rows["mean_i"].to_numpy()
    return mean, cov


def _distance(rows: pd.DataFrame) -> float:
    mean1, cov1 = _dense(rows[rows["side"] == 0])
    mean2, cov2 = _dense(rows[rows["side"] == 1])
    # The product of two covariances has real, non-negative eigenvalues; tiny
    # negative ones are rounding.
    eigen = np.linalg.eigvals(cov1 @ cov2).real
    cross = np.sqrt(np.clip(eigen, 0.0, None)).sum()
    return float(((mean1 - mean2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2.0 * cross)


def frechet_distance(
    test: DataFrame, background: DataFrame, vector: str, by: str, dense_width: int = 1024, side: int = 512
) -> DataFrame:
    """(by, distance) between two embedding sets with full covariances.

    Up to ``dense_width`` dimensions the moments of a group, not its vectors, reach one
    task. Wider matrices are tables of blocks of ``side`` rows (``block_matrices``), and no
    task ever holds one.
    """
    width = test.agg(F.max(F.size(vector))).first()[0] or 0
    if width > dense_width:
        return block_matrices.frechet_distance(test, background, vector, by, width, side)
    kind = test.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), T.StructField("distance", T.DoubleType())])
    moments = embedding_mean_cov(test, vector, by).withColumn("side", F.lit(0))
    moments = moments.unionByName(embedding_mean_cov(background, vector, by).withColumn("side", F.lit(1)))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        # A group of one side only has no distance.
        if rows["side"].nunique() < 2:
            return pd.DataFrame({by: [], "distance": []})
        return pd.DataFrame({by: [rows[by].iloc[0]], "distance": [_distance(rows)]})

    return moments.groupBy(by).applyInPandas(solve, schema)


def diagonal_moments(df: DataFrame, vector: str, by: str) -> DataFrame:
    cells = df.select(by, F.posexplode(vector).alias("dim", "v"))
    value = F.col("v").cast("double")
    return cells.groupBy(by, "dim").agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def frechet_distance_diagonal(test: DataFrame, background: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, distance) with diagonal covariances, built-in expressions only."""
    a = diagonal_moments(test, vector, by).select(by, "dim", F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = diagonal_moments(background, vector, by).select(
        by, "dim", F.col("mean").alias("m2"), F.col("var").alias("v2")
    )
    gap = F.col("m1") - F.col("m2")
    term = gap * gap + F.col("v1") + F.col("v2") - F.lit(2.0) * F.sqrt(F.col("v1") * F.col("v2"))
    return a.join(b, [by, "dim"]).groupBy(by).agg(F.sum(term).alias("distance"))


def feature_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, n, mean, std) of all rows from count, sum and sum of squares; the variance is floored at 0."""
    cells = df.select(F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    sums = cells.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2")
    )
    return sums.select("dim", "n", *mean_std(F.col("n"), F.col("s1"), F.col("s2")))


def mean_std(n, s1, s2):
    mean = s1 / n
    return mean.alias("mean"), F.sqrt(F.greatest(s2 / n - mean * mean, F.lit(0.0))).alias("std")


def _packed(stats: DataFrame) -> DataFrame:
    """One row: arrays of mean and std in dimension order (one entry per dimension)."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(
        F.transform(ordered, lambda x: x["mean"]).alias("__mean"),
        F.transform(ordered, lambda x: x["std"]).alias("__std"),
    ).withColumn("__one", F.lit(1))


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(_packed(stats)), "__one")


def standardise(df: DataFrame, stats: DataFrame, vector: str) -> DataFrame:
    """(x - mean) / std per dimension."""
    z = F.arrays_zip(F.col(vector).alias("x"), F.col("__mean").alias("m"), F.col("__std").alias("s"))
    out = F.transform(z, lambda e: (e["x"] - e["m"]) / F.greatest(e["s"], F.lit(1e-12)))
    return _with_stats(df, stats).withColumn(vector, out).drop("__one", "__mean", "__std")


def unstandardise(df: DataFrame, stats: DataFrame, vector: str) -> DataFrame:
    """x * std + mean per dimension."""
    z = F.arrays_zip(F.col(vector).alias("x"), F.col("__mean").alias("m"), F.col("__std").alias("s"))
    out = F.transform(z, lambda e: e["x"] * F.greatest(e["s"], F.lit(1e-12)) + e["m"])
    return _with_stats(df, stats).withColumn(vector, out).drop("__one", "__mean", "__std")


def rescale(df: DataFrame, stats: DataFrame, vector: str, target_std: float, power: float = 1.0) -> DataFrame:
    """(x - mean) * (target / std) ** power per dimension."""
    z = F.arrays_zip(F.col(vector).alias("x"), F.col("__mean").alias("m"), F.col("__std").alias("s"))
    out = F.transform(
        z,
        lambda e: (e["x"] - e["m"])
        * F.pow(F.lit(target_std) / F.greatest(e["s"], F.lit(1e-12)), F.lit(power)),
    )
    return _with_stats(df, stats).withColumn(vector, out).drop("__one", "__mean", "__std")


def orthogonality(codebook: DataFrame, vector: str, active: DataFrame | None = None, max_codes: int | None = None, seed=0) -> DataFrame:
    """Sum of (cosine - identity)^2 over n^2, without forming the n * n pairs.

    The sum of all squared cosines is the squared norm of the dim * dim product
    of the normalised codes. ``active`` keeps only the codes listed there,
    ``max_codes`` a random subset.
    """
    from tonewell.functions import arrays as A
    from tonewell.operators.corpus import random_subset

    rows = codebook
    if active is not None:
        rows = rows.join(active.select("code").distinct(), "code", "left_semi")
    if max_codes is not None:
        rows = random_subset(rows, max_codes, seed, "code")
    unit = rows.select(F.lit(0).alias("g"), A.l2_normalise(A.doubles(F.col(vector))).alias("u"))
    sums = gram(unit, "u", "g")
    inner = F.col("i") >= 0
    square = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("s") * F.col("s")
    n = F.max(F.when((F.col("i") == -1) & (F.col("j") == -1), F.col("s")))
    trace = F.sum(F.when(inner & (F.col("i") == F.col("j")), F.col("s")))
    total = F.sum(F.when(inner, square))
    return sums.agg(((total - F.lit(2.0) * trace + n) / (n * n)).alias("loss"), n.cast("bigint").alias("codes"))
