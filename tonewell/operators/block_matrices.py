"""Square matrices of any width as tables of blocks, one matrix per group.

A row is a block: (group, i, j, cells), its cells row by row as packed doubles. A product
joins the blocks of a column with those of a row and adds up what meets; no task ever
holds more than a strip, a block's side times the width. Missing blocks are zero.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.session import written

#: Values of the vectors that a task holds at a time while it adds up their products.
STRIP_VALUES = 2_000_000


def schema(df: DataFrame, by: str) -> str:
    return f"`{by}` {df.schema[by].dataType.simpleString()}, i int, j int, cells binary"


def block(cells: bytes, side: int) -> np.ndarray:
    return np.frombuffer(cells, np.float64).reshape(-1, side)


def summed(blocks: DataFrame, by: str) -> DataFrame:
    """One block per place: the sum of those given. Spark sums the cells of a place in parts first."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.float64) for c in rows["cells"]], axis=0)
        return pd.DataFrame({by: rows[by].iloc[:1], "i": rows["i"].iloc[:1], "j": rows["j"].iloc[:1], "cells": [total.tobytes()]})

    return blocks.groupBy(by, "i", "j").applyInPandas(add, schema(blocks, by))


def products_of_rows(df: DataFrame, vector: str, by: str, width: int, side: int) -> DataFrame:
    """Blocks of the sum of v v' over the rows of each group, with the constant 1 as value ``width`` of v.

    The rows of a group are dealt by a salt, and each is multiplied strip by strip.
    """
    strips, full = -(-(width + 1) // side), -(-(width + 1) // side) * side
    rows = max(1, STRIP_VALUES // full)
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    parts = n.select(F.col(by).alias("__by"), F.ceil(F.col("__n") / rows).cast("int").alias("__parts"))
    dealt = df.select(by, F.col(vector).cast("array<double>").alias("__v")).join(parts, F.col(by).eqNullSafe(F.col("__by")))
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.col("__parts")))
    strip = F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("i")

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), full))
        x[:, :width] = np.stack(group["__v"].to_numpy())
        x[:, width] = 1.0
        i = int(group["i"].iloc[0])
        made = x[:, i * side : (i + 1) * side].T @ x
        cells = [np.ascontiguousarray(made[:, j * side : (j + 1) * side]).tobytes() for j in range(strips)]
        return pd.DataFrame({by: [group[by].iloc[0]] * strips, "i": [i] * strips, "j": range(strips), "cells": cells})

    spread = dealt.select(by, "__v", "__salt", strip)
    return summed(spread.groupBy(by, "__salt", "i").applyInPandas(multiply, schema(df, by)), by)


def product(a: DataFrame, b: DataFrame, by: str, side: int) -> DataFrame:
    """Blocks of a b: column k of ``a`` meets row k of ``b``."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        ys = [(j, block(c, side)) for j, c in zip(right["__j"], right["__cells"], strict=True)]
        for group, i, cells in zip(left[by], left["i"], left["cells"], strict=True):
            x = block(cells, side)
            rows += [(group, i, j, (x @ y).tobytes()) for j, y in ys]
        return pd.DataFrame(rows, columns=[by, "i", "j", "cells"])

    left = a.withColumn("__k", F.col("j"))
    # names of their own: both sides may come from one table
    right = b.select(*[F.col(c).alias(n) for c, n in ((by, "__by"), ("i", "__i"), ("j", "__j"), ("cells", "__cells"))])
    met = left.groupBy(by, "__k").cogroup(right.groupBy("__by", "__i")).applyInPandas(meet, schema(a, by))
    return summed(met, by)


def scaled(blocks: DataFrame, by: str, side: int, factors: DataFrame | None = None, factor: float = 1.0, diagonal: float = 0.0) -> DataFrame:
    """``factor`` times the matrix, times the group's own ``__f`` in ``factors``, plus ``diagonal`` on the diagonal.

    The diagonal is added to blocks that are there.
    """
    if factors is not None:
        own = factors.select(F.col(by).alias("__by"), "__f")
        blocks = blocks.join(own, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    else:
        blocks = blocks.withColumn("__f", F.lit(1.0))

    def apply(batches):
        for batch in batches:
            cells = []
            for i, j, f, c in zip(batch["i"], batch["j"], batch["__f"], batch["cells"], strict=True):
                x = block(c, side) * (factor * f)
                if i == j and diagonal:
                    x = x + diagonal * np.eye(side)
                cells.append(x.tobytes())
            yield batch.assign(cells=cells).drop(columns="__f")

    return blocks.select(by, "i", "j", "cells", "__f").mapInPandas(apply, schema(blocks, by))


def identity(blocks: DataFrame, by: str, strips: int, side: int) -> DataFrame:
    """The unit matrix of each group, all blocks of it."""
    places = F.sequence(F.lit(0), F.lit(strips - 1))
    every = blocks.select(by).distinct().withColumn("i", F.explode(places)).withColumn("j", F.explode(places))
    one, none = np.eye(side).tobytes(), np.zeros((side, side)).tobytes()
    return every.withColumn("cells", F.when(F.col("i") == F.col("j"), F.lit(one)).otherwise(F.lit(none)))


def diagonal_and_squares(blocks: DataFrame, by: str, side: int) -> DataFrame:
    """(by, trace, squares): the sum of the diagonal and of all squared cells."""

    def measure(batches):
        for batch in batches:
            x = [block(c, side) for c in batch["cells"]]
            trace = [float(np.trace(m)) if i == j else 0.0 for i, j, m in zip(batch["i"], batch["j"], x, strict=True)]
            yield pd.DataFrame({by: batch[by], "t": trace, "s": [float((m * m).sum()) for m in x]})

    kind = blocks.schema[by].dataType.simpleString()
    parts = blocks.select(by, "i", "j", "cells").mapInPandas(measure, f"`{by}` {kind}, t double, s double")
    return parts.groupBy(by).agg(F.sum("t").alias("trace"), F.sum("s").alias("squares"))


def root_trace(matrix: DataFrame, by: str, strips: int, side: int, tolerance: float = 1e-8, most: int = 40) -> DataFrame:
    """(by, root_trace): the trace of the square root of matrices with real eigenvalues of zero or more.

    Newton-Schulz: with Y = A / |A| and Z = 1, T = (3 - Z Y) / 2, then Y T and T Z. A group
    leaves as soon as its trace moves by no more than ``tolerance`` of itself: rounding in
    the directions of eigenvalue zero would grow from then on. Every step is written; one
    number per step reaches the driver.
    """
    norms = written(diagonal_and_squares(matrix, by, side).select(by, F.sqrt("squares").alias("norm")), "norms")
    inverse = norms.select(by, F.when(F.col("norm") > 0, 1 / F.col("norm")).otherwise(0.0).alias("__f"))
    tag = lambda df, name: df.withColumn("of", F.lit(name))
    own = F.col(by).eqNullSafe(F.col("__by"))
    y = scaled(matrix, by, side, inverse)
    state = written(tag(y, "y").unionByName(tag(identity(matrix, by, strips, side), "z")), "root-0")
    old = norms.select(F.col(by).alias("__by"), F.lit(None).cast("double").alias("__t"))
    done = None
    for step in range(1, most + 1):
        y, z = (state.filter(F.col("of") == name).drop("of") for name in "yz")
        t = written(scaled(product(z, y, by, side), by, side, factor=-0.5, diagonal=1.5), f"factor-{step}")
        state = written(tag(product(y, t, by, side), "y").unionByName(tag(product(t, z, by, side), "z")), f"root-{step}")
        now = diagonal_and_squares(state.filter("of = 'y'").drop("of"), by, side).select(by, "trace")
        still = F.coalesce(F.abs(F.col("trace") - F.col("__t")) <= tolerance * F.abs(F.col("trace")), F.lit(False))
        now = written(now.join(old, own).select(by, "trace", (still | F.lit(step == most)).alias("still")), f"trace-{step}")
        ready = now.filter("still").select(by, "trace")
        done = ready if done is None else done.unionByName(ready)
        old = now.filter("NOT still").select(F.col(by).alias("__by"), F.col("trace").alias("__t"))
        if not old.limit(1).count():
            break
        state = state.join(old.select("__by"), own, "left_semi")
    root = norms.join(done.select(F.col(by).alias("__by"), "trace"), own)
    return root.select(by, (F.sqrt("norm") * F.col("trace")).alias("root_trace"))


def covariance_blocks(df: DataFrame, vector: str, by: str, width: int, side: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of the sample covariance, (by, n, mean as cells of each strip)) of each group with two rows or more."""
    sums = written(products_of_rows(df, vector, by, width, side), "products")
    last, place = width // side, width % side

    def strip_means(batches):
        for batch in batches:
            means = [block(c, side)[:, place].tobytes() for c in batch["cells"]]
            yield batch[[by, "i"]].assign(means=means)

    kind = df.schema[by].dataType.simpleString()
    strips = sums.filter(F.col("j") == last).mapInPandas(strip_means, f"`{by}` {kind}, i int, means binary")
    strips = written(strips, "strip-sums")
    corner = strips.filter(F.col("i") == last)

    def count(batches):
        for batch in batches:
            yield pd.DataFrame({by: batch[by], "n": [np.frombuffer(c, np.float64)[place] for c in batch["means"]]})

    n = written(corner.mapInPandas(count, f"`{by}` {kind}, n double").filter("n > 1"), "counts")
    named = lambda c, i, m: strips.select(F.col(by).alias(c), F.col("i").alias(i), F.col("means").alias(m))
    joined = (
        sums.join(n.select(F.col(by).alias("__n0"), "n"), F.col(by).eqNullSafe(F.col("__n0")))
        .join(named("__l", "__li", "left"), F.col(by).eqNullSafe(F.col("__l")) & (F.col("i") == F.col("__li")))
        .join(named("__r", "__ri", "right"), F.col(by).eqNullSafe(F.col("__r")) & (F.col("j") == F.col("__ri")))
        .select(by, "i", "j", "cells", "n", "left", "right")
    )

    def centre(batches):
        for batch in batches:
            cells = []
            for i, j, c, rows, left, right in zip(*(batch[k] for k in ("i", "j", "cells", "n", "left", "right")), strict=True):
                x = block(c, side) - np.outer(np.frombuffer(left), np.frombuffer(right)) / rows
                x /= rows - 1
                # the constant, and what only fills the last strip, is no dimension
                x[max(0, width - i * side) :, :] = 0
                x[:, max(0, width - j * side) :] = 0
                cells.append(x.tobytes())
            yield batch[[by, "i", "j"]].assign(cells=cells)

    means = strips.join(n.select(F.col(by).alias("__n0"), "n"), F.col(by).eqNullSafe(F.col("__n0"))).drop("__n0")
    return written(joined.mapInPandas(centre, schema(df, by)), "covariance"), means


def frechet_distance(test: DataFrame, background: DataFrame, vector: str, by: str, width: int, side: int = 512) -> DataFrame:
    """(by, distance) between two embedding sets with full covariances, for vectors of any ``width``.

    A group with fewer than two rows on a side has no distance.
    """
    strips = math.ceil((width + 1) / side)
    (one, mean1), (two, mean2) = (covariance_blocks(df, vector, by, width, side) for df in (test, background))
    shared = one.select(by).distinct().join(two.select(F.col(by).alias("__by")).distinct(), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    one = one.join(shared.select(F.col(by).alias("__by")), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    crossed = written(product(one, two, by, side), "crossed")
    crossed = crossed.join(shared.select(F.col(by).alias("__by")), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    root = root_trace(crossed, by, strips, side)

    def gap(batches):
        for batch in batches:
            gaps = []
            for i, n1, m1, n2, m2 in zip(*(batch[k] for k in ("i", "n", "means", "n2", "means2")), strict=True):
                d = (np.frombuffer(m1) / n1 - np.frombuffer(m2) / n2)[: max(0, width - i * side)]
                gaps.append(float(d @ d))
            yield pd.DataFrame({by: batch[by], "gap": gaps})

    kind = test.schema[by].dataType.simpleString()
    other = mean2.select(F.col(by).alias("__by"), F.col("i").alias("__i"), F.col("n").alias("n2"), F.col("means").alias("means2"))
    both = mean1.join(other, F.col(by).eqNullSafe(F.col("__by")) & (F.col("i") == F.col("__i")))
    gaps = both.select(by, "i", "n", "means", "n2", "means2").mapInPandas(gap, f"`{by}` {kind}, gap double")
    total = gaps.groupBy(by).agg(F.sum("gap").alias("gap"))
    for name, matrix in (("t1", one), ("t2", two)):
        trace = diagonal_and_squares(matrix, by, side).select(F.col(by).alias("__by"), F.col("trace").alias(name))
        total = total.join(trace, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    total = total.join(root.select(F.col(by).alias("__by"), "root_trace"), F.col(by).eqNullSafe(F.col("__by")))
    return total.select(by, (F.col("gap") + F.col("t1") + F.col("t2") - 2 * F.col("root_trace")).alias("distance"))
