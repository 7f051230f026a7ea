import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell.llm import multi_index as mi
from tonewell.llm.common import documents

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rep long, cell int, at int, g int, links long, component string"


def brute(rows, threshold=0.95):
    """All pairs in plain doubles; rows of one id are one node."""
    width = max([len(v) for _, v in rows if v] + [1])
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.zeros(width)
        if ok:
            a[: len(v)] = np.asarray(v, np.float32).astype(float)
            a /= np.abs(a).max()
            a /= np.linalg.norm(a)
        unit.append(a if ok else None)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if unit[x] is not None and unit[y] is not None and unit[x] @ unit[y] >= threshold:
                n[x] += 1
                n[y] += 1
                a, b = sorted((find(rows[x][0]), find(rows[y][0])))
                root[b] = a
    out = []
    for (i, _), links in zip(rows, n, strict=True):
        c = None if i is None else find(i)
        out.append((i, links, c, i is None or c == i))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, "k", 1, 2, 3, 4, 5, "c") for i, v in rows], SCHEMA)
    return sorted(map(tuple, mi.near_duplicates(df, **more).collect()), key=str)


def clusters(seed, dims=32, groups=25, size=12, spread=0.18):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, size)):
            rows.append((centre + rng.normal(size=dims) * spread / math.sqrt(dims)).astype(np.float32).tolist())
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[i]) for i in order]


@pytest.mark.parametrize("block", [7, 2048])
def test_against_all_pairs(spark, block):
    rows = clusters(1) + [(1001, clusters(1)[0][1]), (1002, clusters(1)[0][1])]
    assert run(spark, rows, block=block, target_recall=1.0) == brute(rows)


def test_default_walk_finds_the_links(spark):
    """Near the threshold and far below it, at several sizes: the share of links found."""
    for seed, spread in ((2, 0.1), (3, 0.2)):
        rows = clusters(seed, groups=120, size=20, spread=spread)
        found, want = sum(r[1] for r in run(spark, rows)), sum(r[1] for r in brute(rows))
        assert want > 100 and want >= found >= 0.99 * want


def test_one_cell_holds_all(spark):
    """A group of near copies many blocks wide: counts stay whole, components are one."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.02).tolist()) for i in range(90)]
    got = run(spark, rows, block=10)
    assert got == brute(rows)
    assert all(r[1] == 89 and r[2] == 0 for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [1.0, nan, 0.0]), (8, [1.0, None, 0.0]), (9, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (None, None),
        (10, [-1.0, 0.0, 0.0]), (11, [0.0, 1e30, 0.0]), (12, [-0.0, 1e-30, 0.0]), (13, [0.0, 0.0, 1.0]),
        (13, [0.0, 0.0, 1.0]), (13, [0.0, 1.0, 0.0]), (-5, [0.0, 0.0, 3.0]),
    ]
    assert run(spark, rows, target_recall=1.0) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(4, None), (5, None)]) == [(4, 0, 4, True), (5, 0, 5, True)]
    assert run(spark, rows[:1]) == [(1, 0, 1, True)]


def test_doubles_and_other_names(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-9]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id int, v array<double>")
    got = mi.near_duplicates(rows, "id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_batches_of_one_row(spark, data):
    vectors = documents(spark, data, "embeddings").limit(40)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def test_walk_is_in_order_and_whole():
    """The walk gives every cell up to the stop once, nearest first; bounds never exceed distances."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = mi.MultiIndex(mi.kmeans(x[:, :4], 6), mi.kmeans(x[:, 4:], 5))
    (a, b), cell = index.bounds(x)
    for i in range(0, 200, 17):
        total = a[i][:, None] + b[i][None]
        walk = index.traverse(a[i], b[i], 0.3)
        values = [total.ravel()[c] for c in walk]
        assert values == sorted(values) and sorted(walk) == np.flatnonzero(total.ravel() <= 0.3).tolist()
        assert walk[0] == cell[i]
        square = ((x - x[i]) ** 2).sum(1)
        assert (total.ravel()[cell] <= square + 1e-9).all()


def test_recall_on_the_given_table(spark, data):
    vectors = documents(spark, data, "embeddings")
    noise = vectors.select(
        (F.col("vec_id") + 100_000).alias("vec_id"),
        F.transform("embedding", lambda x, i: x + 0.02 * F.sin(i * 7 + F.col("vec_id"))).cast("array<float>").alias("embedding"),
    )
    both = vectors.select("vec_id", "embedding").union(noise)
    got = sorted(map(tuple, mi.near_duplicates(both).collect()))
    want = brute([(r["vec_id"], r["embedding"]) for r in both.collect()])
    found, links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert links >= 0.9 * vectors.count() and links >= found >= 0.99 * links
