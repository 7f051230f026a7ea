import math

import numpy as np

from tonewell.llm import maxscore


def brute(rows, k):
    whole = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = [math.floor(64 * float(x)) for x in v]
        whole[vec_id] = min(whole.get(vec_id, e), e)
    out = []
    for q, a in whole.items():
        if q % 20 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in whole.items() if c != q)
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(hits[:k])]
    return sorted(out)


def run(spark, rows, k=20, **sizes):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score long, rank int")
    terms = maxscore.quantised(df, "vec_id", "embedding")
    out = maxscore.top_k(terms.filter("vec_id % 20 = 0"), terms, k, **sizes).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out)


def vectors(n, dim, seed=0, skew=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dim))
    if skew:
        v[:, 3:] *= 0.05  # few strong terms: the others are non-essential
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def test_against_brute_force(spark):
    for skew in (False, True):
        rows = vectors(300, 12, 1, skew)
        assert run(spark, rows, shard_rows=60, block_rows=5) == brute(rows, 20)


def test_ties_and_repeats(spark):
    rows = [(i, [0.5, -0.25]) for i in range(60)] + [(7, [0.5, -0.25]), (7, [0.1, 0.1])]
    assert run(spark, rows, k=5, shard_rows=16) == brute(rows, 5)


def test_broken_vectors(spark):
    rows = vectors(50, 4) + [(100, None), (120, [1.0, None, 0.0, 0.0]), (140, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(160, [math.nan, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (180, []), (200, [1.0])]
    assert run(spark, rows) == brute(rows, 20)


def test_large_values(spark):
    rows = [(0, [1e7, -3e6]), (1, [2e6, 1.0]), (2, [5e6, 5e6]), (3, [-4e6, 9e6])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows, 20)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_probing_term_by_term():
    """Both ways to probe the non-essential terms give the same hits."""
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(0, 10, (2000, 16)) * np.r_[np.full(4, 5.0), np.ones(12)])
    ids = np.arange(2000)
    few = [x.tolist() for x in maxscore.search_block(c[:40], ids[:40], c, ids, 10, dense=0)]
    many = [x.tolist() for x in maxscore.search_block(c[:40], ids[:40], c, ids, 10, dense=10**9)]
    full = c[:40] @ c.T
    full[np.arange(40), np.arange(40)] = -np.inf
    want = [j for i in range(40) for j in np.lexsort((ids, -full[i]))[:10]]
    assert few == many and few[1] == want
