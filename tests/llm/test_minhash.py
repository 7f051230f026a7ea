import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import tables
from tonewell.llm import bbit_minhash as mh
from tonewell.llm.common import components


def shingles(text):
    raw = (text or "").encode()
    words = raw.lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, threshold=85):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = []
    for i, text in rows:
        c = None if i is None else find(i)
        out.append((i, len(shingles(text)), c, True if i is None else c == i))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, u long, component long, id long")
    return sorted(map(tuple, mh.near_duplicates(df).collect()), key=str)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def test_edges(spark):
    rows = [r[:2] for r in tables.rows()]
    assert run(spark, rows) == brute(rows)
    assert mh.near_duplicates(tables.empty(spark)).collect() == []


def test_chains_and_groups(spark):
    """Neighbours of a chain are links, its ends are not; copies differ in one or a few words."""
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(8):
            rows.append((i, " ".join(words)))
            i += 1
            words = edited(words, rng, 2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(40):
        rows.append((i, " ".join(edited(base, rng, rng.randint(0, 4)))))
        i += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_one_document_stays(spark):
    docs = tables.docs(spark)
    kept = mh.without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    want = sorted((i for i, _, _, k in set(brute([r[:2] for r in tables.rows()])) if k and i is not None), key=str)
    assert [x for x in got if x is not None] == sorted(want, key=str) and got.count(None) == 2


def test_estimate_is_corrected_for_chance(spark):
    family = mh.hash_family()
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85, 1.0):
        got = []
        for _ in range(10):
            both = rng.integers(0, 1 << 63, 1000, np.uint64)
            n = int(1000 * 2 * share / (1 + share))
            other = np.r_[both[:n], rng.integers(0, 1 << 63, 1000 - n, np.uint64)]
            a, b = (mh.packed(mh.minima(np.unique(x), family)).view(np.int64).tolist() for x in (both, other))
            got.append((a, b))
        df = spark.createDataFrame(got, "a array<long>, b array<long>")
        mean = df.agg(F.avg(mh.estimate(F.col("a"), F.col("b")))).first()[0]
        assert abs(mean - share) < 0.05


def test_every_two_components_of_a_bucket_meet(spark):
    """Small blocks, one large component: links are found across all cells, and connect what they should."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    family = mh.hash_family()
    rows, sets = [], {}
    for i in range(60):
        s = mh.shingle_sets([" ".join(edited(base, rng, rng.randint(0, 4)))])[0]
        values = mh.minima(s, family)
        sets[i] = s
        # buckets made by hand: all classes share the first band
        bands = [1, *(1000 * (i + 1) + j for j in range(mh.BANDS - 1))]
        rows.append((1, i, 100 if i % 3 else i, bands, mh.packed(values).view(np.int64).tolist(), s.tobytes()))
    df = spark.createDataFrame(rows, "bucket long, rep long, component long, bands array<long>, low_bits array<long>, shingles binary")
    component = {r[1]: r[2] for r in rows}
    link = {(a, b) for a in sets for b in sets if a < b and mh.similar(sets[a], sets[b], 85) and component[a] != component[b]}
    still = {r["rep"] for r in mh.open_members(df.drop("shingles"), 85, block=7).collect()}
    assert {x for pair in link for x in pair} <= still
    got = {tuple(sorted(r)) for r in mh.open_links(df, 85, block=7).collect()}
    assert got <= link

    def merged(pairs):
        root = {c: c for c in component.values()}
        for _ in range(100):
            for a, b in pairs:
                x, y = component[a], component[b]
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert merged(got) == merged(link)


def test_a_pair_belongs_to_its_first_common_band(spark):
    bits = [0] * 12
    shingles = np.arange(10, dtype=np.uint64).tobytes()
    rows = [(bucket, rep, rep, [5, 6, *(100 * rep + j for j in range(mh.BANDS - 2))], bits, shingles) for bucket in (5, 6) for rep in (1, 2)]
    df = spark.createDataFrame(rows, "bucket long, rep long, component long, bands array<long>, low_bits array<long>, shingles binary")
    assert {tuple(r) for r in mh.open_members(df.drop("shingles"), 85).collect()} == {(5, 1), (5, 2)}
    assert mh.open_links(df, 85).count() == 1


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == root[x] for x in root)
