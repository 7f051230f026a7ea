import hashlib
import random

import numpy as np
import pytest

from tests.llm import tables
from tonewell.llm import suffix_dedup as sd


def brute(rows):
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for p in range(len(raw) - 49):
                least[raw[p : p + 50]] = min(least.get(raw[p : p + 50], i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49 if i is not None else 0):
            if least[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def shared_texts(seed):
    rng = random.Random(seed)
    letters = "abé \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("cdefgh ") for _ in range(rng.randint(1, 90))))
        rows.append((rng.randrange(200) if i % 7 else 3, "".join(parts)))
    return rows + [(500, "z" * 400), (501, "z" * 70), (502, "z" * 49), (2, "yz" * 60), (600, "yz" * 40)]


@pytest.mark.parametrize(("hot", "shard"), [(4096, 1 << 21), (1, 600), (2, 3000), (10**6, 600)])
def test_against_brute_force(spark, hot, shard):
    rows = shared_texts(hot % 97)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sd.repeats(df, shard_bytes=shard, part_bytes=4000, hot=hot).collect()))
    assert got == sorted(r[:5] for r in brute(rows))


def test_edges(spark):
    rows = [r[:2] for r in tables.rows()]
    got = sorted(map(tuple, sd.repeats(tables.docs(spark)).collect()), key=str)
    assert got == sorted((r[:5] for r in brute(rows)), key=str)
    assert sd.repeats(tables.empty(spark)).collect() == []
    assert sd.without_repeats(tables.empty(spark)).collect() == []


def test_texts(spark):
    docs = tables.docs(spark)
    left = sd.without_repeats(docs)
    assert left.columns == docs.columns and left.schema == docs.schema or left.columns == docs.columns
    want = sorted(
        (str(r[:1] + (None if r[1] is None else b[5].decode("utf-8", "ignore"),) + r[2:]))
        for r, b in zip(tables.rows(), brute([r[:2] for r in tables.rows()]), strict=True)
    )
    assert sorted(str(tuple(r)) for r in left.collect()) == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for text in (rng.integers(1, 4, 300), np.ones(100, int), np.r_[rng.integers(0, 256, 50), np.zeros(40, int)], np.array([5])):
        symbols = text.astype(np.uint16)
        order = sd.suffix_array(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        prefix = sd.common_prefixes(symbols, order, np.array([0]), np.array([len(symbols)]), 10**4)
        for a, b in zip(order, order[1:], strict=False):
            x, y = symbols[a:].tolist() + [-1], symbols[b:].tolist() + [-2]
            # where a suffix ends, the sentinel stands for symbol 0
            assert prefix[b] >= next(i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v)


def test_every_string_holds_an_anchor():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 101, 3000).astype(np.uint8)
    ends = np.array([700, 740, 1500, 1500, 3000])
    place, _ = sd.anchors(text, ends, np.ones(5, bool))
    flags = np.zeros(3001, bool)
    flags[place] = True
    starts = np.r_[0, ends[:-1]]
    for a, b in zip(starts, ends, strict=True):
        for p in range(a, b - 49):
            assert flags[p : p + sd.LEFT + 1].any()
