import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tests.llm import tables
from tonewell.llm import periodic_runs as pr
from tonewell.llm import queries
from tonewell.llm.common import documents, text_session


def brute(words):
    """Every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + q
                if length >= max(6, 4 * q):
                    out.setdefault((start, length), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return (text or "").encode().split()


def digest_row(doc_id, words):
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, words):
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, runs long, collapsed string, best int")


def run(spark, rows, rewrite=None):
    return sorted(map(tuple, pr.digests(pr.runs(frame(spark, rows), rewrite)).collect()), key=str)


def test_all_short_binary_texts():
    """Every text of up to 12 words over two words."""
    lists = [[(x >> i) & 1 for i in range(n)] for n in range(13) for x in range(1 << n)]
    assert pr.text_runs(lists) == [brute(w) for w in lists]


def test_random_texts():
    rng = random.Random(1)
    for _ in range(800):
        lists = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 70))]
            if words and rng.random() < 0.6:
                a, p = rng.randrange(len(words)), rng.randint(1, 12)
                words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
            lists.append(words)
        assert pr.text_runs(lists) == [brute(w) for w in lists]


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    words = [rng.randrange(3) for _ in range(300)]
    import numpy as np

    codes = np.array(words)
    order, shared = pr.suffix_array(codes, np.zeros(300, np.int64), 300 - np.arange(300))
    ordered = order.tolist()
    assert ordered == sorted(ordered, key=lambda i: words[i:])
    for (a, b), n in zip(zip(ordered, ordered[1:]), shared[1:].tolist()):
        want = 0
        while max(a, b) + want < 300 and words[a + want] == words[b + want]:
            want += 1
        assert n == want


def test_edges(spark):
    rows = [r[:2] for r in tables.rows()]
    assert run(spark, rows) == sorted((digest_row(i, split(t)) for i, t in rows), key=str)
    assert run(spark, rows, queries.planted_tail) == sorted((digest_row(i, planted(i, split(t))) for i, t in rows), key=str)
    assert run(spark, []) == []


@pytest.mark.parametrize("n", range(11))
def test_few_words(spark, n):
    for word in ("a", "b c"):
        rows = [(1, " ".join([word] * n))]
        assert run(spark, rows) == [digest_row(1, split(rows[0][1]))]


def test_real_outputs(spark):
    got = pr.runs(frame(spark, [(5, "x a b a b a b a b y z z z z z z")])).first()
    assert got["n_words"] == 16 and got["collapsed"] == "x a b y z"
    assert [tuple(r) for r in got["runs"]] == [(1, 8, 2), (10, 6, 1)]


def test_planted_tails(spark, data):
    """The query against brute force on the texts of the smallest table."""
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, data).collect() if len(r["text"] or "") < 4000]
    assert run(spark, docs, queries.planted_tail) == sorted((digest_row(i, planted(i, split(t))) for i, t in docs), key=str)


def test_batches_of_one_row(spark):
    rows = [(i, "spam " * i) for i in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = run(spark, rows)
    finally:
        text_session(spark)
    assert got == sorted((digest_row(i, split(t)) for i, t in rows), key=str)


def test_long_texts(spark):
    """Over a million words, periodic or not, and a single word of over a million letters."""
    varied = " ".join(str(i * i % 99991) for i in range(150_000))
    rows = [(1, "spam " * 1_100_000), (2, "a b c " * 100_000 + varied), (3, "x" * 1_100_000), (4, " \n" * 600_000)]
    got = {r[0]: r[1:6] for r in run(spark, rows)}
    assert got[1] == (1, 0, 1_100_000, 1, 1_100_000_000)
    assert got[2] == (1, 0, 300_000, 3, 100_000_000)
    assert got[3] == got[4] == (0, None, None, None, None)
