"""Small tables with the cases every operator must stand: nulls, empties, ties, repeats, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot long, u long, shard long, block long"


def words(seed, n, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return [rng.choice(alphabet) * rng.randint(1, 3) + rng.choice(alphabet) for _ in range(n)]


def prose(seed, n):
    parts = words(seed, n)
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(parts))


def rows():
    base = prose(1, 80)
    near = base.replace("\n", " ", 1) + " one more"
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", "b"),
        (4, None, None, None),
        (5, "", "de", "b"),
        (6, "   \n\t ", "de", None),
        (7, "short", "fr", "c"),
        (8, "a b c d e f", None, "c"),
        (9, "A B c D e F", "fr", "c"),
        (10, prose(2, 4000), "es", "a"),
        (11, "x" * 5000, "en", "a"),
        (12, "é" * 120 + " ünïcode ✓ 漢字 " + base, "fr", "d"),
        (13, "spam " * 200, "en", "d"),
        (14, "line one is here\n" * 12, "en", "d"),
        (15, "# $ % & | < > * words", None, "e"),
        (None, base, "en", "e"),
        (None, None, None, None),
        (17, base, "en", "a"),
        (17, base, "en", "a"),
        ((1 << 62) + 1, "a large id " * 30, "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 0.0, 1, 2, 3, 4) for i, t, lang, s in texts]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
