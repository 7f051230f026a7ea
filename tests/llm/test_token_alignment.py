import hashlib
import random
from collections import Counter

import pytest

from tests.llm import tables
from tonewell.llm import token_alignment as ta
from tonewell.llm.common import documents, text_session


@pytest.fixture(scope="module")
def vocabularies():
    """The vocabulary files' own libraries, and the bytes of their entries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b, decoders.ByteLevel()


def spans(text, vocabularies):
    """Per side (start, end, id) of every token; empty where the bytes differ."""
    a, b, _ = vocabularies
    if not text:
        return [], []
    value, sides = ta.byte_values(), []
    one = [(i, bytes(value[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    for side in (one, two):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, out = 0, []
        for i, raw in side:
            out.append((at, at + len(raw), i))
            at += len(raw)
        sides.append(out)
    return sides


def brute(rows, vocabularies):
    """Every pair of tokens of a text looked at; counts over all rows."""
    cut = [(i, *spans(t, vocabularies)) for i, t in rows]
    links = [[(x[2], y[2]) for x in a for y in b if x[1] == y[1]] for _, a, b in cut]
    count = Counter(pair for doc in links for pair in doc)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for (i, a, b), doc in zip(cut, links, strict=True):
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, p = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(t) for s, f, t in side if p <= s and f <= e) for side in (a, b)))
            p = e
        best, total = sum(count[x] == top[x[1]] for x in doc), sum(count[x] for x in doc)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        touching = sum(x[0] < y[1] and y[0] < x[1] for x in a for y in b)
        out.append((i, len(a), len(b), len(groups), len(doc), best, total, digest, touching))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, chunk long, pairs string, n_a int")
    return sorted(map(tuple, ta.alignments(df).collect()), key=str)


ODD = [
    (1, "hello world"), (2, "  two  blanks\n\nand lines\t"), (3, "café 漢字かな 🙂 ok"), (4, "a▁b"), (5, "▁"), (6, ""),
    (7, None), (None, "hello world"), (None, None), (8, "<|endoftext|> <s> x </s> <unk> <0x41>"), (9, " "), (9, " "),
    (10, "\x00 \x7f ﬁ ½ 　 x"), (11, "antidisestablishmentarianism"), (12, "  a"), (13, "a  "), (14, "é" * 30),
    (1 << 60, "hello world hello"),
]


def test_odd_texts(spark, vocabularies):
    assert run(spark, ODD) == brute(ODD, vocabularies)
    assert run(spark, []) == []
    assert [r[1:] for r in run(spark, [(1, None)])] == [(0, 0, 0, 0, 0, 0, "", 0)]


@pytest.mark.parametrize("n", range(11))
def test_few_words(spark, vocabularies, n):
    rows = [(1, " ".join(tables.words(n, n)))]
    assert run(spark, rows) == brute(rows, vocabularies)


def test_mixed_texts(spark, vocabularies):
    rng = random.Random(3)
    alphabet = list("abcdefgh  \n\t.,éß漢字かकि🙂<|>▁'0123") + ["the", "ing", " of", "  "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [r[:2] for r in tables.rows() if len(r[1] or "") < 3000]
    assert run(spark, rows) == brute(rows, vocabularies)


def test_chunks_and_batches_do_not_matter(spark, data, monkeypatch):
    docs = documents(spark, data).limit(60)
    whole = sorted(map(tuple, ta.alignments(docs).collect()))
    rows = docs.select("doc_id", "text").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        alone = ta.alignments(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    finally:
        text_session(spark)
    assert sorted(map(tuple, alone)) == whole
    segment = ta.Segmenters()
    texts = [r["text"] for r in rows]
    together = ta.align(texts, segment)[0]
    assert together == [ta.align([t], segment)[0][0] for t in texts]


def test_ids_are_those_of_the_libraries(vocabularies, data, spark):
    """Of texts cut together, and none where the bytes differ."""
    segment = ta.Segmenters()
    rng = random.Random(8)
    alphabet = list("ab  \n\t,.'s1é漢\u3000\xa0\u2028\x1c\x85<|>") + [" the", "'ll", "  ", " \n"]
    texts = [r["text"] for r in documents(spark, data).collect()] + [t for _, t in ODD]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    (one, n_one), (two, n_two) = segment(texts)
    want = [spans(t, vocabularies) for t in texts]
    assert one.tolist() == [x[2] for w in want for x in w[0]] and n_one.tolist() == [len(w[0]) for w in want]
    assert two.tolist() == [x[2] for w in want for x in w[1]] and n_two.tolist() == [len(w[1]) for w in want]


def test_long_runs(spark):
    """Over a million blanks, letters or line ends in a text: bytes are covered, nothing is cut off."""
    rows = [(1, " " * 1_100_000), (2, "x" * 1_100_000), (3, "\n" * 1_100_000)]
    got = {r[0]: r for r in run(spark, rows)}
    assert all(got[i][1] > 0 and got[i][2] > 0 and got[i][3] > 0 for i in (1, 2, 3))
    assert got[3][2] == 1_100_001
