"""Every operator and stage on texts of 0 to 10 words, each alone in its partition, and on endless runs."""

import re

import pytest

from tests.llm import tables, test_minhash, test_packing, test_suffix
from tonewell.llm import bbit_minhash, crf_language, fertility, packing, pfair, pu_quality, suffix_dedup, token_rollup
from tonewell.llm.common import Tokenizers, documents

import corpus_pipeline

SHORT = [(n, " ".join(tables.words(n, n)) or None) for n in range(11)] + [(20 + n, "a " * n) for n in range(11)]
LONG = [(1, " " * 1_100_000), (2, "x" * 1_100_000), (3, "\n" * 1_100_000), (4, "w \n" * 400_000)]


def alone(spark, rows):
    """A row per partition, hence per batch."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(
        spark.sparkContext.parallelize(full, len(full)), "doc_id long, text string, lang string, source string, n_chars long"
    )


def test_fertility_counts(spark):
    got = {r["doc_id"]: r for r in fertility.rules(alone(spark, SHORT)).collect()}
    assert len(got) == len(SHORT)
    for i, text in SHORT:
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[i]["n_words"] == n_words and got[i]["base_failed"] and not got[i]["kept"]
        assert got[i]["n_repeat_words"] == (n_words if i >= 20 and n_words > 8 else 0)


def test_repeated_words_of_any_batch():
    for total in range(20):
        lists = [["w"] * total]
        want = total if total > 8 else 0
        assert fertility.repeated_words(lists).tolist() == [want]
        assert fertility.repeated_words([["w"]] * total).tolist() == [0] * total


def test_near_duplicates(spark):
    got = sorted(map(tuple, bbit_minhash.near_duplicates(alone(spark, SHORT)).collect()), key=str)
    assert got == test_minhash.brute(SHORT)


def test_shingles_of_any_batch():
    for n in range(12):
        sets = bbit_minhash.shingle_sets([" ".join(f"w{i}" for i in range(n))])
        assert [len(s) for s in sets] == [min(n, max(1, n - 4))]


def test_scores(spark, data):
    labels = documents(spark, data, "labels")
    both = documents(spark, data).union(alone(spark, [(10**6 + i, t) for i, t in SHORT]).select(*documents(spark, data).columns))
    scored = pu_quality.classify(both, labels).filter("doc_id >= 1000000").collect()
    assert len(scored) == len(SHORT) and all(0 <= r["score"] <= 1 for r in scored)


def test_the_other_operators(spark):
    docs = alone(spark, SHORT)
    test_packing.check(packing.pack(docs, 1024).collect(), SHORT, 1024)
    assert pfair.mix(spark, docs).count() == len(SHORT)
    assert crf_language.identify(docs).count() == len(SHORT)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeats(docs).collect())
    assert got == sorted((r[0], r[1], r[2]) for r in test_suffix.brute(SHORT))
    totals = token_rollup.corpus_rollup(spark, docs).collect()
    once = {t or "" for _, t in SHORT}
    tok = Tokenizers()
    for r in totals:
        want = sum(len(tok.ranks(token_rollup.VERSIONS[r["tokenizer_version"]]).encode_ordinary(t)) for t in once)
        assert (r["documents"], r["tokens"]) == (len(once), want)


def test_stages(spark, data):
    docs = alone(spark, SHORT)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= len(SHORT), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.filter("piece = 0").count() == len(SHORT)


def test_counts_of_long_runs():
    """Split exactly: the counts of the rank library where it can take the run, of the vocabulary's own one beyond."""
    tok = Tokenizers()
    for file in token_rollup.VERSIONS.values():
        for text in (" " * 5000, "a" + " " * 5000 + "b", "x" * 5000, "\n" * 5000 + " a", "é" * 3000 + " " * 2500 + "\n" * 2500 + "c"):
            assert tok.LONG_RUN.search(text) and tok.ranked(file, text) == tok.ranks(file).encode_ordinary(text)
    own = tok.file("byte_bpe_50k.json")
    for _, text in LONG[:3]:
        assert tok.ranked("byte_bpe_50k.tiktoken", text) == own.encode(text, add_special_tokens=False).ids


def test_long_runs(spark):
    docs = alone(spark, LONG)
    rows = token_rollup.corpus_rollup(spark, docs).collect()
    assert {r["tokenizer_version"] for r in rows} == set(token_rollup.VERSIONS) and all(r["documents"] == 4 for r in rows)
    got = {r["doc_id"]: r for r in fertility.rules(docs).collect()}
    assert got[2]["n_words"] == 1 and got[4]["n_words"] == 400_000 and got[4]["n_repeat_words"] == 400_000
    assert sorted(r["n_shingles"] for r in bbit_minhash.near_duplicates(docs).collect()) == [0, 0, 1, 1]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "A"), (1, "B"), (2, "B"), (3, "C")], [(1, "A"), (1, "B"), (3, "C")]),
        ([(1, "A"), (2, "A"), (2, "D")], [(1, "A"), (2, "D")]),
        ([(5, "A"), (5, "A"), (None, "A"), (None, "A"), (6, None), (6, "")], [(5, "A"), (6, ""), (6, None), (None, "A"), (None, "A")]),
    ],
)
def test_no_text_is_lost(spark, rows, want):
    """Rows that share a doc_id: a text goes only where another row keeps it."""
    text = {c: " ".join(tables.words(ord(c), 40)) for c in "ABCD"}
    docs = alone(spark, [(i, text.get(t, t)) for i, t in rows])
    back = {v: k for k, v in text.items()}
    got = [(r["doc_id"], back.get(r["text"], r["text"])) for r in bbit_minhash.without_copies(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


