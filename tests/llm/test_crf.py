import itertools

import numpy as np
from pyspark.sql import functions as F

from tests.llm import tables
from tonewell.llm import crf_language as crf


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t, first = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[True] * 4, [True, True, False, False]])
    marginal, pairs = crf.forward_backward(e, mask, t, first, True)
    want, want_pairs = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for s in range(2):
        n, total = int(mask[s].sum()), 0.0
        one, two = np.zeros((4, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(first[path[0]] + sum(e[s, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, y in enumerate(path):
                one[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                two[a, b] += w
        want[s] = one / total
        want_pairs += two / total
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def test_cut_chains_are_whole(monkeypatch):
    """Marginals of texts cut in stretches equal those of uncut chains."""
    rng = np.random.default_rng(1)
    field = crf.Field(["a", "b", "c"], np.float32(rng.normal(size=(crf.BUCKETS, 3)) * 0.3), rng.normal(size=(3, 3)) * 2, rng.normal(size=3))
    texts = [" ".join("".join(rng.choice(list("abcde"), 3)) for _ in range(n)) for n in (0, 1, 5, 7, 8, 9, 300, 64, 2000)]
    whole = crf.label_batch(field, texts, length=5000)
    for length in (1, 2, 7, 128):
        cut = crf.label_batch(field, texts, length=length)
        assert cut[0] == whole[0] and np.abs(cut[2] - whole[2]).max() < 1e-9, length


def test_the_draw_does_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, two = (crf.fit(x, per_label=20) for x in (docs.repartition(1), docs.repartition(7, "text")))
    assert one.labels == two.labels and np.array_equal(one.weights, two.weights)
    # one text in most rows doesn't crowd out the others of its language
    often = docs.union(docs.limit(1).withColumn("doc_id", F.explode(F.array_repeat(F.lit(-1).cast("long"), 500))))
    assert np.isfinite(crf.fit(often, per_label=20).weights).all()
    assert len(crf.fit(docs, per_label=20, most_labels=2).labels) == 2


def test_held_out_accuracy_and_folds(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = {r["doc_id"]: r for r in crf.identify(docs).collect()}
    rows = docs.withColumn("fold", fold).collect()
    held = [r for r in rows if r["fold"] == 2 and r["lang"]]
    assert all(out[r["doc_id"]]["held_out"] == (r["fold"] == 2) for r in rows)
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    hidden = docs.withColumn("lang", F.when(fold == 2, F.lit("xx")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r for r in crf.identify(hidden).collect()}
    assert again == out


def test_edges(spark):
    out = crf.identify(tables.docs(spark)).collect()
    assert len(out) == len(tables.rows())
    by = {r["doc_id"]: r for r in out}
    for i in (4, 5, 6, 15):
        none = not any(c.isalpha() for c in dict((r[0], r[1] or "") for r in tables.rows())[i])
        assert (by[i]["lang_pred"] == "und") == none
    assert all(0 <= r["score"] <= 1 for r in out)
    assert crf.identify(tables.empty(spark)).collect() == []
    unlabelled = tables.docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in crf.identify(unlabelled).collect()} == {"und"}
    odd = spark.createDataFrame([(1, "²½ 12", "en"), (2, "words here", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in crf.identify(odd).collect()}[1] == "und"


def test_switches_inside_a_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("lang IN ('en', 'de') AND length(text) > 800")
    field = crf.fit(docs)
    texts = {lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first()["text"] for lang in ("en", "de")}
    parts = [" ".join(crf.LETTERS.findall(texts[x])[:60]) for x in ("en", "de", "en")]
    mixed = spark.createDataFrame([(1, " ".join(parts)), (2, None)], "doc_id long, text string")
    spans = sorted(map(tuple, crf.label_words(mixed, field).collect()))
    labels = [lang for _, _, n, lang in spans for _ in range(n)]
    want = ["en"] * 60 + ["de"] * 60 + ["en"] * 60
    assert len(labels) == 180 and sum(a == b for a, b in zip(labels, want, strict=True)) > 165


def test_features_of_a_word_stand_alone():
    one, _ = crf.word_features(["abc"])
    many, starts = crf.word_features(["zz", "abc", "é"])
    assert sorted(one.tolist()) == sorted(many[starts[1] : starts[2]].tolist())
