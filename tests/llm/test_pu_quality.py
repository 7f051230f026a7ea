import numpy as np
from pyspark.sql import functions as F

from tests.llm import tables
from tonewell.llm import pu_quality


def test_held_out_accuracy(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = pu_quality.classify(docs, labels).select("doc_id", "held_out", "score", "predicted").toPandas()
    got = out.merge(labels.toPandas(), on="doc_id")
    got = got[got["held_out"]]
    good, bad = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    assert len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all()
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_held_out_labels_are_never_read(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("quality", F.when(pu_quality.remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(map(tuple, pu_quality.classify(docs, x).select("doc_id", "score").collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_edges(spark, data):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = pu_quality.classify(tables.docs(spark), labels).collect()
    assert len(out) == len(tables.rows()) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    real = spark.read.parquet(f"{data}/documents.parquet")
    model = pu_quality.fit(real, real.select("doc_id"))
    scored = tables.docs(spark).select(pu_quality.score_column(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scored)
    assert pu_quality.classify(tables.empty(spark), labels).collect() == []
    kept = pu_quality.accepted(tables.docs(spark), labels)
    assert kept.columns == tables.docs(spark).columns and kept.count() == len(tables.rows())


def test_statistics_of_all_rows_whatever_the_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = pu_quality.measured(docs)
    x = np.stack([r["x"] for r in rows.collect()])
    mean, deviation = pu_quality.moments(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(deviation, x.std(0), atol=1e-6)
    labels = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1")
    one, two = (pu_quality.fit(d, labels.select("doc_id")) for d in (docs.repartition(1), docs.repartition(9, "text")))
    assert np.allclose(one.mean, two.mean) and abs(one.prior - two.prior) < 1e-6
    assert np.allclose(one.scores(x), two.scores(x), atol=1e-4)
    cuts = np.quantile(one.logits(x), [0.1, 0.5, 0.9])
    want = [(one.logits(x) >= c).mean() for c in cuts]
    assert np.allclose(pu_quality.shares_above(rows, one, cuts), want)


def test_prior_without_negatives():
    rng = np.random.default_rng(0)
    positive = rng.normal(0, 1, (4000, 5))
    unlabelled = np.vstack([rng.normal(0, 1, (5600, 5)), rng.normal(3, 1, (2400, 5))])
    unlabelled = unlabelled[rng.permutation(8000)]
    assert abs(pu_quality.estimate_prior(positive, unlabelled, 1) - 0.7) < 0.05
    weights = pu_quality._train(positive, unlabelled, 0.7, 10, 1)
    model = pu_quality.Model(np.zeros(5), np.ones(5), weights, 0.7)
    assert (model.scores(rng.normal(0, 1, (500, 5))) >= 0.5).mean() > 0.95
    assert (model.scores(rng.normal(3, 1, (500, 5))) < 0.5).mean() > 0.95
