import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import block_matrices as B
from tonewell.operators import covariance, decoding, detection, history, metrics, quantise, ratings

RNG = np.random.default_rng(1)


def vectors(spark, data, label=0):
    rows = [(i, label, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id int, label int, x array<double>")


def test_kmeans_equals_numpy(spark):
    data = RNG.normal(size=(200, 4))
    start = data[:5]
    means = start.copy()
    for _ in range(6):
        codes = ((data[:, None] - means) ** 2).sum(-1).argmin(1)
        means = np.stack([data[codes == c].mean(0) if (codes == c).any() else means[c] for c in range(5)])
    got, counts = quantise.kmeans(vectors(spark, data).repartition(4), "x", start, 6)
    assert np.allclose(got, means) and counts.tolist() == np.bincount(codes, minlength=5).tolist()


def test_empty_cluster_keeps_its_mean(spark):
    start = np.array([[0.0, 0.0], [99.0, 99.0]])
    got, counts = quantise.kmeans(vectors(spark, RNG.normal(size=(20, 2))), "x", start, 2)
    assert got[1].tolist() == [99.0, 99.0] and counts.tolist() == [20, 0]


def test_partitions_without_rows_add_nothing(spark):
    # Four partitions, the first two of them empty; their vectors: (2, 3) and (3, 4).
    rows = spark.range(0, 4, 1, 4).filter("id > 1").selectExpr("id", "array(double(id), double(id + 1)) AS x")
    assert rows.rdd.glom().map(len).collect() == [0, 0, 1, 1]
    start = np.array([[0.0, 0.0], [3.0, 4.0]])
    stats = quantise.assignment_stats(rows, "x", start)
    assert sorted(map(tuple, stats.collect())) == [(1, 0, 2, 5.0), (1, 1, 2, 7.0)]
    got, counts = quantise.kmeans(rows, "x", start, 2)
    assert got.tolist() == [[0.0, 0.0], [2.5, 3.5]] and counts.tolist() == [0, 2]
    assert quantise.assignment_stats(rows.filter("id > 5"), "x", start).collect() == []


def test_ties_take_the_lowest_code(spark):
    book = np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    assert [r["code"] for r in quantise.quantise(vectors(spark, [[0.0, 1.0], [2.0, 0.0]]), "x", book).collect()] == [0, 0]


def test_residual_quantiser_shapes_and_error(spark):
    data = RNG.normal(size=(256, 16))
    books = [data[i * 8 : i * 8 + 8] / 2**i for i in range(8)]
    out = quantise.rvq_encode(vectors(spark, data), "x", books)
    rows = out.orderBy("id").collect()
    assert all(len(r["codes"]) == 8 and max(r["codes"]) < 8 for r in rows)
    residual, i = data.copy(), 0
    for q, book in enumerate(books):
        codes = ((residual[:, None] - book) ** 2).sum(-1).argmin(1)
        residual = residual - book[codes]
        assert [r["codes"][q] for r in rows] == codes.tolist()
        assert np.allclose([r["errors"][q] for r in rows], (residual**2).mean(1))
    two = quantise.rvq_encode(vectors(spark, data), "x", books, n_q=2).first()
    assert len(two["codes"]) == 2


def test_decoding_sums_wide_rows(spark):
    """Codes of two rows of one item, books of unlike widths, an unknown code; dimensions beyond one row."""
    cells = [(0, 0, d, float(d)) for d in range(70)] + [(1, 2, d, 0.5) for d in (0, 33, 34)] + [(1, 2, 34, 0.25)]
    books = spark.createDataFrame(cells, "q int, code int, dim int, value double")
    rows = [(1, 0, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 1, 7), (None, 0, 0)]
    got = quantise.rvq_decode(spark.createDataFrame(rows, "id int, q int, code int"), books, "id")
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "double"]
    short = {0: 0.5, 33: 0.5, 34: 0.75}
    want = {(1, d): d + short.get(d, 0) for d in range(70)} | {(2, d): 2 * v for d, v in short.items()}
    assert {(r["id"], r["dim"]): r["value"] for r in got.collect()} == want | {(None, d): float(d) for d in range(70)}
    # No group of its own for each number of an item.
    assert not re.search(r"Aggregate \[id#\d+L?, dim#", got._jdf.queryExecution().optimizedPlan().toString())


def test_few_rows_are_reused(spark):
    picked = quantise.init_centroids(vectors(spark, [[1.0], [2.0]]), "x", "id", 5, "s")
    again = quantise.init_centroids(vectors(spark, [[1.0], [2.0]]), "x", "id", 5, "s")
    assert picked.shape == (5, 1) and set(picked[:, 0]) <= {1.0, 2.0} and (picked == again).all()


def test_expire_is_off_at_zero(spark):
    state = quantise.book_table(spark, np.array([[1.0], [2.0]])).withColumn("cluster_size", F.col("code") * 5)
    batch = vectors(spark, [[7.0], [8.0]])
    assert quantise.expire_codes(state, batch, "x", "id", 2, 0, "s") is state
    got = {r["code"]: r["vector"][0] for r in quantise.expire_codes(state, batch, "x", "id", 2, 3, "s").collect()}
    assert got[0] in (7.0, 8.0) and got[1] == 2.0


def test_codebook_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(quantise, "MAX_BOOK_BYTES", 9 * 8)
    with pytest.raises(ValueError):
        quantise.codebook_matrix(quantise.book_table(spark, np.zeros((5, 2))))
    with pytest.raises(ValueError):
        quantise.kmeans(vectors(spark, [[1.0, 2.0]]), "x", np.zeros((5, 2)), 1)
    with pytest.raises(ValueError):
        quantise.init_centroids(vectors(spark, [[1.0, 2.0]]), "x", "id", 5, 0)
    assert quantise.codebook_matrix(quantise.book_table(spark, np.eye(3))).tolist() == np.eye(3).tolist()


def matrix_root(m):
    values, basis = np.linalg.eigh(m)
    return basis @ np.diag(np.sqrt(np.clip(values, 0, None))) @ basis.T


def test_frechet_equals_numpy(spark):
    a, b = RNG.normal(size=(300, 5)) @ RNG.normal(size=(5, 5)), 1 + RNG.normal(size=(200, 5))
    got = covariance.frechet_distance(vectors(spark, a), vectors(spark, b), "x", "label").first()["distance"]
    ca, cb = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    root = matrix_root(ca)
    cross = np.trace(matrix_root(root @ cb @ root))
    expected = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross
    assert abs(got - expected) < 1e-6
    assert abs(covariance.frechet_distance(vectors(spark, a), vectors(spark, a), "x", "label").first()["distance"]) < 1e-6


def test_groups_of_one_side_have_no_distance(spark):
    a = vectors(spark, RNG.normal(size=(20, 3)), 1).unionByName(vectors(spark, RNG.normal(size=(20, 3)), 2))
    b = vectors(spark, RNG.normal(size=(20, 3)), 2).unionByName(vectors(spark, RNG.normal(size=(20, 3)), 3))
    assert [r["label"] for r in covariance.frechet_distance(a, b, "x", "label").collect()] == [2]


def test_orthogonality(spark):
    book = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(RNG.normal(size=(7, 3)))], "code int, x array<double>")
    m = np.array([r["x"] for r in book.orderBy("code").collect()])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = covariance.orthogonality(book, "x").first()
    assert abs(got["loss"] - ((u @ u.T - np.eye(7)) ** 2).sum() / 49) < 1e-12
    active = spark.createDataFrame([(1,), (1,), (4,)], "code int")
    assert covariance.orthogonality(book, "x", active).first()["codes"] == 2
    assert covariance.orthogonality(book, "x", max_codes=3).first()["codes"] == 3


def test_stats_use_all_samples(spark):
    rows = vectors(spark, [[1.0], [3.0], [5.0], [7.0]])
    assert tuple(covariance.feature_stats(rows, "x").first()) == (0, 4, 4.0, 5.0**0.5)


def test_kl_edges(spark):
    rows = spark.createDataFrame([([0.0, 1.0], [0.5, 0.5])], "pred array<double>, target array<double>")
    got = metrics.kl_divergence(rows).first()
    assert abs(got["kld"] - (0.5 * (np.log(0.5) - np.log(1e-6)) + 0.5 * (np.log(0.5) - np.log(1 + 1e-6)))) < 1e-9
    # A zero target entry adds nothing.
    assert abs(got["kld_qp"] - (np.log(1.0) - np.log(0.5 + 1e-6))) < 1e-9


def test_no_pairs_is_an_error(spark):
    empty = spark.createDataFrame([], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="no pair"):
        metrics.text_consistency(empty, "a", "b").collect()


def test_empty_union_is_nan_unless_skipped(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 1), ("b", 0.1, 0)]
    df = spark.createDataFrame(rows, "item string, pred double, truth int")
    assert np.isnan(metrics.miou(df, "item").first()["miou"])
    assert metrics.miou(df, "item", skip_empty=True).first()["miou"] == 0.5


def test_token_filters(spark):
    probs = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 0, 0.4), (2, 1, 0.3), (2, 2, 0.3)], "step int, token int, p double")
    steps = probs.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("token", "p"))).alias("x"))
    top_p = steps.filter("step = 1").select(F.inline(decoding.nucleus_filter(F.col("x"), 0.5))).collect()
    assert sorted((r["token"], round(r["p"], 6)) for r in top_p) == [(0, 0.625), (1, 0.375)]
    assert steps.filter("step = 2").select(F.inline(decoding.top_k_filter(F.col("x"), 2))).count() == 3


def test_draws_follow_the_probabilities(spark):
    logits = [float(np.log(p)) for p in (0.5, 0.3, 0.2)]
    steps = spark.range(20000).select(F.col("id").alias("step"), F.array(*[F.lit(v) for v in logits]).alias("x"))
    counts = {r["token"]: r["count"] / 20000 for r in decoding.categorical_draw(steps, "step", "x", 1).groupBy("token").count().collect()}
    assert all(abs(counts[i] - p) < 0.01 for i, p in enumerate((0.5, 0.3, 0.2)))


def test_mos_single_rating(spark):
    rows = spark.createDataFrame([("m", 4), ("n", 1), ("n", 3), ("n", 9)], "model string, rating int")
    got = {r["model"]: r for r in ratings.mos(rows).collect()}
    assert got["m"]["interval_text"] == "0.00" and got["m"]["mean_text"] == "4.00"
    # The population deviation of 1 and 3 is 1; a rating of 9 is not valid.
    assert got["n"]["samples"] == 2 and abs(got["n"]["interval"] - 1.96 / 2**0.5) < 1e-12


def test_best_so_far_ties(spark):
    rows = spark.createDataFrame([("r", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 5.0, 1.0])], "run string, epoch int, value double")
    got = history.best_so_far(rows, ["run"], block=2).orderBy("epoch").collect()
    assert [r["is_new_best"] for r in got] == [True, True, True, False, True]


def test_detection_counts(spark):
    def side(values):
        rows = [(i, c, t, v if c else 1 - v) for i, v in enumerate(values) for c in (0, 1) for t in range(3)]
        return spark.createDataFrame(rows, "item int, channel int, t int, value double")

    pos, neg = side([0.9, 0.8, 0.2, 0.7]), side([0.1, 0.6, 0.2, 0.3])
    assert detection.detection_accuracy(pos, neg).first()["acc"] == 6 / 8
    assert detection.false_positive_rate(neg).first()["fpr"] == 0.25
    assert detection.false_negative_rate(pos).first()["fnr"] == 0.25


def test_masked_loss_ignores_negatives(spark):
    pos = spark.createDataFrame([(0.2, 0.8, 1), (0.6, 0.4, 0)], "p0 double, p1 double, mask int")
    neg = spark.createDataFrame([(0.9, 0.1)], "p0 double, p1 double")
    assert abs(detection.detection_nll(pos, neg).first()[0] + (np.log(0.8) + np.log(0.6)) / 2) < 1e-12
    full = pos.withColumn("mask", F.lit(1))
    assert abs(detection.detection_nll(full, neg, 1.0, 2.0).first()[0] + (np.log(0.8) + np.log(0.4)) / 2 + 2 * np.log(0.9)) < 1e-12


def test_message_loss_without_bits(spark):
    decoded = spark.createDataFrame([(0, 0, 0, 0.5, 1)], "item int, bit int, t int, value double, mask int")
    none = spark.createDataFrame([], "item int, bit int, expected int")
    assert detection.message_loss(decoded, none, 0.1).first()[0] == 0.0
    with pytest.raises(ValueError):
        detection.message_loss(decoded, none, 0.1, "l1")


def test_let_runs_once_per_row(spark):
    # A random value bound once is the same for every element.
    df = spark.range(3).select(A.let(F.rand(), lambda r: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda _: r)).alias("x"))
    assert all(len(set(r["x"])) == 1 for r in df.collect())


def test_block_matrices_equal_numpy(spark):
    """Products, covariances and the distance, widths that no block fills, ranks that are not full, groups of one side."""
    rng = np.random.default_rng(6)
    width, side = 7, 3
    a = {g: rng.normal(size=(n, width)) for g, n in ((1, 30), (2, 5), (None, 12), (4, 1))}
    b = {g: rng.normal(size=(n, width)) * 2 + 0.3 for g, n in ((1, 25), (2, 6), (3, 9), (None, 12), (4, 8))}
    frames = [spark.createDataFrame([(g, r.tolist()) for g, x in part.items() for r in x], "label int, x array<double>") for part in (a, b)]
    cov, _ = B.covariance_blocks(frames[0], "x", "label", width, side)
    got = {}
    for r in cov.collect():
        whole = got.setdefault(r["label"], np.zeros((9, 9)))
        whole[r["i"] * side : (r["i"] + 1) * side, r["j"] * side : (r["j"] + 1) * side] = B.block(bytes(r["cells"]), side)
    assert set(got) == {1, 2, None}
    for g, c in got.items():
        assert np.allclose(c[:width, :width], np.cov(a[g].T)) and not c[width:].any() and not c[:, width:].any()
    made = covariance.frechet_distance(*frames, "x", "label", dense_width=0, side=side).collect()
    want = {}
    for g in (1, 2, None):
        c1, c2 = np.cov(a[g].T), np.cov(b[g].T)
        root = np.sqrt(np.clip(np.linalg.eigvals(c1 @ c2).real, 0, None)).sum()
        want[g] = ((a[g].mean(0) - b[g].mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root
    assert {r["label"] for r in made} == set(want)
    assert all(abs(r["distance"] - want[r["label"]]) < 1e-5 for r in made)
