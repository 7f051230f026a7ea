"""Ordered computations against plain Python, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tonewell.operators import corpus, sampling
from tonewell.operators.scans import row_positions, running, share_bucket, sorted_positions, span_bucket, take_smallest


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = []
    for i in range(600):
        group = "hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}"
        group = None if i % 11 == 0 else group
        out.append((i, group, rnd.randrange(100), None if rnd.random() < 0.3 else rnd.randrange(50)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, g string, t int, v int")


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_positions(frame, rows):
    got = row_positions(frame, ["g"], span_bucket(F.col("t"), 7), [F.col("t"), F.col("id")], "pos").collect()
    expected = {r[0]: i for g in groups(rows).values() for i, r in enumerate(g)}
    assert {r["id"]: r["pos"] for r in got} == expected


def test_positions_by_range(frame, rows):
    got = sorted_positions(frame.repartition(3), [], ["g", "id"]).collect()
    expected = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])))}
    assert {r["id"]: r["pos"] for r in got} == expected
    inside = {r["id"]: r["pos"] for r in sorted_positions(frame, ["g"], ["t", "id"]).collect()}
    for group in groups(rows).values():
        want = sorted(group, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [inside[r[0]] for r in want] == list(range(len(group)))


def test_one_value_in_nearly_all_rows_is_many_parts(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted_positions(df.repartition(4), [], ["v"], label="hot")
        parts = got.groupBy(F.floor(F.col("pos") / 1)).count()
        assert parts.count() == 20000
        seven = got.filter("v = 7").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).first()
        assert seven["b"] - seven["a"] + 1 == got.filter("v = 7").count()
        busy = got.filter("v = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count()
        assert busy.filter("count > 2000").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(frame, rows, inclusive):
    got = running(
        frame, ["g"], span_bucket(F.col("t"), 9), [F.col("t"), F.col("id")],
        {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "la": ("last", F.col("v"))},
        inclusive,
    ).collect()
    expected = {}
    for group in groups(rows).values():
        for i, r in enumerate(group):
            seen = [x[3] for x in group[: i + 1 if inclusive else i] if x[3] is not None]
            expected[r[0]] = (sum(seen), min(seen), max(seen), seen[-1]) if seen else (None,) * 4
    assert {r["id"]: (r["s"], r["lo"], r["hi"], r["la"]) for r in got} == expected


def test_null_order_values_stay(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 90, 3), (None, None, 4)], "g string, t int, v int")
    got = row_positions(df, ["g"], span_bucket(F.col("t"), 10), [F.col("t")], "pos").collect()
    assert sorted((r["v"], r["pos"]) for r in got) == [(1, 0), (2, 1), (3, 2), (4, 0)]
    summed = running(df, ["g"], span_bucket(F.col("t"), 10), [F.col("t")], {"s": ("sum", F.col("v"))}).collect()
    assert sorted((r["v"], r["s"]) for r in summed) == [(1, 1), (2, 3), (3, 6), (4, 4)]


def test_take_smallest(spark):
    df = spark.range(5000).withColumn("u", (F.col("id") * 7919 % 5003) / 5003.0)
    got = {r["id"] for r in take_smallest(df, 1234, F.col("u"), [F.col("id")], 64).collect()}
    expected = set(sorted(range(5000), key=lambda i: (i * 7919 % 5003, i))[:1234])
    assert got == expected
    assert take_smallest(df, 9999, F.col("u"), [F.col("id")]).count() == 5000


FILES = [("a", 5.0, 2.0), ("b", 10.0, None), ("c", 5.0, 0.0)]


@pytest.mark.parametrize(
    "on_weight, on_duration, shares",
    [
        (True, True, (0.5, 0.5, 0.0)),
        (False, True, (0.25, 0.5, 0.25)),
        (True, False, (2 / 3, 1 / 3, 0.0)),
        (False, False, (1 / 3, 1 / 3, 1 / 3)),
    ],
)
def test_weighted_sampling_histogram(spark, on_weight, on_duration, shares):
    files = spark.createDataFrame(FILES, "path string, duration double, weight double")
    draws = sampling.sample_files(spark, files, 20000, on_weight=on_weight, on_duration=on_duration)
    counts = {r["path"]: r["count"] / 20000 for r in draws.groupBy("path").count().collect()}
    for (path, _, _), share in zip(FILES, shares):
        assert abs(counts.get(path, 0.0) - share) < 0.01
    assert draws.select("index").distinct().count() == 20000


def test_draws_depend_on_epoch_and_seed_only(spark):
    files = spark.createDataFrame(FILES, "path string, duration double, weight double")

    def draw(**how):
        return [r["path"] for r in sampling.sample_files(spark, files, 200, **how).orderBy("index").collect()]

    assert draw(epoch=1) == draw(epoch=1) and draw(epoch=1) != draw(epoch=2)
    assert draw(epoch=1, shuffle=False) == draw(epoch=2, shuffle=False)


def test_hot_file_and_many_light_ones(spark):
    files = spark.range(2000).select(
        F.col("id").cast("string").alias("path"), F.when(F.col("id") == 7, 1000.0).otherwise(1.0).alias("duration")
    )
    draws = sampling.sample_files(spark, files, 9000, on_weight=False)
    counts = {r["path"]: r["count"] for r in draws.groupBy("path").count().collect()}
    assert sum(counts.values()) == 9000 and abs(counts["7"] / 9000 - 1 / 3) < 0.03


def test_permutations_use_every_file_once_per_round(spark):
    files = spark.range(7).select(F.col("id").alias("path"))
    seen = []
    for epoch in range(7):
        part = sampling.permute_files(files, 4, epoch=epoch).orderBy("index").collect()
        assert [r["index"] for r in part] == [0, 1, 2, 3]
        seen += [r["path"] for r in part]
    for start in range(0, 28, 7):
        assert sorted(seen[start : start + 7]) == list(range(7))


def test_segments_stay_inside(spark):
    files = spark.createDataFrame([(i, 0.2 + i % 5) for i in range(50)], "index int, duration double")
    for r in sampling.draw_segments(files, 1.0, 16000, 1).collect():
        assert 0 <= r["seek_time"] <= max(0, r["duration"] - 0.5)
        assert r["total_frames"] == 16000 and 0 < r["n_frames"] <= 16000


def test_retry(spark):
    rows = [(i, a, f"p{i}{a}", i != 2 and a >= i) for i in range(3) for a in range(4)]
    df = spark.createDataFrame(rows, "index int, attempt int, path string, ok boolean")
    got = {r["index"]: r for r in sampling.retry_failed(df, F.col("ok"), 3).collect()}
    assert got[0]["path"] == "p00" and got[1]["path"] == "p11"
    assert got[2]["path"] is None and got[2]["error"] == "no readable file in 3 tries"


def test_duration_filter(spark):
    from pyspark.sql import Observation

    files = spark.createDataFrame(FILES, "path string, duration double, weight double")
    seen = Observation("durations")
    assert corpus.filter_duration(files, high=7, observation=seen).count() == 2
    assert round(corpus.removed_percent(seen), 3) == 33.333
    with pytest.raises(ValueError):
        corpus.filter_duration(files, 5, 4)
    nothing = Observation("nothing")
    corpus.filter_duration(files, 100, None, nothing).count()
    with pytest.raises(ValueError):
        corpus.removed_percent(nothing)


def test_random_subset_returns_all_when_small(spark):
    assert corpus.random_subset(spark.range(5), 9, 1, "id").count() == 5


def test_split_percent_bounds():
    with pytest.raises(ValueError):
        corpus.split_by_hash(F.lit("x"), 0)


def test_share_bucket_keeps_the_last_value(spark):
    got = spark.createDataFrame([(0.0,), (0.999,), (1.0,)], "u double").select(share_bucket(F.col("u"), 4)).collect()
    assert [r[0] for r in got] == [0, 3, 3]


def test_a_hot_group_is_many_tasks(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("g"),
        (F.col("id") / 10.0).alias("t"),
        F.col("id").alias("v"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = running(rows, ["g"], span_bucket(F.col("t"), 50), [F.col("t")], {"s": ("sum", F.col("v"))})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    # A window over the whole group would put 20,000 rows into one partition.
    assert sum(sizes) == 60000 and max(sizes) < 8000
