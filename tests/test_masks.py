import random

import pytest
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import batches, masks


def bisected(scores, target, length):
    """Mask of the least likely spans by plain bisection over the number of spans."""
    n = len(scores)
    sums = [sum(scores[i : i + length]) for i in range(n - length + 1)]
    order = sorted(range(len(sums)), key=lambda i: (-round(sums[i], 9), i))

    def union(u):
        out = [False] * n
        for s in order[:u]:
            for k in range(s, min(n, s + length)):
                out[k] = True
        return out

    goal = max(target, length)
    low, high = goal // length, goal - length + 1
    mid = round(0.5 * (low + high))
    best = union(mid)
    while low < mid < high:
        best = union(mid)
        if sum(best) > goal:
            high = mid
        else:
            low = mid
        mid = round(0.5 * (low + high))
    return best


@pytest.mark.parametrize("length", [1, 3, 5])
def test_lowest_probability_spans(spark, length):
    rnd = random.Random(length)
    rows = [(i, [rnd.random() for _ in range(30)], rnd.randrange(1, 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s array<double>, target int")
    for r in masks.lowest_probability_spans(df, "s", F.col("target"), length).collect():
        assert r["mask"] == bisected(r["s"], r["target"], length), (r["id"], r["target"])


def test_span_mask(spark):
    starts = [[i in (1, 2, 8) for i in range(10)]]
    got = spark.createDataFrame([(s,) for s in starts], "s array<boolean>").select(
        masks.span_mask(F.col("s"), 3), masks.span_mask(F.col("s"), 1)
    ).first()
    assert got[0] == [i in (1, 2, 3, 4, 8, 9) for i in range(10)]
    assert got[1] == starts[0]


def test_random_masks(spark):
    rows = spark.range(200).withColumn("rate", F.col("id") / 200.0)
    got = rows.select(
        "rate",
        masks.random_mask(50, F.col("rate"), 1, F.col("id")).alias("m"),
        masks.random_span_mask(50, F.col("rate"), 3, 1, F.col("id")).alias("s"),
    ).collect()
    for r in got:
        assert sum(r["m"]) == max(1, round(50 * r["rate"]))
        assert sum(r["s"]) >= 1
    high = [sum(r["s"]) / 50 for r in got if 0.45 < r["rate"] < 0.55]
    assert abs(sum(high) / len(high) - 0.5) < 0.1


def test_span_counts_reach_the_rate():
    counts = masks.span_counts(100, 3)
    assert len(counts) == 101 and counts[0] == 0 and counts == sorted(counts)

    def rate(u):
        missed = 1.0
        for j in range(u):
            missed *= (100 - 3 - j) / (100 - j)
        return 1 - missed

    for percent in (10, 50, 90):
        assert rate(counts[percent]) >= percent / 100 > rate(counts[percent] - 1)


def test_window_mask_modes(spark):
    rows = spark.range(300)
    out = masks.random_window_mask(rows, 40, 5, [F.col("id")], 0.25, 0.25, 0.25, 0.5, 3).collect()
    modes = {r["mode"] for r in out}
    assert modes == {"pad", "crop", "shuffle", "keep"}
    assert all(sum(r["mask"]) == 40 for r in out if r["mode"] == "keep")
    with pytest.raises(ValueError):
        masks.random_window_mask(rows, 40, 5, [F.col("id")], 0.5, 0.5, 0.5, 0.5, 3)


def test_swap_window_bounds(spark):
    rows = spark.createDataFrame([(0, 0, 1, [1.0] * 10, [2.0] * 10)], "b int, p bigint, n int, m array<double>, c array<double>")
    got = masks.swap_window(rows, "b", "p", "n", "m", "c", 10, 0.4, 1).first()
    assert sum(got["truth"]) == 6 and [2.0 - t for t in got["truth"]] == got["mixed"]
    with pytest.raises(ValueError):
        masks.swap_window(rows, "b", "p", "n", "m", "c", 10, 0.0, 1)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    blur, fit, frames, short = df.select(
        A.blur_blocks(F.col("x"), 3), A.fit_length(F.col("x"), 7), batches.frame_array(F.col("x"), 4, 2),
        A.resample_linear(F.slice("x", 1, 2), 100.0, 25.0, 3),
    ).first()
    # The last block is completed by the mirrored 4.
    assert blur == [2.0, 2.0, 2.0, 13 / 3, 13 / 3]
    assert fit == [1.0, 2.0, 3.0, 4.0, 5.0, 1.0, 2.0]
    assert frames == [[1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0, 0.0], [5.0, 0.0, 0.0, 0.0]]
    assert short == [0.0, 0.0, 0.0]


def test_one_hot_zero_peak(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([-1.0, 0.0],), ([2.0, 2.0],)], "x array<double>")
    assert [r[0] for r in df.select(A.argmax_one_hot(F.col("x"))).collect()] == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def generated(total, window, stride, prompt):
    """Windows of the generation loop: (offset, prompt length, length)."""
    out, offset, carried = [], 0, prompt
    while offset + carried < total:
        size = min(total - offset, window)
        out.append((offset, carried, size))
        carried, offset = size - stride, offset + stride
    return out


@pytest.mark.parametrize("total, prompt", [(50, 0), (100, 10), (101, 0), (350, 25), (331, 99), (20, 20)])
def test_window_plan(spark, total, prompt):
    df = spark.createDataFrame([(1, total, prompt)], "id int, n int, p int")
    plan = batches.window_plan(df, F.col("n"), 100, 30, F.col("p")).orderBy("window")
    assert [(r["offset"], r["prompt_len"], r["gen_len"]) for r in plan.collect()] == generated(total, 100, 30, prompt)


def test_split_long(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 25), (4, 21)], "id int, n int")
    got = batches.split_long(df, F.col("n"), 10, 3).select("id", "piece", "start", "size").collect()
    assert sorted(map(tuple, got)) == [(2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 5), (4, 0, 0, 10), (4, 1, 10, 10)]


def test_stitched_tokens_are_not_sorted(spark):
    """Windows of 4 with stride 3 over the items a (9 tokens) and b (3), a prompt of one token."""
    df = spark.createDataFrame([("a", 9), ("b", 3)], "id string, n int")
    plan = batches.window_plan(df, F.col("n"), 4, 3, F.lit(1))
    tokens = plan.select("id", "window", F.posexplode(F.sequence(F.col("offset"), F.col("offset") + F.col("gen_len") - 1)).alias("pos", "code"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = batches.stitch_windows(tokens, plan, "id")
        assert sorted(map(tuple, got.collect())) == [("a", t, t) for t in range(9)] + [("b", t, t) for t in range(3)]
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
