import pytest
from pyspark.sql import functions as F

from tonewell.operators import layouts


def drawn(spark, layout):
    """Layout as a list over steps of sorted (q, t)."""
    steps = [[] for _ in range(layout.steps)]
    for r in layouts.layout_table(spark, layout).collect():
        steps[r["s"]].append((r["q"], r["t"]))
    return [sorted(s) for s in steps]


def picture(spark, layout):
    """Rows of the interleaved sequence, codes counted from 1, 0 for special."""
    rows = [[0] * layout.steps for _ in range(layout.n_q)]
    for s, cells in enumerate(drawn(spark, layout)):
        for q, t in cells:
            rows[q][s] = t + 1
    return rows


def test_delayed_example(spark):
    assert picture(spark, layouts.delayed(3, 4)) == [
        [0, 1, 2, 3, 4, 0, 0],
        [0, 0, 1, 2, 3, 4, 0],
        [0, 0, 0, 1, 2, 3, 4],
    ]


def test_unrolled_examples(spark):
    full = picture(spark, layouts.unrolled(3, 2))
    assert full == [[0, 1, 0, 0, 2, 0, 0], [0, 0, 1, 0, 0, 2, 0], [0, 0, 0, 1, 0, 0, 2]]
    partial = picture(spark, layouts.unrolled(3, 2, [0, 1, 1]))
    assert partial == [[0, 1, 0, 2, 0], [0, 0, 1, 0, 2], [0, 0, 1, 0, 2]]
    late = picture(spark, layouts.unrolled(3, 4, [0, 1, 1], [0, 3, 3]))
    # The first codebook runs three positions ahead, then they alternate.
    assert late[0] == [0, 1, 2, 3, 0, 4, 0, 0, 0, 0, 0, 0]
    assert late[1] == late[2] == [0, 0, 0, 0, 1, 0, 2, 0, 3, 0, 4, 0]


@pytest.mark.parametrize("n_q, times", [(1, 0), (1, 8), (4, 1), (4, 16), (8, 40)])
def test_step_counts(n_q, times):
    assert layouts.parallel(n_q, times).steps == times + 1
    delays = list(range(n_q))
    assert layouts.delayed(n_q, times).steps == times + max(delays) + 1
    assert layouts.unrolled(n_q, times).steps == times * n_q + 1
    assert layouts.grouped(n_q, times, 1).steps == times * n_q + 1


def all_layouts():
    return [
        layouts.delayed(4, 8),
        layouts.delayed(4, 8, [0, 4, 4, 4]),
        layouts.delayed(2, 8, [0, 3], flatten_first=2),
        layouts.delayed(4, 1, [0, 1, 1, 1], empty_initial=2),
        layouts.delayed(2, 5, empty_initial=-1),
        layouts.parallel(4, 8),
        layouts.unrolled(3, 6),
        layouts.unrolled(3, 6, [0, 1, 1], [0, 5, 5]),
        layouts.unrolled(3, 6, [0, 2, 2]),
        layouts.coarse_first(4, 6, [0, 1, 2]),
        layouts.grouped(4, 6, 2),
    ]


@pytest.mark.parametrize("layout", all_layouts(), ids=lambda x: f"{x.kind}-{x.n_q}-{x.timesteps}-{x.steps}")
def test_interleave_and_back(spark, layout):
    table = layouts.layout_table(spark, layout)
    assert layouts.check_layout(table).count() == 0
    assert table.select("s", "q").distinct().count() == layout.n_q * layout.timesteps
    assert table.agg(F.max("s")).first()[0] < layout.steps
    codes = spark.range(2).select(F.col("id").alias("item")).crossJoin(
        spark.range(layout.n_q * layout.timesteps).select(
            (F.col("id") % layout.n_q).cast("int").alias("q"), F.floor(F.col("id") / layout.n_q).cast("int").alias("t")
        )
    ).withColumn("code", (F.col("item") * 100 + F.col("q") * 17 + F.col("t") * 5) % 256)
    sequence = layouts.interleave(codes, layout, 256)
    assert sequence.count() == 2 * layout.n_q * layout.steps
    assert sequence.filter("mask").count() == codes.count()
    back = layouts.deinterleave(sequence.drop("mask"), layout, 256)
    joined = back.join(codes.withColumnRenamed("code", "old"), ["item", "q", "t"])
    assert joined.filter((F.col("old") != F.col("code")) | ~F.col("mask")).count() == 0
    assert joined.count() == codes.count()


def test_valid_steps_and_lookup(spark):
    layout = layouts.delayed(3, 4)
    assert layout.max_delay == 2 and layout.valid_steps == 5
    table = layouts.layout_table(spark, layout)
    assert [r["s"] for r in layouts.steps_of(table, 1, 2).collect()] == [4]
    assert sorted(r["s"] for r in layouts.steps_of(table, 0).collect()) == [1, 2, 3]


def test_bad_layouts(spark):
    for make in (
        lambda: layouts.delayed(3, 4, [0, 1]),
        lambda: layouts.delayed(3, 4, [1, 0, 2]),
        lambda: layouts.unrolled(3, 4, [0, 1, 1], [0, 1, 2]),
        lambda: layouts.coarse_first(3, 4, [0]),
        lambda: layouts.grouped(3, 4, 2),
    ):
        with pytest.raises(ValueError):
            make()
    wrong = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (2, 2, 1)], "s int, t int, q int")
    assert {r["problem"] for r in layouts.check_layout(wrong).collect()} == {
        "several times in one step", "time goes back"
    }
    with pytest.raises(ValueError):
        layouts.deinterleave(spark.createDataFrame([], "item int, q int, s int, code int"), layouts.delayed(2, 3), 9, steps=99)


def test_scores_skip_the_first_step(spark):
    layout = layouts.delayed(2, 3)
    scores = spark.createDataFrame(
        [(0, q, s, float(10 * q + s)) for q in range(2) for s in range(layout.steps)], "item int, q int, s int, score double"
    )
    got = {
        (r["q"], r["t"]): r["score"]
        for r in layouts.deinterleave(scores, layout, -1.0, model_output=True, value="score").collect()
    }
    assert got == {(q, t): 10.0 * q + t + q for q in range(2) for t in range(3)}


def test_stereo(spark):
    rows = spark.createDataFrame([(0, q, t, q * 10 + t) for q in range(2) for t in range(3)], "item int, q int, t int, code int")
    for per_timestep in (False, True):
        both = layouts.interleave_stereo(rows, rows.withColumn("code", -F.col("code")), per_timestep)
        assert both.select("q", "t").distinct().count() == 12
        right = layouts.split_stereo(both, per_timestep).filter("c = 1")
        assert {(r["q"], r["t"], r["code"]) for r in right.collect()} == {(q, t, -(q * 10 + t)) for q in range(2) for t in range(3)}
