"""Token and signal masks.

An item is one row with a fixed number of positions, so each mask is a row-local
array expression: no shuffle, and no group that could grow.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions.arrays import let
from tonewell.functions.hashing import uniform, uniform_int


def positions(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size - 1))


def smallest_draws(size: int, count: Column, seed, *keys) -> Column:
    """Boolean array with ``count`` random positions set."""
    draws = F.transform(
        positions(size), lambda t: F.struct(uniform(seed, *keys, t).alias("u"), t.alias("t"))
    )

    def picked(ds: Column) -> Column:
        last = F.get(F.array_sort(ds), (count - 1).cast("int"))
        return let(last, lambda cut: F.transform(ds, lambda d: d <= cut))

    return F.when(count >= size, F.array_repeat(F.lit(True), size)).otherwise(let(draws, picked))


def random_mask(size: int, rate: Column, seed, *keys) -> Column:
    """max(1, size * rate rounded half to even) random positions."""
    count = F.greatest(F.bround(F.lit(float(size)) * rate, 0), F.lit(1.0)).cast("int")
    return smallest_draws(size, count, seed, *keys)


def span_mask(starts: Column, length: int) -> Column:
    """Union of the spans of ``length`` positions that begin at the set starts, cut at the end."""

    def union(flags: Column) -> Column:
        return F.transform(
            flags,
            lambda _, t: F.array_contains(
                F.slice(flags, F.greatest(t - F.lit(length - 2), F.lit(1)), F.least(t + 1, F.lit(length))),
                True,
            ),
        )

    return let(starts, union)


def span_counts(size: int, length: int) -> list[int]:
    """Number of span starts for a mask rate of 0, 1, ..., 100 percent.

    The mean rate of u random starts is 1 - prod over j < u of
    (size - length - j) / (size - j); the entry is the first u that reaches the rate.
    """
    rates, missed = [0.0], 1.0
    for j in range(size - 1):
        missed *= (size - length - j) / (size - j)
        rates.append(1 - missed)
    return [bisect_left(rates, percent / 100) for percent in range(101)]


def random_span_mask(size: int, rate: Column, length: int, seed, *keys) -> Column:
    """Random spans whose union covers about ``rate`` of the positions."""
    if length <= 1:
        return random_mask(size, rate, seed, *keys)
    table = F.array(*[F.lit(c) for c in span_counts(size, length)])
    count = F.greatest(F.get(table, F.bround(rate * 100.0, 0).cast("int")), F.lit(1))
    return span_mask(smallest_draws(size, count, seed, *keys), length)


def span_scores(scores: Column, length: int) -> Column:
    """Sum of each window of ``length`` scores."""

    def sums(values: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(values) - length),
            lambda t: F.aggregate(F.slice(values, t + 1, length), F.lit(0.0), lambda a, x: a + x),
        )

    return let(scores, sums)


def span_order(sums: Column, digits: int = 9) -> Column:
    """Starts by descending score; equal scores by position."""
    keyed = F.transform(sums, lambda s, t: F.struct((-F.round(s, digits)).alias("s"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def lowest_probability_spans(
    df: DataFrame, scores: str, target: Column, length: int, out: str = "mask", digits: int = 9
) -> DataFrame:
    """Mask of the least likely spans with a size near ``target``.

    ``scores`` are -log probabilities. The number of spans u is found by
    bisection between target / length and target - length + 1. The rank of the
    best span that covers a position tells from which u on it is masked, so
    every union size is known without building the masks.
    """
    goal = F.greatest(target, F.lit(length)).cast("int")
    order = span_order(span_scores(F.col(scores), length), digits)
    # Rank of each start: the order is a permutation, so sort it back.
    back = F.array_sort(F.transform(order, lambda t, r: F.struct(t.alias("t"), r.alias("r"))))

    def covers(rank: Column) -> Column:
        """Per position the best rank among the spans that cover it."""
        return F.transform(
            F.sequence(F.lit(0), F.size(rank) + F.lit(length - 2)),
            lambda t: F.array_min(
                F.slice(
                    rank,
                    F.greatest(t - F.lit(length - 2), F.lit(1)),
                    F.least(t, F.size(rank) - 1) - F.greatest(t - F.lit(length - 1), F.lit(0)) + 1,
                )
            ),
        )

    def middle(low: Column, high: Column) -> Column:
        return F.bround((low + high) * 0.5, 0).cast("int")

    def state(low: Column, high: Column, chosen: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), chosen.alias("chosen"))

    def bisect(cover: Column, wanted: Column) -> Column:
        low0 = F.floor(wanted / length).cast("int")
        high0 = wanted - F.lit(length - 1)

        def halve(s: Column, _: Column) -> Column:
            mid = middle(s["low"], s["high"])
            going = (mid > s["low"]) & (mid < s["high"])
            over = F.size(F.filter(cover, lambda c: c < mid)) > wanted
            low = F.when(over, s["low"]).otherwise(mid)
            high = F.when(over, mid).otherwise(s["high"])
            return F.when(going, state(low, high, mid)).otherwise(s)

        # Each round halves a range that starts below the number of positions.
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cover) + 1)).cast("int") + 2)
        return F.aggregate(rounds, state(low0, high0, middle(low0, high0)), halve, lambda s: s["chosen"])

    def masked(cover: Column) -> Column:
        return let(
            let(goal, lambda wanted: bisect(cover, wanted)),
            lambda u: F.transform(cover, lambda c: c < u),
        )

    rank = F.transform(back, lambda x: x["r"])
    return df.withColumn(out, let(let(rank, covers), masked))


def truth_mask_pad(size: int, seed, *keys, central: bool = False) -> Column:
    """1 between a start in the first and an end in the last third; ``central`` inverts."""
    start = uniform_int(0, int(0.33 * size) - 1, f"{seed}:start", *keys)
    end = uniform_int(int(0.66 * size), size - 1, f"{seed}:end", *keys)

    def inside(span: Column) -> Column:
        return F.transform(
            positions(size),
            lambda t: (((t >= span["start"]) & (t < span["end"])) != F.lit(central)).cast("int"),
        )

    return let(F.struct(start.alias("start"), end.alias("end")), inside)


def random_window_mask(
    df: DataFrame,
    size: int,
    seed,
    keys: list[Column],
    pad_prob: float,
    crop_prob: float,
    shuffle_prob: float,
    window_share: float,
    max_windows: int,
) -> DataFrame:
    """Columns ``mode`` (pad, shuffle, crop, keep) and ``mask`` (1 = still marked).

    Draws depend on ``keys``; a batch key gives one mask for the whole batch.
    """
    if pad_prob + crop_prob + shuffle_prob > 1:
        raise ValueError("the mode probabilities add up to more than 1")

    def u(name) -> Column:
        return uniform(f"{seed}:{name}", *keys)

    mode = (
        F.when(u("mode") < pad_prob, "pad")
        .when(u("mode") < pad_prob + shuffle_prob, "shuffle")
        .when(u("mode") < pad_prob + shuffle_prob + crop_prob, "crop")
        .otherwise("keep")
    )
    start = F.floor(u("start") * F.lit(0.33) * size)
    finish = F.floor((F.lit(0.66) + u("finish") * F.lit(0.33)) * size)
    windows = F.floor(u("windows") * max_windows) + 1
    width = F.floor(F.lit(round(size * window_share)) / windows)
    inverted = u("invert") > 0.5

    def begins(n: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), n["windows"].cast("int")),
            lambda i: F.floor(uniform(f"{seed}:begin", *keys, i) * (F.lit(size) - n["width"])),
        )

    def padded(d: Column) -> Column:
        return F.transform(
            positions(size),
            lambda t: (((t >= d["start"]) & (t < d["finish"])) != d["inverted"]).cast("int"),
        )

    def windowed(d: Column) -> Column:
        return F.transform(
            positions(size),
            lambda t: (
                ~F.exists(d["begins"], lambda b: (t >= b) & (t < b + d["width"])) != d["inverted"]
            ).cast("int"),
        )

    counts = F.struct(windows.alias("windows"), width.alias("width"))
    spans = F.struct(start.alias("start"), finish.alias("finish"), inverted.alias("inverted"))
    places = F.struct(
        let(counts, begins).alias("begins"), width.alias("width"), inverted.alias("inverted")
    )
    mask = (
        F.when(F.col("mode") == "keep", F.array_repeat(F.lit(1), size))
        .when(F.col("mode") == "pad", let(spans, padded))
        .otherwise(let(places, windowed))
    )
    return df.withColumn("mode", mode).withColumn("mask", mask)


def apply_window_mask(
    df: DataFrame, batch: str, position: str, size: str, signal: str, seed
) -> DataFrame:
    """Signal after the mask: padded ones are silenced, shuffled ones take a random
    batch member (``size`` members) where the mask is 0."""
    partner = F.floor(uniform(f"{seed}:partner", F.col(batch), F.col(position)) * F.col(size))
    others = df.select(F.col(batch), F.col(position).alias("__p"), F.col(signal).alias("__other"))
    joined = df.withColumn("__p", partner.cast("bigint")).join(others, [batch, "__p"])
    mixed = F.transform(
        F.arrays_zip(F.col(signal).alias("x"), F.col("mask").alias("m"), F.col("__other").alias("o")),
        lambda z: F.when(F.col("mode") == "pad", z["x"] * z["m"])
        .when(F.col("mode") == "shuffle", z["x"] * z["m"] + z["o"] * (1 - z["m"]))
        .otherwise(z["x"]),
    )
    return joined.withColumn(signal, mixed).drop("__p", "__other")


def swap_window(
    df: DataFrame,
    batch: str,
    position: str,
    members: str,
    marked: str,
    clean: str,
    size: int,
    window: float,
    seed,
    shuffle: bool = False,
) -> DataFrame:
    """Replace a random window of the marked signal by clean signal.

    The window is the same for a whole batch; with ``shuffle`` the clean part
    comes from a random batch member. Adds ``mixed`` and ``truth`` (1 = marked).
    """
    if not 0 < window <= 1:
        raise ValueError("window must be within (0, 1]")
    frames = int(window * size)
    start = uniform_int(0, size - frames, f"{seed}:start", F.col(batch))
    inside = let(
        start, lambda s: F.transform(positions(size), lambda t: (t >= s) & (t < s + F.lit(frames)))
    )
    rows = df.withColumn("__in", inside)
    if shuffle:
        partner = F.floor(uniform(f"{seed}:partner", F.col(batch), F.col(position)) * F.col(members))
        others = df.select(F.col(batch), F.col(position).alias("__p"), F.col(clean).alias("__clean"))
        rows = rows.withColumn("__p", partner.cast("bigint")).join(others, [batch, "__p"]).drop("__p")
    else:
        rows = rows.withColumn("__clean", F.col(clean))
    zipped = F.arrays_zip(F.col(marked).alias("m"), F.col("__clean").alias("c"), F.col("__in").alias("i"))
    return (
        rows.withColumn("mixed", F.transform(zipped, lambda z: F.when(z["i"], z["c"]).otherwise(z["m"])))
        .withColumn("truth", F.transform("__in", lambda i: (~i).cast("int")))
        .drop("__in", "__clean")
    )


