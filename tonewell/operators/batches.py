"""Batch shapes: padding, cutting, windows over long items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A


def collate(df: DataFrame, by: str, values: str, fill=0.0) -> DataFrame:
    """Pad every array to the longest one of its batch; keep the own length.

    Adds ``length`` and ``total_frames``. The batch maximum is an aggregate
    joined back, so rows of a batch are not gathered.
    """
    sized = df.withColumn("length", F.size(values))
    longest = sized.groupBy(by).agg(F.max("length").alias("total_frames"))
    joined = sized.join(longest, by)
    return joined.withColumn(values, A.pad_right(F.col(values), F.col("total_frames"), F.lit(fill)))


def split_long(df: DataFrame, length: Column, max_len: int, min_len: int) -> DataFrame:
    """Consecutive pieces (piece, start, size) of at most max_len; pieces up to min_len are dropped."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), (length - 1).cast("bigint"), F.lit(max_len).cast("bigint")))
    rows = df.select("*", F.posexplode(starts).alias("piece", "start"))
    return rows.withColumn("size", F.least(length - F.col("start"), F.lit(max_len)).cast("int")).filter(
        F.col("size") > min_len
    )


def sliding_starts(length: Column, window: int, stride: int) -> Column:
    """Starts of the full windows; the whole item when it is shorter than a window."""
    last = F.greatest(length - F.lit(window), F.lit(0)).cast("bigint")
    return F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint"))


def sliding_chunks(df: DataFrame, values: str, window: int, stride: int) -> DataFrame:
    """One row per window: (…, chunk, start, values)."""
    rows = df.select("*", F.posexplode(sliding_starts(F.size(values), window, stride)).alias("chunk", "start"))
    return rows.withColumn(values, F.slice(values, (F.col("start") + 1).cast("int"), F.lit(window)))


def frame_array(c: Column, size: int, stride: int) -> Column:
    """ceil(n / stride) frames of ``size`` values, zeros after the end."""
    count = F.ceil(F.size(c) / F.lit(stride)).cast("int")
    padded = F.concat(c, F.array_repeat(F.lit(0.0), size))
    starts = F.sequence(F.lit(0), count - 1)
    return A.let(
        padded,
        lambda values: F.transform(starts, lambda f: F.slice(values, f * F.lit(stride) + 1, F.lit(size))),
    )


def window_plan(df: DataFrame, total: Column, window: int, stride: int, prompt: Column) -> DataFrame:
    """Overlapping generation windows of a long item.

    Columns window, offset, prompt_len (carried from the window before) and
    gen_len. Window i starts at i * stride; its prompt ends where the window
    before ended; the plan stops when the end is reached.
    """
    if stride >= window:
        raise ValueError("the stride must be shorter than the window")
    more = F.ceil(F.greatest(total - F.lit(window), F.lit(0)) / F.lit(stride)).cast("int")
    # A prompt as long as the item leaves nothing to generate.
    starts = F.when(prompt < total, F.sequence(F.lit(0), more))
    rows = df.withColumn("window", F.explode(starts))
    offset = F.col("window") * F.lit(stride)
    return (
        rows.withColumn("offset", offset)
        .withColumn("gen_len", F.least(total - F.col("offset"), F.lit(window)).cast("int"))
        .withColumn(
            "prompt_len", F.when(F.col("window") == 0, prompt).otherwise(F.lit(window - stride)).cast("int")
        )
    )


def stitch_windows(tokens: DataFrame, plan: DataFrame, item: str) -> DataFrame:
    """Absolute tokens (item, t, code) of generated windows (item, window, pos, code).

    The carried prompt of a window is cut off; window 0 keeps its given prompt. The plan, one
    row per window, is hashed, so that the tokens stream past it and are never sorted.
    """
    windows = plan.select(item, "window", "offset", "prompt_len").hint("shuffle_hash")
    joined = tokens.join(windows, [item, "window"])
    fresh = joined.filter((F.col("window") == 0) | (F.col("pos") >= F.col("prompt_len")))
    return fresh.select(item, (F.col("offset") + F.col("pos")).alias("t"), "code")
