"""Symbolic annotations: chord vocabulary, frame alignment, salience."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators.scans import row_positions, running, sorted_positions, span_bucket

NO_CHORD = "N"
UNKNOWN = "UNK"


def build_vocab(chords: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """(chord, idx): dense index by first (track, *order); the unknown symbol comes last.

    If the data holds the unknown symbol, it keeps its place in the count, and its one
    entry takes the last index all the same.
    """
    names = [f"__{i}" for i in range(1 + len(order))]
    places = F.struct(*[F.col(c).alias(n) for c, n in zip(("track", *order), names, strict=True)])
    first = chords.groupBy("chord").agg(F.min(places).alias("first")).select("chord", "first.*")
    placed = sorted_positions(first, [], names, "idx", "vocabulary").select("chord", F.col("idx").cast("int").alias("idx"))
    last = placed.agg(F.count(F.lit(1)).cast("int").alias("idx")).select(F.lit(UNKNOWN).alias("chord"), "idx")
    return placed.filter(~F.col("chord").eqNullSafe(UNKNOWN)).unionByName(last)


def apply_vocab(df: DataFrame, vocab: DataFrame, column: str = "chord", strict: bool = False) -> DataFrame:
    """Symbol to ``idx``; an unknown symbol takes the index of the unknown symbol,
    or raises with ``strict``.

    The vocabulary is read three times: give a written or checkpointed one.
    """
    known = vocab.select(F.col("chord").alias(column), "idx")
    joined = df.join(known, column, "left")
    if strict:
        message = F.concat(F.lit("unknown symbol "), F.col(column))
        return joined.withColumn("idx", F.coalesce("idx", F.raise_error(message).cast("int")))
    fallback = vocab.filter(F.col("chord") == UNKNOWN).agg(F.max("idx")).scalar()
    return joined.withColumn("idx", F.coalesce("idx", fallback))


def group_chords(chords: DataFrame, block_seconds: float = 600.0, block_rows: int = 100_000) -> DataFrame:
    """Ordered (time, chord) lists per track, one row per block of time and ``part`` of it.

    A part has at most ``block_rows`` events, so neither a very long track nor a very
    dense one ever ends up in one row.
    """
    blocked = chords.withColumn("block", span_bucket(F.col("time"), block_seconds))
    # a block is cut in slices of time to number its events, so that no task holds it all
    slice_of = span_bucket(F.col("time"), block_seconds / 64)
    ranked = row_positions(blocked, ["track", "block"], slice_of, [F.col("time"), F.col("pos")], "__place")
    parts = ranked.withColumn("part", F.floor(F.col("__place") / block_rows))
    events = F.array_sort(F.collect_list(F.struct("time", "pos", "chord")))
    return parts.groupBy("track", "block", "part").agg(
        F.transform(events, lambda e: F.struct(e["time"].alias("time"), e["chord"].alias("chord"))).alias("events")
    )


def frame_numbers(seek_time: Column, fps: float, segment: float) -> Column:
    """Absolute frame numbers of a segment; the first one is after the seek time."""
    first = F.floor(seek_time * F.lit(fps)) + 1
    last = F.floor(first + F.lit(segment * fps)) - 1
    return F.when(last >= first, F.sequence(first, last))


def frame_chords(
    segments: DataFrame,
    chords: DataFrame,
    vocab: DataFrame,
    fps: float,
    segment: float,
    bucket_seconds: float = 60.0,
    strict: bool = False,
) -> DataFrame:
    """Chord index per frame: (segment_id, frame, idx).

    A backward as-of join: a frame takes the last chord at or before its time; a
    chord at or after the end of the segment is never used; without any chord
    the symbol is "N", also for null or empty labels. Of chords at equal times
    the later list position wins. Frames and chords go through one ordered scan
    cut in time buckets, so neither a long track nor a popular one is one task.
    """
    label = F.when(F.length("chord") > 0, F.col("chord")).otherwise(F.lit(NO_CHORD))
    end = F.col("seek_time") + F.lit(segment)
    frames = segments.select(
        "track", "segment_id", "seek_time", F.explode(frame_numbers(F.col("seek_time"), fps, segment)).alias("frame")
    ).withColumn("time", F.col("frame") / F.lit(float(fps)))
    # A frame at or past the end looks just before the end, ahead of equal chords.
    late = F.col("time") >= end
    asked = frames.select(
        "track",
        F.when(late, end).otherwise(F.col("time")).alias("time"),
        F.when(late, 0).otherwise(2).alias("kind"),
        F.lit(0).cast("bigint").alias("pos"),
        "segment_id",
        "frame",
        F.lit(None).cast("string").alias("label"),
    )
    events = chords.select(
        "track",
        F.col("time").cast("double").alias("time"),
        F.lit(1).alias("kind"),
        F.col("pos").cast("bigint").alias("pos"),
        F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id"),
        F.lit(None).cast("bigint").alias("frame"),
        label.alias("label"),
    )
    scanned = running(
        asked.unionByName(events),
        ["track"],
        span_bucket(F.col("time"), bucket_seconds),
        [F.col("time"), F.col("kind"), F.col("pos"), F.col("frame")],
        {"found": ("last", F.col("label"))},
    )
    named = scanned.filter(F.col("kind") != 1).select(
        "segment_id", "frame", F.coalesce("found", F.lit(NO_CHORD)).alias("chord")
    )
    return apply_vocab(named, vocab, "chord", strict).select("segment_id", "frame", "chord", "idx")


def null_chords(fps: float, duration: Column, null_index: int) -> Column:
    """Constant index for segments without any chord table."""
    return F.array_repeat(F.lit(null_index), F.ceil(duration * F.lit(fps)).cast("int"))


def segment_salience(
    values: Column, seek_time: Column, model_fps: int, latent_fps: float, segment: float, size: int
) -> Column:
    """Values of one salience bin inside a segment, resized to ``size`` frames."""
    low = F.floor(seek_time * F.lit(model_fps)).cast("int")
    high = F.floor((seek_time + F.lit(segment)) * F.lit(model_fps)).cast("int")
    cut = F.slice(values, low + 1, F.greatest(high - low, F.lit(0)))
    return A.resample_linear(cut, model_fps, latent_fps, size)


def melody_one_hot(frames: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per frame the first bin with the largest value becomes 1, unless that value is 0.

    ``frames`` is long: by, frame, bin, value. One pass of ``max_by`` per frame.
    """
    best = frames.groupBy(*by, "frame").agg(
        F.max(F.struct(F.col(value).alias("v"), (-F.col("bin")).alias("b"))).alias("top")
    )
    return best.select(
        *by, "frame", (-F.col("top.b")).alias("bin"), (F.col("top.v") != 0).cast("int").alias("hot")
    )


def event_positions(events: DataFrame, bucket_seconds: float = 3600.0) -> DataFrame:
    """List position ``pos`` of each (track, time) event."""
    return row_positions(
        events, ["track"], span_bucket(F.col("time"), bucket_seconds), [F.col("time"), F.col("event_id")], "pos"
    )
