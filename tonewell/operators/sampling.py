"""Epoch sampling plans: weighted draws, permutations, segments, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewell.functions.hashing import bucket_of, uniform
from tonewell.operators.scans import bucket_count, row_positions, running, share_bucket
from tonewell.session import written


def sampling_score(on_weight: bool, on_duration: bool) -> Column:
    """Product of the enabled factors; a null weight counts as 1."""
    score = F.lit(1.0)
    if on_weight:
        score = score * F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    if on_duration:
        score = score * F.col("duration")
    return score


def sampling_weights(df: DataFrame, on_weight: bool, on_duration: bool) -> DataFrame:
    """Columns ``score`` and ``probability``, the score over the total of all scores."""
    scored = df.withColumn("score", sampling_score(on_weight, on_duration))
    return sampling_probabilities(scored, {"probability": (on_weight, on_duration)})


def sampling_probabilities(df: DataFrame, wanted: dict[str, tuple[bool, bool]]) -> DataFrame:
    """A column for each name in ``wanted``: (on_weight, on_duration). All totals come from one aggregate."""
    scores = {name: sampling_score(*flags) for name, flags in wanted.items()}
    totals = df.agg(F.struct(*[F.sum(score).alias(name) for name, score in scores.items()])).scalar()
    return df.withColumns({name: score / totals[name] for name, score in scores.items()})


def _bucketed(df: DataFrame, key: str, score: str, buckets: int) -> DataFrame:
    """Rows that can be drawn, with their hash bucket."""
    return df.filter(F.col(score) > 0).withColumn("bucket", bucket_of(buckets, F.col(key)))


def _bucket_spans(rows: DataFrame, score: str) -> DataFrame:
    """(bucket, bucket_low, bucket_weight, total): the place of each bucket on the scale of all weights.

    One row per bucket, so the windows without a key stay small.
    """
    sizes = rows.groupBy("bucket").agg(F.sum(score).alias("bucket_weight"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        "bucket",
        F.coalesce(F.sum("bucket_weight").over(earlier), F.lit(0.0)).alias("bucket_low"),
        "bucket_weight",
        F.sum("bucket_weight").over(everything).alias("total"),
    )


def sampling_cdf(df: DataFrame, key: str, score: str, buckets: int = 1024) -> DataFrame:
    """Cumulative weights by (hash bucket, key): columns bucket, low, high.

    Two-level prefix sum: a window inside each bucket and the offsets of the
    earlier buckets, one row per bucket.
    """
    rows = _bucketed(df, key, score, buckets)
    return _cdf(rows, _bucket_spans(rows, score), key, score)


def _cdf(rows: DataFrame, spans: DataFrame, key: str, score: str) -> DataFrame:
    inside = Window.partitionBy("bucket").orderBy(key)
    local = rows.withColumn("__local", F.sum(score).over(inside))
    return (
        local.join(F.broadcast(spans.drop("total")), "bucket")
        .withColumn("high", F.col("bucket_low") + F.col("__local"))
        .withColumn("low", F.col("high") - F.col(score))
        .drop("__local")
    )


def draw_seed(epoch: int | None, shuffle: bool, shuffle_seed: int, n: int) -> str:
    """Part of the draw key that is common to one epoch."""
    return f"draw:{n * ((epoch or 0) + shuffle_seed)}" if shuffle else "draw:fixed"


def sample_files(
    spark: SparkSession,
    files: DataFrame,
    n: int,
    key: str = "path",
    epoch: int = 0,
    shuffle: bool = True,
    shuffle_seed: int = 0,
    on_weight: bool = True,
    on_duration: bool = True,
    buckets: int = 256,
    cells: int | None = None,
) -> DataFrame:
    """n draws with replacement, in proportion to the scores: (index, key).

    A draw takes the file whose cumulative interval holds u * total. Draws find
    their hash bucket through a table of at most ``buckets`` + ``cells`` rows,
    and inside the bucket the last interval start before them. A bucket is cut
    in ``cells`` position cells, so that a file with a large weight spreads its
    draws over tasks, and a bucket of many light files stays small by hashing. The draws
    depend on ``buckets``, so a larger manifest that wants more of them says so.
    """
    cells = cells or bucket_count(files)
    scored = files.select(key, *[c for c in ("weight", "duration") if c in files.columns])
    scored = scored.withColumn("score", sampling_score(on_weight, on_duration))
    # The manifest is read once; its scores and the bucket spans serve several times.
    rows = written(_bucketed(scored.select(key, "score"), key, "score", buckets), "scores")
    places = written(_bucket_spans(rows, "score"), "spans")
    cdf = _cdf(rows, places, key, "score")
    slot = [
        F.floor(edge / F.col("total") * F.lit(buckets))
        for edge in (F.col("bucket_low"), F.col("bucket_low") + F.col("bucket_weight"))
    ]
    spans = places.select(
        F.explode(F.sequence(*slot)).alias("slot"),
        "bucket",
        F.col("bucket_low").alias("b_low"),
        F.col("bucket_weight").alias("b_weight"),
        "total",
    )
    draws = spark.range(n).select(
        F.col("id").alias("index"),
        uniform(draw_seed(epoch, shuffle, shuffle_seed, n), F.col("id")).alias("u"),
    )
    placed = (
        draws.withColumn("slot", F.floor(F.col("u") * F.lit(buckets)))
        .join(F.broadcast(spans), "slot")
        .withColumn("at", F.col("u") * F.col("total"))
        .filter((F.col("at") >= F.col("b_low")) & (F.col("at") < F.col("b_low") + F.col("b_weight")))
    )

    def cell(position: Column, low: Column, weight: Column) -> Column:
        return share_bucket((position - low) / weight, cells)

    starts = cdf.select(
        "bucket",
        F.col("low").alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("index"),
        F.col(key).alias("__file"),
        cell(F.col("low"), F.col("bucket_low"), F.col("bucket_weight")).alias("cell"),
    )
    points = placed.select(
        "bucket",
        "at",
        F.lit(1).alias("kind"),
        "index",
        F.lit(None).cast(files.schema[key].dataType).alias("__file"),
        cell(F.col("at"), F.col("b_low"), F.col("b_weight")).alias("cell"),
    )
    found = running(
        starts.unionByName(points),
        ["bucket"],
        F.col("cell"),
        [F.col("at"), F.col("kind"), F.col("index")],
        {key: ("last", F.col("__file"))},
    )
    return found.filter(F.col("kind") == 1).select("index", key)


def permute_files(
    files: DataFrame, n: int, key: str = "path", epoch: int = 0, seed: int = 0
) -> DataFrame:
    """Draws without replacement that go on across epochs: (index, key).

    Draw i of an epoch has number epoch * n + i; it takes the entry at
    (number mod F) of permutation (number div F) over F files. Each needed
    permutation is ranked once and its positions give the draw numbers.
    """
    size = files.count()
    if not size:
        return files.select(F.lit(0).cast("bigint").alias("index"), key)
    first, last = epoch * n // size, (epoch * n + n - 1) // size
    orders = files.select(key).withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(last))))
    orders = orders.withColumn("u", uniform(f"perm:{seed}", F.col("perm"), F.col(key)))
    ranked = row_positions(
        orders, ["perm"], share_bucket(F.col("u"), bucket_count(files)), [F.col("u"), F.col(key)], "rel"
    )
    index = F.col("perm").cast("bigint") * size + F.col("rel") - F.lit(epoch * n)
    return ranked.select(index.alias("index"), key).filter((F.col("index") >= 0) & (F.col("index") < n))


def draw_segments(
    df: DataFrame,
    segment: float,
    sample_rate: int,
    channels: int,
    min_ratio: float = 0.5,
    seed="segment",
    index: str = "index",
    pad: bool = True,
) -> DataFrame:
    """Seek time and frame counts of one segment per row.

    The seek range leaves at least ``min_ratio`` of a segment inside the file;
    ``n_frames`` are the readable frames, ``total_frames`` the padded length.
    """
    max_seek = F.greatest(F.lit(0.0), F.col("duration") - F.lit(segment * min_ratio))
    target = int(segment * sample_rate)
    left = F.floor((F.col("duration") - F.col("seek_time")) * F.lit(sample_rate))
    frames = F.least(F.greatest(left, F.lit(0)), F.lit(target)).cast("int")
    return (
        df.withColumn("seek_time", uniform(seed, F.col(index)) * max_seek)
        .withColumn("n_frames", frames)
        .withColumn("total_frames", F.lit(target) if pad else F.col("n_frames"))
        .withColumn("segment_rate", F.lit(sample_rate))
        .withColumn("segment_channels", F.lit(channels))
    )


def full_items(df: DataFrame) -> DataFrame:
    """One row per file, the whole file, when no segment length is set."""
    frames = F.floor(F.col("duration") * F.col("sample_rate")).cast("bigint")
    return df.select(
        "*",
        F.lit(0.0).alias("seek_time"),
        frames.alias("n_frames"),
        frames.alias("total_frames"),
    )


def retry_failed(candidates: DataFrame, readable: Column, max_retry: int = 10) -> DataFrame:
    """First readable candidate per index among the first ``max_retry`` attempts.

    ``error`` is set where every attempt failed.
    """
    payload = [c for c in candidates.columns if c not in ("index", "attempt")]
    attempts = candidates.filter(F.col("attempt") < max_retry)
    chosen = attempts.groupBy("index").agg(
        F.min_by(F.struct("attempt", *payload), F.when(readable, F.col("attempt"))).alias("hit"),
        F.count(F.lit(1)).alias("__tried"),
    )
    return chosen.select(
        "index",
        F.col("hit.attempt").alias("attempt"),
        *[F.col(f"hit.{c}").alias(c) for c in payload],
        F.when(F.col("hit").isNull(), F.format_string("no readable file in %d tries", "__tried")).alias(
            "error"
        ),
    )
