"""Joins of segments with metadata, caches, embeddings and random partners.

Right sides have at most one row per key, so a hot key on the left only makes a
large partition, which AQE splits; no join here can multiply rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.functions import text as X
from tonewell.functions.hashing import uniform
from tonewell.operators.scans import bucket_count, row_positions, share_bucket


def stem_path(c: Column) -> Column:
    """Path without its last suffix, the key of a file and its sidecar."""
    return F.regexp_replace(c, "(?<=[^/])\\.[^./]*$", "")


def attach_sidecar(
    segments: DataFrame, sidecars: DataFrame, path: str = "path", key: str = "stem"
) -> DataFrame:
    """Left join on the stem path.

    Segment columns win over sidecar columns of the same name. Title falls back
    to the file stem, artist and name to ``unknown``, only where a sidecar exists.
    """
    extra = [c for c in sidecars.columns if c != key and c not in segments.columns]
    right = sidecars.select(F.col(key).alias("__stem"), *extra)
    joined = segments.withColumn("__key", stem_path(F.col(path))).join(
        right, F.col("__key") == F.col("__stem"), "left"
    )
    found = F.col("__stem").isNotNull()
    defaults = {
        "title": X.file_stem(F.col(path)),
        "artist": F.lit("unknown"),
        "name": F.lit("unknown"),
    }
    for name, value in defaults.items():
        known = F.col(name) if name in joined.columns else F.lit(None).cast("string")
        joined = joined.withColumn(name, F.when(found, F.coalesce(known, value)).otherwise(known))
    return joined.withColumn("has_sidecar", found).drop("__key", "__stem")


def attach_sidecar_with_fallback(
    segments: DataFrame, local: DataFrame, external: DataFrame, value: str, path: str = "path"
) -> DataFrame:
    """Sidecar by stem path, else by file name in the external folder, else ``error``.

    ``local`` has columns (stem, value), ``external`` (name, value).
    """
    rows = segments.withColumn("__key", stem_path(F.col(path))).withColumn(
        "__name", X.file_stem(F.col(path))
    )
    near = local.select(F.col("stem").alias("__key"), F.col(value).alias("__near"))
    far = external.select(F.col("name").alias("__name"), F.col(value).alias("__far"))
    return (
        rows.join(near, "__key", "left")
        .join(far, "__name", "left")
        .withColumn(value, F.coalesce("__near", "__far"))
        .withColumn("error", F.when(F.col(value).isNull(), F.concat(F.lit("no metadata for "), F.col(path))))
        .drop("__key", "__name", "__near", "__far")
    )


def apply_paraphrase(
    df: DataFrame, paraphrases: DataFrame, p: float, seed, row_id: str, info_path: str = "info_path"
) -> DataFrame:
    """With probability p the description becomes one of the texts of its info path.

    ``paraphrases`` has one row (info_path, texts) per key; a missing key keeps
    the description. Every row draws for itself, by its ``row_id``.
    """
    right = paraphrases.select(F.col("info_path").alias("__info"), "texts")
    joined = df.join(right, F.col(info_path) == F.col("__info"), "left")
    chosen = X.pick_element(F.col("texts"), f"{seed}:pick", F.col(row_id))
    use = uniform(f"{seed}:use", F.col(row_id)) < F.lit(p)
    return joined.withColumn(
        "description", F.when(use & F.col("__info").isNotNull(), chosen).otherwise(F.col("description"))
    ).drop("__info", "texts")


def cache_misses(keys: DataFrame, cache: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(cache.select(*on).distinct(), list(on), "left_anti")


def resume(todo: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Items without a finished mark."""
    return todo.join(done.select(on).distinct(), on, "left_anti")


def resume_pairs(todo: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Items that do not have both output files yet."""
    both = first.select(on).distinct().join(second.select(on).distinct(), on, "left_semi")
    return todo.join(both, on, "left_anti")


def pair_eval(
    preds: DataFrame, targets: DataFrame, on: str, pred: str = "pred", target: str = "target"
) -> DataFrame:
    """One-to-one pairs of predictions and targets; ``same_shape`` tells equal array sizes."""
    right = targets.select(on, F.col(target).alias("target"))
    left = preds.select(on, F.col(pred).alias("pred"))
    return left.join(right, on).withColumn("same_shape", F.size("pred") == F.size("target"))


def eval_key(path: Column, seek_time: Column) -> Column:
    """Pair key: file stem, underscore, seek time."""
    return F.concat(X.file_stem(path), F.lit("_"), seek_time.cast("string"))


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once; a valid batch gives no row."""
    return (
        df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    )


def segment_frames(segments: DataFrame, first: Column, length: Column) -> DataFrame:
    """One row per wanted frame of each segment: columns ``k`` (0-based) and ``frame``."""
    rows = segments.withColumn("__first", first).withColumn("__length", length)
    wanted = F.when(F.col("__length") > 0, F.sequence(F.lit(0), (F.col("__length") - 1).cast("int")))
    return (
        rows.withColumn("k", F.explode(wanted))
        .withColumn("frame", (F.col("__first") + F.col("k")).cast("int"))
        .drop("__first", "__length")
    )


def chunk_frames(
    segments: DataFrame,
    frames: DataFrame,
    fps: float,
    length: Column,
    track: str = "track",
    value: str = "value",
    min_length: int = 0,
    zero=None,
) -> DataFrame:
    """Frames [int(fps * seek), + length) of a precomputed track, zeros past its end.

    The wanted frames are made first and joined on (track, frame), an equi join.
    """
    wanted = segment_frames(
        segments, F.floor(F.col("seek_time") * F.lit(fps)), F.greatest(length, F.lit(min_length))
    )
    found = wanted.join(frames.select(track, "frame", value), [track, "frame"], "left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(0) if zero is None else zero))


def chunk_embeddings(
    segments: DataFrame,
    full: DataFrame,
    stride_seconds: float,
    window_seconds: float,
    track: str = "track",
    segment: str = "segment_id",
    vector: str = "vector",
) -> DataFrame:
    """Mean vector of the track frames in the window that starts at the seek time.

    The frame range is [seek // stride, (seek + window) // stride). The range
    join becomes an equi join because the wanted frame numbers are generated. A
    segment meets at most window / stride frames, so its list is short.
    """
    # A null seek time means the start of the track.
    seek = F.coalesce(F.col("seek_time"), F.lit(0.0))
    first = F.floor(seek / F.lit(stride_seconds))
    last = F.floor((seek + F.lit(window_seconds)) / F.lit(stride_seconds))
    wanted = segment_frames(segments, first, last - first)
    hit = wanted.join(full.select(track, "frame", vector), [track, "frame"])
    met = F.array_sort(F.collect_list(F.struct("frame", A.doubles(F.col(vector)).alias("v"))))
    lists = hit.groupBy(segment).agg(F.transform(met, lambda f: f["v"]).alias("__v"))
    total = F.aggregate(F.slice("__v", F.lit(2), F.size("__v")), F.get("__v", F.lit(0)), A.add)
    means = lists.select(segment, A.let(F.size("__v"), lambda n: F.transform(total, lambda x: x / n)).alias(vector))
    # A window past the end of its track keeps its row, with a null vector.
    return segments.select(segment).join(means, segment, "left")


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of a vector column per group."""
    cells = df.select(*by, F.posexplode(vector).alias("dim", "v"))
    means = cells.groupBy(*by, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One entry per dimension: the list is as long as one vector.
    packed = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return means.groupBy(*by).agg(F.transform(packed, lambda x: x["v"]).alias(vector))


def random_pairs(
    df: DataFrame, batch: str, item: str, share: float, seed, payload: Sequence[str] = ()
) -> DataFrame:
    """int(share * size) random pairs per batch: two independent permutations, matched by rank.

    Columns: batch, rank, source item and target item with their payload.
    """

    def ranked(side: str) -> DataFrame:
        u = uniform(f"{seed}:{side}", F.col(batch), F.col(item))
        rows = df.select(batch, item, *payload).withColumn("__u", u)
        placed = row_positions(
            rows, [batch], share_bucket(F.col("__u"), bucket_count(df)), [F.col("__u"), F.col(item)], "rank"
        )
        return placed.select(
            batch, "rank", *[F.col(c).alias(f"{side}_{c}") for c in (item, *payload)]
        )

    sizes = df.groupBy(batch).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("__k"))
    sources = ranked("source").join(sizes, batch).filter(F.col("rank") < F.col("__k")).drop("__k")
    return sources.join(ranked("target"), [batch, "rank"])
