"""Manifest level operators: filters, splits, projections, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.functions import text as X
from tonewell.functions.hashing import md5_mod, uniform
from tonewell.operators.scans import bucket_count, row_positions, share_bucket, take_smallest

# Fixed value: order of the manifest fields, which is also their sort order.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("duration", T.DoubleType(), False),
        T.StructField("sample_rate", T.IntegerType(), False),
        T.StructField("amplitude", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("info_path", T.StringType()),
    ]
)


def select_known(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the fields of ``schema``; absent ones become null of the right type."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def sort_manifest(df: DataFrame) -> DataFrame:
    """Total order over all manifest fields."""
    return df.orderBy(*[F.col(f.name) for f in MANIFEST_SCHEMA.fields if f.name in df.columns])


def duration_between(duration: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; a missing bound is open."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"min duration {low} is above max duration {high}")
    keep = F.lit(True)
    if low is not None:
        keep = keep & (duration >= F.lit(low))
    if high is not None:
        keep = keep & (duration <= F.lit(high))
    return keep


def filter_duration(
    df: DataFrame,
    low: float | None = None,
    high: float | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Rows whose duration is within the bounds.

    With an ``Observation`` the row counts before and after (``rows``, ``kept``)
    come from the same pass; ``removed_percent`` reads them after an action.
    """
    keep = duration_between(F.col("duration"), low, high)
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.sum(keep.cast("int")).alias("kept"),
        )
    return df.filter(keep)


def removed_percent(observation: Observation) -> float:
    """Share of removed rows; no row left is an error."""
    counts = observation.get
    rows, kept = counts["rows"], counts["kept"] or 0
    if kept == 0:
        raise ValueError("no file left after the duration filter")
    return 100.0 * (rows - kept) / rows


def require_fields(
    df: DataFrame, raw: str, required: Sequence[str], optional: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Check the keys of a raw JSON column.

    Adds ``error`` (null when complete); ``strict`` raises on the first bad row.
    A required field listed in ``optional`` may be missing.
    """
    keys = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(r) for r in required if r not in optional]).cast("array<string>")
    missing = F.array_sort(F.array_except(wanted, keys))
    message = F.when(
        F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))
    )
    if strict:
        message = F.when(message.isNotNull(), F.raise_error(message).cast("string"))
    return df.withColumn("error", message)


def normalise_attributes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Clean attribute columns; ``kinds`` maps a column to its cleaner."""
    cleaners = {
        "string": X.get_string,
        "keyword": X.get_keyword,
        "keyword_list": X.get_keyword_list,
        "keyword_array": lambda c: X.get_keyword_list(c, "array"),
        "key": X.get_musical_key,
        "bpm": X.get_bpm,
    }
    return df.withColumns({name: cleaners[kind](F.col(name)) for name, kind in kinds.items()})


def has_music_meta() -> Column:
    return F.col("name").isNotNull()


def has_sound_meta() -> Column:
    return F.col("description").isNotNull()


def limit_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in the order of the columns; 0 keeps all."""
    return df if n == 0 else df.orderBy(*order).limit(n)


def clip_plan(df: DataFrame, position: str, default_seconds: float = 10.0) -> DataFrame:
    """Clip requests of caption rows: base name, link and time range."""
    clip = F.coalesce(F.col("caption_id").cast("string"), F.col(position).cast("string"))
    return df.select(
        clip.alias("caption_id"),
        "ytid",
        F.concat(clip, F.lit("_"), F.col("ytid")).alias("base_name"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("ytid")).alias("url"),
        F.col("start_s").cast("double").alias("start_s"),
        F.coalesce(F.col("end_s"), F.col("start_s") + F.lit(default_seconds))
        .cast("double")
        .alias("end_s"),
        F.col("raw_caption"),
    )


def rewrite_path(df: DataFrame, column: str, root: str, out: str, suffix: str) -> DataFrame:
    """Move paths from ``root`` to ``out`` with a new suffix; a foreign path is an error row."""
    root = root if root.endswith("/") else root + "/"
    path = F.col(column)
    inner = F.substr(path, F.lit(len(root) + 1))
    moved = F.regexp_replace(F.concat(F.lit(out.rstrip("/") + "/"), inner), "\\.[^./]*$", "")
    return df.withColumn(
        "out_path", F.when(path.startswith(root), F.concat(moved, F.lit(suffix)))
    ).withColumn(
        "error",
        F.when(~path.startswith(root), F.concat(F.lit("path outside of root: "), path)),
    )


def split_by_hash(key: Column, valid_pct: int) -> Column:
    """``valid`` for a stable share of the keys, else ``train``."""
    if not 1 <= valid_pct <= 99:
        raise ValueError("valid_pct must be within 1..99")
    return F.when(md5_mod(key, 100) < valid_pct, "valid").otherwise("train")


def group_key(source_json: Column, path: Column) -> Column:
    """Clip id of the source record, else the file stem."""
    clip = F.get_json_object(source_json, "$.ytid")
    return F.when(F.length(clip) > 0, clip).otherwise(X.file_stem(path))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


def corpus_totals(df: DataFrame, keep: Column) -> DataFrame:
    """Total duration of the kept rows and the removed share, in one pass."""
    return df.agg(
        F.sum(F.when(keep, F.col("duration"))).alias("total_duration"),
        F.count(F.when(keep, 1)).cast("bigint").alias("kept"),
        (F.lit(100.0) * F.count(F.when(~keep, 1)) / F.count(F.lit(1))).alias("removed_percent"),
    )


def random_order(df: DataFrame, seed, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Random position ``pos`` of each row (per group), deterministic in the seed."""
    u = uniform(seed, *[F.col(c) for c in by], F.col(key))
    return row_positions(
        df.withColumn("__u", u),
        by,
        share_bucket(F.col("__u"), bucket_count(df)),
        [F.col("__u"), F.col(key)],
    ).drop("__u")


def random_subset(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n rows without replacement; all rows when there are no more than n."""
    return take_smallest(df, n, uniform(seed, F.col(key)), [F.col(key)])


def sample_with_repeat(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n rows of a pool; a pool smaller than n is repeated floor(n / size) + 1 times."""
    size = df.count()
    copies = n // size + 1 if 0 < size < n else 1
    pool = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return take_smallest(pool, n, uniform(seed, F.col(key), F.col("copy")), [F.col(key), F.col("copy")])


def retain_latest(df: DataFrame, run: str, version: str, n: int) -> DataFrame:
    """The last n numbered versions of each run.

    Spark cuts every run to n rows in each task before it shuffles (a group limit
    below the window), so a run with most rows is a few rows per task.
    """
    newest = Window.partitionBy(run).orderBy(F.col(version).desc())
    return df.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r")


def convert_plan(
    manifest: DataFrame, done: DataFrame, root: str, out: str, suffix: str, channels: int | None = None
) -> DataFrame:
    """Pending conversions: rewritten path, channel count of at most 2, finished rows removed."""
    wanted = F.lit(channels) if channels else F.col("channels")
    plan = rewrite_path(manifest, "path", root, out, suffix)
    plan = plan.withColumn("out_channels", F.least(wanted, F.lit(2)).cast("int"))
    return plan.join(done.select("out_path").distinct(), "out_path", "left_anti")
