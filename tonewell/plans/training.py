"""The training items of an epoch as one plan: files, draws, segments, metadata, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.functions import text as X
from tonewell.operators import conditions, corpus, joins, sampling
from tonewell.session import written

#: How the fields of a sidecar are cleaned.
CLEANERS = {"key": "key", "bpm": "bpm", "genre": "keyword", "instrument": "keyword"}


def training_items(
    spark: SparkSession,
    manifest: DataFrame,
    sidecars: DataFrame,
    paraphrases: DataFrame,
    seconds: float,
    sample_rate: int,
    low: float,
    high: float,
    dropout: dict[str, dict[str, float]],
    batch: int = 16,
    paraphrase_p: float = 0.5,
    merge_p: float = 0.8,
    drop_p: float = 0.3,
    keep_p: float = 0.7,
    seed: int = 3,
) -> DataFrame:
    """One item per kept file and epoch, in draws with replacement: index, path, seek, frames, text and wav conditions.

    Files outside [low, high] seconds go; the others are drawn by weight and duration;
    a draw gets a random segment and its file's sidecar; fields are cleaned, the
    description is paraphrased and merged with them, and conditions are nulled per batch.
    The manifest is filtered and written once, so it is scanned once.
    """
    files = written(corpus.filter_duration(manifest, low=low, high=high).select("path", "duration", "weight"), "files")
    draws = sampling.sample_files(spark, files, files.count(), shuffle=False)
    segments = sampling.draw_segments(draws.join(files.select("path", "duration"), "path"), seconds, sample_rate, 1)
    found = joins.attach_sidecar(segments, sidecars)
    cleaned = corpus.normalise_attributes(found, CLEANERS)
    told = joins.apply_paraphrase(cleaned, paraphrases, paraphrase_p, seed, "index")
    fields = {name: F.col(name) for name in CLEANERS}
    merged = X.merge_description(F.col("description"), fields, F.col("index"), merge_p, drop_p, keep_p, seed=seed)
    wave = F.struct(
        F.col("n_frames").cast("bigint").alias("length"), F.lit(sample_rate).alias("sample_rate"),
        F.col("path").alias("path"), F.col("seek_time").alias("seek_time"),
    )
    rows = told.select("index", "path", "seek_time", "n_frames", merged.alias("description"), "genre", wave.alias("self_wav"))
    made = conditions.to_conditions(rows, ["description", "genre"], wave=["self_wav"])
    return conditions.attribute_dropout(made, dropout, F.expr(f"index div {batch}"), seed)
