"""Distributed corpus conversion: resume, decode, fix channels, clip, encode, mark as done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.operators.corpus import convert_plan
from tonewell.sources.manifests import path_exists
from tonewell.sources.wav import convert_files


def convert_corpus(
    corpus: DataFrame,
    root: str,
    out_root: str,
    target: str,
    done: str,
    channels: int | None = None,
    failures: str | None = None,
) -> None:
    """Convert the files that have no finished mark to ``out_root`` and mark them.

    ``corpus``: (path, channels), and ``member`` for members of archives; other columns (a
    copied sidecar for instance) are kept next to the result. A task streams a file from
    its place to its new one, so no content is ever a row and none is shuffled. One pass
    writes a row per file to ``target`` (partition ``failed``); marks go to ``done``, the
    failed paths of this run to ``failures``. A failed file does not stop the run and is
    tried again by the next one.
    """
    spark = corpus.sparkSession
    run = f"run-{uuid.uuid4().hex}"
    marks = spark.read.parquet(done) if path_exists(spark, done) else spark.createDataFrame([], "out_path string")
    plan = convert_plan(corpus, marks, root, out_root, ".wav", channels).drop("channels")
    made = convert_files(plan.withColumn("reason", F.col("error")).drop("error"))
    rows = made.withColumn("failed", F.col("error").isNotNull().cast("int")).withColumn("run", F.lit(run))
    rows.write.mode("append").partitionBy("run", "failed").parquet(target)

    # Marks and failures come from what was written, so a lost run leaves none.
    written = spark.read.parquet(target).filter(F.col("run") == run)
    written.filter("failed = 0").select("out_path").write.mode("append").parquet(done)
    if failures is not None:
        written.filter("failed = 1").select("path", "error").write.mode("append").json(failures)


def converted_files(spark, target: str) -> DataFrame:
    """(out_path, bytes, kept columns) of all converted files."""
    return spark.read.parquet(target).filter("failed = 0").drop("failed", "run", "error", "path", "out_channels")
