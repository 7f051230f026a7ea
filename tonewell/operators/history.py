"""Run histories: best and latest values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.operators.scans import running, span_bucket


def best_so_far(
    history: DataFrame, by: Sequence[str], epoch: str = "epoch", value: str = "value", block: int = 1000
) -> DataFrame:
    """Running minimum in epoch order and ``is_new_best`` (a tie is a new best)."""
    scanned = running(
        history, by, span_bucket(F.col(epoch), block), [F.col(epoch)], {"best": ("min", F.col(value))}
    )
    return scanned.withColumn("is_new_best", F.col(value) == F.col("best"))


def merge_latest_stage(history: DataFrame) -> DataFrame:
    """Last value of each (run, stage, metric); durations in minutes; number of epochs.

    ``history``: (run, epoch, stage, metric, value). The epoch count of a run is
    the row stage "train", metric "epoch".
    """
    minutes = F.when(F.col("metric") == "duration", F.col("value") / F.lit(60.0)).otherwise(F.col("value"))
    latest = history.groupBy("run", "stage", "metric").agg(F.max_by(minutes, F.col("epoch")).alias("value"))
    # "epoch" is not a stage metric of its own in a history, so the rows do not clash.
    epochs = history.groupBy("run").agg(F.max("epoch").cast("double").alias("value"))
    return latest.unionByName(
        epochs.select("run", F.lit("train").alias("stage"), F.lit("epoch").alias("metric"), "value")
    )


def best_metric(history: DataFrame, modes: dict[str, str], stage: str = "valid") -> DataFrame:
    """Best value over the epochs of one stage: rows ``best_<metric>`` per run."""
    rows = history.filter((F.col("stage") == stage) & F.col("metric").isin(*modes))
    extremes = rows.groupBy("run", "metric").agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    lower = [m for m, mode in modes.items() if mode == "lower"]
    value = F.when(F.col("metric").isin(*lower), F.col("__low")).otherwise(F.col("__high"))
    return extremes.select("run", F.concat(F.lit("best_"), "metric").alias("metric"), value.alias("value"))
