"""Watermark detection reports and losses on long detector outputs.

Detector rows: (item, channel, t, value). Channels 0 and 1 are the class
probabilities, channels from 2 on are the message bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _agg(df: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def item_means(outputs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over time of both class channels per item."""
    return outputs.groupBy(*by, "item").agg(
        F.avg(F.when(F.col("channel") == 0, F.col("value"))).alias("class0"),
        F.avg(F.when(F.col("channel") == 1, F.col("value"))).alias("class1"),
    )


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def false_positive_rate(negative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(item_means(negative, by), by, _share(F.col("class1") > 0.5).alias("fpr"))


def false_negative_rate(positive: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(item_means(positive, by), by, _share(F.col("class0") > 0.5).alias("fnr"))


def _labelled(positive: DataFrame, negative: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per item with what its detection says."""
    pos = item_means(positive, by).withColumn("positive", F.lit(True))
    neg = item_means(negative, by).withColumn("positive", F.lit(False))
    return pos.unionByName(neg)


def _accuracy() -> Column:
    pos = F.col("positive")
    right = F.when(pos, F.col("class1") > 0.5).otherwise(F.col("class0") > 0.5)
    return F.sum(right.cast("double")) / (F.lit(2.0) * F.sum(pos.cast("double")))


def detection_accuracy(positive: DataFrame, negative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Right decisions on both sides over twice the number of positives."""
    return _agg(_labelled(positive, negative, by), by, _accuracy().alias("acc"))


def augmentation_report(positive: DataFrame, negative: DataFrame, aug: str = "aug") -> DataFrame:
    """Accuracy, false positive and false negative rate per augmentation.

    The overall row (``aug`` = "all") comes from the same pass as a second
    grouping set.
    """
    items = _labelled(positive, negative, [aug])
    pos = F.col("positive")
    rows = items.groupingSets([[aug], []], aug).agg(
        _accuracy().alias("acc"),
        F.avg(F.when(~pos, (F.col("class1") > 0.5).cast("double"))).alias("fpr"),
        F.avg(F.when(pos, (F.col("class0") > 0.5).cast("double"))).alias("fnr"),
        F.grouping_id().alias("__g"),
    )
    label = F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col(aug).cast("string"))
    return rows.select(label.alias(aug), "acc", "fpr", "fnr")


def bit_accuracy(decoded: DataFrame, message: DataFrame, mask: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of message bits whose mean output over (masked) time has the right sign.

    ``decoded``: (item, bit, t, value); ``message``: (item, bit, expected);
    ``mask``: (item, t, keep).
    """
    rows = decoded
    if mask is not None:
        rows = rows.join(mask.filter(F.col("keep") == 1).select("item", "t"), ["item", "t"], "left_semi")
    votes = rows.groupBy(*by, "item", "bit").agg(F.avg("value").alias("__mean"))
    said = (F.col("__mean") > 0).cast("int")
    compared = votes.join(message.select("item", "bit", "expected"), ["item", "bit"])
    return _agg(compared, by, _share(said == F.col("expected")).alias("bit_acc"))


def localisation_accuracy(frames: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Share of frames where (pred > 0.5) equals the truth, per scenario."""
    return _agg(frames, by, _share((F.col("pred") > 0.5).cast("int") == F.col("truth").cast("int")).alias("accuracy"))


def reweight_augmentations(weights: DataFrame, report: DataFrame, aug: str = "aug") -> DataFrame:
    """New weight max(1 - accuracy, 0.05); a weight of -1 stays."""
    joined = weights.join(report.select(aug, "acc"), aug, "left")
    changed = F.greatest(F.lit(1.0) - F.col("acc"), F.lit(0.05))
    return joined.withColumn(
        "weight", F.when(F.col("weight") == -1, F.col("weight")).otherwise(F.coalesce(changed, F.col("weight")))
    ).drop("acc")


def detection_nll(
    positive: DataFrame, negative: DataFrame, positive_weight: float = 1.0, negative_weight: float = 1.0
) -> DataFrame:
    """Mean -log p of the right class.

    Rows: (item, t, p0, p1), positives also ``mask``. Positive frames with mask 0
    count as class 0; negatives only enter when every mask is 1.
    """
    pos = positive.agg(
        F.avg(-F.log(F.when(F.col("mask") == 1, F.col("p1")).otherwise(F.col("p0")))).alias("__p"),
        F.min("mask").alias("__m"),
    )
    neg = negative.agg(F.avg(-F.log("p0")).alias("__n"))
    one = F.lit(1).alias("__one")
    both = pos.select("*", one).join(neg.select("*", one), "__one")
    total = F.lit(positive_weight) * F.col("__p") + F.when(
        F.col("__m") == 1, F.lit(negative_weight) * F.col("__n")
    ).otherwise(0.0)
    return both.select(total.alias("loss"))


def message_loss(
    decoded: DataFrame, message: DataFrame, temperature: float, kind: str = "bce"
) -> DataFrame:
    """Masked binary cross entropy with logits, or squared error, at a temperature.

    ``decoded``: (item, bit, t, value, mask); ``message``: (item, bit, expected).
    No message gives 0.
    """
    if kind not in ("bce", "mse"):
        raise ValueError(f"unknown loss {kind}")
    rows = decoded.filter(F.col("mask") == 1).join(message, ["item", "bit"])
    x, y = F.col("value") / F.lit(temperature), F.col("expected").cast("double")
    if kind == "bce":
        term = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    else:
        term = (x - y) * (x - y)
    return rows.agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("loss"))
