"""Evaluation metrics as mergeable sums.

Every metric is a set of partial sums, so a batch result, a grouped result and a
running result over a stream come from the same expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewell.functions import arrays as A


def _agg(df: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def kl_term(pred: Column, target: Column, eps: float = 1e-6) -> Column:
    """Sum of t * (log t - log(p + eps)); a zero target adds nothing."""
    return A.total(
        F.zip_with(
            pred, target, lambda p, t: F.when(t > 0, t * (F.log(t) - F.log(p + F.lit(eps)))).otherwise(0.0)
        )
    )


def kl_divergence(pairs: DataFrame, by: Sequence[str] = (), pred: str = "pred", target: str = "target") -> DataFrame:
    """Dataset means in both directions; ``kld`` is the prediction-side one."""
    p, t = F.col(pred), F.col(target)
    terms = pairs.select(*by, kl_term(p, t).alias("pq"), kl_term(t, p).alias("qp"))
    means = _agg(terms, by, F.avg("pq").alias("kld_pq"), F.avg("qp").alias("kld_qp"))
    return means.withColumn("kld_both", F.col("kld_pq") + F.col("kld_qp")).withColumn("kld", F.col("kld_pq"))


def text_consistency(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean cosine of paired vectors; no pair at all is an error."""
    terms = pairs.select(*by, A.cosine(F.col(a), F.col(b), 1e-8).alias("c"))
    sums = _agg(terms, by, F.sum("c").alias("__s"), F.count("c").alias("pairs"))
    mean = F.when(F.col("pairs") > 0, F.col("__s") / F.col("pairs")).otherwise(
        F.raise_error(F.lit("no pair to compare")).cast("double")
    )
    return sums.withColumn("consistency", mean).drop("__s")


def frame_cosine(pairs: DataFrame, hop: int, eps: float = 1e-12) -> DataFrame:
    """Frame-weighted cosine over the first ceil(size / hop) frames of each item.

    ``pairs``: (item, frame, size, pred, target). An item always weighs
    ceil(size / hop), even where fewer frames exist.
    """
    wanted = F.ceil(F.col("size") / F.lit(hop))
    scored = pairs.select(
        "item",
        wanted.alias("wanted"),
        F.when(F.col("frame") < wanted, A.cosine(F.col("target"), F.col("pred"), eps)).alias("c"),
    )
    per_item = scored.groupBy("item").agg(F.sum("c").alias("c"), F.max("wanted").alias("w"))
    return per_item.agg((F.sum("c") / F.sum("w")).alias("cosine"), F.sum("w").cast("bigint").alias("frames"))


def iou_per_item(pairs: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Intersection over union of (pred > threshold) and truth per item; 0 / 0 is NaN."""
    hit, true = F.col("pred") > F.lit(threshold), F.col("truth") != 0
    sums = pairs.groupBy(*by).agg(
        F.sum((hit & true).cast("bigint")).alias("__i"), F.sum((hit | true).cast("bigint")).alias("__u")
    )
    iou = F.when(F.col("__u") > 0, F.col("__i") / F.col("__u")).otherwise(F.lit(float("nan")))
    return sums.withColumn("iou", iou).drop("__i", "__u")


def miou(
    pairs: DataFrame, item: str, by: Sequence[str] = (), threshold: float = 0.5, skip_empty: bool = False
) -> DataFrame:
    """Mean of the item values; an item with an empty union makes it NaN unless skipped."""
    items = iou_per_item(pairs, [*by, item], threshold)
    if skip_empty:
        items = items.filter(~F.isnan("iou"))
    return _agg(items, by, F.avg("iou").alias("miou"))


def cross_entropy_terms(df: DataFrame, logits: str, target: str) -> Column:
    """-log softmax(logits)[target] of one row."""
    scores = A.doubles(F.col(logits))
    return A.log_sum_exp(scores) - F.get(scores, F.col(target))


def cross_entropy(df: DataFrame, logits: str, target: str, mask: Column, codebook: str = "q") -> DataFrame:
    """Masked cross entropy and perplexity per codebook (rows ``scope`` = q) and overall.

    Overall: the plain mean of the codebook means and its exponential.
    """
    per_q = (
        df.filter(mask)
        .groupBy(F.col(codebook).cast("string").alias("scope"))
        .agg(F.avg(cross_entropy_terms(df, logits, target)).alias("ce"))
    )
    overall = per_q.agg(F.avg("ce").alias("ce")).select(F.lit("all").alias("scope"), "ce")
    return per_q.unionByName(overall).withColumn("ppl", F.exp("ce"))


def stage_cross_entropy(
    df: DataFrame, logits: str, target: str, mask: Column, stage: int, codebook: str = "q"
) -> DataFrame:
    """Cross entropy of one codebook, masked positions left out."""
    chosen = df.filter((F.col(codebook) == F.lit(stage)) & mask)
    return chosen.agg(F.avg(cross_entropy_terms(df, logits, target)).alias("ce"))


def per_stage_mean(losses: DataFrame, num_steps: int, num_stages: int = 4) -> DataFrame:
    """Mean loss per name and range of steps: rows ``name``_``stage``; empty ranges are absent.

    ``losses``: (name, step, value).
    """
    stage = F.floor(F.col("step") / F.lit(num_steps) * F.lit(num_stages)).cast("int")
    in_range = (stage >= 0) & (stage < num_stages)
    means = losses.filter(in_range).groupBy("name", stage.alias("stage")).agg(F.avg("value").alias("value"))
    return means.select(F.concat_ws("_", "name", F.col("stage").cast("string")).alias("name"), "value")


def average_metrics(df: DataFrame, by: Sequence[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Count-weighted mean over batches or workers."""
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"))


def loss_ratios(norms: DataFrame, group: str, name: str = "name", norm: str = "norm", weight: str = "weight") -> DataFrame:
    """Share of each loss in the total norm, and the wanted share by weight."""
    per_loss = norms.groupBy(group, name).agg(F.avg(norm).alias("norm"), F.max(weight).alias("weight"))
    # After the aggregation a group has one row per loss name.
    whole = Window.partitionBy(group)
    return per_loss.select(
        group,
        name,
        (F.col("norm") / F.sum("norm").over(whole)).alias("ratio"),
        (F.col("weight") / F.sum("weight").over(whole)).alias("desired"),
    )


def score_table_mean(scores: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean of external per-pair scores: null ones are skipped, 0 when none is left."""
    return _agg(scores, by, F.coalesce(F.avg(score), F.lit(0.0)).alias("score"))
