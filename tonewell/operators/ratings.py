"""Listening studies: survey pages and mean opinion scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewell.functions.hashing import uniform

PAGE_SIZE = 8


def survey_page(items: DataFrame, seed: int, n: int = PAGE_SIZE, blind: bool = False) -> DataFrame:
    """First n items of a seeded shuffle, one row per model: (key, run, path, place).

    ``items`` has (key, models) with a map run -> path. ``blind`` also shuffles
    the models inside an item.
    """
    page = items.orderBy(uniform(f"page:{seed}", F.col("key")), F.col("key")).limit(n)
    rows = page.select("key", F.explode("models").alias("run", "path"))
    u = uniform(f"blind:{seed}", F.col("key"), F.col("run")) if blind else F.lit(0.0)
    # A page has n items with one row per model.
    order = Window.partitionBy("key").orderBy(u, F.col("run"))
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def explode_ratings(results: DataFrame) -> DataFrame:
    """(user, seed, item, model, rating) of nested rating files."""
    items = results.select("user", "seed", F.explode("results").alias("r"))
    return items.select(
        "user", "seed", F.col("r.id").alias("item"), F.explode("r.models").alias("model", "rating")
    )


def mos(ratings: DataFrame, max_rating: int = 5) -> DataFrame:
    """n, mean and 95% half-width per model, ratings within 1..max_rating.

    Half-width: 1.96 times the population deviation over the root of n.
    """
    valid = ratings.filter(F.col("rating").between(1, max_rating))
    scores = valid.groupBy("model").agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"),
        F.avg("rating").alias("mean_rating"),
        (F.lit(1.96) * F.stddev_pop("rating") / F.sqrt(F.count(F.lit(1)))).alias("interval"),
    )
    return scores.withColumns(
        {
            "mean_text": F.format_string("%.2f", "mean_rating"),
            "interval_text": F.format_string("%.2f", "interval"),
        }
    )


def raters(ratings: DataFrame) -> DataFrame:
    return ratings.select("user").distinct()
