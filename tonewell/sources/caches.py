"""Caches of derived data: embeddings by key, mini batches by epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.operators.joins import cache_misses
from tonewell.session import written
from tonewell.sources.cache_index import SignedFiles
from tonewell.sources.manifests import write_failures


def embedding_cache(
    keys: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    key: str = "path",
    extract: Callable[[DataFrame], DataFrame] | None = None,
    file_rows: int = 1_000_000,
    failures: str | None = None,
) -> DataFrame:
    """Embedding per key, read from the cache or computed, stored and read back.

    The cache is a ``SignedFiles`` table (key, sig, embedding) by sha1(key): a call opens
    only the files that its index names for the asked keys; ``compact_cache`` joins the
    files of many calls. ``compute`` maps the missing keys to
    (key, embedding); ``extract`` cuts the wanted part out of the full embeddings. Where
    ``compute`` also gives ``error`` (``resources.embed_with`` does), the keys that failed are
    left out of the cache, so that the next call tries them again, and out of the result;
    they are appended to the JSON table ``failures``.
    """
    spark = keys.sparkSession
    signed = keys.withColumn("sig", F.sha1(F.col(key).cast("string")))
    wanted = written(signed.select(key, "sig").dropDuplicates(["sig"]), "wanted")
    cache = SignedFiles(spark, path, file_rows)
    files = cache.files_with(wanted)
    missing = cache_misses(wanted, cache.read(files), ["sig"]) if files else wanted
    missing = written(missing, "missing")  # read to compute and to join
    computed = compute(missing.select(key))
    if "error" in computed.columns:
        computed = written(computed, "computed")
        if failures is not None:
            write_failures(computed.select(F.col(key).cast("string").alias("source_file"), "error"), failures)
        computed = computed.filter(F.col("error").isNull()).drop("error")
    fresh = written(missing.join(computed, key), "fresh")
    if not fresh.isEmpty():
        cache.append(fresh)
    kept = fresh.unionByName(cache.read(files).select(*fresh.columns)) if files else fresh
    # the cache may hold an entry twice, where two calls ran side by side
    found = signed.join(kept.drop(key).join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sig").drop("sig")
    return extract(found) if extract else found


def compact_cache(spark: SparkSession, path: str, file_rows: int = 1_000_000) -> None:
    """Join the files of all calls so far into sorted ones; the next call reads those."""
    SignedFiles(spark, path, file_rows).compact()


def split_hits(keys: DataFrame, cache: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cached rows, missing keys)."""
    return keys.join(cache, on), cache_misses(keys, cache, on)


def write_batches(df: DataFrame, path: str, epoch: int, total_batch: int, position: str = "pos") -> None:
    """Mini batches of one epoch: update = position div total_batch, item = the rest.

    An epoch is a folder; inside, files are sorted by update, so that a read of a
    few updates skips the others by Parquet statistics, without a folder per
    update of a hundred rows each.
    """
    rows = df.withColumn("update", F.floor(F.col(position) / total_batch).cast("bigint")).withColumn(
        "item", (F.col(position) % total_batch).cast("int")
    )
    ordered = rows.repartitionByRange("update", "item").sortWithinPartitions("update", "item")
    ordered.write.mode("overwrite").parquet(f"{path}/epoch={epoch:05d}")


def read_batches(spark: SparkSession, path: str, epoch: int, min_length: int = 1) -> DataFrame:
    """All items of all updates of one epoch.

    A gap between updates or fewer than ``min_length`` of them is an error. The check
    reads one column.
    """
    rows = spark.read.parquet(f"{path}/epoch={epoch:05d}")
    updates = rows.select("update").distinct().agg(F.count(F.lit(1)).alias("n"), F.max("update").alias("top")).first()
    if updates["n"] < min_length or updates["top"] is None or updates["top"] + 1 != updates["n"]:
        raise ValueError(f"the cache has {updates['n']} updates, at least {min_length} in a row are needed")
    return rows
