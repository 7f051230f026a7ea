"""Manifests, per-split data sources, splits and failure logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.operators.corpus import MANIFEST_SCHEMA, sort_manifest

SPLITS = ("train", "valid", "evaluate", "generate")


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path exists on its Hadoop file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def is_directory(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, plain or gzip by suffix; unknown keys are ignored."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def resolve_manifest(spark: SparkSession, path: str, strict: bool = False) -> str:
    """``data.jsonl`` of a folder, else ``data.jsonl.gz`` (not with ``strict``); a file stays."""
    if not is_directory(spark, path):
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        return path
    for name in ("data.jsonl",) if strict else ("data.jsonl", "data.jsonl.gz"):
        candidate = f"{path.rstrip('/')}/{name}"
        if path_exists(spark, candidate):
            return candidate
    raise ValueError(f"no manifest in {path}: expected data.jsonl or data.jsonl.gz")


def write_manifest(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Rows in manifest order, one JSON object per line, nulls kept."""
    if compression is None:
        compression = "gzip" if path.lower().endswith(".gz") else "none"
    sort_manifest(df).write.mode("overwrite").json(path, compression=compression, ignoreNullFields=False)


def datasource(spark: SparkSession, config: dict, split: str) -> DataFrame:
    """Manifest of one split.

    ``config``: paths by split under ``datasource``, optional ``max_sample_rate``
    and ``max_channels``, the dataset's ``sample_rate`` and ``channels``, and per
    split keyword overrides under ``kwargs`` (min_duration, max_duration).
    """
    from tonewell.operators.corpus import filter_duration

    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    source = config["datasource"]
    for limit, wanted in (("max_sample_rate", "sample_rate"), ("max_channels", "channels")):
        if limit in source and config.get(wanted, 0) > source[limit]:
            raise ValueError(f"{wanted} {config[wanted]} is above {limit} {source[limit]}")
    if not source.get(split):
        raise ValueError(f"no data for split {split}")
    kwargs = {**config.get("defaults", {}), **config.get("kwargs", {}).get(split, {})}
    rows = read_manifest(spark, resolve_manifest(spark, source[split]))
    return filter_duration(rows, kwargs.get("min_duration"), kwargs.get("max_duration"))


def datasources(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Every configured split."""
    return {s: datasource(spark, config, s) for s in SPLITS if config["datasource"].get(s)}


def write_split(df: DataFrame, root: str) -> None:
    """Items with their sidecars under ``split=train`` and ``split=valid``."""
    df.write.mode("overwrite").partitionBy("split").parquet(root)


def write_failures(df: DataFrame, path: str) -> None:
    """Append the failed rows as JSON lines; earlier failures stay."""
    df.filter(F.col("error").isNotNull()).write.mode("append").json(path)
