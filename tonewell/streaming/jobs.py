"""Incremental ingest, enrichment, metrics and codebook updates.

Each micro-batch writes to a place named by its id, so a repeated batch after a
failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonewell.operators import covariance, quantise
from tonewell.operators.captions import normalise_payload
from tonewell.operators.corpus import MANIFEST_SCHEMA
from tonewell.sources.manifests import path_exists
from tonewell.streaming.stateful import PARTS, faded_blocks, faded_sums


def stream_manifest(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Manifest rows of new files only, with the fixed schema."""
    return spark.readStream.schema(MANIFEST_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def run_available(
    df: DataFrame, write, checkpoint: str, mode: str = "append", partitions: int | None = None
) -> StreamingQuery:
    """Process everything that is there, then stop; the ended query tells its progress.

    ``partitions`` is the number of state partitions, fixed for the life of a
    checkpoint; without it the session's shuffle partitions count.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    if partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        query: StreamingQuery = (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
        return query
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def stream_enrich(raw: DataFrame, payload: str, valid: str, failed: str, checkpoint: str) -> None:
    """Clean captions to one sink and failures to another, each row once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cleaned = normalise_payload(batch, payload).persist()
        good = cleaned.filter(F.col("error").isNull()).drop("error", payload)
        good.write.mode("overwrite").parquet(f"{valid}/batch={batch_id}")
        bad = cleaned.filter(F.col("error").isNotNull()).select(*[c for c in batch.columns if c != payload], "error")
        bad.write.mode("overwrite").json(f"{failed}/batch={batch_id}")
        cleaned.unpersist()

    run_available(raw, write, checkpoint)


def metric_sums(pairs: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mergeable state of a mean: the same plan on a table and on a stream."""
    return pairs.groupBy(metric).agg(F.sum(value).alias("total"), F.count(value).alias("weight"))


def metric_values(sums: DataFrame, metric: str = "metric") -> DataFrame:
    return sums.select(metric, (F.col("total") / F.col("weight")).alias("mean"), "weight")


def running_metrics(pairs: DataFrame, target: str, checkpoint: str, partitions: int | None = None) -> None:
    """Current means after every micro-batch, one folder per batch id.

    Update mode hands over the changed metrics only; the newest folder of a
    metric holds its value.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        metric_values(changed).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_available(metric_sums(pairs), write, checkpoint, mode="update", partitions=partitions)


def latest_by_batch(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Newest row of each key over all batch folders."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch")).alias("r"))
    return newest.select(key, "r.*")


def online_feature_stats(vectors: DataFrame, vector: str) -> DataFrame:
    """(dim, n, s1, s2) of all samples so far, as a streaming aggregate."""
    cells = vectors.select(F.posexplode(vector).alias("dim", "v"))
    return cells.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2")
    )


def finish_feature_stats(sums: DataFrame) -> DataFrame:
    return sums.select("dim", "n", *covariance.mean_std(F.col("n"), F.col("s1"), F.col("s2")))


# State tables: version = number of the last applied micro-batch ----------------------


def _version(folder: str, batch_id: int) -> str:
    return f"{folder}/version={batch_id:010d}"


def ema_merge(parts: DataFrame, name: str, decay: float) -> DataFrame:
    """(name, n, top, mass, first) of the parts (name, block, n, top, mass, first), in the order of their blocks.

    Two parts merge by top = top1 * decay^n2 + top2. There is one part per metric and
    block of time, however many rows a block has.
    """
    after = Window.partitionBy(name).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    fade = F.pow(F.lit(decay), F.coalesce(F.sum("n").over(after), F.lit(0)))
    return parts.withColumn("__fade", fade).groupBy(name).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("top") * F.col("__fade")).alias("top"),
        F.sum(F.col("mass") * F.col("__fade")).alias("mass"),
        F.min_by("first", "block").alias("first"),
    )


def ema_value(state: DataFrame, name: str, decay: float, unbias: bool = True) -> DataFrame:
    """Current average. Unbiased: the weights are 1 / count with count = count * decay + 1.

    Otherwise the first value starts the average and each next one has the
    weight 1 - decay.
    """
    if unbias:
        value = F.col("top") / F.col("mass")
    else:
        fade = F.pow(F.lit(decay), F.col("n") - 1)
        value = F.col("first") * fade + (F.col("top") - F.col("first") * fade) * F.lit(1 - decay)
    return state.select(name, "n", value.alias("ema"))


def ema_state(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    name: str,
    order: str,
    value: str,
    decay: float,
    lateness: float,
    width: float | None = None,
    partitions: int | None = None,
) -> int:
    """Keep the average of a stream by event time; returns how many rows came too late.

    The ``order`` column (seconds) says what comes before what, not the batch: rows wait
    in the keyed state, by metric and block of ``width`` seconds, until a row more than
    ``lateness`` behind the block's end has come. A finished block is one row appended to
    ``folder``; nothing that waits is written again, and each batch has a folder of its
    own, which a repeated batch replaces. A row that comes later than ``lateness`` is not
    merged; Spark counts such rows (the last hundred batches of a run are looked at).
    """
    blocks = faded_blocks(stream, name, order, value, decay, lateness, width or max(lateness, 1e-3))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    query = run_available(blocks, write, checkpoint, partitions=partitions)
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def waiting_sums(spark: SparkSession, checkpoint: str, name: str, decay: float) -> DataFrame:
    """Sums of the blocks that are still open, read from the stream's own state."""
    rows = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    cells = rows.select(f"key.{name}", "key.block", "list_element.times", "list_element.samples")
    kind = cells.schema[name].dataType.simpleString()

    def total(block: pd.DataFrame) -> pd.DataFrame:
        sums = faded_sums(np.concatenate(list(block["times"])), np.concatenate(list(block["samples"])), decay)
        columns = [name, "block", "n", "top", "mass", "first"]
        return pd.DataFrame([(block[name].iloc[0], block["block"].iloc[0], *sums)], columns=columns)

    return cells.groupBy(name, "block").applyInPandas(total, f"{name} {kind}, block bigint, {PARTS}")


def finished_ema(spark: SparkSession, folder: str, checkpoint: str, name: str, decay: float) -> DataFrame:
    """State with all rows that still wait, for a stream that has ended."""
    done = spark.read.parquet(folder).drop("batch")
    return ema_merge(done.unionByName(waiting_sums(spark, checkpoint, name, decay)), name, decay)


def _names(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [x.getPath().getName() for x in found]


def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    """State after the last micro-batch; the folders' names tell which one that is."""
    return spark.read.parquet(f"{folder}/{max(x for x in _names(spark, folder) if x.startswith('version='))}")


def online_codebook(
    stream: DataFrame,
    vector: str,
    key: str,
    start,
    folder: str,
    checkpoint: str,
    decay: float = 0.99,
    threshold: float = 0.0,
    seed=0,
) -> None:
    """Codebook state (code, dim, cluster_size, embed_avg, embed), one version per micro-batch.

    A batch is assigned to the current codes, codes below the threshold take
    random batch vectors, then the averages move. The state is model-sized.
    """
    spark = stream.sparkSession
    codes = len(start)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _version(folder, batch_id - 1)
        if path_exists(spark, before):
            state = spark.read.parquet(before)
        else:
            state = (
                quantise.book_table(spark, start)
                .select("code", F.posexplode("vector").alias("dim", "embed"))
                .select("code", "dim", F.lit(0.0).alias("cluster_size"), F.col("embed").alias("embed_avg"), "embed")
            )
        book = np.zeros_like(np.asarray(start, dtype=np.float64))
        quantise.check_book(*book.shape)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "embed"))), lambda x: x["embed"])
        for r in state.groupBy("code").agg(ordered.alias("vector")).toLocalIterator():
            book[r["code"]] = r["vector"]
        stats = quantise.assignment_stats(batch, vector, book)
        moved = quantise.codebook_ema(state.drop("embed"), stats, decay, codes)
        if threshold:
            # A code that was dead before this batch starts again from a batch vector.
            fresh = quantise.book_table(spark, quantise.init_centroids(batch, vector, key, codes, f"{seed}:{batch_id}"))
            cells = fresh.select("code", F.posexplode("vector").alias("dim", "__fresh"))
            dead = state.filter(F.col("cluster_size") < threshold).select("code").distinct().withColumn("__dead", F.lit(True))
            moved = moved.join(cells, ["code", "dim"]).join(dead, "code", "left")
            moved = moved.withColumn(
                "embed", F.when(F.col("__dead") & F.lit(batch_id > 0), F.col("__fresh")).otherwise(F.col("embed"))
            ).drop("__fresh", "__dead")
        moved.write.mode("overwrite").parquet(_version(folder, batch_id))

    run_available(stream, write, checkpoint)
