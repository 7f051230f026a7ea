"""Registered queries: readers and writers, caches, incremental jobs.

Files are written below the shared folder from the given tables and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import captions, signal
from tonewell.operators import metric_states as M
from tonewell.plans.catalog_corpus import MANIFEST_SQL, MD5_100, manifest
from tonewell.plans.catalog_joins import seconds
from tonewell.plans.catalog_metrics import HISTORY_SQL, V_SQL, run_history, vectors
from tonewell.plans.catalog_signal import CHUNK, waves
from tonewell.plans.catalog_vectors import K, START_SQL, assign_sql, start_codes
from tonewell.plans.registry import joined, query, sql_joined, table
from tonewell.session import configure, scratch_path
from tonewell.sources import caches, manifests, sidecars, wav
from tonewell.sources.files import local_name
from tonewell.sources.resources import embed_with


@query(
    "manifest_round_trip",
    f"""WITH {MANIFEST_SQL} SELECT path, duration, sample_rate, CAST(NULL AS DOUBLE) AS amplitude, weight,
  CAST(NULL AS VARCHAR) AS info_path FROM manifest WHERE duration >= 100""",
)
def manifest_round_trip(spark, sf):
    folder = scratch_path(configure(spark), "manifest")
    manifests.write_manifest(manifest(spark, sf).drop("doc_id", "lang"), f"{folder}/data.jsonl.gz")
    config = {
        "datasource": {"train": folder, "max_sample_rate": 16000},
        "sample_rate": 16000,
        "kwargs": {"train": {"min_duration": 100}},
    }
    return manifests.datasource(spark, config, "train")


@query(
    "written_split",
    f"""SELECT CASE WHEN {MD5_100} < 20 THEN 'valid' ELSE 'train' END AS split, count(*) AS rows, sum(n_chars)::BIGINT AS n_chars
FROM documents GROUP BY 1""",
)
def written_split(spark, sf):
    from tonewell.operators.corpus import split_by_hash

    folder = scratch_path(configure(spark), "split")
    docs = table(spark, sf, "documents")
    manifests.write_split(docs.withColumn("split", split_by_hash(F.col("doc_id").cast("string"), 20)), folder)
    back = spark.read.parquet(folder)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("n_chars"))


@query(
    "failure_log",
    """SELECT source_file, error FROM (
  SELECT lang AS source_file, 'empty' AS error FROM documents WHERE n_chars < 200
  UNION ALL SELECT source, 'long' FROM documents WHERE n_chars > 5000)""",
)
def failure_log(spark, sf):
    folder = scratch_path(configure(spark), "failures")
    docs = table(spark, sf, "documents")
    short = docs.select(F.col("lang").alias("source_file"), F.when(F.col("n_chars") < 200, "empty").alias("error"))
    long = docs.select(F.col("source").alias("source_file"), F.when(F.col("n_chars") > 5000, "long").alias("error"))
    manifests.write_failures(short, folder)
    manifests.write_failures(long, folder)
    return spark.read.schema("source_file string, error string").json(folder)


@query(
    "rating_files",
    """SELECT CAST(o_custkey AS VARCHAR) AS "user", CAST(o_orderkey AS VARCHAR) AS item, o_orderpriority AS model,
  CAST(1 + month(o_orderdate) % 5 AS INTEGER) AS rating FROM orders""",
)
def rating_files(spark, sf):
    folder = scratch_path(configure(spark), "ratings")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user"),
        F.lit(1).alias("seed"),
        F.array(
            F.struct(
                F.col("o_orderkey").cast("string").alias("id"),
                F.lit(False).alias("is_prompted"),
                F.create_map("o_orderpriority", F.month("o_orderdate") % 5 + 1).alias("models"),
            )
        ).alias("results"),
    )
    orders.write.json(folder)
    return sidecars.read_ratings(spark, folder, multi_line=False).drop("seed")


@query(
    "history_files",
    f"""WITH {HISTORY_SQL} SELECT run, CAST(epoch AS INTEGER) AS epoch, stage, metric, value FROM h
UNION ALL SELECT run, CAST(i AS INTEGER), NULL, 'epoch', CAST(i AS DOUBLE) FROM (SELECT DISTINCT run FROM h), (SELECT unnest(range(1, (SELECT max(epoch) + 1 FROM h))) AS i)""",
)
def history_files(spark, sf):
    """One JSON list per run with an object per day, days without events included."""
    rows = run_history(spark, sf)
    last = rows.agg(F.max("epoch")).first()[0] or 1
    stages = rows.groupBy("run", "epoch", "stage").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")
    )
    # A day has at most two stages, a run a row per day.
    days = stages.groupBy("run", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("stage", "m"))).alias("d"))
    every = rows.select("run").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(last))))
    texts = every.join(days, ["run", "epoch"], "left").select(
        "run",
        "epoch",
        F.concat(
            F.lit('{"epoch": '), F.col("epoch").cast("string"), F.lit(', "note": "x"'),
            F.coalesce(F.concat(F.lit(", "), F.expr("substring(to_json(d), 2)")), F.lit("}")),
        ).alias("text"),
    )
    lists = texts.groupBy("run").agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "text"))), lambda r: r["text"]), ","),
            F.lit("]"),
        ).alias("history")
    )
    return sidecars.history_rows(lists, "run", "history")


@query(
    "paraphrase_file",
    """SELECT 'p' || CAST(item_id AS VARCHAR) AS info_path, array_to_string(string_split(text, '. '), ' / ') AS texts FROM benchmark""",
)
def paraphrase_file(spark, sf):
    folder = scratch_path(configure(spark), "paraphrases")
    entries = table(spark, sf, "benchmark").select(
        F.to_json(
            F.create_map(F.concat(F.lit("p"), F.col("item_id").cast("string")), F.split("text", "\\. ", -1))
        ).alias("value")
    )
    entries.write.text(folder, compression="gzip")
    # Every line is an object of its own here, so the text is read by line.
    parsed = F.from_json("value", "map<string,array<string>>")
    return spark.read.text(folder).select(F.explode(parsed).alias("info_path", "texts")).withColumn(
        "texts", joined("texts", " / ")
    )


@query(
    "embedding_cache",
    f"""SELECT doc_id, {sql_joined("list_transform(range(4), lambda i: CAST(ascii(substr(md5(CAST(doc_id AS VARCHAR)), i + 1, 1)) AS DOUBLE))[1:3]")} AS embedding
FROM documents""",
)
def embedding_cache(spark, sf):
    folder = scratch_path(configure(spark), "embeddings")

    def compute(keys):
        digest = F.md5(F.col("doc_id").cast("string"))
        values = [F.ascii(F.substring(digest, i + 1, 1)).cast("double") for i in range(4)]
        return keys.select("doc_id", F.array(*values).alias("embedding"))

    def extract(rows):
        return rows.withColumn("embedding", F.slice("embedding", 1, 3))

    docs = table(spark, sf, "documents").select("doc_id", "lang")
    caches.embedding_cache(docs.filter(F.col("lang") == "en").select("doc_id"), compute, folder, "doc_id", file_rows=200)
    caches.compact_cache(spark, folder, file_rows=300)
    return caches.embedding_cache(docs.select("doc_id"), compute, folder, "doc_id", extract, file_rows=200).select(
        "doc_id", joined("embedding").alias("embedding")
    )


class Digits:
    """What a worker opens: it counts how often that happened in its process."""

    def __init__(self):
        import os
        import sys

        counts = sys.modules["tonewell_worker_resources"].__dict__.setdefault("counts", {})
        counts["digits"] = counts.get("digits", 0) + 1
        self.opened, self.worker = counts["digits"], os.getpid()

    def vectors(self, keys):
        import hashlib

        if any(k % 10 == 3 for k in keys):
            raise ValueError("no vector for these keys")
        return [[*map(float, hashlib.md5(str(k).encode()).hexdigest()[:3].encode()), float(self.opened)] for k in keys]


@query(
    "worker_embeddings",
    f"""SELECT doc_id, {sql_joined("list_transform(range(3), lambda i: CAST(ascii(substr(md5(CAST(doc_id AS VARCHAR)), i + 1, 1)) AS DOUBLE))")} || ',1.0' AS embedding, FALSE AS failed
FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, NULL, TRUE FROM documents WHERE doc_id % 10 = 3""",
)
def worker_embeddings(spark, sf):
    """Vectors by a resource that every worker opens once; keys that fail are rows of their own."""
    folder, failed = scratch_path(configure(spark), "vectors"), scratch_path(spark, "failures")
    keys = table(spark, sf, "documents").select("doc_id")
    compute = embed_with(Digits, lambda digits, ids: digits.vectors(ids), "doc_id", 16)
    good = caches.embedding_cache(keys, compute, folder, "doc_id", failures=failed)
    bad = spark.read.schema("source_file string, error string").json(failed)
    rows = good.select("doc_id", joined("embedding").alias("embedding"), F.lit(False).alias("failed"))
    return rows.union(bad.select(F.col("source_file").cast("bigint"), F.lit(None).cast("string"), F.lit(True)))


@query(
    "epoch_batches",
    """SELECT pos // 16 AS "update", CAST(pos % 16 AS INTEGER) AS item, conv_id, turn FROM (
  SELECT conv_id, turn, row_number() OVER (ORDER BY turn, conv_id) - 1 AS pos FROM conversations)""",
)
def epoch_batches(spark, sf):
    """Every row of an epoch, the last batch included as far as it is filled."""
    from tonewell.operators.scans import sorted_positions

    folder = scratch_path(configure(spark), "batches")
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    caches.write_batches(sorted_positions(turns, [], ["turn", "conv_id"]), folder, 3, 16)
    return caches.read_batches(spark, folder, 3).select("update", "item", "conv_id", "turn")


@query(
    "wav_round_trip",
    f"""WITH {V_SQL} SELECT CAST(c.vec_id AS VARCHAR) AS clip_id, c.i AS t, round_even(e * 32768, 0) / 32768.0 AS x FROM cells c""",
)
def wav_round_trip(spark, sf):
    folder = scratch_path(configure(spark), "wav")
    coded = signal.i16_pcm(waves(spark, sf))
    wav.wav_bytes(coded, 16000).write.parquet(folder)
    files = spark.read.parquet(folder).select(F.col("clip_id").cast("string").alias("clip_id"), "content")
    return signal.to_long(wav.decode(files, 24)).select("clip_id", "t", "x")


@query(
    "partial_reads",
    f"""WITH {V_SQL} SELECT CAST(c.vec_id AS VARCHAR) AS clip_id, c.i - 10 AS t, round_even(e * 32768, 0) / 32768.0 AS x FROM cells c WHERE i >= 10
UNION ALL SELECT CAST(vec_id AS VARCHAR), 54 + k, 0.0 FROM v, (SELECT unnest(range(6)) AS k)""",
)
def partial_reads(spark, sf):
    coded = signal.i16_pcm(waves(spark, sf))
    files = wav.wav_bytes(coded, 16000).select(
        F.col("clip_id").cast("string").alias("clip_id"),
        "content",
        F.lit(10 / 16000).alias("seek_time"),
        F.lit(60 / 16000).alias("duration"),
        F.lit(True).alias("pad"),
    )
    return signal.to_long(wav.decode(files, 16)).select("clip_id", "t", "x")


@query(
    "converted_corpus",
    f"""WITH {V_SQL} SELECT '/out/' || CAST(label AS VARCHAR) || '/' || CAST(c.vec_id AS VARCHAR) || '.wav' AS out_path,
  CAST(ch AS INTEGER) AS channel, c.i AS t, round_even(CASE WHEN ch = 0 THEN e ELSE -0.5 * e END * 32768, 0) / 32768.0 AS x
FROM cells c, (SELECT unnest(range(2)) AS ch) WHERE label <> 3""",
)
def converted_corpus(spark, sf):
    """Three-channel clips to stereo; the clips of one label are already done."""
    from tonewell.plans.convert import convert_corpus

    configure(spark)
    mono = waves(spark, sf)
    three = mono
    for channel, factor in ((1, -0.5), (2, 0.25)):
        three = three.unionByName(
            mono.withColumn("channel", F.lit(channel)).withColumn("samples", A.scale(F.col("samples"), factor))
        )
    labels = vectors(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"))
    clips = signal.i16_pcm(three).join(labels, F.col("clip_id") == F.col("vec_id"))
    folder, out = scratch_path(spark, "unconverted"), scratch_path(spark, "converted")
    wav.write_wav_files(clips.withColumn("clip_id", F.concat_ws("/", "label", F.col("vec_id").cast("string"))), folder, 16000)
    corpus = wav.list_audio(spark, folder).select("path", F.lit(3).alias("channels"))
    done, target = scratch_path(spark, "done"), scratch_path(spark, "conversions")
    root = local_name(folder)
    finished = corpus.filter(F.col("path").startswith(f"{root}/3/"))
    finished.select(F.regexp_replace("path", f"^{root}/", f"{out}/").alias("out_path")).write.parquet(done)
    convert_corpus(corpus, root, out, target, done)
    rows = signal.to_long(wav.read_signal(spark, out, CHUNK / 16000, 16000))
    return rows.select(F.regexp_replace("clip_id", f"^{local_name(out)}/", "/out/").alias("out_path"), "channel", "t", "x")


# Incremental jobs ------------------------------------------------------------------


def state_partitions(spark) -> int:
    """One state partition per core: enough for tables that a few files hold."""
    return spark.sparkContext.defaultParallelism


SLICES = 5


def event_slices(spark, sf):
    """Events with the fifth of the whole time span that they fall in."""
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("metric"), "value", "event_id", seconds().alias("time")
    )
    span = events.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    low, wide = span["low"] or 0.0, max(1.0, (span["high"] or 0.0) - (span["low"] or 0.0))
    part = F.least(F.floor((F.col("time") - low) / wide * SLICES), F.lit(SLICES - 1)).cast("int")
    return events.withColumn("slice", part), wide


def appended_files(spark, rows, label, by, parts, files=3):
    """The rows written as one append per value of ``by``, each of several files in no order."""
    folder = scratch_path(spark, label)
    for part in range(parts):
        rows.filter(F.col(by) == part).repartition(files).write.mode("append").parquet(folder)
    return folder


@query(
    "running_metrics_stream",
    "SELECT event_type AS metric, round(avg(value), 6) AS mean, count(*) AS weight FROM events GROUP BY 1",
)
def running_metrics_stream(spark, sf):
    from tonewell.streaming import jobs

    configure(spark)
    rows, _ = event_slices(spark, sf)
    folder = appended_files(spark, rows, "events", "slice", SLICES)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    target = scratch_path(spark, "metrics")
    jobs.running_metrics(stream.select("metric", "value"), target, scratch_path(spark, "check"), state_partitions(spark))
    out = jobs.latest_by_batch(spark, target, "metric")
    return out.select("metric", F.round("mean", 6).alias("mean"), "weight")


METRIC_SQL = """WITH e AS (SELECT event_type AS kind, value, user_id, value / 500 AS p, (1 + user_id % 7) / 10.0 AS t FROM events),
k AS (SELECT *, t * (ln(t) - ln(p + 1e-6)) + (1 - t) * (ln(1 - t) - ln(1 - p + 1e-6)) AS pq,
  CASE WHEN p > 0 THEN p * (ln(p) - ln(t + 1e-6)) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * (ln(1 - p) - ln(1 - t + 1e-6)) ELSE 0 END AS qp FROM e)
SELECT kind, round(avg(pq), 6) AS kld, round(avg(qp), 6) AS kld_qp, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 4) AS value_std,
  min(value) AS span_low, max(value) AS span_high, round(avg(CASE WHEN value > 250 THEN 1.0 ELSE 0.0 END), 6) AS loud,
  round(sum(value * (user_id % 3)) / sum(user_id % 3), 6) AS weighted FROM k GROUP BY kind"""
METRIC_COLUMNS = ("kld", "kld_qp", "value_mean", "value_std", "span_low", "span_high", "loud", "weighted")


def event_metrics():
    """Six unlike metrics of events, as settings would name them."""
    p, t = F.col("value") / 500, (1 + F.col("user_id") % 7) / 10
    return [
        M.metric("divergence", "kld", F.array(p, 1 - p), F.array(t, 1 - t)),
        M.metric("deviation", "value", "value"),
        M.metric("extent", "span", "value"),
        M.metric("share", "loud", F.col("value") > 250),
        M.metric("mean", "weighted", F.col("value"), F.col("user_id") % 3),
        M.metric("distinct", "users", "user_id"),
    ]


def finished_metrics(states, metrics):
    rounded = {c: F.round(c, 4 if c == "value_std" else 6) for c in METRIC_COLUMNS if not c.startswith("span")}
    return M.compute(states, metrics, ["kind"]).withColumns(rounded).select("kind", *METRIC_COLUMNS)


@query("metric_states", METRIC_SQL)
def metric_states(spark, sf):
    """States of three parts of the table, kept and merged."""
    metrics, folder = event_metrics(), scratch_path(configure(spark), "states")
    events = table(spark, sf, "events").withColumn("kind", F.col("event_type"))
    parts = M.update(events.withColumn("part", F.col("event_id") % 3), metrics, ["kind", "part"])
    parts.write.parquet(folder)
    return finished_metrics(M.merge(spark.read.parquet(folder), metrics, ["kind"]), metrics)


@query("metric_states_stream", METRIC_SQL)
def metric_states_stream(spark, sf):
    """The same states as a stream's aggregate, newest state of each kind."""
    from tonewell.streaming import jobs

    configure(spark)
    metrics = event_metrics()
    events = table(spark, sf, "events").select(F.col("event_type").alias("kind"), "value", "user_id", (F.col("event_id") % 3).alias("slice"))
    folder = appended_files(spark, events, "events", "slice", 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    target = scratch_path(spark, "states")

    def write(changed, batch_id):
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    jobs.run_available(M.update(stream, metrics, ["kind"]), write, scratch_path(spark, "check"), "update", state_partitions(spark))
    return finished_metrics(jobs.latest_by_batch(spark, target, "kind"), metrics)


@query(
    "ema_stream",
    f"""WITH r AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i,
   count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT metric, count(*) AS n, round(sum(power(0.99, n - 1 - i) * value) / sum(power(0.99, n - 1 - i)), 6) AS ema,
  round(sum(CASE WHEN i = 0 THEN power(0.99, n - 1) ELSE 0.01 * power(0.99, n - 1 - i) END * value), 6) AS plain
FROM r GROUP BY metric""",
)
def ema_stream(spark, sf):
    from tonewell.streaming import jobs

    configure(spark)
    rows, wide = event_slices(spark, sf)
    folder = appended_files(spark, rows, "events", "slice", SLICES)
    # Batches of four files: rows of a slice may come in two batches.
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    state, check = scratch_path(spark, "ema"), scratch_path(spark, "check")
    # Two state partitions: a handful of open blocks, and a Python worker starts for each partition and batch.
    jobs.ema_state(stream, state, check, "metric", "time", "value", 0.99, 2.0 * wide / SLICES, partitions=2)
    newest = jobs.finished_ema(spark, state, check, "metric", 0.99)
    unbiased = jobs.ema_value(newest, "metric", 0.99)
    plain = jobs.ema_value(newest, "metric", 0.99, unbias=False).select("metric", F.round("ema", 6).alias("plain"))
    return unbiased.withColumn("ema", F.round("ema", 6)).join(plain, "metric")


@query(
    "enriched_stream",
    r"""SELECT doc_id, CASE WHEN len(w) < 8 THEN NULL WHEN len(w) > 60 THEN 60 ELSE len(w) END AS words,
  len(w) >= 8 AS valid FROM (SELECT doc_id, regexp_split_to_array(trim(text, E' \n\t\r'), '\s+') AS w FROM documents)""",
)
def enriched_stream(spark, sf):
    from tonewell.streaming import jobs

    configure(spark)
    docs = table(spark, sf, "documents")
    fields = {name: F.col("text") if name == "description" else F.lit("x") for name in captions.REQUIRED}
    fields["genre_tags"] = F.array("lang")
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    folder = scratch_path(spark, "captions")
    raw = docs.select("doc_id", payload.alias("payload"))
    # A file per core, half of them in a micro-batch.
    files = max(4, spark.sparkContext.defaultParallelism)
    raw.repartition(files, "doc_id").write.parquet(folder)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(folder)
    valid, failed = scratch_path(spark, "valid"), scratch_path(spark, "failed")
    jobs.stream_enrich(stream, "payload", valid, failed, scratch_path(spark, "check"))
    good = spark.read.parquet(valid).select("doc_id", F.size(F.split("description", "\\s+")).cast("bigint").alias("words"), F.lit(True).alias("valid"))
    bad = spark.read.schema("doc_id bigint, error string").json(failed)
    return good.unionByName(bad.select("doc_id", F.lit(None).cast("bigint").alias("words"), F.lit(False).alias("valid")))


@query(
    "manifest_stream",
    f"WITH {MANIFEST_SQL} SELECT count(*) AS rows, sum(duration) AS total FROM manifest",
)
def manifest_stream(spark, sf):
    from tonewell.streaming import jobs

    configure(spark)
    folder = scratch_path(spark, "manifests")
    rows = manifest(spark, sf).drop("doc_id", "lang")
    rows.repartition(4, "path").write.json(folder, ignoreNullFields=False)
    seen = scratch_path(spark, "seen")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    jobs.run_available(jobs.stream_manifest(spark, folder, 1), write, scratch_path(spark, "check"))
    return spark.read.parquet(seen).agg(F.count(F.lit(1)).alias("rows"), F.sum("duration").alias("total"))


def vector_files(spark, sf):
    """Vectors in four files for a stream, ids in ascending ranges."""
    rows = vectors(spark, sf)
    folder = scratch_path(spark, "vectors")
    rows.repartitionByRange(4, "vec_id").write.parquet(folder)
    return rows, folder


@query(
    "feature_stats_stream",
    f"""WITH {V_SQL} SELECT CAST(i AS INTEGER) AS dim, count(*) AS n, round(avg(e), 9) AS mean, round(sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0)), 9) AS std
FROM cells GROUP BY i""",
)
def feature_stats_stream(spark, sf):
    from tonewell.streaming import jobs

    rows, folder = vector_files(configure(spark), sf)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    target = scratch_path(spark, "sums")

    def write(changed, batch_id):
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    sums = jobs.online_feature_stats(stream, "x")
    jobs.run_available(sums, write, scratch_path(spark, "check"), mode="update", partitions=state_partitions(spark))
    out = jobs.finish_feature_stats(jobs.latest_by_batch(spark, target, "dim"))
    return out.select("dim", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(
    "chunk_windows_stream",
    f"""WITH {V_SQL}, f AS (SELECT vec_id, CAST(unnest(range(6)) AS BIGINT) AS frame FROM v)
SELECT f.vec_id AS clip_id, frame, round(sum(e), 9) AS mass, 24 AS size FROM f JOIN cells c ON c.vec_id = f.vec_id AND c.i >= frame * 9 AND c.i < frame * 9 + 24 GROUP BY 1, 2""",
)
def chunk_windows_stream(spark, sf):
    from tonewell.streaming import jobs
    from tonewell.streaming.stateful import chunk_windows

    configure(spark)
    wave = waves(spark, sf)
    ends = wave.groupBy("clip_id").agg(F.max("chunk_idx").alias("top"))
    chunks = wave.join(ends, "clip_id").select("clip_id", "chunk_idx", "samples", (F.col("chunk_idx") == F.col("top")).alias("is_last"))
    folder = scratch_path(spark, "chunks")
    # Chunks of a clip in any file: their number gives the order, not the batch.
    chunks.repartition(7, F.xxhash64("clip_id", "chunk_idx")).write.parquet(folder)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    target = scratch_path(spark, "windows")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    windows = chunk_windows(stream, 24, 9)
    jobs.run_available(windows, write, scratch_path(spark, "check"), partitions=state_partitions(spark))
    out = spark.read.parquet(target)
    return out.select(
        "clip_id", "frame", F.round(A.total(F.col("values")), 9).alias("mass"), F.size("values").alias("size")
    )


def _online_sql(steps: int = 4) -> str:
    """One moving-average step per batch of labels, with the codes of the step before."""
    parts = [
        START_SQL,
        "t0 AS (SELECT code, 0.0::DOUBLE AS size, x AS avg, x FROM book0)",
    ]
    for k in range(steps):
        parts.append(f"v{k} AS (SELECT vec_id, x FROM v WHERE vec_id % {steps} = {k})")
        parts.append(f"a{k} AS {assign_sql(f'v{k}', f't{k}')}")
        parts.append(
            f"""n{k} AS (SELECT code, sum(n) AS n, list(s ORDER BY i) AS s FROM (SELECT a.code, c.i, CASE WHEN c.i = 0 THEN count(*) ELSE 0 END AS n, sum(c.e) AS s
   FROM a{k} a JOIN cells c ON c.vec_id = a.vec_id GROUP BY a.code, c.i) GROUP BY code)"""
        )
        parts.append(
            f"""m{k} AS (SELECT t.code, 0.9 * size + 0.1 * coalesce(n, 0) AS size, list_transform(list_zip(avg, coalesce(s, [0.0::DOUBLE FOR e IN avg])), lambda z: 0.9 * z[1] + 0.1 * z[2]) AS avg
   FROM t{k} t LEFT JOIN n{k} n ON n.code = t.code)"""
        )
        parts.append(
            f"""t{k + 1} AS (SELECT code, size, avg, list_transform(avg, lambda e: e / ((size + 1e-5) / (tot + {K} * 1e-5) * tot)) AS x
   FROM m{k}, (SELECT sum(size) AS tot FROM m{k}))"""
        )
    return f"""WITH {', '.join(parts)}
SELECT CAST(code AS INTEGER) AS code, round(size, 6) AS cluster_size, round(list_sum(list_transform(avg, lambda e: e * e)), 6) AS energy FROM t{steps}"""


@query("online_codebook_stream", _online_sql())
def online_codebook_stream(spark, sf):
    from tonewell.streaming import jobs

    rows = vectors(configure(spark), sf).withColumn("step", (F.col("vec_id") % 4).cast("int"))
    # One append of three files per step, and three files per micro-batch.
    folder = appended_files(spark, rows, "vectors", "step", 4, files=3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    state = scratch_path(spark, "codebook")
    jobs.online_codebook(stream, "x", "vec_id", start_codes(spark, sf), state, scratch_path(spark, "check"), 0.9)
    newest = jobs.newest_version(spark, state)
    return newest.groupBy("code").agg(
        F.round(F.max("cluster_size"), 6).alias("cluster_size"),
        F.round(F.sum(F.col("embed_avg") * F.col("embed_avg")), 6).alias("energy"),
    )
