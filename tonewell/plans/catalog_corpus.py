"""Registered queries: manifests, splits, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions.hashing import sha256_mod, uniform
from tonewell.operators import corpus, sampling
from tonewell.plans.registry import query, sql_fold, sql_u, table


def manifest(spark, sf):
    """Documents as manifest rows: n_chars is the duration, label quality the weight."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias(
            "path"
        ),
        F.col("n_chars").cast("double").alias("duration"),
        F.lit(16000).alias("sample_rate"),
        F.lit(None).cast("double").alias("amplitude"),
        F.col("quality").cast("double").alias("weight"),
        F.lit(None).cast("string").alias("info_path"),
        "doc_id",
        "lang",
    )


MANIFEST_SQL = """
manifest AS (
  SELECT '/data/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.wav' AS path,
         CAST(d.n_chars AS DOUBLE) AS duration, 16000 AS sample_rate,
         CAST(l.quality AS DOUBLE) AS weight, d.doc_id, d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

MD5_100 = sql_fold("md5(CAST(doc_id AS VARCHAR))", 32, 100)


@query(
    "split_sampling_summary",
    f"""
WITH {MANIFEST_SQL},
kept AS (SELECT *, coalesce(weight, 1.0) * duration AS score,
                CASE WHEN {MD5_100} < 20 THEN 'valid' ELSE 'train' END AS split
         FROM manifest WHERE duration >= 50 AND duration <= 50000)
SELECT split, count(*) AS n_files, sum(duration) AS total_duration,
       round(sum(score / (SELECT sum(score) FROM kept)), 6) AS probability_mass
FROM kept GROUP BY split""",
)
def split_sampling_summary(spark, sf):
    kept = corpus.filter_duration(manifest(spark, sf), 50, 50000)
    weighed = sampling.sampling_weights(kept, on_weight=True, on_duration=True)
    return (
        weighed.withColumn("split", corpus.split_by_hash(F.col("doc_id").cast("string"), 20))
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("duration").alias("total_duration"),
            F.round(F.sum("probability"), 6).alias("probability_mass"),
        )
    )


@query(
    "manifest_order",
    f"WITH {MANIFEST_SQL} SELECT path, duration, sample_rate, weight, "
    "row_number() OVER (ORDER BY path) - 1 AS pos FROM manifest",
)
def manifest_order(spark, sf):
    from tonewell.operators.scans import sorted_positions

    rows = manifest(spark, sf).select("path", "duration", "sample_rate", "weight")
    return sorted_positions(rows, [], ["path"])


@query(
    "known_fields",
    f"WITH {MANIFEST_SQL} SELECT path, duration, sample_rate, CAST(NULL AS DOUBLE) AS amplitude, weight, "
    "CAST(NULL AS VARCHAR) AS info_path FROM manifest",
)
def known_fields(spark, sf):
    rows = manifest(spark, sf).drop("amplitude", "info_path")
    return corpus.select_known(rows, corpus.MANIFEST_SCHEMA)


@query(
    "duration_filter_report",
    f"""WITH {MANIFEST_SQL}
SELECT sum(CASE WHEN duration BETWEEN 100 AND 5000 THEN duration END) AS total_duration,
       count(CASE WHEN duration BETWEEN 100 AND 5000 THEN 1 END) AS kept,
       round(100.0 * count(CASE WHEN NOT duration BETWEEN 100 AND 5000 THEN 1 END) / count(*), 6)
         AS removed_percent
FROM manifest""",
)
def duration_filter_report(spark, sf):
    keep = corpus.duration_between(F.col("duration"), 100, 5000)
    totals = corpus.corpus_totals(manifest(spark, sf), keep)
    return totals.withColumn("removed_percent", F.round("removed_percent", 6))


@query(
    "split_counts",
    f"SELECT CASE WHEN {MD5_100} < 10 THEN 'valid' ELSE 'train' END AS split, count(*) AS rows "
    "FROM documents GROUP BY 1",
)
def split_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return corpus.split_counts(
        docs.withColumn("split", corpus.split_by_hash(F.col("doc_id").cast("string"), 10))
    )


@query(
    "hash_helpers",
    f"""SELECT doc_id, {sql_fold("md5(text)", 32, 100)} AS md5_bucket,
       {sql_fold("sha256(text)", 64, 1000)} AS sha_bucket, {sql_u(7, "doc_id", "lang")} AS u
FROM documents""",
)
def hash_helpers(spark, sf):
    from tonewell.functions.hashing import md5_mod

    return table(spark, sf, "documents").select(
        "doc_id",
        md5_mod(F.col("text"), 100).alias("md5_bucket"),
        sha256_mod(F.col("text"), 1000).alias("sha_bucket"),
        uniform(7, F.col("doc_id"), F.col("lang")).alias("u"),
    )


@query(
    "random_subset",
    f"SELECT doc_id, lang FROM documents ORDER BY {sql_u('subset', 'doc_id')}, doc_id LIMIT 137",
)
def random_subset(spark, sf):
    return corpus.random_subset(table(spark, sf, "documents").select("doc_id", "lang"), 137, "subset", "doc_id")


@query(
    "pool_with_repeat",
    f"""WITH pool AS (SELECT b.item_id, c.copy FROM benchmark b,
                     (SELECT unnest(range(CAST(floor(500 / (SELECT count(*) FROM benchmark)) AS BIGINT)
                       + CASE WHEN 500 > (SELECT count(*) FROM benchmark) THEN 1 ELSE 0 END)) AS copy) c)
SELECT item_id, CAST(copy AS INTEGER) AS copy FROM pool
ORDER BY {sql_u('pool', 'item_id', 'copy')}, item_id, copy LIMIT 500""",
)
def pool_with_repeat(spark, sf):
    pool = table(spark, sf, "benchmark").select("item_id")
    return corpus.sample_with_repeat(pool, 500, "pool", "item_id")


@query("limited_rows", "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 100")
def limited_rows(spark, sf):
    return corpus.limit_rows(table(spark, sf, "documents").select("doc_id", "lang"), 100, ["lang", "doc_id"])


@query(
    "rows_with_meta",
    """SELECT d.doc_id, l.quality IS NOT NULL AS music, d.n_chars > 500 AS sound FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def rows_with_meta(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id", F.when(F.col("quality").isNotNull(), F.col("source")).alias("name"),
        F.when(F.col("n_chars") > 500, F.col("lang")).alias("description"),
    )
    return rows.select("doc_id", corpus.has_music_meta().alias("music"), corpus.has_sound_meta().alias("sound"))


@query(
    "sampling_probabilities",
    f"""WITH {MANIFEST_SQL}
SELECT path, round(coalesce(weight, 1.0) * duration / sum(coalesce(weight, 1.0) * duration) OVER (), 9) AS p_both,
       round(duration / sum(duration) OVER (), 9) AS p_duration,
       round(coalesce(weight, 1.0) / sum(coalesce(weight, 1.0)) OVER (), 9) AS p_weight,
       round(1.0 / count(*) OVER (), 9) AS p_uniform
FROM manifest""",
)
def sampling_probabilities(spark, sf):
    rows = manifest(spark, sf).select("path", "duration", "weight")
    wanted = {"p_both": (True, True), "p_duration": (False, True), "p_weight": (True, False), "p_uniform": (False, False)}
    rows = sampling.sampling_probabilities(rows, wanted)
    return rows.select("path", *[F.round(name, 9).alias(name) for name in wanted])


BUCKET_SQL = f"CAST(floor({sql_u('bucket', 'path')} * 256) AS INTEGER)"
CDF_SQL = f"""
scored AS (SELECT path, coalesce(weight, 1.0) * duration AS score, {BUCKET_SQL} AS bucket FROM manifest),
cdf AS (SELECT path, bucket, score, sum(score) OVER (ORDER BY bucket, path) AS high FROM scored WHERE score > 0)
"""


@query(
    "sampling_cdf",
    f"WITH {MANIFEST_SQL}, {CDF_SQL} SELECT path, bucket, high - score AS low, high FROM cdf",
)
def sampling_cdf(spark, sf):
    rows = manifest(spark, sf).withColumn("score", sampling.sampling_score(True, True))
    return sampling.sampling_cdf(rows.select("path", "score"), "path", "score", 256).select(
        "path", "bucket", "low", "high"
    )


@query(
    "weighted_draws",
    f"""WITH {MANIFEST_SQL}, {CDF_SQL},
draws AS (SELECT i AS index, {sql_u('draw:40000', 'i')} * (SELECT max(high) FROM cdf) AS at
          FROM (SELECT unnest(range(20000)) AS i))
SELECT d.index, c.path FROM draws d JOIN cdf c ON d.at >= c.high - c.score AND d.at < c.high""",
)
def weighted_draws(spark, sf):
    rows = manifest(spark, sf).select("path", "duration", "weight")
    return sampling.sample_files(spark, rows, 20000, epoch=2)


@query(
    "file_permutation",
    f"""WITH n AS (SELECT count(*) AS f FROM documents),
perms AS (SELECT unnest(range(CAST(floor(2 * 1500 / f) AS BIGINT), CAST(floor((2 * 1500 + 1499) / f) AS BIGINT) + 1)) AS perm
          FROM n),
ranked AS (SELECT perm, doc_id, row_number() OVER (PARTITION BY perm
             ORDER BY {sql_u('perm:0', 'perm', 'doc_id')}, doc_id) - 1 AS rel FROM documents, perms)
SELECT perm * f + rel - 3000 AS index, doc_id FROM ranked, n
WHERE perm * f + rel - 3000 >= 0 AND perm * f + rel - 3000 < 1500""",
)
def file_permutation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.permute_files(docs, 1500, "doc_id", epoch=2)


@query(
    "segment_plan",
    f"""WITH {MANIFEST_SQL},
s AS (SELECT path, duration, {sql_u('segment', 'path')} * greatest(0.0, duration - 15.0) AS seek_time FROM manifest)
SELECT path, seek_time,
       CAST(least(greatest(floor((duration - seek_time) * 16000), 0), 480000) AS INTEGER) AS n_frames,
       480000 AS total_frames FROM s""",
)
def segment_plan(spark, sf):
    rows = manifest(spark, sf).select("path", "duration")
    return sampling.draw_segments(rows, 30.0, 16000, 1, 0.5, index="path").select(
        "path", "seek_time", "n_frames", "total_frames"
    )


@query(
    "full_items",
    f"""WITH {MANIFEST_SQL} SELECT path, 0.0::DOUBLE AS seek_time,
CAST(floor(duration * sample_rate) AS BIGINT) AS n_frames,
CAST(floor(duration * sample_rate) AS BIGINT) AS total_frames FROM manifest""",
)
def full_items(spark, sf):
    return sampling.full_items(manifest(spark, sf)).select("path", "seek_time", "n_frames", "total_frames")


@query(
    "retry_candidates",
    f"""WITH c AS (SELECT e.user_id AS index, e.event_id, e.event_type,
    row_number() OVER (PARTITION BY e.user_id ORDER BY {sql_u('try', 'event_id')}, event_id) - 1 AS attempt
    FROM events e),
lim AS (SELECT * FROM c WHERE attempt < 10),
hit AS (SELECT index, min(attempt) AS attempt FROM lim WHERE event_type <> 'error' GROUP BY index)
SELECT a.index, h.attempt, c.event_id,
  CASE WHEN h.attempt IS NULL THEN 'no readable file in ' || CAST(a.n AS VARCHAR) || ' tries' END AS error
FROM (SELECT index, count(*) AS n FROM lim GROUP BY index) a
LEFT JOIN hit h ON a.index = h.index
LEFT JOIN lim c ON c.index = h.index AND c.attempt = h.attempt""",
)
def retry_candidates(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("index"), "event_id", "event_type")
    from tonewell.operators.scans import row_positions, share_bucket

    u = uniform("try", F.col("event_id"))
    tries = row_positions(
        events.withColumn("u", u), ["index"], share_bucket(F.col("u"), 64), [F.col("u"), F.col("event_id")], "attempt"
    ).drop("u")
    picked = sampling.retry_failed(tries, F.col("event_type") != "error")
    return picked.select("index", "attempt", "event_id", "error")


@query(
    "retain_latest_turns",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r "
    "FROM conversations) WHERE r <= 3",
)
def retain_latest_turns(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return corpus.retain_latest(turns, "conv_id", "turn", 3)


@query(
    "path_rewrite",
    r"""SELECT page_id,
  CASE WHEN starts_with(url, 'http://') THEN
    regexp_replace('/out/' || substr(url, 8), '\.[^./]*$', '') || '.flac' END AS out_path,
  CASE WHEN NOT starts_with(url, 'http://') THEN 'path outside of root: ' || url END AS error
FROM pages""",
)
def path_rewrite(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return corpus.rewrite_path(pages, "url", "http://", "/out", ".flac").select("page_id", "out_path", "error")


@query(
    "clip_requests",
    """SELECT caption_id, ytid, caption_id || '_' || ytid AS base_name,
  'https://www.youtube.com/watch?v=' || ytid AS url, start_s, coalesce(end_s, start_s + 10.0) AS end_s
FROM (SELECT CAST(doc_id AS VARCHAR) AS caption_id, substr(md5(text), 1, 11) AS ytid,
   CAST(length(text) AS DOUBLE) AS start_s, CASE WHEN quality = 1 THEN length(text) + 30.0 END AS end_s
   FROM documents LEFT JOIN labels USING (doc_id))""",
)
def clip_requests(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    source = docs.select(
        F.lit(None).cast("string").alias("caption_id"),
        F.substring(F.md5("text"), 1, 11).alias("ytid"),
        F.length("text").cast("double").alias("start_s"),
        F.when(F.col("quality") == 1, F.length("text") + 30.0).alias("end_s"),
        F.col("text").alias("raw_caption"),
        "doc_id",
    )
    return corpus.clip_plan(source, "doc_id").select(
        "caption_id", "ytid", "base_name", "url", "start_s", "end_s"
    )


@query(
    "conversion_resume",
    r"""SELECT regexp_replace('/out/' || substr('/data/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.wav', 7),
   '\.[^./]*$', '') || '.wav' AS out_path, 2 AS out_channels
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def conversion_resume(spark, sf):
    files = manifest(spark, sf).select("path", "doc_id", F.lit(6).alias("channels"))
    done = files.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(
        F.regexp_replace("path", "^/data/", "/out/").alias("out_path")
    )
    plan = corpus.convert_plan(files.drop("doc_id"), done, "/data", "/out", ".wav")
    return plan.select("out_path", "out_channels")


@query(
    "group_key_split",
    f"""SELECT doc_id, CASE WHEN {sql_fold("md5(k)", 32, 100)} < 30 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'yt' || CAST(l.doc_id AS VARCHAR) END,
   CAST(d.doc_id AS VARCHAR)) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def group_key_split(spark, sf):
    rows = manifest(spark, sf).withColumn(
        "source_json",
        F.when(
            F.col("weight") == 1,
            F.to_json(F.struct(F.concat(F.lit("yt"), F.col("doc_id").cast("string")).alias("ytid"))),
        ),
    )
    key = corpus.group_key(F.col("source_json"), F.col("path"))
    return rows.select("doc_id", corpus.split_by_hash(key, 30).alias("split"))


@query(
    "required_fields",
    """SELECT event_id, CASE WHEN NOT json_exists(props, '$.k') THEN
   CASE WHEN json_exists(props, '$.genre') THEN 'missing fields: k' ELSE 'missing fields: genre, k' END
   WHEN json_exists(props, '$.genre') THEN NULL ELSE 'missing fields: genre' END AS error FROM events""",
)
def required_fields(spark, sf):
    events = table(spark, sf, "events").select("event_id", "props")
    return corpus.require_fields(events, "props", ["k", "genre", "mood"], optional=["mood"]).select(
        "event_id", "error"
    )
