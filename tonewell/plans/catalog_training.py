"""Registered query: the training items of an epoch, from the manifest to the conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.operators import joins
from tonewell.plans.catalog_corpus import BUCKET_SQL, MANIFEST_SQL, manifest
from tonewell.plans.registry import configure, query, sql_trim, sql_u, table
from tonewell.plans.training import training_items

FIELDS = {
    "key": "CASE WHEN contains(c_key, ',') THEN NULL ELSE c_key END",
    "bpm": "CAST(c_bpm AS VARCHAR)",
    "genre": "c_genre",
    "instrument": "c_instrument",
}
P = {"text": {"description": 0.3, "genre": 0.2}, "wav": {"self_wav": 0.5}}


def _pairs() -> str:
    return ", ".join(
        f"{{'u': {sql_u(f'3:order:{n}', 'index')}, 'name': '{n}', 'pair': CASE WHEN ({e}) IS NOT NULL AND "
        f"{sql_u(f'3:keep:{n}', 'index')} < 0.7 THEN '{n}: ' || ({e}) END}}"
        for n, e in FIELDS.items()
    )


def _gone(kind: str, name: str) -> str:
    return f"""{sql_u('attr:3', f"'{kind}'", f"'{name}'", 'index // 16')} < {P[kind][name]}"""


TRAINING_SQL = f"""
WITH {MANIFEST_SQL.replace("manifest AS", "base AS", 1)},
manifest AS (SELECT path, duration, weight, doc_id FROM base WHERE duration BETWEEN 100 AND 20000),
scored AS (SELECT path, coalesce(weight, 1.0) * duration AS score, {BUCKET_SQL} AS bucket FROM manifest),
cdf AS (SELECT path, score, sum(score) OVER (ORDER BY bucket, path) AS high FROM scored WHERE score > 0),
draws AS (SELECT i AS index, {sql_u('draw:fixed', 'i')} * (SELECT max(high) FROM cdf) AS at
   FROM (SELECT unnest(range((SELECT count(*) FROM manifest))) AS i)),
item AS (SELECT d.index, m.path, m.doc_id, m.duration, {sql_u('segment', 'd.index')} * greatest(0.0, m.duration - 15.0) AS seek_time
   FROM draws d JOIN cdf c ON d.at >= c.high - c.score AND d.at < c.high JOIN manifest m ON m.path = c.path),
side AS (SELECT i.*, l.doc_id IS NOT NULL AS has, CASE WHEN l.doc_id IS NOT NULL THEN t.text END AS text,
   CASE WHEN l.doc_id IS NOT NULL THEN t.lang END AS c_key, CASE WHEN l.quality = 1 THEN CAST(t.n_chars AS DOUBLE) END AS c_bpm,
   CASE WHEN l.doc_id IS NOT NULL THEN t.source END AS c_genre, CASE WHEN l.toxic = 0 THEN 'piano' END AS c_instrument,
   CASE WHEN l.doc_id IS NOT NULL THEN t.source END AS info
   FROM item i JOIN documents t ON t.doc_id = i.doc_id LEFT JOIN labels l ON l.doc_id = i.doc_id),
told AS (SELECT s.*, CASE WHEN b.item_id IS NOT NULL AND {sql_u('3:use', 'index')} < 0.5
   THEN b.s[CAST(floor({sql_u('3:pick', 'index')} * len(b.s)) AS INTEGER) + 1] ELSE s.text END AS description
   FROM side s LEFT JOIN (SELECT item_id, string_split(text, '.') AS s, 'src' || CAST(item_id AS VARCHAR) AS k FROM benchmark) b ON b.k = s.info),
p AS (SELECT *, CASE WHEN {sql_u('3:merge', 'index')} < 0.8 THEN array_to_string(list_transform(
    list_sort(list_filter([{_pairs()}], lambda x: x.pair IS NOT NULL)), lambda x: x.pair), '. ') ELSE '' END AS meta,
  {sql_u('3:merge', 'index')} < 0.8 AND {sql_u('3:drop', 'index')} < 0.3 AS dropped FROM told),
m AS (SELECT *, CASE WHEN dropped OR description IS NULL THEN CASE WHEN length(meta) > 1 THEN meta END
   ELSE regexp_replace(description, '[.]+$', '') || '. ' || meta END AS v FROM p)
SELECT index, path, seek_time, CAST(least(greatest(floor((duration - seek_time) * 16000), 0), 480000) AS INTEGER) AS n_frames,
  CASE WHEN {_gone('text', 'description')} THEN NULL WHEN length(v) > 0 THEN {sql_trim('v')} END AS description,
  CASE WHEN {_gone('text', 'genre')} THEN NULL ELSE c_genre END AS genre,
  CASE WHEN {_gone('wav', 'self_wav')} THEN NULL ELSE path END AS wav_path FROM m"""


@query("training_items", TRAINING_SQL)
def training_query(spark, sf):
    files = manifest(configure(spark), sf)
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    sidecars = docs.select(
        joins.stem_path(path).alias("stem"),
        F.col("text").alias("description"),
        F.col("lang").alias("key"),
        F.when(F.col("quality") == 1, F.col("n_chars").cast("string")).alias("bpm"),
        F.upper("source").alias("genre"),
        F.when(F.col("toxic") == 0, " Piano").alias("instrument"),
        F.col("source").alias("info_path"),
    )
    paraphrases = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("info_path"), F.split("text", "\\.", -1).alias("texts")
    )
    out = training_items(spark, files, sidecars, paraphrases, 30.0, 16000, 100, 20000, P)
    return out.select(
        "index", "path", "seek_time", "n_frames", F.col("text")["description"].alias("description"),
        F.col("text")["genre"].alias("genre"), F.col("wav")["self_wav"]["path"].alias("wav_path"),
    )
