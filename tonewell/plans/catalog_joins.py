"""Registered queries: metadata joins, matches, symbolic alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.operators import joins, matching, symbolic
from tonewell.plans.catalog_corpus import manifest
from tonewell.plans.registry import joined, query, sql_joined, sql_u, table
from tonewell.session import written


def seconds(column: str = "ts"):
    """Timestamp column as seconds since 2024-01-01, the first day of the events."""
    return (F.unix_micros(F.col(column).cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1e6)


SECONDS_SQL = "(epoch_us(ts) - 1704067200000000) / 1000000.0"


@query(
    "sidecar_join",
    """SELECT d.doc_id, d.lang AS genre, CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) END AS title,
  CASE WHEN l.doc_id IS NOT NULL THEN coalesce(CASE WHEN l.quality = 1 THEN 'q' END, 'unknown') END AS artist,
  CASE WHEN l.doc_id IS NOT NULL THEN 'unknown' END AS name, l.doc_id IS NOT NULL AS has_sidecar
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def sidecar_join(spark, sf):
    segments = manifest(spark, sf).select("path", "doc_id", F.col("lang").alias("genre"))
    sidecars = (
        manifest(spark, sf)
        .filter(F.col("weight").isNotNull())
        .select(
            joins.stem_path(F.col("path")).alias("stem"),
            F.lit("hidden").alias("genre"),
            F.when(F.col("weight") == 1, "q").alias("artist"),
        )
    )
    return joins.attach_sidecar(segments, sidecars).select(
        "doc_id", "genre", "title", "artist", "name", "has_sidecar"
    )


@query(
    "sidecar_fallback",
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'local' END, CASE WHEN l.toxic = 0 THEN 'external' END) AS description,
  CASE WHEN coalesce(CASE WHEN l.quality = 1 THEN 'local' END, CASE WHEN l.toxic = 0 THEN 'external' END) IS NULL
   THEN 'no metadata for /data/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.wav' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def sidecar_fallback(spark, sf):
    files = manifest(spark, sf)
    labels = table(spark, sf, "labels")
    local = files.filter(F.col("weight") == 1).select(
        joins.stem_path(F.col("path")).alias("stem"), F.lit("local").alias("description")
    )
    external = labels.filter(F.col("toxic") == 0).select(
        F.col("doc_id").cast("string").alias("name"), F.lit("external").alias("description")
    )
    out = joins.attach_sidecar_with_fallback(files.select("path", "doc_id"), local, external, "description")
    return out.select("doc_id", "description", "error")


@query(
    "paraphrased",
    f"""SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL AND {sql_u('9:use', 'd.doc_id')} < 0.5
   THEN s[CAST(floor({sql_u('9:pick', 'd.doc_id')} * len(s)) AS INTEGER) + 1] ELSE d.text END AS description
FROM documents d LEFT JOIN (SELECT item_id, string_split(text, '.') AS s,
   'src' || CAST(item_id AS VARCHAR) AS k FROM benchmark) b ON b.k = d.source""",
)
def paraphrased(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("info_path"), F.col("text").alias("description"))
    texts = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("info_path"),
        F.split("text", "\\.", -1).alias("texts"),
    )
    return joins.apply_paraphrase(docs, texts, 0.5, 9, "doc_id").select("doc_id", "description")


@query(
    "cache_merge",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'hit' ELSE 'new' END AS origin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def cache_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    cache = table(spark, sf, "labels").select("doc_id", F.lit("hit").alias("origin"))
    missed = joins.cache_misses(docs, cache, ["doc_id"]).withColumn("origin", F.lit("new"))
    return docs.join(cache, "doc_id").unionByName(missed)


@query(
    "resume_anti",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def resume_anti(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return joins.resume(docs, table(spark, sf, "labels"), "doc_id")


@query(
    "resume_pairs",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (
  SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def resume_pairs(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id")
    return joins.resume_pairs(
        docs, labels.filter(F.col("quality") == 1), labels.filter(F.col("toxic") == 0), "doc_id"
    )


@query(
    "eval_pair_keys",
    """SELECT split_part(url, '/', -1) AS name, count(*) AS rows FROM pages GROUP BY 1 HAVING count(*) > 1""",
)
def eval_pair_keys(spark, sf):
    pages = table(spark, sf, "pages").select(F.element_at(F.split("url", "/"), -1).alias("name"))
    return joins.duplicate_keys(pages, F.col("name")).select(F.col("key").alias("name"), "rows")


@query(
    "paired_shapes",
    """SELECT a.vec_id, len(a.embedding) = len(b.embedding) AS same_shape,
  CAST(a.vec_id AS VARCHAR) || '_' || CAST(a.label + 0.5 AS VARCHAR) AS pair_key
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id""",
)
def paired_shapes(spark, sf):
    vectors = table(spark, sf, "embeddings")
    pairs = joins.pair_eval(vectors, vectors, "vec_id", "embedding", "embedding")
    keyed = pairs.join(vectors.select("vec_id", "label"), "vec_id")
    path = F.concat(F.lit("/out/"), F.col("vec_id").cast("string"), F.lit(".wav"))
    return keyed.select(
        "vec_id", "same_shape", joins.eval_key(path, F.col("label").cast("double") + F.lit(0.5)).alias("pair_key")
    )


# Sample catalogue: orders of one priority are the samples of one run -----------------


def sample_catalogue(spark, sf):
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    # The customer is the input of a sample: equal customers give equal ids.
    free = F.col("c_mktsegment") == "HOUSEHOLD"
    rows = orders.join(customers, "o_custkey")
    return rows.select(
        F.col("o_orderpriority").alias("run"),
        F.when(free, F.concat(F.lit("noinput_"), F.md5(F.col("o_orderkey").cast("string"))))
        .otherwise(F.col("c_name"))
        .alias("id"),
        F.col("o_orderkey").cast("string").alias("path"),
        F.year("o_orderdate").alias("epoch"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.struct(F.col("c_name").alias("id"))).alias("prompt"),
        F.when(
            ~free & (F.col("c_mktsegment") != "BUILDING"), F.create_map(F.lit("description"), F.col("c_mktsegment"))
        ).alias("conditioning"),
    )


SAMPLES_SQL = """
samples AS (SELECT o_orderpriority AS run,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'noinput_' || md5(CAST(o_orderkey AS VARCHAR)) ELSE c_name END AS id,
  CAST(o_orderkey AS VARCHAR) AS path, year(o_orderdate) AS epoch,
  c_mktsegment = 'BUILDING' AS prompted, c_mktsegment NOT IN ('HOUSEHOLD', 'BUILDING') AS conditioned
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
RUNS = ["1-URGENT", "2-HIGH", "5-LOW"]
RUNS_SQL = "('1-URGENT', '2-HIGH', '5-LOW')"
STABLE_SQL = f"""
SELECT id AS key, max(p) FILTER (run = '1-URGENT') AS urgent, max(p) FILTER (run = '2-HIGH') AS high,
  max(p) FILTER (run = '5-LOW') AS low
FROM (SELECT run, id, max(path) AS p FROM samples WHERE (prompted OR conditioned) AND run IN {RUNS_SQL} GROUP BY run, id)
GROUP BY id HAVING count(*) = 3"""
UNSTABLE_SQL = f"""
SELECT 'noinput_' || CAST(pos AS VARCHAR) AS key, max(path) FILTER (run = '1-URGENT') AS urgent,
  max(path) FILTER (run = '2-HIGH') AS high, max(path) FILTER (run = '5-LOW') AS low
FROM (SELECT run, path, row_number() OVER (PARTITION BY run ORDER BY id) - 1 AS pos FROM samples
      WHERE NOT prompted AND NOT conditioned AND run IN {RUNS_SQL}) GROUP BY pos HAVING count(*) = 3"""


def by_run_columns(df):
    return df.select(
        "key",
        F.col("by_run")["1-URGENT"].alias("urgent"),
        F.col("by_run")["2-HIGH"].alias("high"),
        F.col("by_run")["5-LOW"].alias("low"),
    )


@query("stable_match", f"WITH {SAMPLES_SQL} {STABLE_SQL}")
def stable_match(spark, sf):
    return by_run_columns(matching.match_stable(sample_catalogue(spark, sf), RUNS))


@query("unstable_match", f"WITH {SAMPLES_SQL} {UNSTABLE_SQL}")
def unstable_match(spark, sf):
    return by_run_columns(matching.match_unstable(sample_catalogue(spark, sf), RUNS))


@query("matched_samples", f"WITH {SAMPLES_SQL} SELECT * FROM ({STABLE_SQL}) UNION ALL SELECT * FROM ({UNSTABLE_SQL})")
def matched_samples(spark, sf):
    return by_run_columns(matching.match_samples(sample_catalogue(spark, sf), RUNS))


@query(
    "filtered_samples",
    f"""WITH {SAMPLES_SQL}, last AS (SELECT run, max(epoch) AS epoch FROM samples WHERE epoch <= 1999 GROUP BY run)
SELECT DISTINCT s.run, s.id FROM samples s JOIN last l ON s.run = l.run AND s.epoch = l.epoch
WHERE NOT prompted AND conditioned""",
)
def filtered_samples(spark, sf):
    kept = matching.filter_samples(
        sample_catalogue(spark, sf), ["run"], max_epoch=1999, exclude_prompted=True, exclude_unconditioned=True
    )
    return kept.select("run", "id")


@query(
    "run_set",
    """SELECT DISTINCT run, known FROM (
  SELECT n_name AS run, true AS known FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA')
  UNION ALL SELECT n_name, true FROM nation WHERE n_name IN (SELECT 'NATION_' || CAST(s_nationkey AS VARCHAR) FROM supplier)
  UNION ALL SELECT s_name, false FROM supplier)""",
)
def run_set(spark, sf):
    nations = table(spark, sf, "nation")
    regions = table(spark, sf, "region")
    suppliers = table(spark, sf, "supplier")
    names = (
        suppliers.select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"))
        .union(suppliers.select("s_name"))
        .union(regions.filter(F.col("r_name").isin("ASIA", "AFRICA")).select("r_name"))
    )
    grids = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("name"), F.col("n_name").alias("run")
    )
    runs, unknown = matching.expand_runs(names, nations.select(F.col("n_name").alias("name")), grids)
    return runs.withColumn("known", F.lit(True)).union(unknown.select("name", F.lit(False)))


# Chords: an event type is a chord symbol, a user is a track --------------------------


def raw_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("track"), seconds().alias("time"), F.col("event_type").alias("chord"), "event_id"
    )


def chord_events(spark, sf):
    return symbolic.event_positions(raw_events(spark, sf), 86400.0)


CHORDS_SQL = f"""
chords AS (SELECT user_id AS track, {SECONDS_SQL} AS time, event_type AS chord, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
first_seen AS (SELECT chord, min({{'t': track, 'p': pos}}) AS f FROM chords GROUP BY chord),
vocab AS (SELECT chord, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS idx FROM first_seen
  UNION ALL SELECT 'UNK', CAST(count(*) AS INTEGER) FROM first_seen)
"""


@query("chord_vocab", f"WITH {CHORDS_SQL} SELECT chord, idx FROM vocab")
def chord_vocab(spark, sf):
    return symbolic.build_vocab(raw_events(spark, sf), ("time", "event_id"))


@query(
    "chord_lists",
    f"""WITH {CHORDS_SQL} SELECT track, CAST(floor(time / 86400) AS BIGINT) AS block,
  array_to_string(list(chord ORDER BY time, pos), ',') AS chords FROM chords GROUP BY 1, 2""",
)
def chord_lists(spark, sf):
    lists = symbolic.group_chords(chord_events(spark, sf), 86400.0)
    return lists.select(
        "track", "block", F.array_join(F.transform("events", lambda e: e["chord"]), ",").alias("chords")
    )


# Segments of one day per user and order year; frames of one hour.
@query(
    "chord_frames",
    f"""WITH {CHORDS_SQL},
seg AS (SELECT DISTINCT user_id AS track, user_id * 100 + day(ts) AS segment_id,
   CAST((day(ts) - 1) * 86400.0 + 1800.0 AS DOUBLE) AS seek_time FROM events),
f AS (SELECT track, segment_id, seek_time, unnest(range(CAST(floor(seek_time / 3600.0) AS BIGINT) + 1,
   CAST(floor(seek_time / 3600.0) AS BIGINT) + 25)) AS frame FROM seg),
hit AS (SELECT f.segment_id, f.frame, c.chord FROM f ASOF LEFT JOIN chords c
   ON f.track = c.track AND f.frame * 3600.0 >= c.time)
SELECT segment_id, frame, coalesce(h.chord, 'N') AS chord,
  coalesce(v.idx, (SELECT idx FROM vocab WHERE chord = 'UNK')) AS idx
FROM hit h LEFT JOIN vocab v ON coalesce(h.chord, 'N') = v.chord""",
)
def chord_frames(spark, sf):
    # The events' numbers order those of one time as their list positions do.
    chords = raw_events(spark, sf).withColumn("pos", F.col("event_id"))
    day = F.floor(F.col("time") / 86400.0)
    segments = raw_events(spark, sf).select(
        "track",
        (F.col("track") * 100 + day + 1).alias("segment_id"),
        (day * F.lit(86400.0) + F.lit(1800.0)).alias("seek_time"),
    ).distinct()
    return symbolic.frame_chords(
        segments, chords, written(symbolic.build_vocab(chords, ("time", "event_id")), "vocab"), 1.0 / 3600.0, 86400.0, bucket_seconds=86400.0
    )


@query(
    "chord_indices",
    f"""WITH {CHORDS_SQL}, small AS (SELECT * FROM vocab WHERE chord <> 'error')
SELECT event_id, coalesce(s.idx, (SELECT idx FROM vocab WHERE chord = 'UNK')) AS idx
FROM chords c LEFT JOIN small s ON c.chord = s.chord""",
)
def chord_indices(spark, sf):
    chords = raw_events(spark, sf)
    vocab = written(symbolic.build_vocab(chords, ("time", "event_id")), "vocab").filter(F.col("chord") != "error")
    return symbolic.apply_vocab(chords.select("event_id", "chord"), vocab).select("event_id", "idx")


@query(
    "null_chord_rows",
    f"""SELECT event_id, {sql_joined("[194 FOR x IN range(CAST(ceil(value * 0.2) AS BIGINT))]")} AS chords FROM events""",
)
def null_chord_rows(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", joined(symbolic.null_chords(0.2, F.col("value"), 194)).alias("chords")
    )


# Precomputed frames: the vectors of one label are the frames of one track -----------


def track_frames(spark, sf):
    vectors = table(spark, sf, "embeddings")
    from tonewell.operators.scans import row_positions, span_bucket

    placed = row_positions(
        vectors.withColumnRenamed("label", "track"), ["track"], span_bucket(F.col("vec_id"), 100), [F.col("vec_id")], "frame"
    )
    return placed.withColumn("frame", F.col("frame").cast("int"))


FRAMES_SQL = """
frames AS (SELECT label AS track, vec_id, embedding,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame FROM embeddings),
seg AS (SELECT p_partkey AS segment_id, p_size % 10 AS track, CAST(p_retailprice / 100.0 AS DOUBLE) AS seek_time FROM part)
"""


def part_segments(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("segment_id"),
        (F.col("p_size") % 10).alias("track"),
        (F.col("p_retailprice") / 100.0).alias("seek_time"),
    )


@query(
    "embedding_chunks",
    f"""WITH {FRAMES_SQL},
w AS (SELECT segment_id, track, unnest(range(CAST(floor(seek_time / 2.0) AS INTEGER), CAST(floor((seek_time + 10.0) / 2.0) AS INTEGER))) AS frame
   FROM seg),
hit AS (SELECT segment_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim
   FROM w JOIN frames USING (track, frame))
SELECT segment_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM hit GROUP BY segment_id, dim""",
)
def embedding_chunks(spark, sf):
    frames = track_frames(spark, sf).select("track", "frame", F.col("embedding").alias("vector"))
    chunks = joins.chunk_embeddings(part_segments(spark, sf), frames, 2.0, 10.0)
    return chunks.select("segment_id", F.posexplode("vector").alias("dim", "v")).select(
        "segment_id", "dim", F.round("v", 6).alias("v")
    )


@query(
    "frame_chunks",
    f"""WITH {FRAMES_SQL},
w AS (SELECT segment_id, track, CAST(floor(seek_time * 3.0) AS INTEGER) + k AS frame, CAST(k AS INTEGER) AS k
   FROM seg, (SELECT unnest(range(12)) AS k))
SELECT w.segment_id, w.k, coalesce(f.vec_id, 0) AS vec_id FROM w LEFT JOIN frames f USING (track, frame)""",
)
def frame_chunks(spark, sf):
    frames = track_frames(spark, sf).select("track", "frame", "vec_id")
    out = joins.chunk_frames(part_segments(spark, sf), frames, 3.0, F.lit(8), value="vec_id", min_length=12)
    return out.select("segment_id", "k", "vec_id")


@query(
    "random_pairs",
    f"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_u('mix:source', 'conv_id', 'turn')}, turn) - 1 AS rank,
   count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_u('mix:target', 'conv_id', 'turn')}, turn) - 1 AS rank FROM conversations)
SELECT s.conv_id, s.rank, s.turn AS source_turn, t.turn AS target_turn
FROM s JOIN t USING (conv_id, rank) WHERE s.rank < floor(s.n * 0.6)""",
)
def random_pairs(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return joins.random_pairs(turns, "conv_id", "turn", 0.6, "mix")


@query(
    "survey_page",
    f"""WITH {SAMPLES_SQL}, m AS ({STABLE_SQL}),
page AS (SELECT * FROM m ORDER BY {sql_u('page:3', 'key')}, key LIMIT 8),
long AS (SELECT key, 'urgent' AS run, urgent AS path FROM page UNION ALL SELECT key, 'high', high FROM page
  UNION ALL SELECT key, 'low', low FROM page)
SELECT key, run, path, CAST(row_number() OVER (PARTITION BY key ORDER BY {sql_u('blind:3', 'key', 'run')}, run) - 1 AS INTEGER) AS place
FROM long""",
)
def survey_page(spark, sf):
    from tonewell.operators import ratings

    matched = by_run_columns(matching.match_stable(sample_catalogue(spark, sf), RUNS))
    long = matched.select("key", F.map_from_arrays(
        F.array(F.lit("urgent"), F.lit("high"), F.lit("low")), F.array("urgent", "high", "low")).alias("models"))
    return ratings.survey_page(long, 3, 8, blind=True)
