"""Registered queries: attribute cleaning and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions import text as X
from tonewell.operators import captions, conditions
from tonewell.plans.registry import PY_SPACE_SQL, heavy_table, joined, query, sql_fold, sql_joined, sql_trim, sql_u, table

SPACE = PY_SPACE_SQL


def sql_keyword(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL OR {value} = '' OR {value} = 'None' THEN NULL "
        f"ELSE lower({sql_trim(value)}) END"
    )


@query(
    "keyword_normalise",
    f"""SELECT doc_id, {sql_keyword("lang")} AS genre, {sql_trim("source")} AS artist,
  CASE WHEN contains({sql_keyword("text")}, ',') THEN NULL ELSE {sql_keyword("text")} END AS key,
  {sql_joined(f"""nullif(list_filter(list_transform(regexp_split_to_array(text, '[,{SPACE[1:]}'), lambda v: {sql_keyword("v")}),
      lambda v: v IS NOT NULL), [])""", " ")} AS keywords
FROM documents""",
)
def keyword_normalise(spark, sf):
    docs = heavy_table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("genre"),
        F.col("source").alias("artist"),
        F.col("text").alias("key"),
        F.col("text").alias("keywords"),
    )
    from tonewell.operators.corpus import normalise_attributes

    cleaned = normalise_attributes(
        docs, {"genre": "keyword", "artist": "string", "key": "key", "keywords": "keyword_list"}
    )
    return cleaned.withColumn("keywords", joined("keywords", " "))


@query(
    "bpm_and_numbers",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS bpm,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) END AS bad_bpm, CAST(event_id AS VARCHAR) AS keywords FROM events""",
)
def bpm_and_numbers(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        X.get_bpm(F.get_json_object("props", "$.k")).alias("bpm"),
        X.get_bpm(F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "").otherwise("f"))).alias("bad_bpm"),
        joined(X.get_keyword_list(F.col("event_id"), "number")).alias("keywords"),
    )


TAGS = f"regexp_split_to_array(text, '[.]')"


@query(
    "caption_normalise",
    f"""WITH raw AS (SELECT doc_id, lang, source, {sql_trim("text")} AS d, {TAGS} AS tags FROM documents),
clean AS (SELECT *, list_filter(list_transform(tags, lambda t: {sql_trim("t")}), lambda t: t <> '') AS t,
   regexp_split_to_array(d, '{SPACE}+') AS w FROM raw),
uniq AS (SELECT *, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i) AS u
   FROM clean)
SELECT doc_id,
  CASE WHEN len(w) < 8 THEN NULL WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') ELSE d END AS description,
  {sql_joined("CASE WHEN len(w) >= 8 THEN CASE WHEN len(u) = 0 THEN ['Unknown'] ELSE u[1:5] END END", ' | ')} AS genre_tags,
  CASE WHEN len(w) >= 8 THEN lang END AS general_mood,
  CASE WHEN len(w) >= 8 THEN 'Unknown' END AS lead_instrument,
  CASE WHEN len(w) < 8 THEN 'description too short: ' || d END AS error
FROM uniq""",
)
def caption_normalise(spark, sf):
    docs = heavy_table(spark, sf, "documents")
    payload = F.to_json(
        F.struct(
            F.col("text").alias("description"),
            F.col("lang").alias("general_mood"),
            F.split("text", "[.]").alias("genre_tags"),
            F.lit("  ").alias("lead_instrument"),
            F.col("source").alias("accompaniment"),
            F.lit("").alias("tempo_and_rhythm"),
            F.lit("x").alias("vocal_presence"),
            F.lit("y").alias("production_quality"),
        )
    )
    out = captions.normalise_payload(docs.select("doc_id", payload.alias("payload")), "payload")
    out = out.withColumn("genre_tags", joined("genre_tags", " | "))
    return out.select("doc_id", "description", "genre_tags", "general_mood", "lead_instrument", "error")


FIELD_SQL = {
    "key": "lang",
    "bpm": "CASE WHEN quality = 1 THEN CAST(n_chars AS VARCHAR) END",
    "genre": "source",
    "instrument": "CASE WHEN toxic = 0 THEN 'piano' END",
    "general_mood": "lang || ' ' || source",
}


def _merge_sql() -> str:
    pairs = ", ".join(
        f"{{'u': {sql_u(f'3:order:{n}', 'doc_id')}, 'name': '{n}', 'pair': CASE WHEN ({e}) IS NOT NULL AND "
        f"{sql_u(f'3:keep:{n}', 'doc_id')} < 0.7 THEN '{n}: ' || ({e}) END}}"
        for n, e in FIELD_SQL.items()
    )
    return f"""
WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT doc_id, text, CASE WHEN {sql_u('3:merge', 'doc_id')} < 0.8 THEN array_to_string(list_transform(
    list_sort(list_filter([{pairs}], lambda x: x.pair IS NOT NULL)), lambda x: x.pair), '. ') ELSE '' END AS meta,
  {sql_u('3:merge', 'doc_id')} < 0.8 AND {sql_u('3:drop', 'doc_id')} < 0.3 AS dropped FROM j),
m AS (SELECT doc_id, CASE WHEN dropped THEN CASE WHEN length(meta) > 1 THEN meta END
   ELSE regexp_replace(text, '[.]+$', '') || '. ' || meta END AS v FROM p)
SELECT doc_id, CASE WHEN length(v) > 0 THEN {sql_trim("v")} END AS description FROM m"""


@query("description_merge", _merge_sql())
def description_merge(spark, sf):
    rows = heavy_table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    fields = {
        "key": F.col("lang"),
        "bpm": F.when(F.col("quality") == 1, F.col("n_chars").cast("string")),
        "genre": F.col("source"),
        "instrument": F.when(F.col("toxic") == 0, "piano"),
        "general_mood": F.concat_ws(" ", "lang", "source"),
    }
    merged = X.merge_description(F.col("text"), fields, F.col("doc_id"), 0.8, 0.3, 0.7, seed=3)
    return rows.select("doc_id", merged.alias("description"))


@query(
    "prompt_text",
    f"""SELECT p_partkey, array_to_string(list_filter([
   'description: ' || {sql_trim("p_name")}, 'general_mood: ' || lower(p_type),
   'genre_tags: ' || array_to_string([p_brand, p_type], ', ')], lambda x: x IS NOT NULL), '. ') AS prompt FROM part""",
)
def prompt_text(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        X.struct_to_text(
            {
                "genre_tags": F.array_join(F.array("p_brand", "p_type"), ", "),
                "description": F.col("p_name"),
                "general_mood": F.lower("p_type"),
                "accompaniment": F.lit("  "),
            }
        ).alias("prompt"),
    )


@query(
    "mixed_text",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE text || ' ' || role END AS mixed FROM conversations",
)
def mixed_text(spark, sf):
    turns = heavy_table(spark, sf, "conversations")
    other = F.when(F.col("role") == "user", F.col("text")).otherwise(F.col("role"))
    return turns.select("conv_id", "turn", X.mix_text(F.col("text"), other).alias("mixed"))


@query(
    "word_dropout",
    f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
   generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents)
SELECT d.doc_id, coalesce(k.kept, '') AS kept FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w
  WHERE {sql_u(5, 'doc_id', 'i')} >= 0.3 GROUP BY doc_id) k ON d.doc_id = k.doc_id""",
)
def word_dropout(spark, sf):
    return heavy_table(spark, sf, "documents").select(
        "doc_id", X.word_dropout(F.col("text"), 0.3, 5, F.col("doc_id")).alias("kept")
    )


@query(
    "hashed_tokens",
    f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array({sql_trim("text")}, '{SPACE}+'),
   lambda w: w <> '' AND w NOT IN ('?', ':', '!', '.', ',', ';')) AS ws FROM conversations)
SELECT conv_id, turn, {sql_joined("list_transform(ws, lambda w: " + sql_fold("sha256(w)", 64, 4096) + ")")} AS tokens,
  CAST(len(ws) AS INTEGER) AS length FROM t""",
)
def hashed_tokens(spark, sf):
    turns = heavy_table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", X.hash_tokens(F.col("text"), 4096).alias("h")).select(
        "conv_id", "turn", joined("h.tokens").alias("tokens"), "h.length"
    )


@query(
    "hashed_labels",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE {sql_fold("sha256(event_type)", 64, 500)} END AS token,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask FROM events""",
)
def hashed_labels(spark, sf):
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf, "events").select("event_id", X.hash_label(label, 500).alias("h")).select(
        "event_id", "h.token", "h.mask"
    )


SLUG_BLANK = "\t\n\x0b\x0c\r\x1c-\x1f "


def sql_slug(value: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({value})), "
        f"'[^a-z0-9_{SLUG_BLANK}-]', '', 'g'), '[{SLUG_BLANK}-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"
    )


@query("slugs", f"SELECT page_id, {sql_slug('url')} AS url_slug FROM pages")
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slugify(F.col("url")).alias("url_slug"))


@query("text_slugs", f"SELECT doc_id, {sql_slug('text')} AS slug FROM documents")
def text_slugs(spark, sf):
    return heavy_table(spark, sf, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query(
    "sample_ids",
    f"""SELECT p_partkey, sha1(CAST(p_partkey AS VARCHAR) || p_type ||
    '{{"brand": "' || p_brand || '", "name": "' || p_name || '"}}') || '_prompted_' ||
    substr('brand=' || {sql_slug("p_brand")} || '-name=' || {sql_slug("p_name")}, 1, 100) AS sample_id,
  sha1(CAST(p_partkey AS VARCHAR) || p_type) || '_prompted_unconditioned' AS bare_id,
  'noinput_' || md5(p_name) AS free_id FROM part""",
)
def sample_ids(spark, sf):
    given = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    nothing = F.create_map().cast("map<string,string>")
    prompt = F.encode("p_type", "UTF-8")
    free = X.sample_id(F.col("p_partkey"), F.lit(None).cast("binary"), nothing, F.md5("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        X.sample_id(F.col("p_partkey"), prompt, given).alias("sample_id"),
        X.sample_id(F.col("p_partkey"), prompt, nothing).alias("bare_id"),
        free.alias("free_id"),
    )


@query(
    "path_mappers",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '^http://', '//reference/', 'g'), '\?.*$', '', 'g') AS mapped,
  regexp_replace(regexp_replace(regexp_replace(url, '^http://', '//reference/', 'g'), '\?.*$', '', 'g'),
    '^//reference', '/mnt/ref') AS resolved FROM pages""",
)
def path_mappers(spark, sf):
    mapped = X.apply_mappers(F.col("url"), [("^http://", "//reference/"), ("\\?.*$", "")])
    return table(spark, sf, "pages").select(
        "page_id", mapped.alias("mapped"), X.resolve_reference(mapped, "/mnt/ref").alias("resolved")
    )


@query(
    "zip_paths",
    """SELECT doc_id, source || '.zip' AS zip_path, lang || '/' || CAST(doc_id AS VARCHAR) || '.json' AS file_path,
  '/base/' || source || '.zip:' || lang || '/' || CAST(doc_id AS VARCHAR) || '.json' AS full_path FROM documents""",
)
def zip_paths(spark, sf):
    raw = F.concat(F.col("source"), F.lit(".zip:"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    parsed = X.parse_zip_path(raw)
    return heavy_table(spark, sf, "documents").select(
        "doc_id", parsed.alias("p"), X.absolute_path(raw, "/base").alias("full_path")
    ).select("doc_id", "p.zip_path", "p.file_path", "full_path")


@query(
    "flat_config",
    """SELECT event_id, name, value FROM (
  SELECT event_id, 'run.kind' AS name, event_type AS value FROM events
  UNION ALL SELECT event_id, 'run.props.k', json_extract_string(props, '$.k') FROM events
  UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'l1.l2.l3.l4.l5.l6.l7.l8.l9', event_type FROM events WHERE event_id % 3 = 0)""",
)
def flat_config(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit('{"run": {"kind": "'), "event_type", F.lit('", "props": '), "props",
            F.lit('}, "user": '), F.col("user_id").cast("string"),
            # every third config is nine levels deep
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "l1": ' + "".join(f'{{"l{i}": ' for i in range(2, 10)) + '"'), "event_type", F.lit('"' + "}" * 8)))
            .otherwise(F.lit("")),
            F.lit("}"),
        ).alias("config"),
    )
    return captions.flatten_config(events, "event_id", "config").drop("error")


@query(
    "run_signature",
    """SELECT conv_id, substr(sha1('["' || array_to_string(list(md5(text) ORDER BY turn), '", "') || '"]'), 1, 10)
  AS signature FROM conversations GROUP BY conv_id""",
)
def run_signature(spark, sf):
    turns = heavy_table(spark, sf, "conversations")
    runs = turns.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))), lambda x: x["m"]).alias("names")
    )
    return runs.select("conv_id", X.set_signature(F.col("names")).alias("signature"))


@query(
    "picked_descriptions",
    f"""SELECT doc_id, s[CAST(floor({sql_u('pick', 'doc_id')} * len(s)) AS INTEGER) + 1] AS description
FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents)""",
)
def picked_descriptions(spark, sf):
    sentences = F.split("text", "\\.", -1)
    return heavy_table(spark, sf, "documents").select(
        "doc_id", X.pick_element(sentences, "pick", F.col("doc_id")).alias("description")
    )


# Conditioning tables ---------------------------------------------------------------


def condition_rows(spark, sf):
    """Conversation turns as conditioned items; a conversation is a batch."""
    turns = heavy_table(spark, sf, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        F.create_map(
            F.lit("description"), F.col("text"), F.lit("genre"), F.col("role"),
            F.lit("keywords"), F.array_join(F.slice(F.split("text", " "), 1, 3), " "),
        ).alias("text"),
        F.map_from_arrays(
            F.array(F.lit("self_wav")),
            F.array(
                F.struct(
                    F.length("text").cast("bigint").alias("length"),
                    F.lit(16000).alias("sample_rate"),
                    F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
                    (F.col("turn") * 0.5).alias("seek_time"),
                )
            ),
        ).alias("wav"),
    )


@query(
    "condition_attributes",
    """SELECT conv_id, turn, 'text.description' AS attribute, text AS value FROM conversations
UNION ALL SELECT conv_id, turn, 'text.genre', role FROM conversations
UNION ALL SELECT conv_id, turn, 'text.keywords', array_to_string(string_split(text, ' ')[1:3], ' ') FROM conversations
UNION ALL SELECT conv_id, turn, 'wav.self_wav', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) FROM conversations""",
)
def condition_attributes(spark, sf):
    rows = heavy_table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("description"),
        F.col("role").alias("genre"),
        F.slice(F.split("text", " "), 1, 3).alias("keywords"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("self_wav"),
    )
    made = conditions.to_conditions(rows, ["description", "genre", "keywords"], wave=["self_wav"])
    flat = conditions.flatten_conditions(made, ["text", "wav"])
    back = conditions.unflatten_conditions(flat, "flat", ["text", "wav"]).select("conv_id", "turn", "text", "wav")
    again = conditions.flatten_conditions(back, ["text", "wav"])
    return again.select("conv_id", "turn", F.explode("flat").alias("attribute", "value"))


ATTR_P = {"text": {"description": 0.3, "genre": 0.6}, "wav": {"self_wav": 0.5}}


@query(
    "condition_dropout",
    f"""SELECT conv_id, turn,
  CASE WHEN {sql_u('attr:11', "'text'", "'description'", 'conv_id')} < 0.3 THEN NULL ELSE text END AS description,
  CASE WHEN {sql_u('attr:11', "'text'", "'genre'", 'conv_id')} < 0.6 THEN NULL ELSE role END AS genre,
  CASE WHEN {sql_u('attr:11', "'wav'", "'self_wav'", 'conv_id')} < 0.5 THEN 0 ELSE CAST(length(text) AS BIGINT) END AS wav_length,
  CASE WHEN {sql_u('attr:11', "'wav'", "'self_wav'", 'conv_id')} < 0.5 THEN NULL
    ELSE CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) END AS wav_path,
  CASE WHEN {sql_u('attr:11', "'wav'", "'self_wav'", 'conv_id')} < 0.5 THEN NULL ELSE CAST(turn * 0.5 AS DOUBLE) END AS wav_seek
FROM conversations""",
)
def condition_dropout(spark, sf):
    out = conditions.attribute_dropout(condition_rows(spark, sf), ATTR_P, F.col("conv_id"), 11)
    return out.select(
        "conv_id",
        "turn",
        F.col("text")["description"].alias("description"),
        F.col("text")["genre"].alias("genre"),
        F.col("wav")["self_wav"]["length"].alias("wav_length"),
        F.col("wav")["self_wav"]["path"].alias("wav_path"),
        F.col("wav")["self_wav"]["seek_time"].alias("wav_seek"),
    )


@query(
    "guidance_dropout",
    f"""SELECT conv_id, turn, CASE WHEN {sql_u('guide:4', 'conv_id')} < 0.4 THEN NULL ELSE text END AS description,
  CASE WHEN {sql_u('guide:4', 'conv_id')} < 0.4 THEN 0 ELSE CAST(length(text) AS BIGINT) END AS wav_length
FROM conversations""",
)
def guidance_dropout(spark, sf):
    out = conditions.guidance_dropout(condition_rows(spark, sf), 0.4, F.col("conv_id"), 4)
    return out.select(
        "conv_id",
        "turn",
        F.col("text")["description"].alias("description"),
        F.col("wav")["self_wav"]["length"].alias("wav_length"),
    )


@query(
    "description_drop",
    """SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS description, role AS genre, CAST(length(text) AS BIGINT) AS wav_length
FROM conversations""",
)
def description_drop(spark, sf):
    out = conditions.drop_description(condition_rows(spark, sf))
    return out.select(
        "conv_id", "turn", F.col("text")["description"].alias("description"), F.col("text")["genre"].alias("genre"),
        F.col("wav")["self_wav"]["length"].alias("wav_length"),
    )


@query(
    "null_symbols",
    """SELECT event_id, array_to_string(list_transform(range(1 + event_id % 5), lambda i: '194'), ',') AS frame_chords,
  array_to_string(list_transform(range(1 + user_id % 3), lambda i: '0.0'), ',') AS melody FROM events""",
)
def null_symbols(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        # As long as the row says, so that the null symbols must follow the data.
        F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: i + F.length("event_type")).alias("chords"),
        F.transform(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int")), lambda i: F.col("value") + i).alias("melody"),
    )
    return rows.select(
        "event_id",
        joined(conditions.nullify_chords(F.col("chords"), 194)).alias("frame_chords"),
        joined(conditions.nullify_melody(F.col("melody"))).alias("melody"),
    )


@query(
    "collated_conditions",
    """SELECT batch, attribute, string_agg(value, ' / ' ORDER BY pos) AS values FROM (
 SELECT pos // 16 AS batch, attribute, value, pos FROM (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, text, role FROM conversations) t,
  LATERAL (SELECT 'text.description' AS attribute, text AS value UNION ALL SELECT 'text.genre', role))
GROUP BY batch, attribute""",
)
def collated_conditions(spark, sf):
    from tonewell.operators.scans import sorted_positions

    rows = sorted_positions(table(spark, sf, "conversations"), [], ["conv_id", "turn"])
    made = rows.select(
        F.expr("pos div 16").alias("batch"),
        "pos",
        F.create_map(F.lit("text.description"), F.col("text"), F.lit("text.genre"), F.col("role")).alias("flat"),
    )
    return conditions.collate_conditions(made, "batch", "pos", "flat").withColumn("values", joined("values", " / "))


@query(
    "hydrated_conditions",
    """SELECT conv_id, turn, role AS genre, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS self_wav
FROM conversations""",
)
def hydrated_conditions(spark, sf):
    out = conditions.hydrate_conditions(condition_rows(spark, sf), ["genre", "self_wav"])
    return out.select(
        "conv_id", "turn", F.col("conditions")["genre"].alias("genre"), F.col("conditions")["self_wav"].alias("self_wav")
    )
