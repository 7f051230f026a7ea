"""JSON sidecars, sample catalogues, chords, paraphrases, ratings, histories, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.functions import text as X
from tonewell.operators.joins import stem_path
from tonewell.operators.ratings import explode_ratings
from tonewell.sources.files import file_path
from tonewell.sources.json_stream import json_entries

# Field names of the sidecars.
MUSIC_SCHEMA = (
    "title string, artist string, key string, bpm string, genre string, moods array<string>, "
    "keywords array<string>, description string, name string, instrument string, "
    "general_mood string, genre_tags array<string>, lead_instrument string, accompaniment string, "
    "tempo_and_rhythm string, vocal_presence string, production_quality string"
)
REFERENCE_SCHEMA = "struct<id: string, path: string, duration: double>"
SAMPLE_SCHEMA = (
    "id string, path string, epoch int, duration double, conditioning map<string,string>, "
    f"prompt {REFERENCE_SCHEMA}, reference {REFERENCE_SCHEMA}, generation_args map<string,string>"
)
RATING_SCHEMA = (
    "user string, seed int, blind boolean, exclude_prompted boolean, exclude_unprompted boolean, "
    "results array<struct<id: string, is_prompted: boolean, models: map<string,int>>>"
)
STAGES = ("train", "valid", "evaluate", "generate")


def whole_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, value) with the whole text of each matching file, found recursively."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(file_path().alias("path"), "value")
    )


def read_sidecars(
    spark: SparkSession, root: str, schema: str = MUSIC_SCHEMA, archived: DataFrame | None = None
) -> DataFrame:
    """Sidecar fields with the key ``stem``; the raw text stays in ``raw`` for key checks.

    ``archived``: (path, value) of members of archives (``archives.read_members``), whose
    stem is ``archive.zip:inner`` without the suffix.
    """
    files = whole_files(spark, root)
    if archived is not None:
        files = files.unionByName(archived.select("path", "value").filter(F.col("value").isNotNull()))
    return files.filter(~F.col("path").endswith(".source.json")).select(
        stem_path(F.col("path")).alias("stem"),
        F.from_json("value", T.StructType.fromDDL(schema)).alias("s"),
        F.col("value").alias("raw"),
    ).select("stem", "s.*", "raw")


def sound_descriptions(raw: Column) -> Column:
    """Description of a sound sidecar as an array, given as text or as a list."""
    value = F.get_json_object(raw, "$.description")
    as_list = F.from_json(value, T.ArrayType(T.StringType()))
    return F.when(value.startswith("["), as_list).when(value.isNotNull(), F.array(value))


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """Generated-sample catalogue: one JSON file per sample, found recursively."""
    return (
        spark.read.schema(SAMPLE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(root, multiLine=True)
    )


def read_chords(spark: SparkSession, path: str) -> DataFrame:
    """(track, pos, time, chord): a long Parquet table, or JSON files ``[[chord, time], ...]``
    named after their track."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("track", "pos", "time", "chord")
    event = F.from_json("value", T.ArrayType(T.StringType()))
    rows = _whole(json_entries(spark, path, "*.json"))
    events = rows.select(X.track_name(F.col("path")).alias("track"), F.col("pos").cast("int").alias("pos"), event.alias("e"))
    return events.select("track", "pos", F.col("e")[1].cast("double").alias("time"), F.col("e")[0].alias("chord"))


def _whole(entries: DataFrame) -> DataFrame:
    """Entries of whole files; one that is no JSON or breaks off ends the job with its name."""
    broken = F.raise_error(F.concat(F.lit("bad JSON file "), "path", F.lit(": "), "error")).cast("string")
    return entries.withColumn("path", F.when(F.col("error").isNull(), F.col("path")).otherwise(broken)).drop("error")


def read_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    """(info_path, texts) of JSON objects, plain or gzip, of any size: entries are read one by one."""
    texts = F.from_json("value", T.ArrayType(T.StringType()))
    rows = _whole(json_entries(spark, path, "*"))
    # the path is looked at so that a broken file is not left out
    return rows.filter(F.col("path").isNotNull()).select(F.col("key").alias("info_path"), texts.alias("texts"))


def read_ratings(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """(user, seed, item, model, rating) of all rating files; other suffixes are ignored."""
    files = (
        spark.read.schema(RATING_SCHEMA)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "true")
        .json(root, multiLine=multi_line)
    )
    return explode_ratings(files)


def history_rows(df: DataFrame, run: str, history: str) -> DataFrame:
    """(run, epoch, stage, metric, value) of run histories in JSON.

    A history is a list with one object per epoch, counted from 1. Only objects
    under the known stages and only numbers count; the top-level ``epoch``
    becomes a metric without a stage.
    """
    return epoch_rows(df.select(run, F.posexplode(F.parse_json(history).cast("array<variant>")).alias("i", "row")), run)


def epoch_rows(epochs: DataFrame, run: str) -> DataFrame:
    """The same of (run, i, row): one variant per epoch."""
    parts = epochs.filter(F.schema_of_variant("row").startswith("OBJECT"))
    parts = parts.select(
        run, (F.col("i") + 1).alias("epoch"), F.explode(F.col("row").cast("map<string,variant>")).alias("stage", "v")
    ).withColumn("kind", F.schema_of_variant("v"))

    def number(value: str, kind: str) -> Column:
        numeric = F.regexp_like(F.col(kind), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
        # Booleans count as numbers.
        truth = F.try_variant_get(value, "$", "boolean").cast("double")
        return F.when(numeric, F.try_variant_get(value, "$", "double")).when(F.col(kind) == "BOOLEAN", truth)

    metrics = (
        parts.filter(F.col("stage").isin(*STAGES) & F.col("kind").startswith("OBJECT"))
        .select(run, "epoch", "stage", F.explode(F.col("v").cast("map<string,variant>")).alias("metric", "m"))
        .withColumn("mkind", F.schema_of_variant("m"))
        .select(run, "epoch", "stage", "metric", number("m", "mkind").alias("value"))
    )
    tops = parts.filter(F.col("stage") == "epoch").select(
        run, "epoch", F.lit(None).cast("string").alias("stage"), F.lit("epoch").alias("metric"),
        number("v", "kind").alias("value"),
    )
    return metrics.unionByName(tops).filter(F.col("value").isNotNull())


def read_history(spark: SparkSession, root: str, pattern: str = "history.json") -> DataFrame:
    """Histories of all runs below ``root``; the run is the folder name. Epochs are read one by one."""
    rows = _whole(json_entries(spark, root, pattern))
    run = F.element_at(F.split("path", "/"), -2).alias("run")
    return epoch_rows(rows.select(run, F.col("pos").cast("int").alias("i"), F.parse_json("value").alias("row")), "run")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Structured prompt list with its ``prompt`` text."""
    fields = ", ".join(
        f"{name} {'array<string>' if name == 'genre_tags' else 'string'}" for name in X.PROMPT_FIELDS
    )
    rows = spark.read.schema(fields).json(path, multiLine=True)
    columns = {
        name: F.array_join(name, ", ") if name == "genre_tags" else F.col(name) for name in X.PROMPT_FIELDS
    }
    return rows.withColumn("prompt", X.struct_to_text(columns))
