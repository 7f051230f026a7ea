"""Registered queries: the file readers, on files that tasks make of the given tables."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tonewell.operators import joins, signal
from tonewell.plans.catalog_metrics import V_SQL
from tonewell.plans.catalog_signal import waves
from tonewell.plans.registry import joined, query, table
from tonewell.session import configure, scratch_path
from tonewell.sources import archives, sidecars, wav
from tonewell.sources.files import write_files

RATE = 16000


def wav_folder(spark, sf):
    """A file per vector, named by its id."""
    folder = scratch_path(configure(spark), "wavs")
    wav.write_wav_files(signal.i16_pcm(waves(spark, sf)), folder, RATE)
    return folder


def file_number(path):
    return F.regexp_extract(path, "([0-9]+)[.][a-z.]+$", 1).cast("bigint")


@query(
    "scanned_corpus",
    f"""WITH {V_SQL} SELECT vec_id, round(count(*) / 16000.0, 9) AS duration, 16000 AS sample_rate,
  round(max(abs(round_even(e * 32768, 0) / 32768.0)), 9) AS amplitude FROM cells GROUP BY vec_id""",
)
def scanned_corpus(spark, sf):
    good, _ = wav.scan_corpus(spark, wav_folder(spark, sf), minimal=False)
    return good.select(
        file_number("path").alias("vec_id"), F.round("duration", 9).alias("duration"), "sample_rate",
        F.round("amplitude", 9).alias("amplitude"),
    )


@query(
    "read_segments",
    f"""WITH {V_SQL} SELECT c.vec_id, CAST(s AS INTEGER) AS segment, c.i - 8 * (s + 1) * s AS t, round_even(e * 32768, 0) / 32768.0 AS x
FROM cells c, (SELECT unnest(range(3)) AS s) WHERE i >= 8 * (s + 1) * s AND i < 8 * (s + 1) * s + 24
UNION ALL SELECT vec_id, 2, 16 + k, 0.0 FROM v, (SELECT unnest(range(8)) AS k)""",
)
def read_segments(spark, sf):
    """Three segments of every file; the last one goes beyond the end and is filled up."""
    folder = wav_folder(spark, sf)
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda s: 8 * (s + 1) * s))
    vectors = table(spark, sf, "embeddings").select("vec_id", starts.alias("frame"))
    segments = vectors.select(
        F.concat(F.lit(f"{folder}/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"),
        (F.col("frame") / F.lit(float(RATE)) + F.lit(1e-9)).alias("seek_time"),
        F.lit(24 / RATE + 1e-9).alias("duration"),
        F.lit(True).alias("pad"),
    )
    chunks = wav.read_signal(spark, folder, 10 / RATE, RATE, segments)
    rows = chunks.select("clip_id", "segment", "start_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select(file_number("clip_id").alias("vec_id"), "segment", (F.col("start_frame") + F.col("i")).alias("t"), "x")


def write_archives(rows, folder):
    """A ZIP file ``folder/archive.zip`` per archive of (archive, name, content), members stored, deflated and bzipped in turn."""

    def pack(members):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as packed:
            for i, (name, content) in enumerate(members.sort_values("name")[["name", "content"]].itertuples(index=False, name=None)):
                packed.writestr(name, bytes(content), (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[i % 3])
        return pd.DataFrame({"path": [f"{folder}/{members['archive'].iloc[0]}.zip"], "content": [raw.getvalue()]})

    write_files(rows.groupBy("archive").applyInPandas(pack, "path string, content binary"))
    return folder


@query(
    "archived_segments",
    f"""WITH {V_SQL} SELECT c.vec_id, CAST(s AS INTEGER) AS segment, c.i - 8 * (s + 1) * s AS t, round_even(e * 32768, 0) / 32768.0 AS x
FROM cells c, (SELECT unnest(range(3)) AS s) WHERE i >= 8 * (s + 1) * s AND i < 8 * (s + 1) * s + 24
UNION ALL SELECT vec_id, 2, 16 + k, 0.0 FROM v, (SELECT unnest(range(8)) AS k)""",
)
def archived_segments(spark, sf):
    """Three segments of every member of archives with about a hundred clips each."""
    folder = scratch_path(configure(spark), "archived")
    clips = wav.wav_bytes(signal.i16_pcm(waves(spark, sf)), RATE)
    archive = F.concat(F.lit("clips-"), F.expr("clip_id div 100").cast("string"))
    name = F.concat(F.lit("in/"), F.col("clip_id").cast("string"), F.lit(".wav"))
    write_archives(clips.select(archive.alias("archive"), name.alias("name"), "content"), folder)
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda s: 8 * (s + 1) * s))
    number = F.col("vec_id").cast("string")
    path = F.concat(F.lit(f"{folder}/clips-"), F.expr("vec_id div 100").cast("string"), F.lit(".zip:in/"), number, F.lit(".wav"))
    segments = table(spark, sf, "embeddings").select(path.alias("path"), starts.alias("frame")).select(
        "path",
        (F.col("frame") / F.lit(float(RATE)) + F.lit(1e-9)).alias("seek_time"),
        F.lit(24 / RATE + 1e-9).alias("duration"),
        F.lit(True).alias("pad"),
    )
    chunks = wav.read_signal(spark, folder, 10 / RATE, RATE, segments)
    rows = chunks.select("clip_id", "segment", "start_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select(file_number("clip_id").alias("vec_id"), "segment", (F.col("start_frame") + F.col("i")).alias("t"), "x")


@query(
    "archived_sidecars",
    """SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'm' || CAST(s_suppkey AS VARCHAR) ELSE 'unknown' END AS artist,
  TRUE AS has_sidecar FROM supplier""",
)
def archived_sidecars(spark, sf):
    """Sidecars inside archives, one per nation."""
    folder = scratch_path(configure(spark), "archives")
    artist = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("m"), F.col("s_suppkey").cast("string")))
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("archive"),
        F.concat(F.lit("info/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"),
        F.to_json(F.struct(F.col("s_name").alias("title"), artist.alias("artist"))).cast("binary").alias("content"),
    )
    write_archives(rows.drop("id"), folder)
    wanted = F.concat(F.lit(f"{folder}/"), "archive", F.lit(".zip:"), F.regexp_replace("name", "json$", "wav"))
    files = rows.select("id", wanted.alias("path"))
    texts = archives.read_members(archives.list_members(spark, folder, (".json",)))
    found = joins.attach_sidecar(files, sidecars.read_sidecars(spark, folder, archived=texts))
    return found.select("id", "title", "artist", "has_sidecar")


def made_head(kind: int, frames: int, rate: int) -> bytes:
    """A small file of each format that states ``frames`` at ``rate``; the sound itself is left out."""
    if kind == 0:
        info = bytes(10) + (rate << 44 | 1 << 41 | 15 << 36 | frames).to_bytes(8, "big") + bytes(16)
        return b"fLaC" + bytes([0x80, 0, 0, len(info)]) + info
    if kind == 1:
        pages = [(0, b"\x01vorbis" + struct.pack("<IBI", 0, 2, rate) + bytes(14)), (frames, bytes(40))]
        return b"".join(
            b"OggS" + struct.pack("<BBqIIIBB", 0, 0, at, 7, n, 0, 1, len(packet)) + packet for n, (at, packet) in enumerate(pages)
        )
    if kind == 2:  # whole frames of 1152 samples at 44,100
        frame = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">II", 1, frames // 1152)
        return b"ID3\x03\0\0\0\0\x02\x01" + bytes(257) + frame.ljust(417, b"\0") + b"\xff\xfb\x90\x00" + bytes(413)

    def box(name: bytes, *inside: bytes) -> bytes:
        return struct.pack(">I", 8 + sum(map(len, inside))) + name + b"".join(inside)

    entry = bytes(16) + struct.pack(">HHHHI", 2, 16, 0, 0, rate << 16)
    track = box(
        b"trak", box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">III", rate, frames, 0)), box(b"hdlr", bytes(8) + b"soun" + bytes(13)),
        box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + box(b"mp4a", bytes(8) + entry[8:])))))
    )
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"mdat", bytes(100)) + box(b"moov", box(b"mvhd", bytes(100)), track)


@query(
    "scanned_formats",
    """WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey % 4 AS INTEGER) AS kind, 1152 * (s_suppkey + 1) AS frames,
  CASE WHEN s_suppkey % 4 = 2 THEN 44100 ELSE 8000 * (1 + s_nationkey % 4) END AS rate FROM supplier)
SELECT id, round(frames / CAST(rate AS DOUBLE), 9) AS duration, CAST(rate AS INTEGER) AS sample_rate FROM s""",
)
def scanned_formats(spark, sf):
    """Heads of FLAC, Ogg, MP3 and M4A files, without a failure."""
    folder = scratch_path(configure(spark), "formats")
    rate = F.when(F.col("s_suppkey") % 4 == 2, 44100).otherwise(8000 * (1 + F.col("s_nationkey") % 4))
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("kind"), (1152 * (F.col("s_suppkey") + 1)).alias("frames"), rate.alias("rate")
    )

    def make(batches):
        for batch in batches:
            columns = zip(batch["id"], batch["kind"], batch["frames"], batch["rate"], strict=True)
            made = [(f"{folder}/{i}.{('flac', 'ogg', 'mp3', 'm4a')[k]}", made_head(k, n, r)) for i, k, n, r in columns]
            yield pd.DataFrame(made, columns=["path", "content"])

    write_files(rows.mapInPandas(make, "path string, content binary"))
    good, bad = wav.scan_corpus(spark, folder)
    found = good.select(F.regexp_extract("path", "([0-9]+)[.][a-z0-9]+$", 1).cast("bigint").alias("id"), F.round("duration", 9).alias("duration"), "sample_rate")
    failed = bad.select(F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("int"))
    return found.union(failed)


@query(
    "written_pcm",
    f"""WITH {V_SQL}, g AS (SELECT vec_id, i, greatest(least(e * 8, power(10, -0.05)), -power(10, -0.05)) AS x FROM cells)
SELECT vec_id, i AS t, round(round_even(x * 32768, 0) / 32768.0, 9) AS x FROM g""",
)
def written_pcm(spark, sf):
    """Loud signals clamped, written and read again."""
    folder = scratch_path(configure(spark), "pcm")
    wav.write_pcm(signal._map(waves(spark, sf), lambda x: x * 8), folder, RATE, "clip")
    rows = signal.to_long(wav.read_signal(spark, folder, 16 / RATE, RATE))
    return rows.select(file_number("clip_id").alias("vec_id"), "t", F.round("x", 9).alias("x"))


def named_json(rows, folder, name, value):
    """Write a JSON file for every row and return the folder."""
    path = F.concat(F.lit(f"{folder}/"), name, F.lit(".json"))
    write_files(rows.select(path.alias("path"), value.alias("content")))
    return folder


@query(
    "sidecar_files",
    """SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS genre,
  CASE WHEN s_suppkey % 2 = 0 THEN 'm' || CAST(s_suppkey AS VARCHAR) ELSE 'unknown' END AS artist, TRUE AS has_sidecar FROM supplier""",
)
def sidecar_files(spark, sf):
    folder = scratch_path(configure(spark), "sidecars")
    rows = table(spark, sf, "supplier")
    value = F.to_json(
        F.struct(
            F.col("s_name").alias("title"),
            F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey").cast("string")).alias("genre"),
            F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))).alias("artist"),
            F.lit(7).alias("unheard_of"),
        )
    )
    named_json(rows, folder, F.col("s_suppkey").cast("string"), value)
    path = F.concat(F.lit(f"{folder}/"), F.col("s_suppkey").cast("string"), F.lit(".wav"))
    files = rows.select(F.col("s_suppkey").alias("id"), path.alias("path"))
    found = joins.attach_sidecar(files, sidecars.read_sidecars(spark, folder))
    return found.select("id", "title", "genre", "artist", "has_sidecar")


@query(
    "sample_files",
    """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS INTEGER) AS epoch, round(s_acctbal, 6) AS duration, s_name AS text,
  CASE WHEN s_suppkey % 2 = 0 THEN 'p' || CAST(s_nationkey AS VARCHAR) END AS prompt FROM supplier""",
)
def sample_files(spark, sf):
    folder = scratch_path(configure(spark), "samples")
    rows = table(spark, sf, "supplier")
    number = F.col("s_suppkey").cast("string")
    prompt = F.struct(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("id"), F.lit("q").alias("path"), F.lit(1.5).alias("duration"))
    value = F.to_json(
        F.struct(
            F.concat(F.lit("s"), number).alias("id"),
            F.lit("x").alias("path"),
            F.col("s_nationkey").cast("int").alias("epoch"),
            F.round("s_acctbal", 6).alias("duration"),
            F.create_map(F.lit("text"), F.col("s_name")).alias("conditioning"),
            F.when(F.col("s_suppkey") % 2 == 0, prompt).alias("prompt"),
        )
    )
    named_json(rows, folder, F.concat_ws("/", F.col("s_nationkey").cast("string"), number), value)
    return sidecars.read_samples(spark, folder).select(
        "id", "epoch", "duration", F.col("conditioning")["text"].alias("text"), F.col("prompt.id").alias("prompt")
    )


@query(
    "chord_files",
    """SELECT 't' || CAST(user_id // 100 AS VARCHAR) AS track, CAST(row_number() OVER (PARTITION BY user_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS pos,
  round(value, 6) AS time, event_type AS chord FROM events""",
)
def chord_files(spark, sf):
    """A list file per hundred users: files grow in number with the table, not in size."""
    folder = scratch_path(configure(spark), "chords")
    events = table(spark, sf, "events").select(
        "event_id", F.expr("user_id div 100").cast("string").alias("track"), "event_type", F.round("value", 6).alias("time")
    )
    entry = F.struct("event_id", F.to_json(F.array(F.col("event_type"), F.col("time").cast("string"))).alias("e"))
    lists = events.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("l"))
    value = F.concat(F.lit("["), joined("l", ","), F.lit("]"))
    named_json(lists, folder, F.concat(F.lit("t"), F.col("track")), value)
    return sidecars.read_chords(spark, folder).withColumn("time", F.round("time", 6))


@query(
    "prompt_files",
    """SELECT item_id, 'description: ' || text || '. genre_tags: rock, g' || CAST(item_id AS VARCHAR) AS prompt
FROM (SELECT item_id, regexp_replace(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g') AS raw, trim(raw) AS text FROM benchmark)""",
)
def prompt_files(spark, sf):
    """One list file per ten prompts."""
    folder = scratch_path(configure(spark), "prompts")
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "[^a-zA-Z ]", ""), " +", " "))
    rows = table(spark, sf, "benchmark").select("item_id", plain.alias("description"))
    entry = F.struct("description", F.array(F.lit("rock"), F.concat(F.lit("g"), F.col("item_id").cast("string"))).alias("genre_tags"))
    lists = rows.groupBy(F.expr("item_id div 10").alias("part")).agg(F.to_json(F.collect_list(entry)).alias("l"))
    named_json(lists, folder, F.col("part").cast("string"), F.col("l"))
    found = sidecars.read_prompts(spark, folder)
    number = F.regexp_extract("prompt", "g([0-9]+)$", 1).cast("bigint")
    return found.select(number.alias("item_id"), "prompt")


@query(
    "paraphrase_files",
    """SELECT 'p' || CAST(item_id AS VARCHAR) AS info_path, array_to_string(string_split(text, '. '), ' / ') AS texts FROM benchmark""",
)
def paraphrase_files(spark, sf):
    """Files of ten objects' keys each, read as whole objects."""
    folder = scratch_path(configure(spark), "paraphrases")
    rows = table(spark, sf, "benchmark").select("item_id", F.split("text", "\\. ", -1).alias("texts"))
    entry = F.struct(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("k"), F.col("texts").alias("v"))
    lists = rows.groupBy(F.expr("item_id div 10").alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("l"))
    named_json(lists, folder, F.col("part").cast("string"), F.col("l"))
    return sidecars.read_paraphrases(spark, folder).withColumn("texts", joined("texts", " / "))
