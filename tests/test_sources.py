import gzip
import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell.operators import joins, signal
from tonewell.plans.convert import convert_corpus, converted_files
from tonewell.sources import archives, caches, files, manifests, sidecars, wav
from tonewell.sources.resources import embed_with


def write(path, text):
    os.makedirs(os.path.dirname(str(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def wave_file(path, codes, rate=16000):
    codes = np.asarray(codes, dtype="<i2")
    channels, data = codes.shape[1], codes.tobytes()
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate,
        rate * 2 * channels, 2 * channels, 16, b"data", len(data),
    )
    os.makedirs(os.path.dirname(str(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(head + data)


def test_manifest_round_trip(spark, tmp_path):
    rows = [
        ("mypath2", 2.0, 16000, None, None, None),
        ("mypath1", 1.0, 16000, None, 0.5, "/foo/bar.zip:/relative/file1.json"),
    ]
    from tonewell.operators.corpus import MANIFEST_SCHEMA

    df = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    for name in ("data.jsonl", "data.jsonl.gz"):
        path = str(tmp_path / name)
        manifests.write_manifest(df, path)
        assert sorted(map(tuple, manifests.read_manifest(spark, path).collect())) == sorted(rows)
        manifests.write_manifest(df.limit(0), path)
        assert manifests.read_manifest(spark, path).count() == 0
    extra = write(tmp_path / "x" / "data.jsonl", '{"path": "p", "duration": 1, "sample_rate": 8, "new": [1]}\n')
    assert tuple(manifests.read_manifest(spark, extra).first()) == ("p", 1.0, 8, None, None, None)


def test_resolving(spark, tmp_path):
    with pytest.raises(ValueError):
        manifests.resolve_manifest(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        manifests.resolve_manifest(spark, str(tmp_path / "none"))
    with gzip.open(tmp_path / "data.jsonl.gz", "wt") as f:
        f.write('{"path": "p", "duration": 3.0, "sample_rate": 8}\n')
    assert manifests.resolve_manifest(spark, str(tmp_path)).endswith("data.jsonl.gz")
    with pytest.raises(ValueError):
        manifests.resolve_manifest(spark, str(tmp_path), strict=True)
    plain = write(tmp_path / "data.jsonl", "")
    assert manifests.resolve_manifest(spark, str(tmp_path)) == plain
    assert manifests.resolve_manifest(spark, plain) == plain


def test_datasource_limits(spark, tmp_path):
    write(tmp_path / "data.jsonl", '{"path": "p", "duration": 3.0, "sample_rate": 8}\n{"path": "q", "duration": 9.0, "sample_rate": 8}\n')
    config = {"datasource": {"train": str(tmp_path), "max_sample_rate": 32000, "max_channels": 2}, "sample_rate": 32000, "channels": 2,
              "defaults": {"max_duration": 20}, "kwargs": {"train": {"max_duration": 5}}}
    assert [r["path"] for r in manifests.datasource(spark, config, "train").collect()] == ["p"]
    assert set(manifests.datasources(spark, config)) == {"train"}
    for bad in ({"sample_rate": 48000}, {"channels": 3}):
        with pytest.raises(ValueError):
            manifests.datasource(spark, {**config, **bad}, "train")
    with pytest.raises(ValueError):
        manifests.datasource(spark, config, "valid")


def test_sidecars(spark, tmp_path):
    root = str(tmp_path)
    write(tmp_path / "a" / "x.1.json", json.dumps({"title": "T", "genre_tags": ["r"], "other": 1}))
    write(tmp_path / "a" / "y.json", json.dumps({"description": ["one", "two"]}))
    write(tmp_path / "a" / "y.source.json", json.dumps({"ytid": "abc"}))
    rows = sidecars.read_sidecars(spark, root)
    got = {r["stem"]: r for r in rows.collect()}
    assert set(got) == {f"{root}/a/x.1", f"{root}/a/y"} and got[f"{root}/a/x.1"]["genre_tags"] == ["r"]
    sounds = rows.select("stem", sidecars.sound_descriptions(F.col("raw")).alias("d")).collect()
    assert {r["stem"][-1]: r["d"] for r in sounds} == {"1": None, "y": ["one", "two"]}
    files = spark.createDataFrame([(f"{root}/a/x.1.wav", "g"), (f"{root}/a/z.wav", "h")], "path string, genre string")
    joined = {r["genre"]: r for r in joins.attach_sidecar(files, rows).collect()}
    assert joined["g"]["title"] == "T" and joined["g"]["artist"] == "unknown" and joined["g"]["has_sidecar"]
    assert joined["h"]["title"] is None and joined["h"]["name"] is None


def test_small_readers(spark, tmp_path):
    write(tmp_path / "s" / "1" / "a.json", json.dumps({"id": "a", "path": "p", "epoch": 1, "duration": 2.0,
          "prompt": {"id": "q", "path": "pp", "duration": 1.0}, "conditioning": {"d": "x"}}))
    sample = sidecars.read_samples(spark, str(tmp_path / "s")).first()
    assert sample["prompt"]["id"] == "q" and sample["conditioning"] == {"d": "x"} and sample["reference"] is None

    write(tmp_path / "c" / "t1.x.json", json.dumps([["C", 0.5], ["D", 1.5]]))
    assert sorted(map(tuple, sidecars.read_chords(spark, str(tmp_path / "c")).collect())) == [("t1", 0, 0.5, "C"), ("t1", 1, 1.5, "D")]

    path = str(tmp_path / "p.json.gz")
    with gzip.open(path, "wt") as f:
        json.dump({"a.json": ["x", "y"], "b.json": []}, f)
    assert {r["info_path"]: r["texts"] for r in sidecars.read_paraphrases(spark, path).collect()} == {"a.json": ["x", "y"], "b.json": []}

    write(tmp_path / "r" / "u.json", json.dumps({"user": "u", "seed": 3, "blind": True, "results": [
        {"id": "i", "is_prompted": False, "models": {"m1": 4, "m2": 2}}]}, indent=1))
    write(tmp_path / "r" / "notes.txt", "no json")
    assert sorted(map(tuple, sidecars.read_ratings(spark, str(tmp_path / "r")).collect())) == [("u", 3, "i", "m1", 4), ("u", 3, "i", "m2", 2)]

    write(tmp_path / "h" / "run1" / "history.json", json.dumps([
        {"train": {"loss": 2, "text": "x", "ok": True}, "epoch": 1, "other": {"z": 1}}, "skip", {"valid": {"loss": 1.5}, "train": 3}]))
    got = sorted(map(tuple, sidecars.read_history(spark, str(tmp_path / "h")).na.fill("", ["stage"]).collect()))
    assert got == [("run1", 1, "", "epoch", 1.0), ("run1", 1, "train", "loss", 2.0), ("run1", 1, "train", "ok", 1.0), ("run1", 3, "valid", "loss", 1.5)]

    prompts = write(tmp_path / "prompts.json", json.dumps([{"genre_tags": ["a", "b"], "description": " d ", "vocal_presence": ""}]))
    assert sidecars.read_prompts(spark, prompts).first()["prompt"] == "description: d. genre_tags: a, b"


def test_scan_and_read(spark, tmp_path):
    root = str(tmp_path)
    rng = np.random.default_rng(0)
    mono, stereo = rng.integers(-9000, 9000, (40, 1)), rng.integers(-9000, 9000, (33, 2))
    wave_file(tmp_path / "b" / "mono.WAV", mono)
    wave_file(tmp_path / "a.wav", stereo)
    write(tmp_path / "bad.wav", "no wave")
    write(tmp_path / "note.txt", "x")
    good, bad = wav.scan_corpus(spark, root, minimal=False)
    rows = good.collect()
    assert [r["path"] for r in rows] == [f"{root}/a.wav", f"{root}/b/mono.WAV"]
    assert rows[0]["duration"] == 33 / 16000 and abs(rows[1]["amplitude"] - np.abs(mono).max() / 2**15) < 1e-12
    assert [r["source_file"] for r in bad.collect()] == [f"{root}/bad.wav"]
    chunks = wav.read_signal(spark, root, 0.001, 16000)
    assert chunks.filter("error is not null").count() == 1
    long = signal.to_long(chunks.filter("error is null"))
    got = {(r["clip_id"], r["channel"], r["t"]): r["x"] for r in long.collect()}
    assert len(got) == 40 + 66
    assert got[(f"{root}/a.wav", 1, 32)] == stereo[32, 1] / 2**15
    part = spark.createDataFrame([(f"{root}/a.wav", 30 / 16000, 10 / 16000, True)], "path string, seek_time double, duration double, pad boolean")
    cut = signal.to_long(wav.read_signal(spark, root, 0.001, 16000, part)).filter("channel = 0").orderBy("t").collect()
    assert [r["x"] for r in cut] == [v / 2**15 for v in stereo[30:, 0]] + [0.0] * 7


def test_many_segments_of_a_file(spark, tmp_path, monkeypatch):
    """Lists of a bounded length: numbers go by time, whatever the order of the rows, and every segment is read."""
    monkeypatch.setattr(wav, "SEGMENTS", 7)
    codes = np.random.default_rng(9).integers(-9000, 9000, (3000, 1))
    wave_file(tmp_path / "a.wav", codes)
    starts = np.random.default_rng(3).permutation(50) * 59
    rows = [(f"{tmp_path}/a.wav", s / 16000 + 1e-9, 20 / 16000 + 1e-9) for s in starts.tolist()]
    segments = spark.createDataFrame(rows, "path string, seek_time double, duration double")
    got = wav.read_signal(spark, str(tmp_path), 100 / 16000, 16000, segments).collect()
    assert {r["segment"]: (np.array(r["samples"]) * 2**15).astype(int).tolist() for r in got} == {
        i: codes[i * 59 : i * 59 + 20, 0].tolist() for i in range(50)
    }


def test_written_pcm_reads_back(spark, tmp_path):
    x = spark.createDataFrame([("c", 0, 0, 0, [0.5, -2.0]), ("c", 0, 1, 2, [0.25])], "clip_id string, channel int, chunk_idx int, start_frame bigint, samples array<double>")
    out = str(tmp_path / "pcm")
    made = wav.write_pcm(x, out, 8000, "clip").first()
    assert (made["clip_id"], made["path"], made["bytes"]) == ("c", f"{out}/c.wav", 44 + 6)
    back = wav.read_signal(spark, out, 10 / 8000, 8000).first()
    assert back["sample_rate"] == 8000
    limit = round(10 ** (-1 / 20) * 2**15) / 2**15
    assert back["samples"] == [0.5, -limit, 0.25]


def odd_names(root):
    names = ["a.wav", "b c.WAV", "p%20q#?.wav", "[é]{\u3000}.wav", "k=1/x.wav", "d/e/f.wav", "d/u.zip", "U.ZIP", "note.txt"]
    names += [".a.wav", "_a.wav", "_k=v.wav", "_metadata.wav", "w.wav._COPYING_", ".h/x.wav", "_h/x.wav", "_metadata/x.wav"]
    for name in names:
        write(root / name, name)
    (root / "none.wav").write_bytes(b"")
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "d")
    (root / "dead.wav").symlink_to(root / "nowhere")


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_listing_by_tasks(spark, tmp_path, monkeypatch, limit):
    """The same files as Spark's index, in one round or in many."""
    monkeypatch.setattr(files, "ENTRIES", limit)
    odd_names(tmp_path / "in")
    columns = ["path", "modificationTime", "length", "content"]
    for root in ("in", "in/*", "in/{d,d/e}", "in/a.wav", "in/none.wav", "in/_h", "in/empty"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / root))
        want = sorted(plain.withColumn("path", files.file_path()).collect())
        got = files.list_files(spark, str(tmp_path / root)).select(columns)
        assert got.dtypes == plain.dtypes and sorted(got.collect()) == want, root
    for pattern in ("*.zip", "*.{zip,ZIP}", "[a-d]*", "b c?WAV"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        want = sorted(r[0] for r in plain.load(str(tmp_path / "in")).select(files.file_path()).collect())
        got = files.list_files(spark, str(tmp_path / "in")).filter(files.name_matches(spark, pattern))
        assert sorted(r["path"] for r in got.collect()) == want and want, pattern


def test_missing_folder(spark, tmp_path):
    for name in ("none", "none*"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files.list_files(spark, str(tmp_path / name))


def test_no_file_index_on_the_driver(spark, tmp_path):
    """However many files, the driver holds no names and a few tasks read them."""
    for i in range(200):
        wave_file(f"{tmp_path}/in/{i % 2}/{i}.wav", np.full((2, 1), i))
    root = str(tmp_path / "in")
    for listed in (wav.list_audio(spark, root).select("path"), wav.audio_files(spark, root), archives.list_members(spark, root)):
        assert not [f for f in listed.inputFiles() if f.endswith(".wav")]
    assert wav.list_audio(spark, root).select("path").rdd.getNumPartitions() == 4
    assert wav.read_signal(spark, root, 1.0, 16000).count() == 200


def test_walk_of_another_store(tmp_path, monkeypatch):
    from urllib.parse import unquote

    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    odd_names(tmp_path)
    write(tmp_path / "s p" / "x.wav", "x")
    here = sorted(files._walk(str(tmp_path), 10_000))
    asked = []

    def store_of(path):
        asked.append(path)
        return SubTreeFileSystem(str(tmp_path), LocalFileSystem()), unquote(path.removeprefix("far://host"))

    monkeypatch.setattr(files, "store_of", store_of)
    far = sorted(files._walk("far://host", 10_000))
    assert [(r[0].removeprefix("far://host"), *r[2:]) for r in far] == [
        (r[0].removeprefix(str(tmp_path)), *r[2:]) for r in here
    ]
    assert "far://host/s%20p" in asked


def test_conversion_resumes(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, channels in (("a", 1), ("b", 3), ("c", 2)):
        wave_file(f"{root}/{name}.wav", np.full((20, channels), 100))
    write(tmp_path / "in" / "d.wav", "x")
    files = wav.list_audio(spark, root).select("path").withColumn(
        "channels", F.when(F.col("path").endswith("b.wav"), 3).when(F.col("path").endswith("c.wav"), 2).otherwise(1)
    ).withColumn("sidecar", F.lit("{}"))
    outside = files.limit(1).withColumn("path", F.lit("/else/e.wav"))
    target, done, failed = (str(tmp_path / n) for n in ("target", "done", "failed"))
    for _ in range(2):
        convert_corpus(files.unionByName(outside), root, out, target, done, failures=failed)
    rows = converted_files(spark, target).collect()
    assert sorted(r["out_path"] for r in rows) == [f"{out}/{n}.wav" for n in "abc"]
    assert all(r["sidecar"] == "{}" and r["bytes"] == os.path.getsize(r["out_path"]) for r in rows)
    made = {n: (tmp_path / "out" / f"{n}.wav").read_bytes() for n in "abc"}
    assert {n: wav.pcm_layout(c)["channels"] for n, c in made.items()} == {"a": 1, "b": 2, "c": 2}
    assert sorted(os.listdir(out)) == ["a.wav", "b.wav", "c.wav"]
    assert spark.read.parquet(done).count() == 3
    assert {r["path"] for r in spark.read.json(failed).collect()} == {f"{root}/d.wav", "/else/e.wav"}


def test_shared_folder_named_by_a_uri(spark, tmp_path, monkeypatch):
    from tonewell.plans import catalog_jobs

    rows = [(i, [i / 100.0, 0.5], i % 4) for i in range(8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(catalog_jobs, "scratch_path", lambda spark, label: f"file://{tmp_path}/{label}")
    got = catalog_jobs.converted_corpus(spark, str(tmp_path)).collect()
    assert {r["out_path"] for r in got} == {f"/out/{i % 4}/{i}.wav" for i in range(8) if i % 4 != 3}
    assert len(got) == 6 * 2 * 2 and sum(r["x"] for r in got if r["t"] == 1) == 6 * 0.25


def test_conversion_in_slices(spark, tmp_path, monkeypatch):
    """Whole files from slices: 32 bits with and without overflow, means, copies, too few channels."""
    monkeypatch.setattr(wav, "MAX_VALUES", 8 * 100)
    rng = np.random.default_rng(4)

    def converted(codes, bits, wanted):
        raw = codes.astype("<i4" if bits == 32 else "<i2")
        block = bits // 8 * codes.shape[1]
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + raw.nbytes, b"WAVE", b"fmt ", 16, 1, codes.shape[1], 8000, 8000 * block, block, bits, b"data", raw.nbytes)
        path = tmp_path / f"{bits}-{wanted}-{codes.shape}.wav"
        path.write_bytes(head + raw.tobytes())
        with wav.Ranges(str(path)) as source:
            out = b"".join(wav._converted(source, wanted))
        layout = wav.pcm_layout(out)
        assert len(out) == 44 + layout["size"] and layout["rate"] == 8000
        return np.rint(wav._samples(out, layout) * 2**15).astype(int)

    small = rng.integers(-9000, 9000, (1234, 2))
    assert np.array_equal(converted(small, 16, 2), small)
    assert np.array_equal(converted(small, 16, None), small)
    assert np.array_equal(converted(small, 16, 1)[:, 0], np.rint(small.mean(1)))
    mono = small[:, :1]
    assert np.array_equal(converted(mono, 16, 2), np.repeat(mono, 2, 1))
    wide = rng.integers(-(2**30), 2**30, (1234, 3))
    assert np.array_equal(converted(wide, 32, 2), np.rint(wide[:, :2] / 2**16).astype(int))
    wide[700, 1] = 2**31 - 1
    assert np.array_equal(converted(wide, 32, 2), np.rint(wide[:, :2] / 2**31 * (2**15 - 1)).astype(int))
    with pytest.raises(ValueError, match="fewer channels"):
        converted(small, 16, 3)


def test_header_of_more_than_4_gb():
    head = wav._header(2**31, 1, 8000)
    layout = wav.pcm_layout(head, len(head) + 2**32)
    assert layout["size"] == 2**32 and layout["first"] == len(head)


def test_cache_computes_only_misses(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(keys):
        asked.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("embedding", F.array(F.length("path").cast("double")))

    keys = spark.createDataFrame([("a",), ("bb",), ("a",)], "path string")
    assert caches.embedding_cache(keys, compute, path).count() == 3
    more = spark.createDataFrame([("bb",), ("ccc",)], "path string")
    got = {r["path"]: r["embedding"] for r in caches.embedding_cache(more, compute, path).collect()}
    assert asked == [["a", "bb"], ["ccc"]] and got == {"bb": [2.0], "ccc": [3.0]}


def test_resources_are_opened_once_per_worker(spark, tmp_path):
    """Several tasks and calls, one opening per worker process; bad keys are rows, also alone in a batch."""
    log = str(tmp_path / "opened")

    class Costly:
        def __init__(self):
            with open(log, "a") as f:
                f.write(f"{os.getpid()}\n")

        def vectors(self, keys):
            if "bad" in keys:
                raise KeyError("bad")
            return [[float(len(k)), float(os.getpid())] for k in keys]

    compute = embed_with(Costly, lambda r, keys: r.vectors(keys), batch_rows=4)
    keys = spark.createDataFrame([(f"k{'x' * (i % 5)}{i}",) for i in range(60)] + [("bad",)], "path string").repartition(6)
    path, failed = str(tmp_path / "cache"), str(tmp_path / "failed")
    for _ in range(2):
        got = {r["path"]: r["embedding"] for r in caches.embedding_cache(keys, compute, path, failures=failed).collect()}
        assert len(got) == 60 and all(v[0] == len(k) for k, v in got.items())
    with open(log) as f:
        opened = f.read().split()
    assert len(opened) == len(set(opened)) and {str(int(v[1])) for v in got.values()} <= set(opened)
    # the bad key is not kept, so both calls tried it
    assert [(r["source_file"], r["error"]) for r in spark.read.json(failed).collect()] == [("bad", "KeyError: 'bad'")] * 2


def test_short_answers_are_failures(spark):
    compute = embed_with(dict, lambda r, keys: [[1.0]] if len(keys) == 1 and keys[0] != "b" else [], batch_rows=3)
    rows = compute(spark.createDataFrame([("a",), ("b",), ("c",)], "path string").coalesce(1)).collect()
    assert [(r["path"], r["embedding"], r["error"] is None) for r in rows] == [("a", [1.0], True), ("b", None, False), ("c", [1.0], True)]


def test_batches(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.range(30).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    caches.write_batches(rows, path, 1, 10)
    got = caches.read_batches(spark, path, 1).collect()
    assert sorted((r["update"], r["item"], r["pos"]) for r in got) == [(i // 10, i % 10, i) for i in range(30)]
    with pytest.raises(ValueError):
        caches.read_batches(spark, path, 1, min_length=4)
    caches.write_batches(rows.filter("pos < 10 OR pos >= 20"), path, 2, 10)
    with pytest.raises(ValueError):
        caches.read_batches(spark, path, 2)


def test_failures_are_appended(spark, tmp_path):
    path = str(tmp_path / "f")
    for i in range(2):
        manifests.write_failures(spark.createDataFrame([(f"a{i}", "bad"), ("ok", None)], "source_file string, error string"), path)
    assert sorted(r["source_file"] for r in spark.read.json(path).collect()) == ["a0", "a1"]


def test_long_heads_and_slices(spark, tmp_path, monkeypatch):
    """A data chunk behind a long list chunk, and a signal read in several slices."""
    codes = np.random.default_rng(1).integers(-9000, 9000, (5000, 2))
    plain = wav._encode(codes, 16000)
    listed = plain[:36] + b"LIST" + (200_000).to_bytes(4, "little") + b"x" * 200_000 + plain[36:]
    (tmp_path / "long.wav").write_bytes(listed)
    monkeypatch.setattr(wav, "MAX_VALUES", 8 * 700)
    head = wav.head_of(str(tmp_path / "long.wav"), len(listed))
    assert head["channels"] == 2 and head["size"] == 20000
    assert wav._peak(str(tmp_path / "long.wav"), head) == np.abs(codes).max() / 2**15
    part = {"seek_time": 100 / 16000, "duration": 4950 / 16000, "pad": True}
    rows = list(wav._ranged(str(tmp_path / "long.wav"), len(listed), part, 64))
    left = np.concatenate([r[4] for r in rows if r[1] == 1])
    assert np.allclose(left, np.r_[codes[100:, 1] / 2**15, np.zeros(50)]) and len(left) == 4950
    assert [r[3] for r in rows if r[1] == 0] == list(range(0, 4950, 64))


def test_stereo_files_are_streamed(spark, tmp_path):
    rng = np.random.default_rng(2)
    clips = {c: rng.integers(-9000, 9000, (n, 2)) for c, n in (("a", 50), ("b", 7), ("c", 33))}
    rows = [(c, ch, i, x[i * 8 : i * 8 + 8, ch].tolist()) for c, x in clips.items() for i in range(-(-len(x) // 8)) for ch in range(2)]
    df = spark.createDataFrame(rows, "clip_id string, channel int, chunk_idx int, samples array<int>").repartition(5)
    assert wav.write_wav_files(df, str(tmp_path / "w"), 8000).count() == 3
    for c, x in clips.items():
        head = wav.pcm_layout(content := (tmp_path / "w" / f"{c}.wav").read_bytes())
        assert np.array_equal(wav._samples(content, head) * 2**15, x)


def test_digests_of_clips(spark):
    rng = np.random.default_rng(3)
    clips = {c: rng.normal(size=(n, ch)).astype(np.float32) for c, n, ch in (("a", 50, 2), ("b", 7, 1), ("c", 33, 2))}
    rows = [
        (c, ch, i, x[i * 8 : i * 8 + 8, ch].astype(float).tolist())
        for c, x in clips.items() for i in range(-(-len(x) // 8)) for ch in range(x.shape[1])
    ]
    df = spark.createDataFrame(rows, "clip_id string, channel int, chunk_idx int, samples array<double>").repartition(3)
    want = {c: hashlib.sha1(x.sum(1, dtype=np.float32).tobytes()).hexdigest() for c, x in clips.items()}
    assert {r["clip_id"]: r["digest"] for r in wav.clip_digests(df).collect()} == want
