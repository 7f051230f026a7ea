"""Members of ZIP archives against the archives that the standard library writes."""

import io
import json
import zipfile

import numpy as np
import pytest

from tests.test_sources import wave_file
from tonewell.operators import signal
from tonewell.sources import archives, sidecars, wav
from tonewell.sources.files import Ranges


def packed(path, entries, comment=b"", prefix=b""):
    """``entries``: (name, content, method)."""
    raw = io.BytesIO()
    raw.write(prefix)
    with zipfile.ZipFile(raw, "a" if prefix else "w") as z:
        for name, content, method in entries:
            z.writestr(name, content, method)
        z.comment = comment
    path.write_bytes(raw.getvalue())
    return str(path)


def listed(path):
    with Ranges(path) as source:
        return list(archives.members(source))


def contents(path):
    out = {}
    for name, place, size, full, method, crc, error in listed(path):
        assert error is None
        with archives.Member(path, place, size, full, method, crc) as member:
            out[name] = member.read(0, member.size)
    return out


RNG = np.random.default_rng(0)
NOISE, TEXT = RNG.bytes(3_000_000), b"line of text\n" * 200_000
ENTRIES = [
    ("a/one.bin", NOISE, zipfile.ZIP_STORED), ("a/two.txt", TEXT, zipfile.ZIP_DEFLATED), ("three.txt", TEXT, zipfile.ZIP_BZIP2),
    ("empty", b"", zipfile.ZIP_DEFLATED), ("ünï/漢字.bin", NOISE[:1000], zipfile.ZIP_DEFLATED), ("noise.z", NOISE, zipfile.ZIP_DEFLATED),
]


@pytest.mark.parametrize("comment", [b"", b"a comment", b"PK\x05\x06" + bytes(30), b"x" * 65535])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n" * 100])
def test_all_members(tmp_path, comment, prefix):
    path = packed(tmp_path / "a.zip", ENTRIES, comment, prefix)
    assert contents(path) == {name: content for name, content, _ in ENTRIES}


def test_wide_sizes(tmp_path, monkeypatch):
    """Every record in its 64-bit form."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = packed(tmp_path / "wide.zip", ENTRIES)
    assert archives.END64 in (tmp_path / "wide.zip").read_bytes()
    assert contents(path) == {name: content for name, content, _ in ENTRIES}


def test_directory_in_slices(tmp_path, monkeypatch):
    many = [(f"dir/{i:05d}.txt", str(i).encode(), zipfile.ZIP_STORED) for i in range(30_000)]
    path = packed(tmp_path / "many.zip", many)
    monkeypatch.setattr(archives, "SLICE", 1000)
    assert [m[0] for m in listed(path)] == [name for name, _, _ in many]


@pytest.mark.parametrize("name", ["a/one.bin", "a/two.txt", "three.txt", "noise.z"])
def test_ranges(tmp_path, name):
    """Any range, forwards and backwards, equals the slice of the content."""
    path = packed(tmp_path / "a.zip", ENTRIES)
    want = {n: c for n, c, _ in ENTRIES}[name]
    entry = next(m for m in listed(path) if m[0] == name)
    with archives.Member(path, *entry[1:6]) as member:
        for first, size in ((0, 10), (100, 5), (50, 7), (1_500_000, 1_200_000), (len(want) - 3, 10), (len(want), 5), (len(want) + 9, 1), (0, 1)):
            assert member.read(first, size) == want[first : first + size]


def test_damage(tmp_path):
    path = packed(tmp_path / "a.zip", [("x.txt", TEXT, zipfile.ZIP_DEFLATED)])
    _, place, size, full, method, crc, _ = listed(path)[0]
    with archives.Member(path, place, size, full, method, crc ^ 1) as member, pytest.raises(ValueError, match="checksum"):
        member.read(0, full)
    with archives.Member(path, place, size // 2, full, method, crc) as member, pytest.raises(ValueError, match="cut off"):
        member.read(0, full)
    with pytest.raises(ValueError, match="no ZIP member"):
        archives.Member(path, place + 1, size, full, method, crc)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="not a ZIP"):
        listed(str(tmp_path / "b.zip"))
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(raw[-60:])
    with pytest.raises(ValueError, match="outside"):
        listed(str(tmp_path / "c.zip"))


def test_listing(spark, tmp_path):
    """Unreadable archives and members are rows with an error; folders are no members."""
    packed(tmp_path / "good.zip", [("d/", b"", 0), ("d/x.wav", b"1", 0), ("d/y.WAV", b"2", 8), ("d/z.json", b"{}", 8)])
    packed(tmp_path / "other.zip", [("l.wav", b"1" * 100, zipfile.ZIP_LZMA)])
    packed(tmp_path / "none.zip", [])
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in archives.list_members(spark, str(tmp_path), (".wav",)).collect()}
    assert set(rows) == {"good.zip:d/x.wav", "good.zip:d/y.WAV", "other.zip:l.wav", "bad.zip"}
    assert rows["good.zip:d/x.wav"]["length"] == 1 and rows["good.zip:d/x.wav"]["error"] is None
    assert rows["bad.zip"]["error"] == "not a ZIP archive" and "method" in rows["other.zip:l.wav"]["error"]
    assert archives.list_members(spark, str(tmp_path)).filter("path LIKE '%none.zip%'").count() == 0


def test_segments_of_members(spark, tmp_path):
    """Members beside a plain file: the same chunks whichever way a clip is kept."""
    codes = np.random.default_rng(1).integers(-9000, 9000, (4000, 2))
    wave_file(tmp_path / "plain.wav", codes)
    raw = (tmp_path / "plain.wav").read_bytes()
    packed(tmp_path / "a.zip", [(f"in/{m}.wav", raw, m) for m in (0, 8, 12)] + [("in/bad.wav", b"RIFF", 8)])
    paths = [f"{tmp_path}/plain.wav", *(f"{tmp_path}/a.zip:in/{m}.wav" for m in (0, 8, 12))]
    times = [(3000, 700), (0, 100), (50, 30), (3990, 50)]
    rows = [(p, a / 16000, n / 16000, True) for p in paths for a, n in times]
    segments = spark.createDataFrame(rows, "path string, seek_time double, duration double, pad boolean")
    got = wav.read_signal(spark, str(tmp_path), 64 / 16000, 16000, segments).collect()
    by_path = {p: sorted((r["segment"], r["channel"], r["start_frame"], tuple(r["samples"])) for r in got if r["clip_id"] == p) for p in paths}
    assert all(by_path[p] == by_path[paths[0]] for p in paths) and by_path[paths[0]]
    ordered = np.array([x for s, c, _, v in by_path[paths[1]] if (s, c) == (2, 1) for x in v])
    assert np.array_equal(ordered * 2**15, codes[3000:3700, 1])

    whole = wav.read_signal(spark, str(tmp_path), 0.01, 16000)
    assert [r["clip_id"] for r in whole.filter("error IS NOT NULL").collect()] == [f"{tmp_path}/a.zip:in/bad.wav"]
    assert signal.to_long(whole.filter("error IS NULL")).count() == 4 * 8000


def test_scan_of_members(spark, tmp_path):
    wave_file(tmp_path / "w.wav", np.full((800, 1), 1 << 14))
    raw = (tmp_path / "w.wav").read_bytes()
    packed(tmp_path / "a.zip", [("x.wav", raw, 8), ("y.txt", b"", 8), ("z.flac", b"none", 0)])
    good, bad = wav.scan_corpus(spark, str(tmp_path), minimal=False)
    assert [(r["path"], r["duration"], r["amplitude"]) for r in good.collect()] == [
        (f"{tmp_path}/a.zip:x.wav", 0.05, 0.5), (f"{tmp_path}/w.wav", 0.05, 0.5)
    ]
    assert [r["source_file"] for r in bad.collect()] == [f"{tmp_path}/a.zip:z.flac"]


def test_sidecars_in_archives(spark, tmp_path):
    packed(tmp_path / "a.zip", [("i/x.json", json.dumps({"title": "T"}).encode(), 8), ("i/bad.json", b"\xff\xfe", 8)])
    texts = archives.read_members(archives.list_members(spark, str(tmp_path), (".json",)))
    assert texts.filter("error IS NOT NULL").count() == 1
    rows = sidecars.read_sidecars(spark, str(tmp_path), archived=texts).collect()
    assert [(r["stem"], r["title"]) for r in rows] == [(f"{tmp_path}/a.zip:i/x", "T")]
