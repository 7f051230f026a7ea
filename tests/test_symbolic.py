import random

import pytest
from pyspark.sql import functions as F

from tonewell.operators import joins, matching, symbolic

CHORD = "track string, pos bigint, time double, chord string"
SEG = "track string, segment_id int, seek_time double"


def looked_up(chords, seek, fps, segment):
    """Frame symbols by the plain rule: last chord at or before the frame, cut at the end."""
    first = int(seek * fps) + 1
    out = []
    for frame in range(first, int(first + segment * fps)):
        time, current = frame / fps, "N"
        for at, chord in chords:
            if at < seek or (at <= time and at < seek + segment):
                current = chord or "N"
        out.append((frame, current))
    return out


def test_frames_with_edges(spark):
    chords = {
        "a": [(1.0, "C"), (2.0, "D"), (2.0, "E"), (2.5, ""), (3.0, "F"), (4.0, "G")],
        "b": [(9.0, "C")],
        "c": [],
    }
    events = [(t, i, at, ch) for t, rows in chords.items() for i, (at, ch) in enumerate(rows)]
    events.append(("d", 0, 0.1, None))
    segments = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 0.3), ("b", 4, 0.0), ("c", 5, 0.0), ("d", 6, 0.0)]
    table = spark.createDataFrame(events, CHORD)
    vocab = spark.createDataFrame([("C", 0), ("D", 1), ("E", 2), ("F", 3), ("G", 4), ("N", 5), ("UNK", 6)], "chord string, idx int")
    for bucket in (0.5, 100.0):
        out = symbolic.frame_chords(spark.createDataFrame(segments, SEG), table, vocab, 4.0, 2.0, bucket)
        got = {}
        for r in out.collect():
            got.setdefault(r["segment_id"], []).append((r["frame"], r["chord"]))
        for track, seg, seek in segments:
            assert sorted(got[seg]) == looked_up(chords.get(track, []), seek, 4.0, 2.0), (seg, bucket)


def test_frames_random(spark):
    rnd = random.Random(3)
    chords = {t: sorted((round(rnd.random() * 20, 1), rnd.choice("ABC")) for _ in range(40)) for t in "xy"}
    events = [(t, i, at, ch) for t, rows in chords.items() for i, (at, ch) in enumerate(rows)]
    segments = [(rnd.choice("xy"), i, round(rnd.random() * 18, 1)) for i in range(25)]
    vocab = symbolic.build_vocab(spark.createDataFrame(events, CHORD))
    out = symbolic.frame_chords(
        spark.createDataFrame(segments, SEG), spark.createDataFrame(events, CHORD), vocab, 10.0, 2.0, 3.0
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["segment_id"], []).append((r["frame"], r["chord"]))
    for track, seg, seek in segments:
        assert sorted(got[seg]) == looked_up(chords[track], seek, 10.0, 2.0)


def test_vocab_order_and_unknown(spark):
    events = spark.createDataFrame([("b", 0, 0.0, "Z"), ("a", 0, 0.0, "Y"), ("a", 1, 1.0, "X"), ("b", 1, 1.0, "Y")], CHORD)
    vocab = symbolic.build_vocab(events)
    assert {r["chord"]: r["idx"] for r in vocab.collect()} == {"Y": 0, "X": 1, "Z": 2, "UNK": 3}
    rows = spark.createDataFrame([("Y",), ("new",)], "chord string")
    assert {r["chord"]: r["idx"] for r in symbolic.apply_vocab(rows, vocab).collect()} == {"Y": 0, "new": 3}
    with pytest.raises(Exception, match="unknown symbol"):
        symbolic.apply_vocab(rows, vocab, strict=True).collect()


def test_lists_are_cut_in_blocks(spark):
    events = spark.createDataFrame([("a", i, float(i), "C") for i in range(10)], CHORD)
    got = symbolic.group_chords(events, 4.0).orderBy("block").collect()
    assert [len(r["events"]) for r in got] == [4, 4, 2]


def test_melody(spark):
    rows = [("a", 0, 0, 0.5), ("a", 0, 1, 0.5), ("a", 1, 0, 0.0), ("a", 1, 1, 0.0)]
    got = symbolic.melody_one_hot(spark.createDataFrame(rows, "track string, frame int, bin int, value double"), ["track"])
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 1), ("a", 1, 0, 0)]


def test_segment_salience(spark):
    df = spark.createDataFrame([([float(i) for i in range(40)],)], "v array<double>")
    got = df.select(symbolic.segment_salience(F.col("v"), F.lit(1.0), 10, 5.0, 2.0, 12)).first()[0]
    assert got == [10.5 + 2 * i for i in range(10)] + [0.0, 0.0]


def test_null_chords(spark):
    got = spark.range(1).select(symbolic.null_chords(50.0, F.lit(0.11), 194)).first()[0]
    assert got == [194] * 6


def test_chunk_frames_pads(spark):
    frames = spark.createDataFrame([("a", i, i + 1) for i in range(5)], "track string, frame int, value int")
    seg = spark.createDataFrame([("a", 1, 1.5)], SEG)
    got = joins.chunk_frames(seg, frames, 2.0, F.lit(3), min_length=4).orderBy("k").collect()
    assert [r["value"] for r in got] == [4, 5, 0, 0]


def test_chunk_embeddings_keep_empty_windows(spark):
    full = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(4)], "track string, frame int, vector array<double>")
    seg = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 90.0)], SEG)
    got = {r["segment_id"]: r["vector"] for r in joins.chunk_embeddings(seg, full, 0.5, 1.0).collect()}
    assert got == {1: [1.5, 1.0], 2: None}


SAMPLE = "run string, id string, path string, epoch int, prompt struct<id: string>, conditioning map<string,string>"


def samples(spark):
    def row(run, id_, epoch=1, prompt=None, cond=None):
        return (run, id_, f"{run}/{id_}", epoch, prompt, cond)

    rows = [row("A", "1", cond={"d": "x"}), row("A", "2", prompt=("p",)), row("B", "2", prompt=("p",)), row("B", "3", cond={"d": "y"})]
    rows += [row("A", f"noinput_{c}", cond={}) for c in "abc"] + [row("B", f"noinput_{c}") for c in "xy"]
    rows.append(row("B", "9", epoch=4, cond={"d": "z"}))
    return spark.createDataFrame(rows, SAMPLE)


def test_matches(spark):
    early = samples(spark).filter("epoch = 1")
    got = {r["key"]: r["by_run"] for r in matching.match_samples(early, ["A", "B"]).collect()}
    assert got == {
        "2": {"A": "A/2", "B": "B/2"},
        "noinput_0": {"A": "A/noinput_a", "B": "B/noinput_x"},
        "noinput_1": {"A": "A/noinput_b", "B": "B/noinput_y"},
    }
    assert matching.match_unstable(early, ["A", "B", "C"]).count() == 0


def test_sample_filters(spark):
    rows = samples(spark)
    assert {r["id"] for r in matching.filter_samples(rows).collect()} == {"9"}
    assert matching.filter_samples(rows, max_epoch=0).count() == 0
    latest = matching.filter_samples(rows, ["run"], max_epoch=3)
    assert latest.filter("run = 'B'").count() == 4
    assert matching.filter_samples(rows, epoch=1, exclude_conditioned=True, exclude_prompted=True).count() == 5
    assert {r["id"] for r in matching.filter_samples(rows, epoch=1, exclude_unprompted=True).collect()} == {"2"}


def test_run_sets(spark):
    names = spark.createDataFrame([("r1",), ("g",), ("zzz",), ("r1",)], "name string")
    runs = spark.createDataFrame([("r1",), ("r2",)], "name string")
    grids = spark.createDataFrame([("g", "r1"), ("g", "r2")], "name string, run string")
    found, unknown = matching.expand_runs(names, runs, grids)
    assert {r[0] for r in found.collect()} == {"r1", "r2"}
    assert [r[0] for r in unknown.collect()] == ["zzz"]
