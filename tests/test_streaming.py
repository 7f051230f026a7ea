import numpy as np
from pyspark.sql import functions as F

from tonewell.plans import catalog_jobs
from tonewell.session import cut_lineage, scratch_path, shared_folder
from tonewell.streaming import jobs
from tonewell.streaming.stateful import ChunkWindows, chunk_windows


def appended(spark, rows, schema, key, parts, files=2):
    """Several files per part, oldest part first, the rows of a part in no order."""
    folder = scratch_path(spark, "stream")
    df = spark.createDataFrame(rows, schema)
    for part in parts:
        df.filter(F.col(key) == part).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(folder), df


def test_windows_over_chunks(spark):
    rng = np.random.default_rng(0)
    lengths = {1: 37, 2: 8, 3: 3, 4: 24}
    clips = {c: rng.normal(size=n) for c, n in lengths.items()}
    rows = []
    for c, x in clips.items():
        starts = list(range(0, len(x), 8))
        for i, s in enumerate(starts):
            rows.append((c, i, [float(v) for v in x[s : s + 8]], i == len(starts) - 1))
    stream, _ = appended(spark, rows, "clip_id bigint, chunk_idx int, samples array<double>, is_last boolean", "chunk_idx", [3, 0, 4, 2, 1])
    target = scratch_path(spark, "windows")
    jobs.run_available(
        chunk_windows(stream, 8, 4), lambda b, i: b.write.mode("overwrite").parquet(f"{target}/batch={i}"), scratch_path(spark, "c")
    )
    got = {}
    for r in spark.read.parquet(target).orderBy("frame").collect():
        got.setdefault(r["clip_id"], []).append(r["values"])
    for c, x in clips.items():
        count = max(0, -(-(len(x) - 8) // 4)) + 1
        padded = np.pad(x, (0, max(0, (count - 1) * 4 + 8 - len(x))))
        assert np.allclose(got[c], [padded[f * 4 : f * 4 + 8] for f in range(count)]), c


def test_chunks_in_turn_never_enter_the_state():
    """One clip in two batches: chunks 0, 1 and 3, then 2 and the last one, 4; chunk 3 alone has to wait."""

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

        def clear(self):
            self.kept = None

    class Waiting(dict):
        added = []

        def exists(self):
            return bool(self)

        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self.added.append(key)
            self[key] = value

        def removeKey(self, key):
            self.pop(key, None)

    windows = ChunkWindows(4, 2)
    windows.state, windows.waiting = Value(), Waiting()
    first, second = [[{"chunk_idx": i, "samples": [2.0 * i, 2.0 * i + 1], "is_last": i == 4} for i in part] for part in ([1, 3, 0], [4, 2])]
    got = [*windows.handleInputRows((7,), iter(first), None)]
    assert windows.waiting.added == [(3,)] and [r["frame"] for r in got] == [0]
    got += windows.handleInputRows((7,), iter(second), None)
    assert [(r["clip_id"], r["frame"], r["values"]) for r in got] == [(7, f, [2.0 * f + i for i in range(4)]) for f in range(4)]
    assert windows.waiting.added == [(3,)] and not windows.waiting and windows.state.kept is None


def walked(values, decay, unbias):
    state, count = None, 0.0
    for v in values:
        if unbias:
            count = count * decay + 1
            w = 1 / count
        else:
            w = 1 - decay
        state = v if state is None else state * (1 - w) + v * w
    return state


def test_average_state(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else "cold", float(i), float(rng.normal()), i // 40) for i in range(200)]
    stream, df = appended(spark, rows, "name string, t double, v double, part int", "part", range(5))
    folder, check = scratch_path(spark, "ema"), scratch_path(spark, "c")
    assert jobs.ema_state(stream, folder, check, "name", "t", "v", 0.9, 80.0, width=15.0, partitions=2) == 0
    newest = jobs.finished_ema(spark, folder, check, "name", 0.9)
    # blocks that are over have left the state, the others wait in it
    closed = {r["block"] for r in spark.read.parquet(folder).collect()}
    waiting = {r["block"] for r in jobs.waiting_sums(spark, check, "name", 0.9).collect()}
    assert closed and waiting and max(closed) < min(waiting) and closed | waiting == set(range(14))
    for unbias in (True, False):
        got = {r["name"]: r["ema"] for r in jobs.ema_value(newest, "name", 0.9, unbias).collect()}
        for name in ("hot", "cold"):
            expected = walked([r[2] for r in rows if r[0] == name], 0.9, unbias)
            assert abs(got[name] - expected) < 1e-9


def test_average_goes_on_and_counts_late_rows(spark):
    """A second run takes up the state; ties stand by value; a row behind the watermark is counted, not merged."""
    folder, check = scratch_path(spark, "ema"), scratch_path(spark, "c")
    source = scratch_path(spark, "stream")
    first = [("a", float(t % 20), float(t), 0) for t in range(30)] + [("a", None, 1.0, 0), ("a", 1.0, None, 0)]
    second = [("a", 2.0, 99.0, 1), ("a", 30.0, -1.0, 1), ("b", 31.0, 5.0, 1)]
    for rows in (first, second):
        df = spark.createDataFrame(rows, "name string, t double, v double, part int")
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        late = jobs.ema_state(stream, folder, check, "name", "t", "v", 0.9, 5.0, width=4.0, partitions=2)
        assert late == (0 if rows is first else 1)
    kept = sorted((t, v) for n, t, v, _ in first + second[1:] if n == "a" and t is not None and v is not None)
    newest = jobs.finished_ema(spark, folder, check, "name", 0.9)
    got = {r["name"]: (r["n"], r["ema"]) for r in jobs.ema_value(newest, "name", 0.9).collect()}
    assert got["b"] == (1, 5.0) and got["a"][0] == len(kept)
    assert abs(got["a"][1] - walked([v for _, v in kept], 0.9, True)) < 1e-9


def test_second_run_adds_nothing(spark):
    rows = [("a", 1.0, 0), ("b", 2.0, 1), ("a", 3.0, 1)]
    stream, _ = appended(spark, rows, "metric string, value double, part int", "part", range(2))
    target, check = scratch_path(spark, "m"), scratch_path(spark, "c")
    for _ in range(2):
        jobs.running_metrics(stream, target, check)
        got = {r["metric"]: (r["mean"], r["weight"]) for r in jobs.latest_by_batch(spark, target, "metric").collect()}
        assert got == {"a": (2.0, 2), "b": (2.0, 1)}


def test_shared_folder_and_lineage(spark):
    assert shared_folder(spark) == shared_folder(spark)
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert cut_lineage(df).filter("x > 10").count() == 4


def test_captions_are_written_by_every_core(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(["word"] * (i + 1)), "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog_jobs, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 6))
    got = {r["doc_id"]: (r["words"], r["valid"]) for r in catalog_jobs.enriched_stream(spark, str(tmp_path)).collect()}
    assert got == {i: (i + 1, True) if i >= 7 else (None, False) for i in range(60)}
    assert len([*(tmp_path / "captions").glob("part-*.parquet")]) == 6
