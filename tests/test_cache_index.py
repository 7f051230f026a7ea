"""The index of a cache: nothing is missed, few files are opened, compaction keeps all rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tonewell.sources import cache_index, caches
from tonewell.sources.cache_index import SignedFiles


def sig(key):
    return hashlib.sha1(str(key).encode()).hexdigest()


def test_filters_hold_what_was_put_in():
    sigs = [sig(i) for i in range(20_000)]
    made = cache_index.bloom(sigs[:10_000])
    assert cache_index.held(made, sigs[:10_000]).all()
    assert cache_index.held(made, sigs[10_000:]).mean() < 0.002
    assert len(made) == 10_000 * cache_index.BITS // 8
    assert cache_index.held(cache_index.bloom(sigs[:1]), sigs[:1]).all()


def signed(spark, low, high):
    return spark.range(low, high).select(F.sha1(F.col("id").cast("string")).alias("sig"), F.array(F.col("id").cast("double")).alias("embedding"))


def test_few_files_are_opened(spark, tmp_path):
    """A hundred keys of one append among a million in twenty: the others' files stay closed."""
    table = SignedFiles(spark, str(tmp_path / "t"), file_rows=10_000)
    for part in range(20):
        table.append(signed(spark, part * 50_000, (part + 1) * 50_000))
    assert table.index().agg(F.sum("rows"), F.count("*")).first()[0] == 1_000_000
    asked = signed(spark, 350_000, 350_100).select("sig")
    files = table.files_with(asked)
    found = table.read(files).join(asked, "sig")
    all_files = table.index().count()
    assert found.count() == 100 and all_files >= 90
    assert len(table.read(files).inputFiles()) == len(files) <= 8
    assert len(table.files_with(signed(spark, 2_000_000, 2_000_050).select("sig"))) <= 5
    assert table.files_with(asked.limit(0)) == []

    table = SignedFiles(spark, str(tmp_path / "t"), file_rows=50_000)
    table.compact()
    assert table.index().count() <= 20 < all_files and len(table.live()) == 1
    files = table.files_with(asked)
    assert table.read(files).join(asked, "sig").count() == 100
    everything = table.read(table.files_with(signed(spark, 0, 1_000_000).select("sig")))
    assert everything.count() == everything.select("sig").distinct().count() == 1_000_000


def test_changes_count_when_they_are_finished(spark, tmp_path):
    table = SignedFiles(spark, str(tmp_path / "t"), file_rows=100)
    assert table.index() is None and table.files_with(signed(spark, 0, 5)) == []
    table.compact()
    table.append(signed(spark, 0, 250))
    table.append(signed(spark, 0, 0))
    table.append(signed(spark, 200, 300))
    (tmp_path / "t" / "index" / "00000003-add").mkdir()  # broke off before its end
    assert table.changes() == ["00000000-add", "00000001-add", "00000002-add"]
    table.compact()
    table.append(signed(spark, 300, 310))
    table.compact()
    assert table.live() == ["00000005-base"]
    # the changes before the first compaction are gone, what it wrote is still there
    assert table.changes() == ["00000003-base", "00000004-add", "00000005-base"]
    rows = table.read(table.files_with(signed(spark, 0, 400)))
    assert sorted(int(r["embedding"][0]) for r in rows.collect()) == list(range(310))


def test_cache_over_calls(spark, tmp_path):
    """Only what no call has computed is computed, before and after compaction; null and repeated keys."""
    path, asked = str(tmp_path / "c"), []

    def compute(keys):
        asked.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("embedding", F.array(F.col("id").cast("double") * 2))

    def call(*ids):
        rows = caches.embedding_cache(spark.createDataFrame([(i,) for i in ids], "id int"), compute, path, "id", file_rows=3)
        return sorted((r["id"], r["embedding"][0]) for r in rows.collect())

    assert call(1, 2, 2) == [(1, 2.0), (2, 4.0), (2, 4.0)]
    assert call(2, 3, 4, 5, 6, 7) == [(i, 2.0 * i) for i in range(2, 8)]
    caches.compact_cache(spark, path, file_rows=2)
    assert call(*range(1, 10)) == [(i, 2.0 * i) for i in range(1, 10)]
    assert call(9) == [(9, 18.0)] and call() == []
    assert asked == [[1, 2], [3, 4, 5, 6, 7], [8, 9], [], []]
    assert np.unique([len(a) for a in asked]).tolist() == [0, 2, 5]
