from pyspark.sql import functions as F

from tests.llm import tables, test_minhash, test_packing, test_suffix
from tonewell.llm import pfair
from tonewell.llm.common import documents, text_session

import corpus_pipeline


def test_stages_one_by_one(spark, data, tmp_path):
    docs = documents(spark, data)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name] = (docs, docs := text_session(spark).read.parquet(path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents(spark, data).columns
    assert list(kept) == ["quality_classifier", "near_dedup", "repeat_removal", "source_mixing", "best_fit_packing"]

    before, after = kept["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in documents(spark, data, "labels").collect()}
    stay = {r["doc_id"] for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert stay <= {r["doc_id"] for r in before.collect()}
    assert sum(i in stay for i in good) >= 0.95 * len(good)

    before, after = kept["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == [i for i, _, _, k in sorted(test_minhash.brute(rows, 80)) if k]

    before, after = kept["repeat_removal"]
    want = {r[0]: r[5].decode("utf-8", "ignore") for r in test_suffix.brute([(r["doc_id"], r["text"]) for r in before.collect()])}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = kept["source_mixing"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))

    before, after = kept["best_fit_packing"]
    test_packing.check(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], 1024)
    # the stream of sequences follows the mix: whose files are in its order
    files = before.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    order = [r["doc_id"] for r in files.orderBy("f", "i").collect()]
    slots = {r["doc_id"]: r["slot"] for r in pfair.mix(spark, before).collect()}
    assert [slots[i] for i in order] == sorted(slots.values())
    turns = {(r["doc_id"], r["piece"]): r["sequence_turn"] for r in after.collect()}
    assert turns[order[0], 0] == 0 and len(set(turns.values())) > 1


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_on_odd_tables(spark, data):
    """Nulls, empties, repeats and clashing names; and no rows at all."""
    for docs in (tables.docs(spark), tables.empty(spark)):
        columns, rows = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert out.count() <= rows and (name not in ("repeat_removal", "source_mixing") or out.count() == rows)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
        assert packed.filter("piece = 0").count() == rows
