from collections import Counter

from tests.llm import tables
from tonewell.llm import token_rollup
from tonewell.llm.common import Tokenizers
from tonewell.session import scratch_path

CHANGE = "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_corpus_against_brute_force(spark):
    tok = Tokenizers()
    first = {}
    for i, text, *_ in tables.rows():
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    want = Counter()
    docs = Counter()
    for i, text, lang, source, *_ in tables.rows():
        text = text or ""
        if first.get(text) != i:
            continue
        for version, file in token_rollup.VERSIONS.items():
            once = "\n".join(dict.fromkeys(text.split("\n")))
            want[(source, lang, version)] += len(tok.ranks(file).encode_ordinary(once))
            docs[(source, lang, version)] += 1
    out = token_rollup.corpus_rollup(spark, tables.docs(spark))
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in out.collect()}
    assert got == {k: (docs[k], want[k]) for k in docs}
    assert token_rollup.corpus_rollup(spark, tables.empty(spark)).collect() == []


def test_batches_are_idempotent(spark):
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    load = spark.createDataFrame([("a", "en", "v", None, 10), ("a", "en", "v", None, 5), (None, None, "v", None, 7)], CHANGE)
    change = spark.createDataFrame([("a", "en", "v", 5, None), (None, None, "v", 7, 9), ("b", "en", "v", None, None)], CHANGE)
    assert rollup.commit(1, load) and rollup.commit(2, change)
    want = {("a", "en", "v"): (1, 10), (None, None, "v"): (1, 9)}
    assert totals(rollup) == want
    assert not rollup.commit(2, change) and totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and rollup.committed() == [1, 2]
    assert not rollup.commit(1, load) and totals(rollup) == want
    assert rollup.commit(3, change.limit(0)) and totals(rollup) == want
    assert rollup.commit(4, spark.createDataFrame([("a", "en", "v", 10, None)], CHANGE))
    assert totals(rollup) == {(None, None, "v"): (1, 9)}


def test_unfinished_batch_counts_for_nothing(spark):
    folder = scratch_path(spark, "rollup")
    rollup = token_rollup.Rollup(spark, folder)
    half = spark.createDataFrame([("a", "en", "v", 1, 99)], token_rollup.DELTA)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/deltas/7")
    assert rollup.committed() == [] and totals(rollup) == {}
    assert rollup.commit(7, spark.createDataFrame([("a", "en", "v", None, 3)], CHANGE))
    assert totals(rollup) == {("a", "en", "v"): (1, 3)}
