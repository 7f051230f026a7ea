"""Token totals by source, language and tokenizer version, maintained by signed batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.llm.common import Tokenizers, id_text, long_ids, written
from tonewell.session import scratch_path

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long"
#: Version name -> rank file of the public vocabulary.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
COUNTS = "doc_id long, source string, lang string, text_key string, tokenizer_version string, tokens long, revised_tokens long"


def count_tokens(docs: DataFrame) -> DataFrame:
    """A row per document and version: its tokens, and those left without its repeated lines (null: none repeats)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizers()
        for batch in batches:
            rows = []
            for doc_id, source, lang, text_key, text in batch[
                ["doc_id", "source", "lang", "text_key", "text"]
            ].itertuples(index=False, name=None):
                lines = text.split("\n")
                once = list(dict.fromkeys(lines))
                for version, file in VERSIONS.items():
                    revised = len(tok.ranked(file, "\n".join(once))) if len(once) < len(lines) else None
                    rows.append((doc_id, source, lang, text_key, version, len(tok.ranked(file, text)), revised))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])
            yield out.assign(doc_id=long_ids(out["doc_id"])).astype({"tokens": "Int64", "revised_tokens": "Int64"})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        id_text(), "source", "lang", F.sha2(text, 256).alias("text_key"), text.alias("text")
    )
    return rows.mapInPandas(count, COUNTS)


class Rollup:
    """Additive totals in a folder: one small table of signed sums per committed batch.

    A batch lives under its own identifier and is written as a whole; Spark's success
    file is its commit. Committing an identifier again changes nothing, and one that
    broke off halfway is not counted until it is written anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        path, fs = self._path(kind)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        marks = [(int(n), self._path(kind, n, "_SUCCESS")) for n in names if n.isdigit()]
        return sorted(n for n, (mark, at) in marks if at.exists(mark))

    def committed(self) -> list[int]:
        """Identifiers that count, whether still as deltas or inside the snapshot."""
        deltas, base = self._done("deltas"), self._done("base")
        folded = [int(r["batch"]) for r in self._folded(base[-1]).collect()] if base else []
        return sorted({*deltas, *folded})

    def _folded(self, base: int) -> DataFrame:
        return self.spark.read.schema("batch long").parquet(f"{self.folder}/folded/{base}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add ``changes``: ``KEYS`` and ``old_tokens``, ``new_tokens`` (null old: insert, null new: delete).

        Sums are taken per task before the shuffle, so a source with most rows is no hot
        key. Returns whether the batch was new. A row with neither count adds nothing.
        """
        if batch in self.committed():
            return False
        there = lambda c: F.col(c).isNotNull().cast("long")
        zero = F.lit(0)
        deltas = changes.groupBy(*KEYS).agg(
            F.sum(there("new_tokens") - there("old_tokens")).alias("documents"),
            F.sum(F.coalesce("new_tokens", zero) - F.coalesce("old_tokens", zero)).cast("long").alias("tokens"),
        )
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Current sums; groups without documents and tokens are left out."""
        base = self._done("base")
        parts = [f"{self.folder}/base/{base[-1]}"] if base else []
        inside = {int(r["batch"]) for r in self._folded(base[-1]).collect()} if base else set()
        parts += [f"{self.folder}/deltas/{b}" for b in self._done("deltas") if b not in inside]
        rows = self.spark.createDataFrame([], DELTA)
        if parts:
            rows = self.spark.read.schema(DELTA).parquet(*parts)
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; the snapshot's own commit switches over."""
        batches, base = self.committed(), self._done("base")
        number = base[-1] + 1 if base else 0
        self.spark.createDataFrame([(b,) for b in batches], "batch long").write.mode("overwrite").parquet(
            f"{self.folder}/folded/{number}"
        )
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base/{number}")


def corpus_rollup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Totals of a corpus after its life so far: loaded, exact copies deleted, repeated lines taken out.

    Batch 0 inserts every row of ``docs`` under every tokenizer version, batch 1 deletes
    copies (equal texts, the smallest doc_id stays), batch 2 revises the counts of the
    texts that repeat lines. Batch 1 arrives twice and counts once. Whole texts count,
    however long, runs of over a million like characters too. Null text is an empty text, null source and language are groups of their own, rows that repeat the
    smallest doc_id all stay. An empty table gives no row.
    """
    counts = written(count_tokens(docs), "tokens")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    none = F.lit(None).cast("long")
    first = counts.groupBy(F.col("text_key").alias("same")).agg(F.min("doc_id").alias("first_id"))
    marked = written(
        counts.join(first, F.col("text_key") == F.col("same")).select(
            *KEYS, "tokens", "revised_tokens", (~F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("copy")
        ),
        "marked",
    )
    inserts = counts.select(*KEYS, none.alias("old_tokens"), F.col("tokens").alias("new_tokens"))
    deletes = marked.filter("copy").select(*KEYS, F.col("tokens").alias("old_tokens"), none.alias("new_tokens"))
    revised = marked.filter("NOT copy AND revised_tokens IS NOT NULL").select(
        *KEYS, F.col("tokens").alias("old_tokens"), F.col("revised_tokens").alias("new_tokens")
    )
    for batch, changes in ((0, inserts), (1, deletes), (1, deletes), (2, revised)):
        rollup.commit(batch, changes)
    return rollup.totals()
