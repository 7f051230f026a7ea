"""Helpers shared by the text operators: written intermediates, Arrow batches, tokenizers."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.session import configure, scratch_path

#: ASCII white space that separates words; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch of texts. A batch is what a Python worker holds at a time.
TEXT_BATCH, BATCH_BYTES = 500, 16 << 20


def text_session(spark: SparkSession) -> SparkSession:
    """Session settings of jobs that send texts to Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as Parquet in the shared folder: a cut that survives lost executors.

    Rows that a later step must see unchanged (drawn salts, learned features) and
    rows that several steps read go through here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(name: str = "doc_id"):
    """An integer id as text: pandas would make a batch of ids with a null into floats."""
    return F.col(name).cast("long").cast("string").alias(name)


def long_ids(values):
    """Ids from ``id_text`` as nullable integers."""
    import pandas as pd

    return pd.array([None if x is None or x is pd.NA else int(x) for x in values], dtype="Int64")


class Scratch:
    """Intermediate tables of one operator, each dropped when what was made of it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def union_find_step(pairs: DataFrame) -> DataFrame:
    """One round of large-star / small-star on ``(u, v)`` rows; see ``components``."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: neighbours above u go to the smallest of u and its neighbours
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (
        both.join(low, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    # small star: u and its smaller neighbours go to the smallest of them
    down = large.filter(F.col("u") != F.col("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
    )
    return small.filter(F.col("u") != F.col("v")).distinct()


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)`` of every id in ``(u, v)``: component is the smallest id reachable.

    Alternating large-star and small-star rounds; only counts and two sums reach the
    driver. Each round is written, so lineage does not grow with the rounds.
    """
    scratch, turn = Scratch(pairs.sparkSession), 0
    edges = scratch.write(
        f"{label}-0",
        pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
    )
    state = None
    while True:
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("g"),
        ).first()
        if now == state or not now["n"]:
            break
        state = now
        edges = scratch.write(f"{label}-{turn + 1}", union_find_step(edges))
        scratch.drop(f"{label}-{turn}")
        turn += 1
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()


class Tokenizers:
    """Public vocabularies, opened on first use inside a task."""

    #: The tokenizers and tiktoken libraries cut these texts alike. Others go to the
    #: library that the vocabulary file is made for.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞]*")
    LONG_RUN = re.compile(r"\S{2000}|[^\S\n]{2000}|\n{2000}")

    def __init__(self):
        self._open: dict = {}

    def _get(self, name: str, make: Callable):
        if name not in self._open:
            self._open[name] = make()
        return self._open[name]

    def ranks(self, file: str):
        def make():
            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(file), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            return tiktoken.Encoding(
                file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

        return self._get(file, make)

    def file(self, file: str):
        def make():
            import public_tokenizers
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
            tokenizer.encode_special_tokens = True
            return tokenizer

        return self._get(file, make)

    def pieces(self, file: str = "piece_bpe_32k.model"):
        def make():
            import public_tokenizers
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))

        return self._get(file, make)

    def ranked(self, file: str, text: str) -> list[int]:
        """Ids of a rank file; a text with endless runs is split by a pattern engine that needs no stack for them."""
        ranks = self.ranks(file)
        if not self.LONG_RUN.search(text):
            return ranks.encode_ordinary(text)

        def splitter():
            import public_tokenizers
            import regex

            return regex.compile(public_tokenizers.PATTERN)

        parts = self._get("split", splitter).findall(text)
        return [i for part in parts for i in ranks._encode_single_piece(part)]

    def byte_bpe(self, text: str) -> list[int]:
        """Ids of byte_bpe_50k.json.

        The rank file holds the same vocabulary and is several times faster, so plain
        Latin texts without special strings or endless runs take it.
        """
        if self.PLAIN.fullmatch(text) and "<|" not in text and not self.LONG_RUN.search(text):
            return self.ranks("byte_bpe_50k.tiktoken").encode_ordinary(text)
        return self.file("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    return df.mapInPandas(fn, schema)
