"""The training-text pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.llm import bbit_minhash, packing, pfair, pu_quality, suffix_dedup
from tonewell.llm.common import documents, text_session, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; the others go."""
    return pu_quality.accepted(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (four fifths of their shingles or more) stays."""
    return bbit_minhash.without_copies(docs, threshold=80, bands=48)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller document holds; no document goes."""
    left = suffix_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order in which their sources' blocks meet their deadlines."""
    return pfair.in_mix_order(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, cut only where longer than a sequence, in as few sequences as can be.

    ``sequence_turn`` orders the sequences as the mix before ordered the documents' files.
    """
    return packing.pack(docs, capacity=1024, in_order=True)


def _with_settings(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(text_session(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    (stage.__name__, _with_settings(stage))
    for stage in (quality_classifier, near_dedup, repeat_removal, source_mixing, best_fit_packing)
]

#: A learned classifier and a search by heuristics decide the rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
