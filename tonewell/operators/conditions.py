"""Conditioning tables: building, flattening, dropout, collation.

Text conditions are ``map<string,string>``; wave and joint conditions are maps of
structs that point at a waveform table (length, sample_rate, path, seek_time and,
for joint ones, text). Samples are never inlined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.functions.hashing import uniform

KINDS = ("text", "wav", "joint_embed", "symbolic")


def to_conditions(
    df: DataFrame, text: Sequence[str], wave: Sequence[str] = (), joint: Sequence[str] = ()
) -> DataFrame:
    """Maps ``text``, ``wav`` and ``joint_embed``; list attributes are joined by a space."""

    def flat(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.ArrayType):
            return F.array_join(F.col(name), " ")
        return F.col(name).cast("string")

    def as_map(names: Sequence[str], value) -> Column:
        if not names:
            return F.lit(None)
        return F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[value(n) for n in names])
        )

    keep = [c for c in df.columns if c not in {*text, *wave, *joint}]
    out = df.select(
        *keep,
        as_map(text, flat).alias("text"),
        as_map(wave, F.col).alias("wav"),
        as_map(joint, F.col).alias("joint_embed"),
    )
    return out.drop(*[k for k, n in (("wav", wave), ("joint_embed", joint)) if not n])


def flatten_conditions(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One map ``flat`` with ``kind.attribute`` keys."""

    def dotted(kind: str) -> Column:
        return F.transform_keys(F.col(kind), lambda n, v: F.concat(F.lit(f"{kind}."), n))

    parts = [dotted(k) for k in kinds]
    return df.withColumn("flat", F.map_concat(*parts)).drop(*kinds)


def unflatten_conditions(df: DataFrame, flat: str, kinds: Sequence[str]) -> DataFrame:
    """The maps per kind back from the dotted keys."""


    def of_kind(kind: str) -> Column:
        own = F.map_filter(F.col(flat), lambda n, v: n.startswith(f"{kind}."))
        return F.transform_keys(own, lambda n, v: F.substr(n, F.lit(len(kind) + 2)))

    return df.withColumns({k: of_kind(k) for k in kinds}).drop(flat)


def hydrate_conditions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Loggable form of the configured conditions in one map ``conditions``.

    Text keeps its value, waves give their path, joint ones their text; anything
    else gives its type name.
    """
    wanted = F.array(*[F.lit(n) for n in names])
    shown = {
        "text": lambda v: v,
        "wav": lambda v: v["path"],
        "joint_embed": lambda v: v["text"],
        "symbolic": lambda v: F.lit("symbolic"),
    }

    def logged(kind: str) -> Column:
        kept = F.map_filter(F.col(kind), lambda n, v: F.array_contains(wanted, n))
        return F.transform_values(kept, lambda n, v: shown[kind](v).cast("string"))

    parts = [logged(kind) for kind in KINDS if kind in df.columns]
    return df.withColumn("conditions", F.map_concat(*parts))


def nullify_wave(c: Column) -> Column:
    """Length 0, no path, no seek time; the sample rate stays."""
    return (
        c.withField("length", F.lit(0).cast("bigint"))
        .withField("path", F.lit(None).cast("string"))
        .withField("seek_time", F.lit(None).cast("double"))
    )


def nullify_joint(c: Column) -> Column:
    """Length 0, no path, no text, seek time 0."""
    return (
        c.withField("length", F.lit(0).cast("bigint"))
        .withField("path", F.lit(None).cast("string"))
        .withField("seek_time", F.lit(0.0))
        .withField("text", F.lit(None).cast("string"))
    )


def nullify_chords(c: Column, null_index: int = 194) -> Column:
    return F.transform(c, lambda _: F.lit(null_index))


def nullify_melody(c: Column) -> Column:
    return F.transform(c, lambda x: x * 0)


def _nullify(kind: str, name: str, value: Column, null_index: int) -> Column:
    if kind == "text":
        return F.lit(None).cast("string")
    if kind == "wav":
        return nullify_wave(value)
    if kind == "joint_embed":
        return nullify_joint(value)
    if kind == "symbolic":
        if name not in ("chords", "melody"):
            raise ValueError(f"unknown symbolic condition {name}")
        return nullify_chords(value, null_index) if name == "chords" else nullify_melody(value)
    raise ValueError(f"unknown condition type {kind}")


def _checked(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown condition type {kind}; expected one of {KINDS}")
    return kind


def attribute_dropout(
    df: DataFrame,
    p: dict[str, dict[str, float]],
    batch: Column,
    seed: int,
    training: bool = True,
    active_on_eval: bool = False,
    null_index: int = 194,
) -> DataFrame:
    """Null an attribute for a whole batch with its own probability.

    The draw is a function of (seed, kind, attribute, batch), so all rows of a
    batch agree without a shuffle.
    """
    if not training and not active_on_eval:
        return df

    def dropped(column: Column, kind: str, name: str, probability: float) -> Column:
        hit = uniform(f"attr:{seed}", F.lit(kind), F.lit(name), batch) < F.lit(probability)
        return F.transform_values(
            column,
            lambda n, v: F.when((n == name) & hit, _nullify(kind, name, v, null_index)).otherwise(v),
        )

    for kind, probabilities in p.items():
        column = F.col(_checked(kind))
        for name, probability in probabilities.items():
            column = dropped(column, kind, name, probability)
        df = df.withColumn(kind, column)
    return df


def guidance_dropout(
    df: DataFrame,
    p: float,
    batch: Column,
    seed: int,
    kinds: Sequence[str] = ("wav", "text"),
    training: bool = True,
    null_index: int = 194,
) -> DataFrame:
    """Null every attribute of the given kinds for a whole batch with probability p."""
    if not training:
        return df
    drop = uniform(f"guide:{seed}", batch) < F.lit(p)

    def emptied(kind: str) -> Column:
        return F.transform_values(
            F.col(kind), lambda n, v: F.when(drop, _nullify(kind, "", v, null_index)).otherwise(v)
        )

    for kind in kinds:
        if _checked(kind) not in df.columns:
            continue
        if kind == "symbolic":
            # The two symbolic conditions have different value types.
            raise ValueError("drop symbolic columns with nullify_chords and nullify_melody")
        df = df.withColumn(kind, emptied(kind))
    return df


def drop_description(df: DataFrame) -> DataFrame:
    """Null the description and keep the wave; both have to be there."""
    both = F.map_contains_key("text", "description") & F.map_contains_key("wav", "self_wav")
    edited = F.transform_values(
        F.col("text"),
        lambda n, v: F.when(
            ~F.coalesce(both, F.lit(False)), F.raise_error(F.lit("description and self_wav are needed")).cast("string")
        ).when(n != "description", v),
    )
    return df.withColumn("text", edited)


def collate_conditions(df: DataFrame, batch: str, position: str, flat: str) -> DataFrame:
    """(batch, attribute) -> values in batch order.

    A batch has a fixed number of rows, so a list is as long as one batch.
    """
    entries = df.select(batch, position, F.explode(F.col(flat)).alias("attribute", "value"))
    return entries.groupBy(batch, "attribute").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("value").alias("v")))),
            lambda x: x["v"],
        ).alias("values")
    )
