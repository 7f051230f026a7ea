"""Structured captions: payload validation, failure routing, config flattening."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.functions import text as X
from tonewell.functions.arrays import let
from tonewell.sources.json_stream import leaves

REQUIRED = X.PROMPT_FIELDS


def normalise_payload(
    df: DataFrame, payload: str, max_tags: int = 5, max_words: int = 60, min_words: int = 8, cut: str | None = None
) -> DataFrame:
    """Parse and clean one JSON caption per row.

    Adds the eight caption fields and ``error``; a rejected row keeps its other
    columns, has null caption fields and the reason in ``error``. A caption has at most
    ``max_tags`` tags and ``max_words`` words; the boolean column named by ``cut`` tells
    which rows lost some.
    """
    parsed = F.from_json(F.col(payload), "map<string,string>")
    rows = df.withColumn("__m", parsed)
    field = {name: F.col("__m")[name] for name in REQUIRED}

    missing = F.filter(
        F.array(*[F.lit(n) for n in REQUIRED]),
        lambda n: ~F.coalesce(F.map_contains_key(F.col("__m"), n), F.lit(False)),
    )
    raw_tags = F.from_json(field["genre_tags"], "array<string>")
    tags = F.filter(F.transform(raw_tags, lambda t: X.strip(t)), lambda t: F.length(t) > 0)

    def first_seen(values):
        """The first tags whose lower-case form has not come before, in order."""
        return let(
            F.transform(values, F.lower),
            lambda keys: F.transform(
                F.slice(F.array_distinct(keys), 1, max_tags), lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))
            ),
        )

    distinct = let(tags, first_seen)
    description = X.normalise_text(field["description"])
    rows = rows.withColumn("__text", description)
    words = F.split("__text", f"{X.PY_SPACE}+")

    error = (
        F.when(F.col("__m").isNull(), F.lit("not a JSON object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing key: "), F.get(missing, 0)))
        .when(
            ~F.coalesce(field["genre_tags"].startswith("["), F.lit(False)),
            F.lit("genre_tags must be a list"),
        )
        .when(F.size(words) < min_words, F.concat(F.lit("description too short: "), F.col("__text")))
    )
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    short = let(
        words,
        lambda ws: F.when(F.size(ws) > max_words, F.array_join(F.slice(ws, 1, max_words), " ")).otherwise(F.col("__text")),
    )
    kinds = F.size(F.array_distinct(F.transform(tags, F.lower)))
    lost = good & ((F.size(words) > max_words) | (kinds > max_tags))
    columns = {
        name: F.when(good, X.normalise_text(field[name]))
        for name in REQUIRED
        if name not in ("description", "genre_tags")
    }
    columns["description"] = F.when(good, short)
    named = let(distinct, lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(F.lit("Unknown"))))
    columns["genre_tags"] = F.when(good, named)
    if cut is not None:
        columns[cut] = F.coalesce(lost, F.lit(False))
    return rows.withColumns(columns).drop("__m", "__text")


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without error, rows with error)."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def flatten_config(df: DataFrame, key: str, config: str) -> DataFrame:
    """Nested JSON config as (key, dotted name, value, error); lists keep their JSON text.

    Objects of any depth are walked in one pass over the row's text, in one plan. The last
    of equal names counts. A row that is no JSON object is one row with ``error``, a null
    one gives no row.
    """

    @F.pandas_udf("array<struct<name: string, raw: string, error: string>>")
    def walk(configs: pd.Series) -> pd.Series:
        rows = []
        for text in configs:
            try:
                found = leaves(text) if text is not None else {}
                rows.append([{"name": name, "raw": raw, "error": None} for name, raw in found.items()])
            except (ValueError, RecursionError) as exc:
                rows.append([{"name": None, "raw": None, "error": str(exc) or "nested too deep"}])
        return pd.Series(rows, dtype=object)

    rows = df.select(key, F.inline(walk(config)))
    v = F.try_parse_json("raw")
    text = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return rows.select(key, "name", text.alias("value"), "error")
