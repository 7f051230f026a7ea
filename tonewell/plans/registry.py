"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewell.functions.text import PY_SPACE
from tonewell.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL when there is one."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def heavy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much CPU: spread over the cores where the files do not do it."""
    return spread(table(spark, sf_dir, name))


# SQL text of the shared expressions -------------------------------------------------

# SQL patterns take the same literal class as the Spark expressions.
PY_SPACE_SQL = PY_SPACE


def sql_u(seed, *keys) -> str:
    """SQL text of ``uniform(seed, keys...)``."""
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return (
        f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) AS DOUBLE)"
        f" / CAST({2**52} AS DOUBLE))"
    )


def sql_fold(digest: str, digits: int, modulus: int) -> str:
    """SQL text of the hex digest modulo ``modulus``."""
    step = 2**32 % modulus
    acc = "CAST(0 AS BIGINT)"
    for i in range(digits // 8):
        chunk = f"CAST('0x' || substr({digest}, {i * 8 + 1}, 8) AS BIGINT)"
        acc = f"(({acc} * {step} + {chunk}) % {modulus})"
    return acc


def sql_trim(value: str) -> str:
    """SQL text of Python's ``str.strip``."""
    return f"regexp_replace({value}, '^{PY_SPACE_SQL}+|{PY_SPACE_SQL}+$', '', 'g')"


def joined(values, separator: str = ",") -> Column:
    """A list as one text, so that results compare whatever type a client gives lists."""
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(column, lambda v: v.cast("string")), separator)


def sql_joined(values: str, separator: str = ",") -> str:
    return f"array_to_string(list_transform({values}, lambda j: CAST(j AS VARCHAR)), '{separator}')"
