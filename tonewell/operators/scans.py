"""Ordered (prefix) computations that never hold a whole group in one task.

A window over ``partitionBy(group)`` puts a hot group into one task. Here each
group is cut in ordered buckets: one window inside (group, bucket), one small
table with a row per (group, bucket) for the carry, and a join of the two. The
``bucket`` expression must grow with the order: every row of bucket b comes
before every row of bucket b + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.session import scratch_path

BUCKET = "__bucket"


def _default(kind: T.DataType) -> Column:
    """Any value of a type, to stand in for null next to a null flag."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("1970-01-01").cast(kind)
    raise TypeError(f"cannot group by a column of type {kind.simpleString()}")


def _with_cell(df: DataFrame, by: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with key columns, group keys, group and bucket keys).

    The keys are never null, so window, aggregate and join share one hash
    partitioning and the rows are shuffled once, also for null groups.
    """
    columns, groups = {}, []
    for i, name in enumerate(by):
        columns[f"__k{i}"] = F.coalesce(F.col(name), _default(df.schema[name].dataType))
        groups.append(f"__k{i}")
        if df.schema[name].nullable:
            columns[f"__n{i}"] = F.col(name).isNull()
            groups.append(f"__n{i}")
    # Rows without a bucket have a null order value and come first.
    placed = F.coalesce(bucket.cast("bigint"), F.lit(-(2**63)))
    return df.withColumns({**columns, BUCKET: placed}), groups, [*groups, BUCKET]


def _earlier(groups: Sequence[str]):
    """All earlier buckets of the same group, over one row per group and bucket."""
    return Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def row_positions(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "pos"
) -> DataFrame:
    """Zero-based rank inside each group, as a bigint column ``out``."""
    rows, groups, keys = _with_cell(df, by, bucket)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select(*keys, F.coalesce(F.sum("__size").over(_earlier(groups)), F.lit(0)).alias("__offset"))
    local = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("__local", F.row_number().over(local) - 1)
    return (
        ranked.join(offsets, keys)
        .withColumn(out, (F.col("__local") + F.col("__offset")).cast("bigint"))
        .drop("__local", "__offset", *keys)
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``min``, ``max`` or ``last`` (latest non-null) per group.

    ``outputs`` maps an output name to (kind, value). With ``inclusive`` false
    the current row is left out.
    """
    rows, groups, keys = _with_cell(df, by, bucket)
    for name, (_, value) in outputs.items():
        rows = rows.withColumn(f"__v_{name}", value)
    order = list(order)
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
    earlier = _earlier(groups)
    plain = {"sum": F.sum, "min": F.min, "max": F.max}

    partial, carries, locals_ = [], [], []
    sort_key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    for name, (kind, _) in outputs.items():
        value = F.col(f"__v_{name}")
        if kind == "last":
            partial.append(F.max_by(value, F.when(value.isNotNull(), sort_key)).alias(f"__p_{name}"))
            carries.append(F.last(f"__p_{name}", ignorenulls=True).over(earlier).alias(f"__c_{name}"))
            locals_.append(F.last(value, ignorenulls=True).over(local).alias(f"__l_{name}"))
        else:
            func = plain[kind]
            partial.append(func(value).alias(f"__p_{name}"))
            carries.append(func(f"__p_{name}").over(earlier).alias(f"__c_{name}"))
            locals_.append(func(value).over(local).alias(f"__l_{name}"))

    carry = rows.groupBy(*keys).agg(*partial).select(*keys, *carries)
    result = rows.select("*", *locals_).join(carry, keys)
    for name, (kind, _) in outputs.items():
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            merged = F.when(
                here.isNotNull() | before.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
            )
        elif kind == "last":
            merged = F.coalesce(here, before)
        else:
            merged = F.least(here, before) if kind == "min" else F.greatest(here, before)
        result = result.withColumn(name, merged)
    drop = keys + [f"__{t}_{n}" for t in "vlc" for n in outputs]
    return result.drop(*drop)


def bucket_count(df: DataFrame) -> int:
    """Ordered buckets of a scan: several for each shuffle partition, so they grow with the cluster set up for the data."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def take_smallest(
    df: DataFrame, n: int, u: Column, ties: Sequence[Column], buckets: int | None = None
) -> DataFrame:
    """The n rows with the smallest u in [0, 1), whatever the size of n.

    Counts per u-bucket tell where the n-th row falls, so only the rows up to
    that bucket are shuffled and no task ever holds all n of them.
    """
    buckets = buckets or bucket_count(df)
    rows = df.withColumn("__u", u).withColumn(BUCKET, share_bucket(F.col("__u"), buckets))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, so at most ``buckets`` rows here.
    sizes = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    near = rows.join(F.broadcast(offsets.filter(F.col("__offset") < n)), BUCKET)
    local = Window.partitionBy(BUCKET).orderBy("__u", *ties)
    return (
        near.withColumn("__rank", F.row_number().over(local) + F.col("__offset"))
        .filter(F.col("__rank") <= n)
        .drop("__u", BUCKET, "__offset", "__rank")
    )


def share_bucket(u: Column, buckets: int) -> Column:
    """Ordered bucket of a value in [0, 1]: rows sorted by u fall in equal shares."""
    return F.least(F.floor(u * F.lit(buckets)).cast("int"), F.lit(buckets - 1))


def span_bucket(position: Column, width) -> Column:
    """Ordered bucket of a number: one bucket per ``width`` units."""
    return F.floor(position / F.lit(width)).cast("bigint")


def sorted_positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "pos", label: str = "positions"
) -> DataFrame:
    """Zero-based rank inside each group in the order of plain columns, as a bigint column ``out``.

    Spark's range shuffle cuts the sorted rows in partitions, and the hash of all other
    columns breaks ties, so one value that fills most rows is still many partitions.
    The sorted rows are written with their place, which fixes the cuts; what is added is
    one offset per partition and one first place per group.
    """
    rest = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (*by, *order)]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    keys = [*by, *order, "__tie"]
    ranged = df.withColumn("__tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    # The lower 33 bits count the rows of a partition.
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = scratch_path(df.sparkSession, label)
    ranged = ranged.withColumns({"__part": F.spark_partition_id(), "__here": here})
    ranged.write.parquet(path)
    placed = df.sparkSession.read.schema(ranged.schema).parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range shuffle.
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    ranked = placed.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__here") + F.col("__offset"))
    if by:
        groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
        firsts = ranked.groupBy(*groups).agg(F.min(out).alias("__first"))
        match = F.lit(True)
        for i, c in enumerate(by):
            match = match & F.col(c).eqNullSafe(F.col(f"__g{i}"))
        ranked = ranked.join(firsts, match).withColumn(out, F.col(out) - F.col("__first"))
    return ranked.select(*df.columns, F.col(out).cast("bigint").alias(out))
