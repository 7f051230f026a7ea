"""Generated-sample catalogues: filters and matches over several runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.operators.scans import sorted_positions


def is_prompted() -> Column:
    return F.col("prompt").isNotNull()


def is_conditioned() -> Column:
    """An empty or missing map counts as unconditioned."""
    return F.coalesce(F.size("conditioning"), F.lit(0)) > 0


def filter_samples(
    df: DataFrame,
    by: Sequence[str] = (),
    epoch: int = -1,
    max_epoch: int = -1,
    exclude_prompted: bool = False,
    exclude_unprompted: bool = False,
    exclude_conditioned: bool = False,
    exclude_unconditioned: bool = False,
) -> DataFrame:
    """Samples of one epoch: the given one, the latest, or the latest up to ``max_epoch``.

    The epoch is chosen per group of ``by`` (for instance per run). No sample
    within ``max_epoch`` gives an empty result.
    """
    keys = list(by)
    if max_epoch < 0 and epoch >= 0:
        rows = df.filter(F.col("epoch") == epoch)
    else:
        known = df.filter(F.col("epoch") <= max_epoch) if max_epoch >= 0 else df
        # One row per group; a constant key stands for "no group".
        latest = known.groupBy(F.lit(0).alias("__g"), *keys).agg(F.max("epoch").alias("epoch"))
        rows = df.withColumn("__g", F.lit(0)).join(latest, ["__g", *keys, "epoch"], "left_semi").drop("__g")
    if exclude_prompted:
        rows = rows.filter(~is_prompted())
    if exclude_unprompted:
        rows = rows.filter(is_prompted())
    if exclude_conditioned:
        rows = rows.filter(~is_conditioned())
    if exclude_unconditioned:
        rows = rows.filter(is_conditioned())
    return rows.dropDuplicates([*keys, "id"])


def match_stable(samples: DataFrame, runs: Sequence[str], value: str = "path") -> DataFrame:
    """Ids of prompted or conditioned samples that every run has: (key, by_run).

    One shuffle on the id with a count test in place of a join per run.
    """
    stable = samples.filter(is_prompted() | is_conditioned()).filter(F.col("run").isin(*runs))
    unique = stable.groupBy("run", "id").agg(F.max(value).alias(value))
    # At most one entry per run for an id.
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", value))))
    return (
        unique.groupBy("id")
        .agg(F.count(F.lit(1)).alias("__n"), packed.alias("by_run"))
        .filter(F.col("__n") == len(runs))
        .select(F.col("id").alias("key"), "by_run")
    )


def match_unstable(samples: DataFrame, runs: Sequence[str], value: str = "path") -> DataFrame:
    """Samples without any input, matched by their position in id order: (key, by_run).

    Runs are trimmed to the shortest one; a run without such samples gives none.
    """
    free = samples.filter(~is_prompted() & ~is_conditioned()).filter(F.col("run").isin(*runs))
    placed = sorted_positions(free, ["run"], ["id"])
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", value))))
    # A position up to the shortest run is the one every run has.
    return (
        placed.groupBy("pos")
        .agg(F.count(F.lit(1)).alias("__n"), packed.alias("by_run"))
        .filter(F.col("__n") == len(runs))
        .select(F.concat(F.lit("noinput_"), F.col("pos").cast("string")).alias("key"), "by_run")
    )


def match_samples(samples: DataFrame, runs: Sequence[str], value: str = "path") -> DataFrame:
    return match_stable(samples, runs, value).unionByName(match_unstable(samples, runs, value))


def expand_runs(names: DataFrame, runs: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct runs, unknown names) of a mix of run names and grid names.

    ``names`` and ``runs`` have a column ``name``; ``grids`` has (name, run).
    """
    direct = names.join(runs.select("name").distinct(), "name", "left_semi").select(
        F.col("name").alias("run")
    )
    members = names.join(grids.select("name", "run"), "name").select("run")
    unknown = names.join(
        runs.select("name").union(grids.select("name")).distinct(), "name", "left_anti"
    ).distinct()
    return direct.union(members).distinct(), unknown
