"""Registry of signal effects and their random selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions.hashing import uniform
from tonewell.operators import signal as S

# The names of the effects. Effects take the chunk table and keyword parameters.
EFFECTS: dict[str, Callable[..., DataFrame]] = {
    "boost_audio": S.boost,
    "duck_audio": S.duck,
    "echo": S.echo,
    "identity": S.identity,
    "pink_noise": S.pink_noise,
    "random_noise": S.white_noise,
    "smooth": S.moving_average,
}


def available_effects(params: dict[str, dict] | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Name to effect with its configured parameters bound."""
    params = params or {}

    def bound(name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda signal: EFFECTS[name](signal, **params.get(name, {}))

    return {name: bound(name) for name in EFFECTS}


def effect_variants(
    signal: DataFrame, chosen: DataFrame, effects: dict[str, Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """The signal under every effect chosen for its clip: chunk rows with the column ``effect``.

    ``chosen``: (clip_id, names). An effect runs over its own clips only, so the work
    follows the number of choices.
    """
    wanted = chosen.select("clip_id", F.explode("names").alias("effect"))
    parts = None
    for name, effect in effects.items():
        own = signal.join(wanted.filter(F.col("effect") == name).select("clip_id"), "clip_id", "left_semi")
        made = effect(own).withColumn("effect", F.lit(name))
        parts = made if parts is None else parts.unionByName(made)
    return parts


def select_effects(
    names: Sequence[str],
    seed,
    *keys: Column,
    weights: dict[str, float] | None = None,
    mode: str = "all",
    max_length: int | None = None,
) -> Column:
    """Array of the chosen effect names per key (for instance per batch).

    ``weighted``: each effect with its probability (1 when not listed); a cap
    keeps a random subset; an empty choice becomes ``identity``.
    """
    if mode not in ("all", "weighted"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "weighted" and weights is None:
        raise ValueError("weighted mode needs weights")
    entries = F.array(
        *[
            F.struct(
                uniform(f"{seed}:cap", *keys, F.lit(name)).alias("u"),
                F.lit(name).alias("name"),
                (
                    F.lit(True)
                    if mode == "all"
                    else uniform(f"{seed}:pick", *keys, F.lit(name)) < F.lit(weights.get(name, 1.0))
                ).alias("keep"),
            )
            for name in names
        ]
    )
    # The cast gives an empty list its type.
    entries = entries.cast("array<struct<u: double, name: string, keep: boolean>>")
    kept = F.filter(entries, lambda e: e["keep"])
    if max_length is not None:
        kept = F.slice(F.array_sort(kept), 1, max_length)
    chosen = F.array_sort(F.transform(kept, lambda e: e["name"]))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit("identity")))
