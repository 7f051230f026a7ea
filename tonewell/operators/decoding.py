"""Token choice from score tables: top-k, nucleus, guided scores, draws.

One row per decoding step holds its scores as an array, and every choice stays in
that row: sorting, running masses and draws are array expressions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.functions.hashing import uniform

# Cumulative masses are compared after rounding, so that equal masses added in
# another order fall on the same side of the threshold.
DIGITS = 12


def token_probabilities(logits: Column, temperature: float = 1.0) -> Column:
    """Array of (token, p) in token order."""
    return F.transform(
        A.softmax(A.doubles(logits), temperature), lambda p, i: F.struct(i.alias("token"), p.alias("p"))
    )


def _renormalise(kept: Column) -> Column:
    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["p"])
    return A.let(
        kept,
        lambda xs: A.let(
            mass(xs),
            lambda m: F.transform(xs, lambda x: F.struct(x["token"].alias("token"), (x["p"] / m).alias("p"))),
        ),
    )


def _likely_first(probs: Column) -> Column:
    """The tokens by falling probability, equal ones by number."""
    keyed = F.transform(probs, lambda x: F.struct((-x["p"]).alias("o"), x["token"].alias("token"), x["p"].alias("p")))
    return F.array_sort(keyed)


def nucleus_filter(probs: Column, p: float) -> Column:
    """Keep tokens while the mass before them is at most p; the crossing one stays."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("kept"))

    def step(s, x):
        inside = F.round(s["mass"], DIGITS) <= F.lit(p)
        return F.struct((s["mass"] + x["p"]).alias("mass"), (s["kept"] + inside.cast("int")).alias("kept"))

    def cut(xs):
        # masses only grow, so the kept tokens are the first ones
        return A.let(F.aggregate(xs, start, step)["kept"], lambda n: F.slice(xs, 1, n))

    plain = lambda x: F.struct(x["token"].alias("token"), x["p"].alias("p"))
    return _renormalise(F.transform(A.let(_likely_first(probs), cut), plain))


def top_k_filter(probs: Column, k: int) -> Column:
    """Keep every token at least as likely as the k-th one (ties stay)."""

    def cut(xs):
        least = F.get(F.sort_array(F.transform(xs, lambda x: x["p"]), asc=False), F.least(F.lit(k), F.size(xs)) - 1)
        return A.let(least, lambda low: F.filter(xs, lambda x: x["p"] >= low))

    return _renormalise(A.let(probs, cut))


def draw_token(probs: Column, u: Column) -> Column:
    """The first token, by number, whose cumulative mass exceeds the draw.

    Rounding may leave the last sum below the draw; the last token then takes it.
    """
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("int").alias("hit"), F.lit(None).cast("int").alias("last"))

    def step(s, x):
        mass = s["mass"] + x["p"]
        hit = F.when(s["hit"].isNull() & (mass > u), x["token"]).otherwise(s["hit"])
        return F.struct(mass.alias("mass"), hit.alias("hit"), x["token"].alias("last"))

    by_number = F.array_sort(probs)
    return A.let(F.aggregate(by_number, start, step), lambda s: F.coalesce(s["hit"], s["last"]))


def categorical_draw(
    df: DataFrame,
    step: str,
    logits: str,
    seed,
    use_sampling: bool = True,
    temperature: float = 1.0,
    top_k: int = 0,
    top_p: float = 0.0,
    out: str = "token",
) -> DataFrame:
    """Next token per step: greedy without sampling or temperature, else top-p, top-k, plain."""
    if not use_sampling or temperature <= 0.0:
        return df.withColumn(out, A.argmax(A.doubles(F.col(logits))))
    probs = token_probabilities(F.col(logits), temperature)
    if top_p > 0.0:
        probs = nucleus_filter(probs, top_p)
    elif top_k > 0:
        probs = top_k_filter(probs, top_k)
    return df.withColumn(out, draw_token(probs, uniform(seed, F.col(step))))
