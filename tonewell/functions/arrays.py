"""Array and vector expressions (double arrays unless stated)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda would be computed again for each element;
    as the only element of an array it becomes a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def l2_normalise(c: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(norm(c), F.lit(eps)), lambda length: F.transform(c, lambda x: x / length))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity with each norm floored at eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def softmax(c: Column, temperature: float = 1.0) -> Column:
    weights = let(
        F.array_max(c), lambda top: F.transform(c, lambda x: F.exp((x - top) / F.lit(temperature)))
    )
    return let(weights, lambda ws: let(total(ws), lambda mass: F.transform(ws, lambda w: w / mass)))


def log_sum_exp(c: Column) -> Column:
    return let(
        F.array_max(c), lambda top: top + F.log(total(F.transform(c, lambda x: F.exp(x - top))))
    )


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(c: Column, factor) -> Column:
    return F.transform(c, lambda x: x * factor)


def guided_scores(cond: Column, uncond: Column, strength: float) -> Column:
    """uncond + strength * (cond - uncond)."""
    return F.zip_with(cond, uncond, lambda c, u: u + F.lit(strength) * (c - u))


def double_guided_scores(
    cond: Column, wav: Column, uncond: Column, strength: float, beta: float
) -> Column:
    """uncond + strength * (wav + beta * (cond - wav) - uncond)."""
    inner = F.zip_with(cond, wav, lambda c, w: w + F.lit(beta) * (c - w))
    return F.zip_with(inner, uncond, lambda x, u: u + F.lit(strength) * (x - u))


def weighted_scores(terms: list[tuple[float, Column]]) -> Column:
    """Weighted sum of several score arrays."""
    scaled = [scale(column, F.lit(weight)) for weight, column in terms]
    acc = scaled[0]
    for term in scaled[1:]:
        acc = add(acc, term)
    return acc


def length_to_mask(length: Column, size: Column) -> Column:
    """1 up to ``length`` (at least 1 place is made), then 0 up to ``size``."""
    places = F.greatest(size, F.lit(1))
    return F.transform(F.sequence(F.lit(0), places - 1), lambda i: (i < length).cast("int"))


def argmax(c: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def argmax_one_hot(c: Column) -> Column:
    """One-hot of the first maximum, all zero where that maximum is 0."""
    hot = F.when(F.array_max(c) != 0, argmax(c)).otherwise(-1)
    return let(hot, lambda at: F.transform(c, lambda x, i: F.when(i == at, 1.0).otherwise(0.0)))


def inf_normalise(c: Column, eps: float = 1e-6) -> Column:
    peak = F.greatest(F.array_max(F.transform(c, F.abs)), F.lit(eps))
    return let(peak, lambda p: F.transform(c, lambda x: x / p))


def fit_length(c: Column, size: int) -> Column:
    """Cut to ``size`` elements, or repeat the array until it is that long."""
    times = F.ceil(F.lit(size) / F.size(c)).cast("int")
    return F.slice(F.flatten(F.array_repeat(c, times)), 1, size)


def pad_right(c: Column, size: Column, value) -> Column:
    """Cut or extend to exactly ``size`` elements."""
    missing = F.greatest(size - F.size(c), F.lit(0)).cast("int")
    return F.slice(F.concat(c, F.array_repeat(value, missing)), F.lit(1), size)


def resample_linear(c: Column, rate_in: float, rate_out: float, size: int) -> Column:
    """Linear resize of a value array in time (half-pixel centres).

    The result has ``size`` entries: cut, or padded by zeros. Inputs no longer
    than one output step give zeros only.
    """
    ratio = rate_out / rate_in

    def resized(values):
        n = F.size(values)

        def at(i):
            # The source position follows the given scale, as resizing by a factor does.
            pos = F.greatest((i + F.lit(0.5)) / F.lit(ratio) - F.lit(0.5), F.lit(0.0))
            low = F.least(F.floor(pos).cast("int"), n - 1)
            high = F.least(low + 1, n - 1)
            frac = pos - low
            return F.get(values, low) * (1.0 - frac) + F.get(values, high) * frac

        made = F.floor(n * F.lit(ratio)).cast("int")
        filled = F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i < made, at(i)).otherwise(0.0)
        )
        too_short = n <= F.lit(rate_in / rate_out)
        return F.when(too_short, F.array_repeat(F.lit(0.0), size)).otherwise(filled)

    return let(c, resized)


def excerpt_mask(size: int, start: Column, width: int) -> Column:
    """0 inside [start, start + width), 1 elsewhere."""
    return let(
        start,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda i: (~((i >= s) & (i < s + F.lit(width)))).cast("int"),
        ),
    )


def db_to_scale(db) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def scale_to_db(scale_: Column, floor_db: float = -120.0) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(scale_, F.lit(10.0 ** (floor_db / 20.0))))


def blur_blocks(c: Column, width: int) -> Column:
    """Mean of each block of ``width`` values, repeated; the tail block is completed
    by the values mirrored before the last one."""
    n = F.size(c)
    missing = F.pmod(F.lit(width) - n % F.lit(width), F.lit(width))
    mirrored = F.reverse(F.slice(c, F.greatest(n - missing, F.lit(1)), missing))
    full = F.when(missing > 0, F.concat(c, mirrored)).otherwise(c)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))

    def means(values):
        return F.transform(
            blocks, lambda b: total(F.slice(values, b * width + 1, F.lit(width))) / F.lit(float(width))
        )

    spread = let(full, lambda values: F.flatten(F.transform(means(values), lambda m: F.array_repeat(m, width))))
    return F.slice(spread, F.lit(1), n)
