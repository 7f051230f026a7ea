"""Deterministic draws and hash buckets as pure column expressions.

Random choices are functions of (seed, keys), so a rerun, a retried task or a
different cluster size gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 52


def text(value) -> Column:
    """A key part as string: columns are cast, Python values become literals."""
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def draw_key(seed, *keys) -> Column:
    return F.concat_ws("|", *[text(part) for part in (seed, *keys)])


def uniform(seed, *keys) -> Column:
    """u in [0, 1) from the first 52 bits of md5(seed|key|...)."""
    digits = F.substring(F.md5(draw_key(seed, *keys)), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**DRAW_BITS))


def uniform_int(low: int, high: int, seed, *keys) -> Column:
    """Integer uniform in [low, high], both ends included."""
    return (F.floor(uniform(seed, *keys) * F.lit(high - low + 1)) + F.lit(low)).cast("int")


def _fold(digest: Column, digits: int, modulus: int) -> Column:
    """Big-integer value of a hex digest modulo ``modulus`` (below 2^31), fifteen digits at a time."""
    width = 15
    first = digits % width or width

    def folded(text_: Column) -> Column:
        def chunk(start: int, length: int) -> Column:
            return F.conv(F.substring(text_, start + 1, length), 16, 10).cast("bigint")

        value = chunk(0, first) % F.lit(modulus)
        for start in range(first, digits, width):
            value = (value * F.lit(16**width % modulus) + chunk(start, width)) % F.lit(modulus)
        return value

    # Bound once, so that the digest is not made again for every chunk.
    return F.get(F.transform(F.array(digest), folded), F.lit(0))


def md5_mod(value: Column, modulus: int) -> Column:
    return _fold(F.md5(value), 32, modulus)


def sha256_mod(value: Column, modulus: int) -> Column:
    return _fold(F.sha2(value, 256), 64, modulus)


def normal(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller over two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(f"{seed}:r", *keys)))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(f"{seed}:a", *keys))


def bucket_of(buckets: int, *keys) -> Column:
    """Hash bucket, an even split of rows whatever the distribution of the key."""
    return F.floor(uniform("bucket", *keys) * F.lit(buckets)).cast("int")
