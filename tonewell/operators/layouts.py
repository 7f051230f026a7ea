"""Re-layout of multi-codebook tokens.

A layout places the code of (time t, codebook q) at a sequence step s(t, q).
Each kind has a closed form, so a layout is a column expression; step 0 is an
empty step unless it is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Steps times codebooks of a layout that may be broadcast.
MAX_LAYOUT = 4_000_000


@dataclass(frozen=True)
class Layout:
    """Shape of a layout; use the builders below."""

    kind: str
    n_q: int
    timesteps: int
    steps: int
    max_delay: int
    starts_empty: bool = True
    delays: tuple[int, ...] = ()
    flattening: tuple[int, ...] = ()
    flatten_first: int = 0
    base: int = 1
    group_by: int = 1
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def valid_steps(self) -> int:
        """Steps up to the last one where every codebook is still inside the sequence."""
        return self.steps - self.max_delay

    def step(self, t: Column, q: Column) -> Column:
        """Sequence step of (t, q) as int."""
        return _STEP[self.kind](self, t, q).cast("int")


def _by_codebook(values: Sequence[int], q: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (q + 1).cast("int"))


def _sorted(values: Sequence[int], name: str) -> tuple[int, ...]:
    if list(values) != sorted(values):
        raise ValueError(f"{name} must be in ascending order")
    return tuple(values)


def delayed(
    n_q: int,
    timesteps: int,
    delays: Sequence[int] | None = None,
    flatten_first: int = 0,
    empty_initial: int = 0,
) -> Layout:
    """Codebook q comes delays[q] steps late; the first times may be flattened."""
    delays = _sorted(range(n_q) if delays is None else delays, "delays")
    if len(delays) != n_q:
        raise ValueError("one delay per codebook is needed")
    base = 0 if empty_initial < 0 else 1 + empty_initial
    flat = min(timesteps, flatten_first)
    tail = max(0, timesteps + max(delays) - flatten_first)
    return Layout(
        "delayed",
        n_q,
        timesteps,
        base + flat * n_q + tail,
        # Later times of the less delayed codebooks fill the last steps.
        max(delays) - min(delays) if tail else 0,
        starts_empty=base > 0,
        delays=delays,
        flatten_first=flatten_first,
        base=base,
    )


def parallel(n_q: int, timesteps: int, empty_initial: int = 0) -> Layout:
    return delayed(n_q, timesteps, [0] * n_q, empty_initial=empty_initial)


def unrolled(
    n_q: int,
    timesteps: int,
    flattening: Sequence[int] | None = None,
    delays: Sequence[int] | None = None,
) -> Layout:
    """Several inner steps per time; codebooks with one inner step stay together."""
    flattening = _sorted(range(n_q) if flattening is None else flattening, "flattening")
    delays = _sorted([0] * n_q if delays is None else delays, "delays")
    if not len(flattening) == len(delays) == n_q:
        raise ValueError("one inner step and one delay per codebook are needed")
    groups: dict[int, tuple[int, int]] = {}
    for q, (inner, delay) in enumerate(zip(flattening, delays)):
        first, known = groups.setdefault(inner, (q, delay))
        if known != delay:
            raise ValueError("codebooks of one inner step need the same delay")
    reach = timesteps + max(delays)
    empty = max(flattening) + 1 - len(groups)
    steps = 1 + reach * empty + sum(reach - d for _, d in groups.values())
    return Layout(
        "unrolled",
        n_q,
        timesteps,
        steps,
        max(delays) - min(delays),
        delays=delays,
        flattening=flattening,
        extra={"groups": tuple(groups.values()), "empty": empty},
    )


def coarse_first(n_q: int, timesteps: int, delays: Sequence[int] | None = None) -> Layout:
    """All times of codebook 0, then the others side by side."""
    delays = _sorted([0] * (n_q - 1) if delays is None else delays, "delays")
    if len(delays) != n_q - 1:
        raise ValueError("one delay per fine codebook is needed")
    return Layout(
        "coarse_first",
        n_q,
        timesteps,
        1 + 2 * timesteps + max(delays),
        max(delays) - min(delays),
        delays=(0, *delays),
    )


def grouped(n_q: int, timesteps: int, group_by: int = 2) -> Layout:
    """Full flattening, one group of codebooks after the other."""
    if n_q % group_by:
        raise ValueError("group_by must divide the number of codebooks")
    return Layout("grouped", n_q, timesteps, 1 + n_q * timesteps, 0, group_by=group_by)


def _delayed_step(layout: Layout, t: Column, q: Column) -> Column:
    flat = min(layout.timesteps, layout.flatten_first)
    early = F.lit(layout.base) + t * layout.n_q + q
    late = (
        F.lit(layout.base + flat * layout.n_q - layout.flatten_first)
        + t
        + _by_codebook(layout.delays, q)
    )
    return F.when(t < layout.flatten_first, early).otherwise(late)


def _unrolled_step(layout: Layout, t: Column, q: Column) -> Column:
    # Position v = t + delay. Before v come the empty and the filled steps of
    # the earlier positions, at v the empty ones, then the groups by (t, q).
    groups, empty = layout.extra["groups"], layout.extra["empty"]
    own_first = {q_: first for q_ in range(layout.n_q) for first, _ in [groups[_group_of(layout, q_)]]}
    delay = _by_codebook(layout.delays, q)
    first_q = _by_codebook([own_first[i] for i in range(layout.n_q)], q)
    v = t + delay
    place = F.lit(1) + v * empty + F.lit(empty)
    for other_first, other_delay in groups:
        place = place + F.greatest(v - other_delay, F.lit(0))
        ahead = (F.lit(other_delay) > delay) | (
            (F.lit(other_delay) == delay) & (F.lit(other_first) < first_q)
        )
        place = place + (ahead & (v >= other_delay)).cast("int")
    return place


def _group_of(layout: Layout, q: int) -> int:
    """Position of the group of codebook q among the distinct inner steps."""
    return sorted(set(layout.flattening)).index(layout.flattening[q])


def _coarse_step(layout: Layout, t: Column, q: Column) -> Column:
    fine = F.lit(1 + layout.timesteps) + t + _by_codebook(layout.delays, q)
    return F.when(q == 0, t + 1).otherwise(fine)


def _grouped_step(layout: Layout, t: Column, q: Column) -> Column:
    g = layout.group_by
    return F.lit(1) + F.floor(q / g) * (layout.timesteps * g) + t * g + q % g


_STEP = {
    "delayed": _delayed_step,
    "unrolled": _unrolled_step,
    "coarse_first": _coarse_step,
    "grouped": _grouped_step,
}


def layout_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """(s, t, q) of every code inside the sequence: timesteps * n_q rows."""
    cells = spark.range(layout.timesteps * layout.n_q).select(
        F.floor(F.col("id") / layout.n_q).cast("int").alias("t"),
        (F.col("id") % layout.n_q).cast("int").alias("q"),
    )
    return cells.select(layout.step(F.col("t"), F.col("q")).alias("s"), "t", "q")


def steps_of(layout: DataFrame, t: int, q: int | None = None) -> DataFrame:
    """Steps that hold time t (of codebook q)."""
    rows = layout.filter(F.col("t") == t)
    return rows if q is None else rows.filter(F.col("q") == q)


def check_layout(layout: DataFrame) -> DataFrame:
    """Violations: two codes of one codebook in a step, or a time before an earlier one."""
    repeated = (
        layout.groupBy("s", "q")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("s", "q", F.lit("several times in one step").alias("problem"))
    )
    order = Window.partitionBy("q").orderBy("s", "t")
    backwards = (
        layout.withColumn("__before", F.lag("t").over(order))
        .filter(F.col("t") < F.col("__before"))
        .select("s", "q", F.lit("time goes back").alias("problem"))
    )
    return repeated.unionByName(backwards)


def _kept_steps(layout: Layout, valid_only: bool) -> int:
    return layout.valid_steps if valid_only else layout.steps


def _moves(moves: DataFrame, layout: Layout) -> DataFrame:
    """Broadcast hint for the moves of a layout of known, limited size."""
    return F.broadcast(moves) if layout.steps * layout.n_q <= MAX_LAYOUT else moves


def interleave(
    codes: DataFrame, layout: Layout, special: int, valid_only: bool = False
) -> DataFrame:
    """(item, q, s, code, mask) from dense codes (item, q, t, code).

    Codes of an item are dense, so its row with t = 0 also writes the special
    tokens of the steps its codebook leaves empty: no shuffle, one broadcast of
    the layout (timesteps * n_q rows) while that is small.
    """
    spark = codes.sparkSession
    steps = _kept_steps(layout, valid_only)
    placed = layout_table(spark, layout).filter(F.col("s") < steps)
    used = placed.groupBy("q").agg(F.collect_set("s").alias("used"))
    books = spark.range(layout.n_q).select(F.col("id").cast("int").alias("q"), F.lit(0).alias("t"))
    none = F.array().cast("array<int>")
    holes = books.join(used, "q", "left").select(
        "q",
        "t",
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.lit(steps - 1)), F.coalesce("used", none)),
            lambda s: F.struct(s.alias("s"), F.lit(False).alias("mask")),
        ).alias("cells"),
    )
    own = placed.select(
        "q", "t", F.array(F.struct(F.col("s").alias("s"), F.lit(True).alias("mask"))).alias("cells")
    )
    moves = own.unionByName(holes).groupBy("q", "t").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    rows = codes.join(_moves(moves, layout), ["q", "t"]).withColumn("cell", F.explode("cells"))
    return rows.select(
        "item",
        "q",
        F.col("cell.s").alias("s"),
        F.when(F.col("cell.mask"), F.col("code")).otherwise(F.lit(special)).alias("code"),
        F.col("cell.mask").alias("mask"),
    )


def deinterleave(
    sequence: DataFrame,
    layout: Layout,
    special,
    steps: int | None = None,
    valid_only: bool = False,
    model_output: bool = False,
    value: str = "code",
) -> DataFrame:
    """(item, q, t, value, mask) from a dense sequence (item, q, s, value).

    Codes whose step is not part of the sequence become the special value, also
    written by the row of step 0. ``model_output`` is for scores: they have no
    entry for the first, empty step.
    """
    spark = sequence.sparkSession
    known = _kept_steps(layout, valid_only)
    shift = 1 if model_output and layout.starts_empty else 0
    steps = known if steps is None else steps
    if steps > known:
        raise ValueError(f"sequence of {steps} steps is longer than the layout of {known}")
    placed = layout_table(spark, layout).withColumn("s", F.col("s") - shift)
    inside = placed.filter((F.col("s") >= 0) & (F.col("s") < steps) & (F.col("s") < known - shift))
    found = inside.select(
        "q", "s", F.array(F.struct(F.col("t").alias("t"), F.lit(True).alias("mask"))).alias("cells")
    )
    lost = (
        placed.join(inside.select("q", "t"), ["q", "t"], "left_anti")
        .groupBy("q")
        .agg(F.collect_list(F.struct(F.col("t").alias("t"), F.lit(False).alias("mask"))).alias("cells"))
        .select("q", F.lit(0).alias("s"), "cells")
    )
    moves = found.unionByName(lost).groupBy("q", "s").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    rows = sequence.join(_moves(moves, layout), ["q", "s"]).withColumn("cell", F.explode("cells"))
    fill = special if isinstance(special, Column) else F.lit(special)
    return rows.select(
        "item",
        "q",
        F.col("cell.t").alias("t"),
        F.when(F.col("cell.mask"), F.col(value)).otherwise(fill).alias(value),
        F.col("cell.mask").alias("mask"),
    )


def pad_invalid_tokens(codes: DataFrame, fps: float, special: int) -> DataFrame:
    """Tokens from padded audio become special, with mask 0.

    ``codes`` carries ``n_frames`` and ``sample_rate`` of its item.
    """
    valid = F.floor(F.col("n_frames") / F.col("sample_rate") * F.lit(fps))
    real = F.col("t") < valid
    return codes.withColumn("code", F.when(real, F.col("code")).otherwise(F.lit(special))).withColumn(
        "mask", real.cast("int")
    )


def interleave_stereo(left: DataFrame, right: DataFrame, per_timestep: bool = False) -> DataFrame:
    """One stream of both channels, side by side per codebook or per time."""
    both = left.withColumn("c", F.lit(0)).unionByName(right.withColumn("c", F.lit(1)))
    key = "t" if per_timestep else "q"
    return both.withColumn(key, (F.col(key) * 2 + F.col("c")).cast("int")).drop("c")


def split_stereo(codes: DataFrame, per_timestep: bool = False) -> DataFrame:
    """Inverse of ``interleave_stereo``; column ``c`` is the channel."""
    key = "t" if per_timestep else "q"
    return codes.withColumn("c", (F.col(key) % 2).cast("int")).withColumn(
        key, F.floor(F.col(key) / 2).cast("int")
    )
