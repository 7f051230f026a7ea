"""Mixing sources to target weights: Pfair windows and earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Slots that the driver counts through at most, and numbers in all the states that it keeps.
MOST_SLOTS, STATE_NUMBERS = 1 << 25, 1 << 22


def earliest(weights: list[int], done: list[int]) -> Iterator[int]:
    """The source of each slot of an endless phase, once ``done`` blocks of each source have had theirs.

    With w the source's exact part of all weights, block i is released at floor(i / w) and
    due at ceil((i + 1) / w). The earliest deadline among the released blocks goes first.
    The parts add up to one, so every slot has a released block and every deadline holds:
    after t slots a source has more than w t - 1 and less than w t + 1 blocks, however
    large t is.
    """
    total, t = sum(weights), sum(done)
    coming = [(done[s] * total // w, s, done[s]) for s, w in enumerate(weights) if w]
    heapq.heapify(coming)
    ready = []
    while True:
        while coming and coming[0][0] <= t:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        heapq.heappush(coming, ((i + 1) * total // weights[s], s, i + 1))
        t += 1


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the ratio of the weights."""
    if any(not 0 <= w < math.inf for w in weights):
        raise ValueError("a weight is negative or not finite")
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def turns(
    blocks: list[int], weights: list[int], begun: list[int] | None = None, done: list[int] | None = None
) -> Iterator[tuple[list[int], list[int], int]]:
    """``(begun, done, source)`` of every slot: blocks done when the phase began and by now, and who is next.

    A phase ends when the first of its sources has no block left; then the weights of
    the others are scaled to one. Sources of weight zero come after all others. The two
    lists are the whole state: given back, they go on from that slot.
    """
    done = list(done or [0] * len(blocks))
    begun = list(begun or done)
    while active := [s for s in range(len(blocks)) if done[s] < blocks[s]]:
        active = [s for s in active if weights[s]] or active
        parts = [weights[s] for s in active]
        for i in earliest(parts if any(parts) else [1] * len(parts), [done[s] - begun[s] for s in active]):
            s = active[i]
            yield begun, done, s
            done[s] += 1
            if done[s] == blocks[s]:
                break
        begun = list(done)


def slots_of(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], every: int = 1 << 16) -> DataFrame:
    """``(mix_name, mix_block, mix_slot)`` of every block.

    The driver goes through the slots once and keeps the state before every ``every``-th
    (fewer where there are very many sources: ``STATE_NUMBERS`` in all); tasks go on from
    there and make the rows.
    """
    names = sorted(blocks)
    every = max(every, sum(blocks.values()) * len(names) // STATE_NUMBERS)
    sizes, exact = [blocks[s] for s in names], whole_weights([weights[s] for s in names])
    states = [
        (t, list(begun), list(done)) for t, (begun, done, _) in enumerate(turns(sizes, exact)) if t % every == 0
    ]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, begun, done in zip(batch["first"], batch["begun"], batch["done"], strict=True):
                coming = islice(turns(sizes, exact, begun.tolist(), done.tolist()), every)
                rows = [(names[s], now[s], first + j) for j, (_, now, s) in enumerate(coming)]
                yield pd.DataFrame(rows, columns=["mix_name", "mix_block", "mix_slot"])

    chunks = spark.createDataFrame(states, "first long, begun array<long>, done array<long>")
    return chunks.mapInPandas(expand, "mix_name string, mix_block long, mix_slot long")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temper: float = 0.7,
    block_chars: int = 1 << 16,
    bucket_rows: int = 4096,
) -> DataFrame:
    """``docs`` with ``block`` (of its source) and ``slot`` (of the mix); slots order the stream.

    ``weights`` names the target weight of each source; the default is the source's
    size to the power ``temper``, which favours small sources. Documents of a source
    stand in hashed order and are cut into blocks of ``block_chars`` characters; one
    that is longer takes as many blocks as it fills. No document is dropped or
    repeated: once a source has run out, the others share its weight. Until then, the
    blocks of every source differ by less than one from its exact weight times the slots.

    A source is cut in buckets of about ``bucket_rows``, so that running sizes are windows
    of bounded groups however large the source is. Only one row per source reaches the
    driver, which counts through the slots once; see ``slots_of``. Blocks are larger where
    there would be more than ``MOST_SLOTS`` of them, so that this takes about a minute at most.

    Null sources are one source, a source without a weight gets the smallest one given,
    sources of weight zero come last, a negative weight is an error,
    null texts have no characters, rows of one doc_id are told apart by their texts, repeated rows are separate documents, an empty table
    gives no row. Columns of ``docs`` stay, but those named block and slot are replaced;
    names that begin with ``mix_`` are reserved.
    """
    name = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    sized = docs.withColumns(
        {
            "mix_source": name,
            "mix_size": F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1,
            "mix_hash": F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(11)),
        }
    )
    stats = sized.groupBy("mix_source").agg(F.count("*").alias("n"), F.sum("mix_size").alias("size")).collect()
    if not stats:
        return docs.withColumns({"block": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    block_chars = max(block_chars, -(-sum(r["size"] for r in stats) // MOST_SLOTS))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("block", "slot")]
    if weights is None:
        target = {r["mix_source"]: r["size"] ** temper for r in stats}
    else:
        given = {("n" if k is None else f"s{k}"): v for k, v in weights.items()}
        target = {r["mix_source"]: given.get(r["mix_source"], min(given.values())) for r in stats}
    cut = spark.createDataFrame([(r["mix_source"], max(1, -(-r["n"] // bucket_rows))) for r in stats], "mix_name string, mix_cuts long")
    unit = (F.shiftrightunsigned("mix_hash", 11) / F.lit(float(1 << 53))).cast("double")
    placed = (
        sized.join(F.broadcast(cut), F.col("mix_source") == F.col("mix_name"))
        .withColumn("mix_bucket", F.floor(unit * F.col("mix_cuts")))
        .drop("mix_name", "mix_cuts")
    )
    sums = placed.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("mix_source").alias("mix_s"),
        F.col("mix_bucket").alias("mix_b"),
        F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)).alias("mix_carry"),
    )
    inside = (
        Window.partitionBy("mix_source", "mix_bucket")
        .orderBy("mix_hash", "doc_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.withColumn("mix_run", F.sum("mix_size").over(inside) - F.col("mix_size"))
    joined = running.join(
        carried, (F.col("mix_source") == F.col("mix_s")) & (F.col("mix_bucket") == F.col("mix_b")), "left"
    )
    block = F.floor((F.col("mix_carry") + F.col("mix_run")) / F.lit(block_chars)).cast("long")
    joined = joined.withColumn("block", block)

    count = {r["mix_source"]: -(-r["size"] // block_chars) for r in stats}
    slots = slots_of(spark, count, target)
    return (
        joined.join(slots, (F.col("mix_source") == F.col("mix_name")) & (F.col("block") == F.col("mix_block")))
        .withColumn("slot", F.col("mix_slot"))
        .select(*own, "block", "slot")
    )


def in_mix_order(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, in range partitions; columns stay as they are."""
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in ("block", "slot")})
    mixed = mix(spark, named, **settings)
    ordered = mixed.repartitionByRange(F.col("slot")).sortWithinPartitions("slot", "block", "doc_id")
    back = {f"own_{c}": c for c in docs.columns if c in ("block", "slot")}
    return ordered.select(*named.columns).withColumnsRenamed(back)
