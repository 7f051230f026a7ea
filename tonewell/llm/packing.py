"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import Tokenizers, id_text, written
from tonewell.operators.scans import sorted_positions

#: Closing id of a document.
END_ID = 2
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id string, piece int, start long, length long, ids_crc32 long, salt long, bin int, offset long, fill long"
ELITE = "pool long, island int, place int, bins int, fitness double, genes binary"


def has_places(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that each has a place in them."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


def token_pieces(docs: DataFrame, capacity: int = 1024, ordered: bool = False) -> DataFrame:
    """Pieces of every document: one, or for longer ones a first rest and full pieces.

    ``salt`` is drawn from the row's place in its partition, so repeated rows spread. With
    ``ordered`` each piece has its document's ``file`` and ``row`` as well.
    """
    places = ["file", "row"] if ordered else []

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizers()
        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text, *place in zip(*(batch[c] for c in ("doc_id", "text", *places)), strict=True):
                ids = np.array([*tok.byte_bpe(text), END_ID], "<u4")
                rest = len(ids) % capacity if len(ids) > capacity else len(ids)
                edges = ([0] if rest else []) + list(range(rest, len(ids) + 1, capacity))
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    salt = zlib.crc32(f"{part} {seen}".encode())
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), salt, *place))
                    seen += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt", *places])

    found = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")] if ordered else []
    text = docs.select(id_text(), F.coalesce("text", F.lit("")).alias("text"), *found)
    return text.mapInPandas(pieces, PIECE + (", file string, row long" if ordered else ""))


class Bins:
    """Open bins by free space; best fit is the lowest set bit above the need."""

    def __init__(self, fills: np.ndarray, capacity: int):
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.n = len(fills)
        for b, f in enumerate((capacity - fills).tolist()):
            self.free[f].append(b)
            self.mask |= 1 << f
        self.capacity = capacity

    def put(self, size: int) -> int:
        above = self.mask >> size
        if above:
            f = size + (above & -above).bit_length() - 1
            stack = self.free[f]
            b = stack.pop()
            if not stack:
                self.mask &= ~(1 << f)
        else:
            f, b = self.capacity, self.n
            self.n += 1
        self.free[f - size].append(b)
        self.mask |= 1 << (f - size)
        return b


def best_fit(genes: np.ndarray, sizes: np.ndarray, items: np.ndarray, capacity: int, n_bins: int) -> np.ndarray:
    """Put ``items`` into the bins of ``genes`` (-1: not placed), in the given order."""
    fills = np.bincount(genes[genes >= 0], sizes[genes >= 0], n_bins).astype(np.int64)
    bins = Bins(fills, capacity)
    genes = genes.copy()
    genes[items] = [bins.put(s) for s in sizes[items].tolist()]
    return genes


def tidy(genes: np.ndarray) -> np.ndarray:
    return np.unique(genes, return_inverse=True)[1].astype(np.int32)


def fitness(genes: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill: prefers few bins, and among equals full ones beside empty ones."""
    fills = np.bincount(genes, sizes) / capacity
    return float((fills**2).sum() / max(1, len(fills)))


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject whole well-filled bins of ``b`` into ``a``; displaced documents go in by best fit."""
    fills = np.bincount(b, sizes)
    order = np.argsort(-fills, kind="stable")
    well = order[: max(1, len(order) * 3 // 4)]
    taken = well[rng.random(len(well)) < rng.uniform(0.15, 0.5)]
    chosen = np.zeros(len(fills), bool)
    chosen[taken] = True
    injected = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True  # bins of a that hold a duplicate
    child = np.where(hit[a], -1, a)
    child[injected] = a.max() + 1 + b[injected]
    n = int(a.max() + 1 + len(fills))
    child, loose = _compact(child, n)
    return _refill(child, sizes, loose, capacity)


def mutate(genes: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Open the emptiest bins and a few others, and best-fit what they held."""
    fills = np.bincount(genes, sizes)
    order = np.argsort(fills, kind="stable")
    few = max(1, len(order) // 50)
    gone = np.zeros(len(fills), bool)
    gone[order[:few]] = True
    gone[rng.integers(0, len(fills), few)] = True
    child, loose = _compact(np.where(gone[genes], -1, genes), len(fills))
    return _refill(child, sizes, loose, capacity)


def _compact(genes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    used = np.zeros(n, bool)
    used[genes[genes >= 0]] = True
    label = np.cumsum(used) - 1
    return np.where(genes >= 0, label[genes], -1).astype(np.int32), np.flatnonzero(genes < 0)


def _refill(genes, sizes, loose, capacity):
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    return tidy(best_fit(genes, sizes, loose, capacity, int(genes.max(initial=-1)) + 1))


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int, generations: int):
    """The best few groupings after some generations; stops at the lower bound."""
    rng = np.random.default_rng(seed)
    bound = math.ceil(int(sizes.sum()) / capacity)
    empty = np.full(len(sizes), -1, np.int32)
    pool = list(elites)
    order = np.argsort(-sizes, kind="stable")
    while len(pool) < population:
        noisy = order if not pool else np.argsort(-(sizes * rng.uniform(0.85, 1.0, len(sizes))), kind="stable")
        pool.append(tidy(best_fit(empty, sizes, noisy, capacity, 0)))
        if pool[-1].max() + 1 <= bound:
            break
    key = lambda g: (int(g.max()) + 1, -fitness(g, sizes, capacity))
    ranked = sorted(((key(g), i, g) for i, g in enumerate(pool)), key=lambda x: x[:2])
    count = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        born = []
        for _ in range(population // 2):
            i, j = sorted(rng.choice(len(ranked), 2, replace=False))
            child = cross(ranked[j][2], ranked[i][2], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, sizes, capacity, rng)
            count += 1
            born.append((key(child), count, child))
        ranked = sorted(ranked + born, key=lambda x: x[:2])[:population]
    return ranked


def _in_order(items: pd.DataFrame) -> pd.DataFrame:
    """The order that genes refer to. Rows alike in all columns are interchangeable."""
    return items.sort_values(["length", "salt", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(
        drop=True
    )


def pack_level(
    items: DataFrame, capacity: int, pool_rows: int, islands: int, epochs: int, seed: int, label: str
) -> DataFrame:
    """Place every item in a bin of its pool: islands evolve, elites move on after each epoch.

    Items with a ``turn`` keep together with their neighbours, others are dealt by their salt.
    """
    ordered = "turn" in items.columns
    if ordered:
        items = sorted_positions(items, [], ["turn"], "pool", f"{label}-pools")
        items = items.withColumn("pool", F.floor(F.col("pool") / pool_rows))
    else:
        pools = max(1, math.ceil(items.count() / pool_rows))
        items = items.withColumn("pool", F.pmod(F.col("salt"), F.lit(pools)).cast("long"))
    homes = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    def run(epoch: int):
        def fn(key, group: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
            if not len(group):
                return pd.DataFrame(columns=["pool", "island", "place", "bins", "fitness", "genes"])
            sizes = _in_order(group)["length"].to_numpy(np.int64)
            elites = [np.frombuffer(g, np.int32) for g in arrived.sort_values(["island", "place"])["genes"]]
            draw = zlib.crc32(f"{seed} {key[0]} {key[1]} {epoch}".encode())
            best = evolve(sizes, elites, capacity, draw, population=6, generations=6)[:2]
            return pd.DataFrame(
                [(key[0], key[1], i, k[0], -k[1], g.tobytes()) for i, (k, _, g) in enumerate(best)],
                columns=["pool", "island", "place", "bins", "fitness", "genes"],
            )

        return fn

    elites = items.sparkSession.createDataFrame([], ELITE)
    for epoch in range(epochs):
        own = elites
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).filter("place = 0")
        arrived = own.union(moved)
        grown = homes.groupBy("pool", "island").cogroup(arrived.groupBy("pool", "island")).applyInPandas(run(epoch), ELITE)
        elites = written(grown, f"{label}-elites")
    best = (
        elites.filter("place = 0")
        .groupBy("pool")
        .agg(F.min_by("genes", F.struct("bins", -F.col("fitness"), "island")).alias("genes"))
    )

    def place(key, group: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        group = _in_order(group)
        genes = np.frombuffer(chosen["genes"].iloc[0], np.int32)
        sizes = group["length"].to_numpy(np.int64)
        order = np.argsort(genes, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.r_[True, np.diff(genes[order]) > 0]
        before = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - before
        fill = np.bincount(genes, sizes).astype(np.int64)[genes]
        group = group.drop(columns="pool").assign(bin=genes, offset=offset, fill=fill)
        if ordered:
            group["first_turn"] = group.groupby("bin")["turn"].transform("min")
        return group

    schema = f"{PLACED}{', turn long, first_turn long' if ordered else ''}, pool long"
    fn = lambda key, g, c: place(key, g, c).assign(pool=key[0])
    return items.groupBy("pool").cogroup(best.groupBy("pool")).applyInPandas(fn, schema)


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    pool_rows: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    well_filled: float = 0.985,
    seed: int = 7,
    in_order: bool = False,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A piece of ``capacity`` tokens is a sequence by itself. The others are dealt by
    their salt into pools of about ``pool_rows``, whatever source they come from. Every
    pool is evolved by several islands; after each epoch an island's best grouping
    moves to the next one. Pieces in bins that are not ``well_filled`` form new pools
    once more, so that a pool leaves no rest of its own.

    With ``in_order`` the order of ``docs`` in their files is that of the stream to come
    (rows without a place in files are dealt as above): a pool is some ``pool_rows``
    pieces in a row, and ``sequence_turn``, the place of a sequence's first piece, orders the
    sequences, so that up to the end of any pool the stream holds what the files held up to
    there, but for the pieces of bins that are packed once more.

    Null text counts as empty (one closing id). Whole texts are packed, however long. Repeated rows and ids are packed once
    per row. An empty table gives no row. Other columns are ignored.
    """
    in_order = in_order and has_places(docs)
    pieces = written(token_pieces(docs, capacity, in_order), "pieces")
    if in_order:
        pieces = sorted_positions(pieces, [], ["file", "row", "piece"], "turn", "turns").drop("file", "row")
        pieces = written(pieces, "ordered")
    short = pieces.filter(F.col("length") < capacity)
    first = written(pack_level(short, capacity, pool_rows, islands, epochs, seed, "pack"), "packed")
    done = F.col("fill") >= well_filled * capacity
    placed = [c for c in ("bin", "offset", "fill", "pool", "first_turn") if c in first.columns]
    rest = pack_level(first.filter(~done).drop(*placed), capacity, pool_rows, islands, epochs, seed + 1, "rest")
    ident = (F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32")
    step = F.lit(2 * pool_rows * 64).cast("long")

    def turn(name: str) -> list[Column]:
        return [F.col(name).alias("sequence_turn")] if in_order else []

    def numbered(df: DataFrame, level: int) -> DataFrame:
        sequence = ((F.col("pool") * step + F.col("bin")) * 2 + level).alias("sequence_id")
        return df.select(*ident, sequence, "offset", *turn("first_turn"))

    full = pieces.filter(F.col("length") >= capacity).select(
        *ident, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *turn("turn")
    )
    return full.union(numbered(first.filter(done), 0)).union(numbered(rest, 1))
