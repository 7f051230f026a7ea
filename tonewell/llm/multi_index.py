"""Near-duplicate vectors: an inverted multi-index over vector halves, links confirmed by cosine."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import Scratch, components, id_text, long_ids

#: Rows that fit the codebooks, and those of them whose partners set the traversal's stop.
SAMPLE_ROWS, PROBE_ROWS = 20_000, 2_000
#: Rows of a cell that are compared with each other at a time, and rows that a cell should hold.
BLOCK, CELL_ROWS = 2048, 50
#: Codewords of a half at most; the grid has the square of that many cells.
MOST_CODES = 256
#: Parts at least into which the rows of one class of equal vectors are dealt when they get their
#: result, and rows of such a part in the largest class.
SALTS, SALT_ROWS = 16, 1_000_000
#: Least stop of the traversal, in standard deviations of the shift that a partner at the radius,
#: moved in any direction, makes along one direction.
LEAST_SPREAD = 1.25
ROWS = "vec_id long, key binary, vector array<{}>"
HOMES = "key binary, rep long, n long, vector array<{}>, cell int, visits array<int>"


def matrix(rows, width: int) -> np.ndarray:
    """Unit rows in double precision; shorter vectors have zeros in the dimensions they lack."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    # scaled first, so that squares neither overflow nor vanish
    out /= np.abs(out).max(1, initial=0, keepdims=True) + (len(rows) == 0)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, key, vector)``: key is a digest of the vector, null where it takes no part."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for vec_id, row in zip(batch["vec_id"], batch["vector"], strict=True):
                key = None
                if not pd.isna(vec_id) and row is not None:
                    row = np.asarray(row, np.float64) + 0.0  # null components become nan, -0 becomes 0
                    if len(row) and np.isfinite(row).all() and row.any():
                        key = hashlib.blake2b(np.trim_zeros(row, "b").tobytes(), digest_size=16).digest()
                keys.append(key)
            out = pd.DataFrame({"vec_id": long_ids(batch["vec_id"]), "key": keys})
            out["vector"] = [v if k is not None else None for v, k in zip(batch["vector"], keys, strict=True)]
            yield out

    rows = vectors.select(id_text(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    return rows.mapInPandas(digest, ROWS.format(kind))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """At most ``k`` codewords of the rows of ``x``; the sample is bounded, so this is a helper, not a job."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(seed).permutation(len(centres))[:k]].copy()
    for _ in range(rounds):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class MultiIndex:
    """Codebooks of both halves; a cell is a pair of codewords."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.halves = (first, second)
        self.apart = [np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) for c in self.halves]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int) -> MultiIndex:
        half, k = sample.shape[1] // 2, int(min(MOST_CODES, max(1, round(math.sqrt(rows / CELL_ROWS)))))
        blank = np.zeros((1, sample.shape[1]))
        sample = sample if len(sample) else blank
        return cls(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k))

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For both halves the squared distance of each row to each codeword's region (0: its own), and its cell."""
        half, out, own = self.halves[0].shape[1], [], []
        for codes, apart, part in zip(self.halves, self.apart, (x[:, :half], x[:, half:]), strict=True):
            square = np.maximum(0, (part**2).sum(1)[:, None] + (codes**2).sum(1) - 2 * part @ codes.T)
            near = square.argmin(1)
            own.append(near)
            # to the plane halfway between the own codeword and the other one
            beyond = square - square[np.arange(len(x)), near][:, None]
            out.append((beyond / np.maximum(2 * apart[near], 1e-12)) ** 2)
        return out, own[0] * len(self.halves[1]) + own[1]

    def traverse(self, a: np.ndarray, b: np.ndarray, stop: float) -> list[int]:
        """Cells in order of a[i] + b[j], up to ``stop``: the multi-sequence walk over both sorted lists."""
        p, q = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        heap, seen, out = [(a[p[0]] + b[q[0]], 0, 0)], {(0, 0)}, []
        while heap and heap[0][0] <= stop:
            _, i, j = heapq.heappop(heap)
            out.append(p[i] * len(b) + q[j])
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < len(p) and step[1] < len(q) and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (a[p[step[0]]] + b[q[step[1]]], *step))
        return out

    def stop(self, sample: np.ndarray, threshold: float, target_recall: float) -> float:
        """Where the walk may end: the target share of the sample's true partners lies in visited cells.

        Partners found in the sample set it, but never below what a partner at the radius
        needs that is moved in any direction. A recall of 1 walks every cell that a partner could be in.
        """
        radius = 2 - 2 * threshold
        if target_recall >= 1:
            return radius
        least = LEAST_SPREAD**2 * radius / max(1, sample.shape[1])
        probes = sample[:PROBE_ROWS]
        u, v = np.nonzero(probes @ sample.T >= threshold) if len(sample) else (np.empty(0, int),) * 2
        u, v = u[u < v], v[u < v]
        if not len(u):
            return least
        (a, b), cell = self.bounds(sample)
        width = len(self.halves[1])
        there = a[u, cell[v] // width] + b[u, cell[v] % width]
        back = a[v, cell[u] // width] + b[v, cell[u] % width]
        return max(least, float(np.quantile(np.minimum(there, back), target_recall)))


def homes(classes: DataFrame, index: MultiIndex, width: int, stop: float) -> DataFrame:
    """Each class with its own cell and the other cells its walk visits."""
    kind = classes.schema["vector"].dataType.elementType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            (a, b), cell = index.bounds(matrix(batch["vector"], width))
            walks = [index.traverse(x, y, stop) for x, y in zip(a, b, strict=True)]
            batch["cell"] = cell.astype(np.int32)
            batch["visits"] = [[c for c in walk if c != own] for walk, own in zip(walks, cell.tolist(), strict=True)]
            yield batch

    return classes.select("key", "rep", "n", "vector").mapInPandas(place, HOMES.format(kind))


def dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (at, key, ...) in groups ``g`` of bounded size, each of cells' block pairs (at, i, j)."""
    sizes = members.groupBy("at").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    # a row per cell of the grid, 65,536 at most: the members themselves are shuffled once
    rows = members.join(F.broadcast(sizes), "at").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"))
    rows = rows.select(
        *members.columns, "b", F.inline(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    )
    n = members.count()
    return rows.withColumn("g", F.pmod(F.xxhash64("at", "i", "j"), F.lit(max(1, math.ceil(n / (2 * block))))))


def group_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the symmetric matrix ``linked``, for each row."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] >= 0:
            continue
        label[i] = i
        edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & (label < 0))
            label[edge] = i
    return label


def _pairs(left: pd.DataFrame, right: pd.DataFrame, same: bool, at: int, width: int, threshold: float) -> np.ndarray:
    """Which of ``left`` x ``right`` are links that this cell counts: each link belongs to one cell."""
    link = matrix(left["vector"], width) @ matrix(right["vector"], width).T >= threshold
    if same:
        link &= np.arange(len(left))[:, None] < np.arange(len(right))
    for one, other, flip in ((left, right, False), (right, left, True)):
        # a visitor met at home, where the home row also visits the visitor's smaller cell
        cells, place = np.unique(other["cell"].to_numpy(), return_inverse=True)
        visits = np.zeros((len(one), len(cells)), bool)
        for i, (cell, walk) in enumerate(zip(one["cell"], one["visits"], strict=True)):
            if cell == at:
                visits[i] = (cells < at) & np.isin(cells, walk)
        skip = visits[:, place]
        link &= ~(skip.T if flip else skip)
    away = (left["cell"].to_numpy() != at)[:, None] & (right["cell"].to_numpy() != at)
    return link & ~away


def links(members: DataFrame, width: int, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(key, links)`` of each class, in parts, and ``(u, v)`` rows that connect what is linked.

    A block pair gives one row per class that has links and one connecting row per class
    at most, however many links there are.
    """
    schema = "key binary, links long, u long, v long"

    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (at, i, j), cell in batch.groupby(["at", "i", "j"], sort=False):
            left, right = cell[cell["b"] == i], cell[cell["b"] == j]
            if not len(left) or not len(right):
                continue
            link = _pairs(left, right, i == j, at, width, threshold)
            if not link.any():
                continue
            key = np.concatenate([left["key"], right["key"]])
            rep = np.concatenate([left["rep"], right["rep"]])
            count = np.concatenate([link @ right["n"].to_numpy(), link.T @ left["n"].to_numpy()])
            both = np.zeros((len(key), len(key)), bool)
            both[: len(left), len(left) :] = link
            both |= both.T
            if i == j:  # the same rows stand on both sides
                both |= np.eye(len(key), k=len(left), dtype=bool) | np.eye(len(key), k=-len(left), dtype=bool)
            some = np.flatnonzero(count)
            label = group_labels(both)
            out.append(pd.DataFrame({"key": key[some], "links": count[some], "u": rep[some], "v": rep[label[some]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "links", "u", "v"])

    found = Scratch(members.sparkSession).write("links", dealt(members, block).groupBy("g").applyInPandas(verify, schema))
    return found.groupBy("key").agg(F.sum("links").alias("links")), found.select("u", "v")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    target_recall: float = 0.9999,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: vectors are linked by a cosine of at least ``threshold``.

    Equal vectors are one class and never compared. Codebooks of both halves, fitted on
    at most ``SAMPLE_ROWS`` classes drawn by hash, form a grid of cells that holds every
    class. Each class walks the grid from its nearest cell on until the share
    ``target_recall`` of partners is met, and is compared in full, in double precision,
    with the rows of the visited cells; whichever of two partners visits the other's
    cell finds the link. Cells with many rows are compared in blocks; links are counted
    there, and only what connects the rows leaves a block. A ``target_recall`` of 1
    visits every cell that could hold a partner.

    Vectors that are null, empty, zero, or hold null or non-finite components are
    linked with nothing and keep their own component; so do rows with a null id, whose
    component is null and which are kept. A shorter vector has zeros in the dimensions
    it lacks. Equal rows are linked with each other; rows that repeat an id are one node
    of the components and count their links each. An empty table gives no row; other
    columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write("vectors", keyed(vectors, id_col, vector_col))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")
    )
    classes = scratch.write("classes", classes)
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max("n").alias("top")).first()
    width, salts = max(2, size["width"] or 0), F.lit(max(SALTS, math.ceil((size["top"] or 0) / SALT_ROWS)))
    drawn = classes.select("vector", F.xxhash64("key").alias("draw"), "key").orderBy("draw", "key").limit(SAMPLE_ROWS)
    sample = matrix([r["vector"] for r in drawn.select("vector").collect()], width)
    index = MultiIndex.fit(sample, size["n"])
    home = scratch.write("homes", homes(classes, index, width, index.stop(sample, threshold, target_recall)))
    at = F.explode(F.concat(F.array("cell"), "visits")).alias("at")
    counts, joined = links(home.select("key", "rep", "n", "vector", "cell", "visits", at), width, threshold, block)

    group = components(joined).select(F.col("id").alias("rep"), "component")
    classed = classes.select("key", "rep", "n").join(counts, "key", "left").join(group, "rep", "left")
    # a class of many rows meets them in several places
    salt = F.when(F.col("n") > 1, F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).otherwise(F.array(F.pmod("rep", salts)))
    classed = classed.select(
        F.col("key").alias("of"), F.explode(salt).alias("salt"), F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
    )
    here = (F.col("key") == F.col("of")) & (F.pmod("vec_id", salts) == F.col("salt"))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "key").join(classed, here, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
