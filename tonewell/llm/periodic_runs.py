"""Periodic runs of words: maximal pairs from the bottom-up LCP-interval tree of each text."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import id_text, long_ids

#: A run has at least ``LEAST`` words and ``POWER`` periods.
LEAST, POWER = 6, 4
#: A maximal pair of such a run shares at least this many words.
CORE = LEAST - 1
#: Words that are sorted together; a longer text is sorted alone.
SLICE = 300_000
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of the pairs (high, low)."""
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    new = np.ones(len(order), np.int64)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _ahead(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """``values`` ``step`` places after ``at``, 0 beyond the end."""
    there = at + step
    return np.where(there < len(values), values[np.minimum(there, len(values) - 1)], 0)


def suffix_array(codes: np.ndarray, doc: np.ndarray, left: np.ndarray):
    """Suffixes that share ``CORE`` words with another one of their text, sorted, with their common prefixes.

    ``codes`` are the words of several texts one after another, ``doc`` the text of each
    word and ``left`` the words from it to the end of its text. All other suffixes are
    leaves above the depth at which runs begin and are never sorted. Ranks of stretches
    double in length until all differ; the ranks of all lengths then give the prefixes.
    Returns (positions in order, prefix shared with the one before).
    """
    everything = np.arange(len(codes))
    # sums of words with random weights sort out what occurs once; what is left is ranked exactly
    weights = np.random.default_rng(3).integers(1, 1 << 62, int(codes.max(initial=0)) + 1, np.int64)
    value, key = weights[codes], doc * np.int64(0x9E3779B97F4A7C1)
    for j in range(CORE):
        key = key * np.int64(6364136223846793005) + _ahead(value, everything, j)
    at = np.flatnonzero(left >= CORE)
    ordered = np.sort(key[at])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return twice, twice
    sought = at[twice[np.minimum(np.searchsorted(twice, key[at]), len(twice) - 1)] == key[at]]
    # where shared stretches end, the words behind them order the suffixes as well
    behind = sought[left[sought] > CORE] + CORE
    at = np.unique(np.r_[sought, behind])
    rank = doc[at]
    for j in range(CORE):
        rank = _ranks(rank, np.where(left[at] > j, _ahead(codes, at, j) + 1, 0))
    levels, length = [], CORE
    full = np.zeros(len(codes), np.int32)
    while True:
        full[at] = rank
        levels.append((length, full.copy()))
        if rank.max() == len(rank):
            break
        rank = _ranks(rank, np.where(left[at] > length, _ahead(full, at, length), 0))
        length *= 2
    order = at[np.argsort(rank, kind="stable")]
    chosen = np.zeros(len(codes), bool)
    chosen[sought] = True
    order = order[chosen[order]]
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for length, ranks in reversed(levels):
        one, other = _ahead(ranks, a, 0), _ahead(ranks, b, 0)
        same = (one > 0) & (one == other) & (a < len(codes)) & (b < len(codes))
        shared += np.where(same, length, 0)
        a, b = a + np.where(same, length, 0), b + np.where(same, length, 0)
    open_ = np.ones(len(a), bool)
    end_a, end_b = order[:-1] + left[order[:-1]], order[1:] + left[order[1:]]
    for _ in range(CORE):
        inside = open_ & (a < end_a) & (b < end_b)
        last = len(codes) - 1
        open_ = inside & (codes[np.minimum(a, last)] == codes[np.minimum(b, last)])
        shared += open_
        a, b = a + open_, b + open_
    return order, np.r_[0, shared]


def maximal_pairs(order: list[int], shared: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(start, distance, common words)`` of the maximal pairs that are runs.

    The intervals of the tree are closed bottom up with a stack. Each holds its positions
    in order, with the class of each one: the word left of it (``before``). Where two
    children meet, the smaller one's positions look for the next one on both sides in
    the larger one: they come from different children, so nothing longer is shared, and
    with different classes the pair is maximal to the left as well. A run's two ends of
    a period are always neighbours, as nothing of that length repeats inside a period.
    """

    def meet(large: list[int], small: list[int], depth: int):
        reach = depth // (POWER - 1)
        for x in small:
            i = bisect_left(large, x)
            for y in large[max(0, i - 1) : i + 1]:
                q = abs(y - x)
                if q <= reach and depth + q >= LEAST and before[x] != before[y]:
                    yield min(x, y), q, depth
        if len(small) * 8 > len(large):
            large.extend(small)
            large.sort()
        else:
            for x in small:
                insort(large, x)

    if not order:
        return
    stack: list[tuple[int, list[int]]] = []  # open intervals: depth, positions met so far
    child = order[:1]
    for x, depth in zip([*order[1:], -1], [*shared[1:], 0], strict=True):
        # ``child`` is complete; what it shares with the next leaf says which intervals end here
        while stack and stack[-1][0] >= depth:
            at, rest = stack.pop()
            large, small = (rest, child) if len(rest) >= len(child) else (child, rest)
            yield from meet(large, small, at)
            child = large
            if at == depth:
                break
        if depth >= CORE:
            stack.append((depth, child))
        child = [x]


def text_runs(lists: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    flat = np.empty(total, object)
    flat[:] = [w for x in lists for w in x]
    codes = pd.factorize(flat)[0].astype(np.int64)
    doc, ends = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes)
    left = ends[doc] - np.arange(total)
    order, shared = suffix_array(codes, doc, left)
    before = np.r_[-1, codes[:-1]]
    before[(ends - sizes)[sizes > 0]] = -1  # nothing stands left of a text
    shortest: dict[tuple[int, int], int] = {}
    for start, period, common in maximal_pairs(order.tolist(), shared.tolist(), before.tolist()):
        stretch = (start, common + period)
        # a stretch of period q also has the period 2q: the smallest one names it
        shortest[stretch] = min(period, shortest.get(stretch, period))
    first = (ends - sizes).tolist()
    for (start, length), period in shortest.items():
        at = int(doc[start])
        out[at].append((start - first[at], length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run repeats: of every run only its first period stays."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def slices(lists: list[list]) -> Iterator[list[list]]:
    """Consecutive lists of ``SLICE`` words at most together, or a single longer one."""
    part, size = [], 0
    for words in lists:
        if part and size + len(words) > SLICE:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (doc_id, text).

    A run is a stretch of consecutive words with smallest period q, of at least
    ``LEAST`` words and ``POWER`` periods, that no neighbouring word extends. Maximal
    pairs of equal stretches whose distance is within these limits are exactly the runs:
    nothing is extended or probed. ``collapsed`` is the text's words joined by a blank,
    each run reduced to its first period. ``rewrite`` may replace the words of a text.

    Words are what ASCII white space separates. Texts that are null, empty or blank have
    no words, no runs and an empty ``collapsed``. Whole texts are searched, however long:
    memory grows with the longest text of a batch. Each row is judged by itself, so
    repeated rows and null ids give a row each; an empty table gives none; other
    columns are ignored.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [t.encode("utf-8", "replace").split() for t in batch["text"]]
            ids = long_ids(batch["doc_id"])
            if rewrite is not None:
                lists = [rewrite(None if i is pd.NA else int(i), words) for i, words in zip(ids, lists, strict=True)]
            found = [r for part in slices(lists) for r in text_runs(part)]
            yield pd.DataFrame(
                {
                    "doc_id": ids,
                    "n_words": [len(x) for x in lists],
                    "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found],
                    "collapsed": [b" ".join(collapsed(w, rs)).decode() for w, rs in zip(lists, found, strict=True)],
                }
            )

    text = docs.select(id_text(), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(find, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one with most periods, and digests of all runs and of the collapsed text."""
    more = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.aggregate("runs", none, more)
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
