"""Near duplicates by b-bit MinHash: band candidates, corrected estimates, exact links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import Scratch, components, id_text, long_ids, written
from tonewell.llm.fertility import mixed
from tonewell.operators.scans import sorted_positions

BANDS, ROWS, BITS = 32, 6, 4
SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, low_bits array<long>"
#: Bands of the first round, whose buckets link most copies before any others are opened.
LEAD = 8
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
MARGIN = 6.0


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each whole text; A-Z count as a-z.

    ASCII bytes never occur inside another character's UTF-8 form, so lower-casing and
    splitting the bytes is exact. Fewer than ``width`` words are one shingle.
    """
    lists = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.empty(0, np.uint64) for _ in lists]
    flat = np.empty(total, dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, words = pd.factorize(flat)
    value = mixed(pd.util.hash_array(words, categorize=False))[codes]
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(total)
    key = np.zeros(total, np.uint64)
    for j in range(min(width, total)):
        reach = np.where(left > j, np.r_[value[j:], np.zeros(j, np.uint64)], np.uint64(0))
        key += reach * (mixed(np.array([j + 1], np.uint64))[0] | np.uint64(1))
    key = mixed(key + np.minimum(left, width).astype(np.uint64))
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        start = end - size
        out.append(np.unique(key[start : max(start + min(1, size), end - width + 1)]))
    return out


def hash_family(bands: int = BANDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng, n = np.random.default_rng(seed), bands * ROWS
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(shingles: np.ndarray, family) -> np.ndarray:
    """Smallest value of every hash over the set, in slices that stay in the cache."""
    odd, flip = family
    out = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        product = (part[None, :] ^ flip[:, None]) * odd[:, None]
        np.minimum(out, product.min(axis=1), out=out)
    return mixed(out)


def packed(values: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a 64-bit word."""
    low = (values & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, ROWS)
    mix = np.zeros(len(rows), np.uint64)
    for j in range(ROWS):
        mix = mixed(mix * np.uint64(0x100000001B3) + rows[:, j])
    return mixed(mix + np.arange(len(rows), dtype=np.uint64))


def sketches(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """A row per document: set size, a digest of the set, band keys, packed low bits."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = hash_family(bands)
        for batch in batches:
            rows = []
            for s in shingle_sets(batch["text"].tolist()):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                values = minima(s, family)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((len(s), key, band_keys(values).view(np.int64), packed(values).view(np.int64)))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands", "low_bits"])
            out.insert(0, "doc_id", long_ids(batch["doc_id"]))
            yield out

    text = docs.select(id_text(), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(sketch, SKETCH)


def estimate(a: Column, b: Column, hashes: int = BANDS * ROWS) -> Column:
    """Similarity from packed low bits: matches beyond those that chance gives."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return (1 - apart / hashes - chance) / (1 - chance)


def cut(threshold: float, hashes: int = BANDS * ROWS) -> float:
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - MARGIN * math.sqrt(p * (1 - p) / hashes) / (1 - chance)


def competitive(pairs: DataFrame, reps: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """Pairs ``(u, v)`` whose estimate can't be told from ``threshold`` or above."""
    bits = lambda c, name: reps.select(F.col("rep").alias(c), F.col("low_bits").alias(name))
    both = pairs.join(bits("v", "bv"), "v").join(bits("u", "bu"), "u")
    return both.filter(estimate(F.col("bu"), F.col("bv"), hashes) >= cut(threshold, hashes)).select("u", "v")


def linked(pairs: DataFrame, docs: DataFrame, threshold: int, spread: int = 256) -> DataFrame:
    """Pairs ``(u, v)`` of ``pairs`` with 100 * intersection >= threshold * union of their whole sets.

    Only the texts of the pairs leave ``docs``. Partners of a common ``u`` are cut in parts
    of about ``spread``, each with a copy of u's text, and parts are dealt into groups of
    bounded size.
    """
    scratch = Scratch(docs.sparkSession)
    count = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(spread)).alias("parts"))
    pairs = scratch.write(
        "pairs", pairs.join(count, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).drop("parts")
    )
    groups = max(1, math.ceil(pairs.count() / spread))
    group = F.pmod(F.xxhash64("u", "part"), F.lit(groups)).alias("g")
    nodes = pairs.select("u").union(pairs.select("v")).toDF("id").distinct()
    texts = scratch.write("texts", texts_of(docs, nodes.hint("merge")))
    text = lambda c: texts.select(F.col("id").alias(c), "text")
    one = pairs.select("u", "part").distinct().join(text("u"), "u").select(group, "u", F.lit(None).cast("long").alias("v"), "text")
    many = pairs.join(text("v"), "v").select(group, "u", "v", "text")

    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["u", "v"], na_position="first", kind="stable")
        out, at, first = [], None, None
        # sets in slices, so that those of a whole group are never held at once
        for a in range(0, len(batch), 64):
            part = batch.iloc[a : a + 64]
            for u, v, s in zip(part["u"], part["v"], shingle_sets(part["text"].tolist()), strict=True):
                if pd.isna(v):
                    at, first = u, s
                    continue
                if at != u:
                    raise ValueError("a partner came without its centre")
                if similar(first, s, threshold):
                    out.append((u, int(v)))
        return pd.DataFrame(out, columns=["u", "v"])

    links = written(one.union(many).groupBy("g").applyInPandas(verify, "u long, v long"), "links")
    scratch.drop("pairs", "texts")
    return links


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the documents in ``ids``, one row per id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.join(ids, "id", "left_semi").dropDuplicates(["id"])


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (bucket, rep, component, ...) in groups ``g`` of cells (bucket, i, a) of bounded size.

    Two components meet only through members outside the bucket's largest one. Blocks of
    those (``left``) meet blocks of all members, so a large component is never compared
    with itself, and every two members of different components share a cell.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("top"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("int")
    largest = largest.select("bucket", "main", blocks(F.col("n")).alias("nb"), blocks(F.col("n") - F.col("top")).alias("mb"))
    rows = members.join(largest, "bucket").withColumn("minor", F.col("component") != F.col("main"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    right = F.transform(to(F.col("mb")), lambda i: F.struct(i.alias("i"), place(F.col("nb"), 1).alias("a"), F.lit(False).alias("left")))
    left = F.transform(to(F.col("nb")), lambda a: F.struct(place(F.col("mb"), 2).alias("i"), a.alias("a"), F.lit(True).alias("left")))
    cells = F.when(F.col("minor"), F.concat(right, left)).otherwise(right)
    n = members.count()
    group = F.pmod(F.xxhash64("bucket", "i", "a"), F.lit(max(1, math.ceil(n / (4 * block)))))
    return rows.select(*members.columns, "minor", F.inline(cells)).withColumn("g", group)


def _cells(batch: pd.DataFrame, threshold: float) -> Iterator[tuple]:
    """Each cell of a group with its competitive pairs: rows of the cell, positions of both sides.

    A pair belongs to the first band in which it collides, so it is met in one bucket only.
    """
    for (bucket, _, _), rows in batch.groupby(["bucket", "i", "a"], sort=False):
        bits = np.stack(list(rows["low_bits"])).view(np.uint64)
        bands = np.stack(list(rows["bands"]))
        hashes = bands.shape[1] * ROWS
        least = cut(threshold, hashes)
        comp, rep = rows["component"].to_numpy(), rows["rep"].to_numpy()
        minor, left = rows["minor"].to_numpy(bool), rows["left"].to_numpy(bool)
        right = np.flatnonzero(~left)
        pairs = []
        for i in np.flatnonzero(left):
            js = right[(comp[right] != comp[i]) & (~minor[right] | (rep[right] > rep[i]))]
            if not len(js):
                continue
            d = bits[js] ^ bits[i]
            d |= d >> np.uint64(2)
            d |= d >> np.uint64(1)
            apart = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1)
            js = js[(1 - apart / hashes - 2.0**-BITS) / (1 - 2.0**-BITS) >= least]
            if len(js):
                same = bands[js] == bands[i]
                js = js[bands[i][same.argmax(1)] == bucket]
                pairs += [(i, j) for j in js.tolist()]
        if pairs:
            yield rows, pairs


def open_members(members: DataFrame, threshold: int, block: int = 512) -> DataFrame:
    """``(bucket, rep)`` of the members that have a competitive partner in another component."""

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        found = [
            pd.DataFrame({"bucket": rows["bucket"].iloc[0], "rep": np.unique(rows["rep"].to_numpy()[np.unique(pairs)])})
            for rows, pairs in _cells(batch, threshold / 100)
        ]
        return pd.concat(found) if found else pd.DataFrame({"bucket": [], "rep": []}).astype("int64")

    return dealt(members, block).groupBy("g").applyInPandas(compare, "bucket long, rep long").distinct()


def open_links(members: DataFrame, threshold: int, block: int = 512) -> DataFrame:
    """Links ``(u, v)`` between components among ``members``, which hold their whole ``shingles``.

    Inside a cell a pair that verified links connect already is not looked at, so a cell
    gives fewer links than it has members.
    """

    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, pairs in _cells(batch, threshold / 100):
            rep, root = rows["rep"].to_numpy(), {c: c for c in rows["component"].tolist()}
            comp, sets = rows["component"].tolist(), {}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            def shingles(i, rows=rows, sets=sets):
                if i not in sets:
                    sets[i] = np.frombuffer(rows["shingles"].iloc[i], np.uint64)
                return sets[i]

            for i, j in pairs:
                x, y = find(comp[i]), find(comp[j])
                if x != y and similar(shingles(i), shingles(j), threshold):
                    root[x] = y
                    out.append((rep[i], rep[j]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return dealt(members, block).groupBy("g").applyInPandas(verify, "u long, v long")


def whole_sets(texts: DataFrame) -> DataFrame:
    """``(id, shingles)``: the set of each text as packed 64-bit numbers."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets([t or "" for t in batch["text"]])
            yield pd.DataFrame({"id": batch["id"], "shingles": [s.tobytes() for s in sets]})

    return texts.mapInPandas(pack, "id long, shingles binary")


def near_duplicates(docs: DataFrame, threshold: int = 85, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text).

    Equal shingle sets are one class, so copies are never expanded. The classes' band
    keys form buckets. In the first ``LEAD`` bands every class of a bucket is compared with
    the bucket's smallest class, a star rather than all pairs; linked classes become
    components. Where a bucket of any band still holds several components, their classes
    are compared with each other, by packed bits and then on full sets, until links
    connect them; no link between classes that share a bucket is lost. Two sets at the
    threshold share no bucket with a probability below one in three million, for 85 and
    32 ``bands`` (for 80 it takes 48 of them, and the probability is one in two million).
    Whole texts count, however long; those of a pair are held by one task.

    Null and empty texts have no shingles and are linked with nothing. Rows that share
    a doc_id are one document for links. A null doc_id takes no part: its component is
    null and it is kept. An empty table gives no row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.write("sketches", sketches(docs, bands))
    named = sketch.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = scratch.write(
        "classes",
        named.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("low_bits").alias("low_bits")
        ),
    )
    lead = reps.select("rep", F.explode(F.slice("bands", 1, LEAD)).alias("bucket"))
    centre = lead.groupBy("bucket").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).filter("u <> top")
    star = lead.join(centre, "bucket").filter("u <> rep").select("u", F.col("rep").alias("v")).distinct()
    links = linked(competitive(star, reps, threshold / 100, bands * ROWS), docs, threshold)
    group = components(links).select(F.col("id").alias("rep"), "component")

    keyed = reps.join(group, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "bands")
    keyed = scratch.write("keyed", keyed).select("rep", "component", F.explode("bands").alias("bucket"))
    several = (
        keyed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("bucket")
    )
    members = scratch.write("members", keyed.join(several, "bucket"))
    signed = members.join(reps.select("rep", "bands", "low_bits"), "rep")
    still = scratch.write("open", open_members(signed, threshold))
    # few classes: their written size lets Spark choose a broadcast, so that no text moves
    ids = scratch.write("ids", still.select(F.col("rep").alias("id")).distinct())
    sets = whole_sets(texts_of(docs, ids)).withColumnRenamed("id", "rep")
    more = scratch.write("more", open_links(signed.join(still, ["bucket", "rep"]).join(sets, "rep"), threshold))
    scratch.drop("keyed", "members", "open", "ids")
    if not more.isEmpty():
        group = components(links.union(more)).select(F.col("id").alias("rep"), "component")

    found = reps.select("set_key", "rep").join(group, "rep", "left")
    found = found.select(F.col("set_key").alias("key"), F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(found, F.col("set_key") == F.col("key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def without_copies(docs: DataFrame, threshold: int = 85, bands: int = BANDS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id; columns stay as they are.

    Rows that share a doc_id are documents of their own here, so that no text goes but for
    one that stays: equal ones leave a single row, others stay apart. Null, blank and
    empty texts and rows with a null doc_id all stay.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    name = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        numbered = named.withColumn(name, F.col("doc_id").cast("long"))
    else:  # rows get numbers in the order of their ids
        numbered = sorted_positions(named, [], ["doc_id"], name, "numbered")
    found = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text"), threshold, bands)
    kept = found.filter("kept").select(F.col("doc_id").alias(name))
    once = numbered.join(kept.hint("merge"), name, "left_semi").select(*docs.columns)
    return once.union(docs.filter(F.col("doc_id").isNull()))
