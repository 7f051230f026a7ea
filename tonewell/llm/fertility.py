"""Quality rules on how public vocabularies cut a text: fertility, byte fallback, token entropy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.llm.common import WORD, Tokenizers, id_text, long_ids, written

MEASURES = (
    "doc_id long, band_key string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_fallback_share double, token_entropy double"
)
SYMBOLS = r"[#*$%&|<>]"
SIGNALS = ("chars_per_token", "token_entropy", "byte_fallback_share")
#: Share of byte pieces that a text of any language may have.
FALLBACK_FLOOR = 0.05
#: Texts that a script counts for beside one of its languages, and a language beside one of its length classes.
SCRIPT_COUNTS, LANGUAGE_COUNTS = 20, 200
#: First and last code points of the scripts told apart; other letters go by their 256 code points.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("syriac", 0x700, 0x74F), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads small codes over all bits."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(lists: list[list[str]], window: int = 8) -> np.ndarray:
    """Words of each list that lie in a window of words found twice or more in the list."""
    sizes = np.array([len(x) for x in lists])
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(lists), np.int64)
    codes = pd.factorize(np.array([w for x in lists for w in x], dtype=object))[0].astype(np.uint64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # words to the end of the list
    key = mixed(doc.astype(np.uint64) << np.uint64(32))
    value = mixed(codes)
    for j in range(min(window, total)):
        key[: total - j] += value[j:] * mixed(np.array([j + 1], np.uint64))[0]
    at = np.flatnonzero(left >= window)
    _, inverse, counts = np.unique(key[at], return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc, covered, len(lists)).astype(np.int64)


def script_table() -> tuple[list[str], np.ndarray]:
    """Script names, and for each code point the place of its script; 0 is no letter, 1 another one."""
    names = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
    table = np.ones(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        table[a : b + 1] = names.index(name)
    table[:0x41] = 0
    table[0x5A:0x61] = 0
    return names, table


SCRIPT_NAMES, SCRIPT_TABLE = script_table()


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(SCRIPT_TABLE[points], minlength=len(SCRIPT_NAMES))
    letters = int(counts[1:].sum())
    if not letters:
        return "none"
    best = int(counts[2:].argmax()) + 2
    if counts[best] * 2 > letters:
        return SCRIPT_NAMES[best]
    pages = np.bincount(points[SCRIPT_TABLE[points] == 1] >> 8, minlength=1)
    return f"page {pages.argmax():x}" if pages.max() * 2 > letters else "other"


class FallbackShare:
    """Share of byte pieces in the piece vocabulary's segmentation, white space aside."""

    def __init__(self, tokenizers: Tokenizers):
        self.model = tokenizers.pieces()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        single = "".join(re.escape(p) for p in pieces if len(p) == 1)
        self.known = re.compile(f"[{single}\\s]*")
        self.byte = {i for i, p in enumerate(pieces) if self.model.is_byte(i)}
        self.blank = {i for i in self.byte if int(pieces[i][3:5], 16) in (9, 10, 11, 12, 13, 32)}

    def __call__(self, text: str) -> float:
        if self.known.fullmatch(text):  # every character is a piece: nothing falls back
            return 0.0
        ids = self.model.encode(text, num_threads=1)
        counted = [i for i in ids if i not in self.blank]
        return sum(i in self.byte for i in counted) / max(1, len(counted))


def measures(docs: DataFrame) -> DataFrame:
    """The counts of every whole text; null text counts as empty."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizers()
        fallback = FallbackShare(tok)
        word, symbol = re.compile(WORD), re.compile(SYMBOLS)
        for batch in batches:
            texts = batch["text"].tolist()
            lists = [word.findall(t) for t in texts]
            rows = []
            for doc_id, lang, text, words in zip(batch["doc_id"], batch["lang"], texts, lists, strict=True):
                script = script_of(text)
                lines = [x for x in text.split("\n") if word.search(x)]
                ids = np.array(tok.byte_bpe(text), np.int64)
                counts = np.unique(ids, return_counts=True)[1]
                share = counts / max(1, len(ids))
                # as a part of what so many tokens can have: long and short texts compare
                entropy = float(-(share * np.log2(share)).sum() / np.log2(max(2, len(ids))))
                rows.append(
                    (
                        doc_id, lang if lang is not None and lang.strip() else script, script, len(words),
                        sum(map(len, words)), len(symbol.findall(text)), len(lines) - len(set(lines)), 0, len(ids),
                        len(text) / max(1, len(ids)), fallback(text), entropy,
                    )
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])
            out["n_repeat_words"] = repeated_words(lists)
            yield out.assign(doc_id=long_ids(batch["doc_id"]))

    text = docs.select(
        id_text(),
        F.lower(F.trim("lang")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return text.mapInPandas(measure, MEASURES)


def bands(measured: DataFrame, reach: float = 2.5) -> DataFrame:
    """``(band_key, size_class, script, level, n, low and high of each signal)`` from all rows given.

    A band is the quartiles widened by ``reach`` interquartile distances, at least 5 %
    of the median, on both sides and from the group's own texts only; the share of byte
    pieces has an upper edge alone, at least ``FALLBACK_FLOOR``. Level 0 is a language and length class, level 1 the language,
    level 2 a script in any language; level 3 names what stands together and its edges serve
    nothing. Quartiles of n texts are uncertain, so that 12 / sqrt(n) distances, some three
    standard errors, come on top for a language and a script. Every group has a band,
    however small.
    """
    quartiles = [F.percentile_approx(s, [0.25, 0.5, 0.75], 10000).alias(s) for s in SIGNALS]
    keys = ["band_key", "size_class", "script"]
    rolled = measured.groupingSets([keys, keys[:2], keys[:1], keys[2:]], *keys).agg(
        F.grouping_id().alias("id"), F.count("*").alias("n"), *quartiles
    )
    level = F.when(F.col("id") == 1, 0).when(F.col("id") == 3, 1).when(F.col("id") == 6, 2).otherwise(3)
    reach_n = F.lit(reach) + F.when(level == 0, 0.0).otherwise(F.lit(12.0) / F.sqrt("n"))

    def edge(signal: str, side: int) -> Column:
        q = F.col(signal)
        spread = F.greatest(reach_n * (q[2] - q[0]), 0.05 * q[1])
        low, high = q[0] - spread, q[2] + spread
        if signal == "byte_fallback_share":
            low, high = F.lit(0.0), F.greatest(high, F.lit(FALLBACK_FLOOR))
        return high.alias(f"{signal}_high") if side else low.alias(f"{signal}_low")

    return rolled.select(*keys, level.alias("level"), "n", *[edge(s, side) for s in SIGNALS for side in (0, 1)])


def reached(band: DataFrame) -> DataFrame:
    """The bands of texts by language, length class and script: level 0 averaged with level 1, which level 2 may widen.

    A group of n texts counts n beside ``LANGUAGE_COUNTS`` or ``SCRIPT_COUNTS`` of the wider
    one, so that it grows into its own band without a step. A script only moves edges
    outwards: texts of a rare language are not rejected for being unlike those of others,
    and the few of a language that has hardly any are not judged.
    """

    def of(n: int, *keys: str) -> DataFrame:
        edges = F.struct("n", *[f"{s}_{side}" for s in SIGNALS for side in ("low", "high")])
        return band.filter(F.col("level") == n).select(*[F.col(k).alias(f"{k}{n}") for k in keys], edges.alias(f"band{n}"))

    mean = lambda a, n, b, m: (n * a + m * b) / (n + m)
    same = lambda n, *keys: [F.col(f"{k}3") == F.col(f"{k}{n}") for k in keys]
    joined = (
        of(3, "band_key", "size_class", "script")
        .join(of(0, "band_key", "size_class"), same(0, "band_key", "size_class"))
        .join(of(1, "band_key"), same(1, "band_key"))
        .join(of(2, "script"), same(2, "script"))
    )

    def edge(signal: str, side: str) -> Column:
        own, language, script = (F.col(f"band{n}")[f"{signal}_{side}"] for n in (0, 1, 2))
        drawn = mean(language, F.col("band1")["n"], script, SCRIPT_COUNTS)
        outer = F.least(language, drawn) if side == "low" else F.greatest(language, drawn)
        return mean(own, F.col("band0")["n"], outer, LANGUAGE_COUNTS).alias(f"{signal}_{side}")

    keys = [F.col(f"{k}3").alias(f"for_{k}") for k in ("band_key", "size_class", "script")]
    return joined.select(*keys, *[edge(s, side) for s in SIGNALS for side in ("low", "high")])


def rules(docs: DataFrame) -> DataFrame:
    """Base counts, fertility measures and the verdict of every row of ``docs`` (doc_id, text, lang).

    Base: too few words, or too many inside repeated windows. Then the text must lie
    inside the bands of its language (its script where lang is null or blank) for
    characters per token, token entropy and the share of byte pieces (which may always
    be 5 %). Bands come from all texts of the same language or script that pass the base;
    see ``bands`` and ``reached``. Null text is empty and fails the base. Whole texts are
    measured, however long; runs of thousands of like characters take the vocabulary
    file's own library. Repeated rows are judged once each; an empty table gives no row;
    other columns are ignored.
    """
    size_class = F.floor(F.log2(F.col("n_tokens") + 1)).cast("int")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = written(measures(docs), "fertility").withColumns({"size_class": size_class, "base_failed": failed})
    # a few rows per language, whose written size lets Spark choose a broadcast
    band = written(reached(written(bands(found.filter("NOT base_failed")), "bands")), "reached")
    match = [F.col(k) == F.col(f"for_{k}") for k in ("band_key", "size_class", "script")]
    inside = F.lit(True)
    for s in SIGNALS:
        inside = inside & F.col(s).between(F.col(f"{s}_low"), F.col(f"{s}_high"))
    return found.join(band, match, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        "band_key", "n_tokens", "chars_per_token", "byte_fallback_share", "token_entropy",
    )
