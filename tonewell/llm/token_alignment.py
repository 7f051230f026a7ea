"""Alignment of two tokenizers' segmentations of the same bytes by as-of merges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewell.llm.common import Scratch, Tokenizers, id_text, long_ids

#: Bytes of text whose tokens are merged at a time, and whose links are written as one chunk; a longer text is one alone.
SLICE_BYTES, CHUNK_BYTES = 1 << 19, 2 << 20
#: Distinct pairs of one message about a chunk.
PART = 16_384
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string"
#: A row per chunk, which numbers its distinct pairs: where each document's links end, and the pair of each link.
#: Ids are text, as pandas would make those next to a null into floats.
CHUNKS = f"chunk string, documents array<struct<{DOCUMENT.replace('doc_id long', 'doc_id string')}>>, " + (
    "ends array<long>, places binary, pairs array<struct<a int, b int, n long>>"
)


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Segmenters:
    """Ids and token bytes of both vocabularies, opened once per worker."""

    def __init__(self):
        self.tok = Tokenizers()
        value = byte_values()
        vocabulary = self.tok.file("byte_bpe_50k.json").get_vocab(with_added_tokens=True)
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        model = self.tok.pieces("piece_bpe_32k.model")
        self.b = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        sides = (self.a, self.b)
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
        self.bytes = [np.frombuffer(b"".join(side), np.uint8) for side in sides]
        self.first = [np.cumsum(size) - size for size in self.sizes]
        # an id with what stands behind it: A inside and at the end of a group, B likewise
        marked = [[f"{i}{mark}" for i in range(len(side))] for side, marks in zip(sides, (",|", ",;"), strict=True) for mark in marks]
        self.shown = np.array([x for ids in marked for x in ids], object)
        self.row = np.cumsum([0, *map(len, marked)])

    def joined(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another."""
        size = self.sizes[side][ids]
        end = np.cumsum(size)
        return self.bytes[side][np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[side][ids] - end + size, size)]

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side (ids of all texts, number of each text's); none of a text whose bytes either side doesn't give back."""
        there = [i for i, t in enumerate(texts) if t]
        cut = [
            [self.tok.byte_bpe(" " + texts[i]) for i in there],
            self.tok.pieces("piece_bpe_32k.model").encode([texts[i] for i in there], num_threads=1) if there else [],
        ]
        raw = [b" " + texts[i].encode("utf-8", "replace") for i in there]
        whole = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        good, sides = np.ones(len(there), bool), []
        for side, ids in enumerate(cut):
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
            got = np.cumsum(np.r_[0, self.sizes[side][flat]])[np.cumsum(count)]
            joined = self.joined(side, flat)
            if not (np.array_equal(got, ends) and np.array_equal(joined, whole)):
                starts = np.r_[0, got[:-1]]
                for i, (x, y) in enumerate(zip(starts.tolist(), got.tolist(), strict=True)):
                    good[i] &= joined[x:y].tobytes() == raw[i]
            sides.append((flat, count))
        out = []
        for flat, count in sides:
            full = np.zeros(len(texts), np.int64)
            full[there] = np.where(good, count, 0)
            out.append((flat[np.repeat(good, count)], full))
        return out


def tokens(flat: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """``(document, id, place, start, end)`` of consecutive texts' tokens; bytes are numbered through all texts."""
    end = np.cumsum(sizes[flat])
    return pd.DataFrame(
        {
            "document": np.repeat(np.arange(len(count)), count),
            "id": flat,
            "place": np.arange(len(flat)),
            "start": end - sizes[flat],
            "end": end,
        }
    )


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of all token pairs with a byte in common, in order.

    An as-of merge per direction, keyed by document: the start of each token finds the
    token of the other side that covers it. Of two tokens that overlap the later start
    lies in the other token, so the union of both directions has every pair.
    """
    both = []
    for left, right in ((a, b), (b, a)):
        met = pd.merge_asof(
            left[["start", "place", "document"]],
            right[["start", "place", "document"]],
            on="start", by="document", suffixes=("", "_other"),
        )
        one, other = met["place"].to_numpy(), met["place_other"].to_numpy().astype(np.int64)
        both.append(one * len(b) + other if left is a else other * len(b) + one)
    pair = np.sort(np.concatenate(both))
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
    return pair // len(b), pair % len(b)


def shown_groups(a: pd.DataFrame, b: pd.DataFrame, i: np.ndarray, j: np.ndarray, segment: Segmenters) -> np.ndarray:
    """Both sides' ids as they are shown, ``a1,a2|b1;a3|b2,b3;``, in order; ``i`` and ``j`` end together."""
    last = [np.zeros(len(side), np.int64) for side in (a, b)]
    last[0][i], last[1][j] = 1, 1
    # a group's ids stand after those of the groups before it, B's after A's
    group = [np.cumsum(x) - x for x in last]
    place = [
        a["place"].to_numpy() + np.r_[0, j + 1][group[0]],
        b["place"].to_numpy() + (i + 1)[group[1]],
    ]
    out = np.empty(len(a) + len(b), object)
    for side, (frame, at, end) in enumerate(zip((a, b), place, last, strict=True)):
        out[at] = segment.shown[segment.row[2 * side + end] + frame["id"].to_numpy()]
    return out


def align(texts: list[str | None], segment: Segmenters):
    """Counts and digest of each text, and its links as (text, A id, B id) arrays.

    Returns (list of (n_a, n_b, n_groups, n_links, n_overlaps, digest), text, A id, B id of the links).
    """
    cut = segment(texts)
    a, b = (tokens(*cut[side], segment.sizes[side]) for side in (0, 1))
    if not len(a):
        return [(0, 0, 0, 0, 0, "")] * len(texts), *(np.empty(0, np.int64),) * 3
    i, j = overlaps(a, b)
    document = a["document"].to_numpy()
    overlapping = np.bincount(document[i], minlength=len(texts)).tolist()
    together = a["end"].to_numpy()[i] == b["end"].to_numpy()[j]
    i, j = i[together], j[together]
    linked = document[i]
    links = np.bincount(linked, minlength=len(texts)).tolist()
    shown, at, rows = shown_groups(a, b, i, j, segment), 0, []
    for x, y, n, more in zip(cut[0][1].tolist(), cut[1][1].tolist(), links, overlapping, strict=True):
        part = "".join(shown[at : at + x + y].tolist())[:-1]
        at += x + y
        rows.append((x, y, n, n, more, hashlib.sha256(part.encode()).hexdigest() if x else ""))
    return rows, linked, a["id"].to_numpy()[i], b["id"].to_numpy()[j]


def slices(texts: list[str | None], limit: int) -> Iterator[range]:
    """Consecutive texts of ``limit`` characters at most together, or a single longer one."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > limit:
            yield range(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield range(first, len(texts))


class Chunk:
    """Documents whose links are counted together: each distinct pair leaves a chunk once."""

    def __init__(self):
        self.rows, self.links, self.size = [], [], 0

    def add(self, ids, texts: list[str | None], segment: Segmenters) -> None:
        rows, text, a, b = align(texts, segment)
        self.links.append((text + len(self.rows), a * (1 << 32) + b))
        self.rows += [(i, *r) for i, r in zip(ids, rows, strict=True)]
        self.size += sum(len(t or "") for t in texts)

    def row(self) -> dict:
        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        text = np.concatenate([t for t, _ in self.links])
        pairs, place, n = np.unique(np.concatenate([p for _, p in self.links]), return_inverse=True, return_counts=True)
        return {
            "chunk": uuid.uuid4().hex,
            "documents": [dict(zip(names, (None if r[0] is pd.NA else str(r[0]), *r[1:]), strict=True)) for r in self.rows],
            "ends": np.cumsum(np.bincount(text, minlength=len(self.rows))),
            "places": zlib.compress(place.astype(np.int32).tobytes(), 1),
            "pairs": [
                {"a": x, "b": y, "n": z}
                for x, y, z in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), n.tolist(), strict=True)
            ],
        }


def chunks(docs: DataFrame) -> DataFrame:
    """Aligned documents in chunks of about ``CHUNK_BYTES`` of text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, chunk = Segmenters(), Chunk()
        for batch in batches:
            texts, ids = batch["text"].tolist(), long_ids(batch["doc_id"])
            for part in slices(texts, SLICE_BYTES):
                chunk.add(ids[part.start : part.stop], texts[part.start : part.stop], segment)
                if chunk.size >= CHUNK_BYTES:
                    yield pd.DataFrame([chunk.row()])
                    chunk = Chunk()
        if chunk.rows:
            yield pd.DataFrame([chunk.row()])

    return docs.select(id_text(), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, CHUNKS)


def pair_counts(cut: DataFrame) -> DataFrame:
    """``(a, b, count, best)`` of every pair of ids that is linked: best where no A id is linked more often with b."""
    pairs = cut.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    # at most one row per A id and b
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def alignments(docs: DataFrame) -> DataFrame:
    """Digest columns of the alignment of every row of ``docs`` (doc_id, text) under two vocabularies.

    A blank and the text are cut by byte_bpe_50k.json (A) and piece_bpe_32k.model (B).
    As-of merges give every pair of overlapping tokens; common ends cut both sides into
    groups, and the pairs that end together are the links. ``doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256, n_overlaps``: n_best are the links whose pair
    of ids is, over all rows, the one most often linked with its B id, ties included;
    count_sum adds up how often the pairs of the links are linked over all rows.

    Each chunk of documents asks once for each of its distinct pairs, so a pair that
    stands in most documents is a row per chunk, and no document's tokens are shuffled.

    Texts that are null or empty, and those whose tokens don't give their bytes back
    (U+2581 in a text), have no tokens: all zeros and an empty digest. Whole texts are
    aligned, however long: memory grows with the longest one. Special tokens' strings are
    plain text. Repeated rows and null ids are rows like others and count towards the
    pairs; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write("aligned", chunks(docs))
    counts = scratch.write("pairs", pair_counts(cut))
    asked = cut.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    asked = asked.select("of", "place", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    told = asked.join(counts, ["a", "b"]).select(
        "of", F.floor(F.col("place") / PART).alias("part"), F.struct("place", "count", "best").alias("t")
    )
    told = told.groupBy("of", "part").agg(F.collect_list("t").alias("t")).select(
        "of", *(F.col(f"t.{c}").alias(f"{c}s") for c in ("place", "count", "best"))
    )

    def finish(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunk.iterrows():
            place = np.frombuffer(zlib.decompress(row["places"]), np.int32)
            count, best = np.zeros(place.max(initial=-1) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
            for at, n, is_best in zip(answers["places"], answers["counts"], answers["bests"], strict=True):
                count[at], best[at] = n, is_best
            ends = np.asarray(row["ends"], np.int64)
            starts = np.r_[0, ends[:-1]]
            frame = pd.DataFrame(list(row["documents"]))
            frame["doc_id"] = long_ids([r["doc_id"] for r in row["documents"]])
            for name, values in (("count_sum", count), ("n_best", best)):
                total = np.r_[0, np.cumsum(values[place])]
                frame[name] = total[ends] - total[starts]
            out.append(frame)
        columns = [c.split()[0] for c in DOCUMENT.split(", ")] + ["count_sum", "n_best"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    whole = cut.drop("pairs").groupBy("chunk").cogroup(told.groupBy("of"))
    return whole.applyInPandas(finish, DOCUMENT + ", count_sum long, n_best long").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"
    )
