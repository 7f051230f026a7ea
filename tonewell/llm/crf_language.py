"""Language of words and documents: a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewell.llm.common import id_text, long_ids
from tonewell.llm.fertility import mixed

#: Runs of letters; marks, digits and symbols separate them.
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one after another, and where each word's begin.

    A word is written ^word$: grams of two to four characters that hold a border are its
    affixes. The whole word is its entry in the lexicon.
    """
    text = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(points))  # characters to the end of the word
    where, hashes = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        value[:size] = value[:size] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            at = np.flatnonzero(left[:size] >= n)
            where.append(owner[at])
            hashes.append(mixed(value[at] + np.uint64(n << 40)))
    power = mixed(np.arange(int(sizes.max(initial=1)), dtype=np.uint64))
    place = np.arange(len(points)) - begin[owner]
    whole = np.add.reduceat(mixed(points) * power[place], begin) if len(points) else np.empty(0, np.uint64)
    where.append(np.arange(len(words)))
    hashes.append(mixed(whole ^ np.uint64(0x5BD1E995)))
    where, hashes = np.concatenate(where), np.concatenate(hashes)
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(len(words)))
    return (hashes[order] & np.uint64(BUCKETS - 1)).astype(np.int32), starts


@dataclass
class Field:
    """Weights of features by label, and of label pairs."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        index, starts = word_features(words)
        return np.add.reduceat(self.weights[index], starts, axis=0).astype(np.float64)


def passages(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Per padded sequence the matrix that takes a forward message from the word before it to its last word."""
    s, t, n = e.shape
    local = np.exp(e - e.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    out = np.broadcast_to(np.eye(n), (s, n, n)).copy()
    for i in range(t):
        now = (out @ step) * local[:, i, None, :]
        now /= now.sum((1, 2), keepdims=True)
        out = np.where(mask[:, i, None, None], now, out)
    return out


def forward_backward(
    e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False,
    enter: np.ndarray | None = None, leave: np.ndarray | None = None,
):
    """Marginals of padded sequences ``e`` [sequence, place, label]; with ``pairs`` also expected label pairs.

    Of sequences that go on from another one, ``enter`` holds the forward message at the
    word before them (a row of zeros: none); ``leave`` is the backward message at the last word.
    """
    s, t, n = e.shape
    local = np.exp(e - e.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(local), np.ones_like(local)
    now = np.broadcast_to(np.exp(first - first.max()), (s, n))
    if enter is not None:
        now = np.where(enter.any(1)[:, None], enter @ step, now)
    end = np.ones((s, n)) if leave is None else leave
    backward[:, t - 1] = end
    now = local[:, 0] * now
    forward[:, 0] = now / now.sum(1, keepdims=True)
    for i in range(1, t):
        now = (forward[:, i - 1] @ step) * local[:, i]
        now /= now.sum(1, keepdims=True)
        forward[:, i] = np.where(mask[:, i, None], now, forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        now = (backward[:, i + 1] * local[:, i + 1]) @ step.T
        now /= now.sum(1, keepdims=True)
        backward[:, i] = np.where(mask[:, i + 1, None], now, end)
    marginal = forward * backward
    marginal /= marginal.sum(2, keepdims=True)
    marginal *= mask[:, :, None]
    if not pairs:
        return marginal, None
    expected = np.zeros((n, n))
    for i in range(1, t):
        both = forward[:, i - 1, :, None] * step * (local[:, i] * backward[:, i])[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        expected += (both * mask[:, i, None, None]).sum(0)
    return marginal, expected


def train(sequences: list[tuple[list[str], list[int]]], labels: list[str], epochs: int = 6, seed: int = 3) -> Field:
    """Gradient steps on the conditional log-likelihood, with a penalty on all weights."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    field = Field(labels, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)), np.zeros(n))
    seen_w, seen_t = np.full((BUCKETS, n), 1e-2, np.float32), np.full((n, n), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 64):
            batch = [sequences[i] for i in order[at : at + 64]]
            words, codes = pd.factorize(np.array([w for x, _ in batch for w in x], dtype=object))[::-1]
            index, starts = word_features(list(words))
            scores = np.add.reduceat(field.weights[index], starts, axis=0).astype(np.float64)
            sizes = np.array([len(x) for x, _ in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            e = np.zeros((len(batch), sizes.max(), n))
            mask = np.zeros(e.shape[:2], bool)
            e[row, col], mask[row, col] = scores[codes], True
            marginal, expected = forward_backward(e, mask, field.transitions, field.first, True)
            gold = np.concatenate([y for _, y in batch])
            error = marginal[row, col]
            error[np.arange(len(gold)), gold] -= 1
            pairs = np.zeros((n, n))
            inner = np.flatnonzero(col > 0)
            np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
            by_word = np.stack([np.bincount(codes, error[:, k], len(words)) for k in range(n)], 1)
            owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(index)]))
            grad = np.stack([np.bincount(index, by_word[owner, k], BUCKETS) for k in range(n)], 1) / len(batch)
            grad = (grad + 1e-4 * field.weights).astype(np.float32)
            seen_w += grad * grad
            field.weights -= 0.15 * grad / np.sqrt(seen_w)
            change = (expected - pairs) / len(batch) + 1e-2 * field.transitions
            seen_t += change * change
            field.transitions -= 0.3 * change / np.sqrt(seen_t)
    return field


def training_sequences(rows: pd.DataFrame, labels: list[str], length: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Stretches of words from anywhere in the drawn texts; every third one goes on in another text's language.

    The words of a text carry its label. The joined stretches are what the field learns
    switches from.
    """
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(labels)}
    stretches = []
    for text, lang in zip(rows["text"], rows["lang"], strict=True):
        words = LETTERS.findall(text.lower())
        for at in rng.choice(max(1, -(-len(words) // length)), min(3, max(1, -(-len(words) // length))), replace=False):
            if part := words[at * length : (at + 1) * length]:
                stretches.append((part, [code[lang]] * len(part)))
    out = []
    for part, gold in stretches:
        if rng.random() < 1 / 3:
            other, other_gold = stretches[rng.integers(len(stretches))]
            a, b = rng.integers(1, len(part) + 1), rng.integers(0, len(other))
            part, gold = part[:a] + other[b:], gold[:a] + other_gold[b:]
        out.append((part, gold))
    return out


def fit(docs: DataFrame, per_label: int = 400, length: int = 48, seed: int = 3, most_labels: int = 256) -> Field | None:
    """Learn from ``docs`` (doc_id, text, lang): at most ``per_label`` texts of each language, drawn by hash.

    The ``most_labels`` most frequent values of lang are learned. A row for each of them and
    that many texts reach the driver, the same ones whatever the partitions. None without
    a labelled text.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()
    if not counts:
        return None
    labels = sorted(r["lang"] for r in counts)
    hashed = F.xxhash64("doc_id", "text", F.lit(seed))
    unit = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    # about twice the texts wanted; of those a language keeps the ones with the smallest hash
    part = docs.sparkSession.createDataFrame([(r["lang"], 2 * per_label / r["n"]) for r in counts], "lang string, part double")
    drawn = rows.join(F.broadcast(part), "lang").filter(unit < F.col("part")).drop("part").withColumn("draw", hashed)
    # equal rows have one hash, so a text that is repeated very often comes once
    once = drawn.dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    got = once.withColumn("place", place).filter(F.col("place") <= per_label).drop("place", "draw")
    got = got.toPandas().sort_values(["doc_id", "text"], kind="stable")
    if not len(got):
        first = rows.orderBy(hashed, "lang").limit(per_label)
        got = first.toPandas()
    return train(training_sequences(got, labels, length, seed), labels, seed=seed)


def messages(field: Field, per_doc: np.ndarray, stretches) -> tuple[np.ndarray, np.ndarray]:
    """The forward message that enters each stretch of a text and the backward one at its last word.

    Stretches are passed as matrices, all of them at once; from stretch to stretch the
    texts then move together. So a chain is as if it had not been cut.
    """
    n, total = len(field.labels), int(per_doc.sum())
    enter, leave = np.zeros((total, n)), np.ones((total, n))
    if per_doc.max(initial=0) < 2:
        return enter, leave
    through = np.empty((total, n, n))
    begin = np.zeros((total, n))
    init = np.exp(field.first - field.first.max())
    for rows, _, _, e, mask in stretches:
        through[rows] = passages(e[:, 1:], mask[:, 1:], field.transitions)
        first = np.exp(e[:, 0] - e[:, 0].max(1, keepdims=True))
        begin[rows] = first
    step = np.exp(field.transitions - field.transitions.max())
    first_row = np.cumsum(per_doc) - per_doc
    # a stretch as a whole: into its first word, then through the others
    into = lambda message, at: np.einsum("ij,ijk->ik", message * begin[at], through[at])
    for k in range(1, int(per_doc.max())):
        at = first_row[per_doc > k] + k
        before = enter[at - 1] @ step if k > 1 else np.broadcast_to(init, (len(at), n))
        now = into(before, at - 1)
        enter[at] = now / now.sum(1, keepdims=True)
    for k in range(int(per_doc.max()) - 1, 0, -1):
        at = first_row[per_doc > k] + k
        back = np.einsum("ijk,ik->ij", through[at], leave[at]) * begin[at]
        now = back @ step.T
        leave[at - 1] = now / now.sum(1, keepdims=True)
    return enter, leave


def label_batch(field: Field, texts: list[str], length: int = 128) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of the whole texts, the text each belongs to, and its label marginals."""
    lists = [LETTERS.findall(t.lower()) for t in texts]
    sizes = np.array([len(x) for x in lists])
    total = int(sizes.sum())
    doc = np.repeat(np.arange(len(lists)), sizes)
    if not total:
        return lists, doc, np.zeros((0, len(field.labels)))
    codes, words = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    letters = np.array([any(c.isalpha() for c in w) for w in words])
    scores = field.emissions(list(words)) * letters[:, None]
    # texts are cut in stretches of equal length, so that all of them move forward together
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    per_doc = -(-sizes // length)
    row = np.repeat(np.cumsum(per_doc) - per_doc, sizes) + place // length
    col = place % length

    def stretches():
        """``(rows, words, padded scores, which are words)`` of some stretches at a time."""
        for at in range(0, int(row[-1]) + 1, 2048):
            part = slice(*np.searchsorted(row, [at, at + 2048]))
            r, c = row[part] - at, col[part]
            e = np.zeros((r.max() + 1, c.max() + 1, len(field.labels)))
            mask = np.zeros(e.shape[:2], bool)
            e[r, c], mask[r, c] = scores[codes[part]], True
            yield slice(at, at + len(e)), part, (r, c), e, mask

    enter, leave = messages(field, per_doc, stretches())
    marginal = np.empty((total, len(field.labels)))
    for rows, part, at, e, mask in stretches():
        found, _ = forward_backward(e, mask, field.transitions, field.first, False, enter[rows], leave[rows])
        marginal[part] = found[at]
    return lists, doc, marginal * letters[codes][:, None]


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of ``docs`` (doc_id, held_out, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            if field is not None:
                _, doc, marginal = label_batch(field, texts)
                mass = np.stack([np.bincount(doc, marginal[:, k], len(texts)) for k in range(len(field.labels))], 1)
                total = mass.sum(1)
                best = mass.argmax(1)
                for i in np.flatnonzero(total > 0):
                    preds[i] = field.labels[best[i]]
                    scores[i] = float(min(1.0, mass[i, best[i]] / total[i]))
            yield pd.DataFrame(
                {"doc_id": long_ids(batch["doc_id"]), "held_out": batch["held_out"], "lang_pred": preds, "score": scores}
            )

    return docs.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """Language spans inside ``docs`` (doc_id, text): runs of words with one best label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists, doc, marginal = label_batch(field, batch["text"].tolist())
            rows, at = [], 0
            for i, words in enumerate(lists):
                best = marginal[at : at + len(words)].argmax(1)
                at += len(words)
                edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(words)] if words else []
                for a, b in zip(edges, edges[1:], strict=False):
                    rows.append((batch["doc_id"].iloc[i], a, b - a, field.labels[best[a]]))
            out = pd.DataFrame(rows, columns=["doc_id", "first_word", "n_words", "lang"])
            yield out.assign(doc_id=long_ids(out["doc_id"]))

    text = docs.select(id_text(), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(run, "doc_id long, first_word long, n_words long, lang string")


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """Language of every whole text of ``docs`` (doc_id, text, lang); lang of the held-out fold is never read.

    The fold of a row is crc32(doc_id as text) mod ``folds``. The prediction is the label
    with the largest sum of word marginals, the score its share. Whole texts are labelled,
    however long: they are cut in stretches, and messages pass over the cuts. Null texts and texts
    without a letter are ``und`` with score 0, as are all texts if nothing was labelled.
    A null doc_id is in no fold and not learned from. Repeated rows get a row each; an
    empty table gives no row; other columns are ignored.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    field = fit(docs.filter(F.coalesce(remainder != fold, F.lit(False))))
    rows = docs.select(
        id_text(),
        F.coalesce(remainder == fold, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return predict(rows, field)
