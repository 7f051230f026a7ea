"""Quality classifier from positives and unlabelled text: non-negative unbiased risk."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tonewell.llm.common import WORD, written
from tonewell.llm.fertility import repeated_words

#: Classes of characters: lower, upper and other letters, digits, space, line end,
#: sentence punctuation, other marks and symbols.
CLASSES = 8
STATS = 16


def char_classes() -> np.ndarray:
    """Class of every code point of the basic plane."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Nd": 3}
    table = np.full(1 << 16, 7, np.uint8)
    for point in range(1 << 16):
        kind = kinds.get(unicodedata.category(chr(point)))
        if kind is not None:
            table[point] = kind
    table[[9, 11, 12, 32, 160]] = 4
    table[[10, 13]] = 5
    for mark in ".,;:'\"()-?":
        table[ord(mark)] = 6
    return table


def features(texts: list[str], table: np.ndarray) -> np.ndarray:
    """One row per whole text: pairs of character classes, and statistics of words and lines."""
    import re

    word = re.compile(WORD)
    lists = [word.findall(t) for t in texts]
    out = np.zeros((len(texts), CLASSES * CLASSES + STATS))
    repeated = repeated_words(lists)
    for i, (text, words) in enumerate(zip(texts, lists, strict=True)):
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = table[np.minimum(points, 0xFFFF)].astype(np.int16)
        pairs = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        out[i, : CLASSES * CLASSES] = np.log((pairs + 0.1) / (len(kind) + 6.4))
        n, lines = len(words), [x for x in text.split("\n") if x.strip()]
        sizes = np.array([len(w) for w in words] or [0])
        kinds = set(words)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        upper = sum(w.isupper() for w in words)
        marked = sum(not (w[-1].isalnum() or w[-1] in ".,;:'\"()-?!") for w in words)
        ratio = lambda a, b: np.log((a + 0.1) / (b + 1.0))
        out[i, CLASSES * CLASSES :] = (
            np.log1p(len(text)), np.log1p(n), sizes.mean(), sizes.std(), sizes.max(), ratio(len(kinds), n),
            ratio(same, n), ratio(upper, n), ratio(marked, n), ratio(len(lines) - len(set(lines)), len(lines)),
            ratio(repeated[i], n), np.log1p(n / max(1, len(lines))), ratio(len(set(text)), 1),
            ratio(text.count("."), len(lines)), ratio(sum(w.isalpha() for w in words), n), float(n < 20),
        )
    return out


@dataclass
class Model:
    """A small network on standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int, seed: int, hidden: int = 24):
    """Adam on the non-negative risk; without a prior, plain positives against unlabelled."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    size = 512
    rounds = max(16, max(len(positive), len(unlabelled)) // size)
    for _ in range(epochs):
        for _ in range(rounds):
            p = positive[rng.integers(0, len(positive), min(size, 4 * len(positive)))]
            u = unlabelled[rng.integers(0, len(unlabelled), min(size, 4 * len(unlabelled)))]
            x = np.vstack([p, u])
            h = np.tanh(x @ w[0] + w[1])
            g = h @ w[2] + w[3]
            gp, gu = g[: len(p)], g[len(p) :]
            if prior is None:
                grad = np.r_[(sigmoid(gp) - 1) / len(p), sigmoid(gu) / len(u)]
            else:
                soft = lambda t: np.logaddexp(0, t).mean()
                negative = soft(gu) - prior * soft(gp)
                if negative >= 0:
                    grad = np.r_[prior * (sigmoid(gp) - 1) / len(p) - prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)]
                else:  # the negative part can't be a risk: climb back out of it
                    grad = np.r_[prior * sigmoid(gp) / len(p), -sigmoid(gu) / len(u)]
            back = np.outer(grad, w[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-3 * w[0], back.sum(0), h.T @ grad + 1e-3 * w[2], np.array([grad.sum()])]
            step += 1
            for k, gk in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


#: Cuts at which the shares of positives and of unlabelled text are compared.
CUTS = 50


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int, above=None) -> float:
    """Share of positives among the unlabelled, without any negative label.

    A classifier of positives against unlabelled text ranks what it wasn't fitted on.
    Above any cut lie a share of the unlabelled and a share of the positives, and the
    first holds at least prior times the second: the smallest ratio over the cuts that
    keep most positives bounds the prior, and is close where negatives rank low.

    ``above(model, cuts)`` gives the shares of the unlabelled; then all of ``unlabelled`` is
    fitted on. Without it, the second half of ``unlabelled`` is ranked.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2 if above is None else len(unlabelled)
    weights = _train(positive[:half_p], unlabelled[:half_u], None, 6, seed)
    model = Model(np.zeros(positive.shape[1]), np.ones(positive.shape[1]), weights, 0.5)
    p = np.sort(model.logits(positive[half_p:]))
    cuts = np.quantile(p, np.linspace(0.01, 0.5, CUTS))
    share = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    found = share(np.sort(model.logits(unlabelled[half_u:]))) if above is None else above(model, cuts)
    return float(np.clip((found / share(p)).min(), 0.05, 0.98))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, draw, x)``: the features of each row, and a draw from 0 to 1 by its id and text."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = char_classes()
        for batch in batches:
            x = features(batch["text"].tolist(), table)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "draw": batch["draw"], "x": list(x)})

    text = F.coalesce("text", F.lit(""))
    draw = F.pmod(F.xxhash64("doc_id", text, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), draw.alias("draw"), text.alias("text"))
    made = rows.mapInPandas(measure, "doc_id string, draw double, x array<double>")
    return written(made.withColumn("doc_id", F.col("doc_id").cast("long")), "features")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the features of all rows: one row of sums per task, added up by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s1, s2 = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = np.stack(list(batch["x"]))
                n, s1, s2 = n + len(x), s1 + x.sum(0), s2 + (x * x).sum(0)
        if n:
            yield pd.DataFrame({"n": [n], "s": [np.stack([s1, s2], 1).tolist()]})

    sums = rows.select("x").mapInPandas(partial, "n long, s array<array<double>>")
    cells = sums.select("n", F.posexplode("s").alias("dim", "s")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s")[0]).alias("s1"), F.sum(F.col("s")[1]).alias("s2")
    )
    got = cells.orderBy("dim").toPandas()
    mean = (got["s1"] / got["n"]).to_numpy()
    return mean, np.sqrt(np.maximum((got["s2"] / got["n"]).to_numpy() - mean * mean, 0))


def shares_above(rows: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """Share of all ``rows`` whose logit is at least each cut; counts per task reach Spark's sum."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, n = np.zeros(len(cuts), np.int64), 0
        for batch in batches:
            if len(batch):
                logits = np.sort(model.logits(np.stack(list(batch["x"]))))
                above += len(logits) - np.searchsorted(logits, cuts)
                n += len(logits)
        yield pd.DataFrame({"n": [n], "above": [above.tolist()]})

    counted = rows.select("x").mapInPandas(count, "n long, above array<long>")
    got = counted.select("n", F.posexplode("above").alias("cut", "above")).groupBy("cut").agg(F.sum("n").alias("n"), F.sum("above").alias("above"))
    table = got.orderBy("cut").toPandas()
    return (table["above"] / table["n"].clip(lower=1)).to_numpy()


def fit(docs: DataFrame, trusted: DataFrame, positives: int = 6000, unlabelled: int = 12000, seed: int = 5) -> Model | None:
    """Learn from ``trusted`` (doc_id of positives) and ``docs`` (doc_id, text) as unlabelled text.

    The weights are fitted on at most ``positives`` and ``unlabelled`` texts, those with the
    smallest hash of id and text, whatever the partitions; only their features reach the
    driver. The mean and scale of the features come from all rows of ``docs``, the class
    prior from the half of all rows that the ranking of the first half is tried on. None
    if there are fewer than ten of either.
    """
    rows = measured(docs)
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    # at most the parameter, so small enough for every task; the features stay where they are
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(positives)
    known = rows.join(F.broadcast(drawn), "doc_id")

    def smallest(df: DataFrame, n: int) -> np.ndarray:
        # twice as many draws as wanted lie below this, so that no partition sends more than its share
        low = df.filter(F.col("draw") <= 2 * n / max(1, df.count()))
        got = low.select("draw", "doc_id", "x").orderBy("draw", "doc_id").limit(n).toPandas()
        return np.stack(list(got["x"])) if len(got) else np.zeros((0, 0))

    p, u, low = smallest(known, positives), smallest(rows, unlabelled), smallest(rows.filter("draw < 0.5"), unlabelled // 2)
    if len(p) < 10 or len(u) < 10 or len(low) < 5:
        return None
    rng = np.random.default_rng(seed)
    p, u, low = (x[rng.permutation(len(x))] for x in (p, u, low))
    mean, deviation = moments(rows)
    scale = np.maximum(deviation, 1e-3)
    zp, zu, zl = (np.clip((x - mean) / scale, -6, 6) for x in (p, u, low))
    high = rows.filter("draw >= 0.5")

    def above(ranking: Model, cuts: np.ndarray) -> np.ndarray:
        return shares_above(high, Model(mean, scale, ranking.weights, 0.5), cuts)

    prior = estimate_prior(zp, zl, seed, above)
    return Model(mean, scale, _train(zp, zu, prior, 24, seed), prior)


def score_column(text: Column, model: Model | None) -> Column:
    """Score of a whole text, 0 to 1; without a model 0.5. Null text counts as empty."""
    if model is None:
        return F.lit(0.5)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = char_classes()
        for texts in batches:
            yield pd.Series(model.scores(features(texts.tolist(), table)))

    return score(F.coalesce(text, F.lit("")))


def fold_model(docs: DataFrame, labels: DataFrame, fold: int, folds: int) -> Model | None:
    """The model that reads no label of the held-out fold."""
    learn = F.coalesce(remainder(folds) != fold, F.lit(False))
    trusted = labels.filter(learn & (F.col("quality") == 1)).select("doc_id")
    return fit(docs.filter(learn).select("doc_id", "text"), trusted)


def remainder(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def accepted(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more; columns stay as they are."""
    return docs.filter(score_column(F.col("text"), fold_model(docs, labels, fold, folds)) >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """``docs`` with held_out, score and predicted; labels of the held-out fold are never read.

    The fold of a row is crc32(doc_id as text) mod ``folds``. Trusted positives are the
    other rows of ``labels`` with quality 1; label 0 is not used, the classifier only sees
    positives, unlabelled text of the other folds and the prior it estimates from them.
    A null doc_id is in no fold and never trusted. Repeated rows get one score each.
    Without ten positives every score is 0.5. All columns of ``docs`` stay, those named
    held_out, score and predicted are replaced.
    """
    model = fold_model(docs, labels, fold, folds)
    held_out = F.coalesce(remainder(folds) == fold, F.lit(False))
    scored = docs.withColumns({"held_out": held_out, "score": score_column(F.col("text"), model)})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
