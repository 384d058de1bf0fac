"""Quality classifier from trusted positives and unlabelled texts.

A small network is fitted in numpy to the non-negative unbiased risk: with class prior ``p``,
positives ``P`` and unlabelled ``U``, ``p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])``. Negative
labels are never used. The prior is estimated from the same two samples. Features are
figures of the whole text, found in one pass over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from .common import about, id_remainder

FEATURES = (
    "log_words", "symbols", "bars", "stops", "exclaims", "digits", "shouted", "repeated", "distinct",
    "word_length", "long_words", "other_signs", "log_lines", "equal_lines", "no_letters",
)
POSITIVES = 20_000
UNLABELLED = 20_000
_SYMBOLS = "#*$%&<>"
_OTHER = "=+~^_{}[]\\/@"


def figures(text: str | None) -> list[float]:
    """The features of a text; NULL counts as empty. Each is 0 for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = text.split("\n")
    count = text.count

    def share(x: float) -> float:
        return math.sqrt(x / n)  # a few per hundred words already stand out

    return [
        math.log1p(n) / 5,
        share(sum(map(count, _SYMBOLS))),
        share(count("|")),
        share(count(".") + count("?")),
        share(count("!")),
        share(sum(map(count, "0123456789"))),
        share(sum(map(str.isupper, words))),
        share(sum(map(eq, words, words[1:]))),
        math.log(n / len(set(words))),
        (len(text) - n) / n / 10,
        share(sum(len(w) > 20 for w in set(words))),
        share(sum(map(count, _OTHER))),
        math.log1p(len(lines)) / 5,
        1 - len(set(lines)) / len(lines),
        share(n - sum(map(_has_letter, words))),
    ]


def _has_letter(word: str) -> bool:
    return word[0].isalpha() or word.upper() != word.lower()


def features(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(figures(t), np.float32) for t in texts], dtype=object)

    return run(text)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """One hidden layer over standardised features; ``prior`` is the share of positives it met."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(x, float) - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, seed: int = 7) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam on mini-batches.

    Where a batch's estimate of the negatives' risk falls below zero, the step goes against it.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    d = both.shape[1]
    model = Model(mean, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0, prior)
    state = {k: (0.0, 0.0) for k in ("w1", "b1", "w2", "b2")}
    step = 0
    size = 512
    for epoch in range(epochs):
        order_u = rng.permutation(len(unlabelled))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(unlabelled), size):
            xu = unlabelled[order_u[at : at + size]]
            xp = positive[rng.integers(0, len(positive), min(size, 4 * len(positive)))]
            x = np.clip((np.concatenate([xp, xu]) - mean) / scale, -6, 6)
            h = np.tanh(x @ model.w1 + model.b1)
            f = h @ model.w2 + model.b2
            n = len(xp)
            # Slopes of log(1 + e^-f) for positives and of log(1 + e^f) for negatives.
            up, down = -_sigmoid(-f), _sigmoid(f)
            loss = np.logaddexp(0, f)
            negative = loss[n:].mean() - prior * loss[:n].mean()
            g = np.zeros_like(f)
            if negative >= 0:
                g[:n] = prior * (up[:n] - down[:n]) / n
                g[n:] = down[n:] / len(xu)
            else:
                g[:n] = prior * down[:n] / n
                g[n:] = -down[n:] / len(xu)
            gh = np.outer(g, model.w2) * (1 - h * h)
            grads = {"w1": x.T @ gh + 1e-4 * model.w1, "b1": gh.sum(0), "w2": h.T @ g + 1e-4 * model.w2, "b2": g.sum()}
            step += 1
            for k, grad in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                state[k] = m, v
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, getattr(model, k) - change)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled.

    A network tells positives from unlabelled (prior one half in either set). Among the texts it
    finds most like positives, unlabelled ones are as many as their positives alone explain:
    the least ratio of both shares, over thresholds that at least a fifth of held-out positives
    reach, bounds the prior from above, and meets it where positives stand apart.
    """
    rng = np.random.default_rng(seed)
    pick = rng.permutation(len(positive))
    seen, held = positive[pick[: len(pick) // 2]], positive[pick[len(pick) // 2 :]]
    if not len(seen) or not len(held):
        return 0.5
    model = fit(seen, unlabelled, 0.5, epochs=15, seed=seed)
    p, u = np.sort(model.margin(held)), np.sort(model.margin(unlabelled))
    marks = np.quantile(p, np.linspace(0.005, 0.8, 160))
    share_p = 1 - np.searchsorted(p, marks) / len(p)
    share_u = 1 - np.searchsorted(u, marks) / len(u)
    # Allow for chance: one standard error of each share.
    sure = (share_u + np.sqrt(share_u * (1 - share_u) / len(u))) / np.maximum(
        share_p - np.sqrt(share_p * (1 - share_p) / len(p)), 1e-6
    )
    return float(np.clip(sure.min(), 0.01, 0.99))


def train(figured: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on bounded samples of ``figured(doc_id, features)``; None if there are no positives.

    Positives are labelled rows of quality 1 whose id's remainder modulo 3 is not 1. The
    unlabelled sample is drawn from all documents, whatever their labels.
    """
    trusted = labels.where(F.col("quality") == 1).where(id_remainder(F.col("doc_id"), 3) != 1).select("doc_id").distinct()
    good = about(trusted, F.col("doc_id"), positives, seed=3)
    p = figured.join(good, "doc_id", "left_semi").orderBy("doc_id").select("features").toPandas()
    u = about(figured, F.col("doc_id"), unlabelled, seed=4).orderBy("doc_id").select("features").toPandas()
    if not len(p) or not len(u):
        return None
    xp, xu = np.stack(p["features"].to_numpy()).astype(float), np.stack(u["features"].to_numpy()).astype(float)
    return fit(xp, xu, estimate_prior(xp, xu))


def scores(features_column: Column, model: Model | None) -> Column:
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        if model is None or not len(rows):
            return pd.Series(np.full(len(rows), 0.5))
        return pd.Series(model.score(np.stack(rows.to_numpy())))

    return run(features_column)


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``carry`` for each row of ``docs``.

    Only texts are inputs of a score. NULL texts count as empty and get a score like others; so
    do rows with NULL or repeated ids. Without any positive label all scores are 0.5. The driver
    sees two samples of bounded size, about ``POSITIVES`` and ``UNLABELLED`` rows of figures.
    """
    figures_of = features(F.col("text")).alias("features")
    figured = written(docs.select("doc_id", figures_of), "figures")
    model = train(figured, labels)
    # What is carried may be wide: then the figures are found again rather than stored beside it.
    rows = docs.select("doc_id", figures_of, *carry) if carry else figured
    return rows.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        scores(F.col("features"), model).alias("score"),
        *carry,
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
