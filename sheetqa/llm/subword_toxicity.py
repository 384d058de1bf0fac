"""Toxicity by subword bags: embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams between boundary signs, and itself; each is hashed to a
row of an embedding table, so a misspelling shares most rows with the word it stands for. The mean
embedding of a passage of ``PASSAGE`` words goes into a linear softmax. A text scores as its most
toxic passage does, for one insult in a long text would vanish in the mean over the whole of it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about, id_remainder

BUCKETS = 1 << 17
DIMENSIONS = 8
PASSAGE = 8
TOXIC_TEXTS = 3_000
OTHER_TEXTS = 4_500
#: Words whose weights a task keeps; emptied when full.
CACHE_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    """The subwords of a lower-case word: n-grams of 3 to 5 characters, and the word."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]


def row(gram: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % buckets


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case; of a word that follows itself, one."""
    return [w for w, _ in groupby(_LETTERS.findall((text or "").lower()))]


@dataclass
class Model:
    """``weights``: for each row of the embedding table, what it adds to toxic minus other."""

    weights: np.ndarray
    bias: float

    def passages(self, values: np.ndarray) -> np.ndarray:
        """Margins of all passages of a text, from the margins of its words in order."""
        if not len(values):
            return np.array([self.bias])
        n = min(PASSAGE, len(values))
        sums = np.cumsum(np.concatenate([[0.0], values]))
        return (sums[n:] - sums[:-n]) / n + self.bias


class Memory(dict):
    """What ``find`` gives for keys met before; emptied when full, so its size stays bounded."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.find(key)
        return value


class Scorer:
    """Margins of texts under a model; a task keeps what it found for words and subwords."""

    def __init__(self, model: Model):
        self.model = model
        weights = model.weights
        self.gram = Memory(lambda g: float(weights[row(g, len(weights))]), CACHE_WORDS)
        self.word = Memory(self._word, CACHE_WORDS)

    def _word(self, word: str) -> float:
        found = grams(word)
        return sum(map(self.gram.__getitem__, found)) / len(found)

    def margin(self, text: str | None) -> float:
        """Of the most toxic passage."""
        words = words_of(text)
        values = np.fromiter(map(self.word.__getitem__, words), float, len(words))
        return float(self.model.passages(values).max())


class Vocabulary:
    """Rows of all words of the training texts, one after the other."""

    def __init__(self, words: Iterable[str]):
        rows, lengths = array("i"), array("i")
        for word in words:
            found = grams(word)
            rows.extend(row(g) for g in found)
            lengths.append(len(found))
        self.rows = np.frombuffer(rows, np.int32)
        self.lengths = np.frombuffer(lengths, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths[:-1], dtype=np.int64)])

    def values(self, weights: np.ndarray) -> np.ndarray:
        """For each word the mean weight of its rows."""
        return np.add.reduceat(weights[self.rows], self.starts) / self.lengths


def _train(passages: list[np.ndarray], toxic: np.ndarray, vocabulary: Vocabulary, start: tuple | None, epochs: int, seed: int):
    """Embeddings and softmax by Adagrad on mini-batches; ``passages`` hold word numbers."""
    rng = np.random.default_rng(seed)
    if start is None:
        start = (
            rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)),
            rng.normal(0, 0.3, (DIMENSIONS, 2)),
            np.zeros(2),
            np.full((BUCKETS, 1), 1e-12),
            np.full((DIMENSIONS, 2), 1e-12),
            np.full(2, 1e-12),
        )
    table, out, bias, seen, seen_out, seen_bias = start
    lengths, flat, starts = vocabulary.lengths, vocabulary.rows, vocabulary.starts
    size = int(np.clip(len(passages) // 50, 64, 2048))  # few passages still make many steps
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum())) * len(toxic)
    for epoch in range(epochs):
        order = rng.permutation(len(passages))
        rate = 0.1 * (1 - epoch / epochs) + 0.02
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            sizes = np.array([len(passages[i]) for i in chosen])
            words, place = np.unique(np.concatenate([passages[i] for i in chosen]), return_inverse=True)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            # Rows of the batch's distinct words, and the mean of each word's rows.
            n = lengths[words]
            rows = flat[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            ends = np.concatenate([[0], np.cumsum(n)[:-1]])
            vectors = np.add.reduceat(table[rows], ends, axis=0) / n[:, None]
            bag = np.add.reduceat(vectors[place], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
            z = bag @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), toxic[chosen]] -= 1
            g = p * weight[chosen][:, None] / len(chosen)
            back = (g @ out.T) / sizes[:, None]
            per_word = np.stack([np.bincount(place, back[owner, k], len(words)) for k in range(DIMENSIONS)], 1)
            touched, slot = np.unique(rows, return_inverse=True)
            spread = np.repeat(per_word / n[:, None], n, axis=0)
            grad = np.stack([np.bincount(slot, spread[:, k], len(touched)) for k in range(DIMENSIONS)], 1)
            seen[touched] += (grad**2).mean(1, keepdims=True)
            table[touched] -= rate * grad / np.sqrt(seen[touched])
            for values, gradient, squares in ((out, bag.T @ g, seen_out), (bias, g.sum(0), seen_bias)):
                squares += gradient**2
                values -= rate * gradient / np.sqrt(squares)
    return table, out, bias, seen, seen_out, seen_bias


def fit(texts: list[str], toxic: list[int], rounds: int = 3, seed: int = 11) -> Model | None:
    """Train on labelled texts; None if one of the labels is missing.

    First every passage takes its text's label. Then, in rounds, a toxic text lends its label
    only to the passages that the model finds most toxic, and the rest of it is left out.
    """
    labels = np.asarray(toxic)
    if not len(labels) or labels.min() == labels.max():
        return None
    numbers: dict[str, int] = {}
    documents = [
        np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32) for t in texts
    ]
    if not numbers:
        return None
    vocabulary = Vocabulary(numbers)
    del numbers
    rng = np.random.default_rng(seed)
    state, model = None, None
    # One text in five is not trained on: on these the threshold is set.
    apart = rng.random(len(labels)) < 0.2
    for turn in range(rounds + 1):
        passages, target = [], []
        values = None
        if model is not None:
            values = vocabulary.values(model.weights)
        for words, label, skip in zip(documents, labels, apart):
            if skip or not len(words):
                continue
            n = min(PASSAGE, len(words))
            if values is None:
                begins = np.arange(rng.integers(n), max(1, len(words) - n + 1), n)
                begins = begins if len(begins) else np.array([0])
                begins = rng.choice(begins, min(len(begins), 60), replace=False)
            else:
                margins = model.passages(values[words])
                top = int(margins.argmax())
                if label:
                    begins = np.flatnonzero((margins > 0) & (margins > margins[top] - 2))
                    begins = np.union1d(begins[:: max(1, len(begins) // 12)], [top])
                else:
                    begins = np.union1d(rng.integers(0, len(margins), 20), np.argsort(margins)[-6:])
            passages += [words[b : b + n] for b in begins]
            target += [int(label)] * len(begins)
        if len(set(target)) < 2:
            return None
        state = _train(passages, np.array(target), vocabulary, state, 3 if turn == 0 else 2, seed + turn)
        table, out, bias = state[:3]
        model = Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
    values = vocabulary.values(model.weights)
    best = np.array([model.passages(values[w]).max() for w, out in zip(documents, apart) if out])
    return Model(model.weights, model.bias - threshold(best, labels[apart]))


def threshold(margin: np.ndarray, label: np.ndarray) -> float:
    """The cut with the fewest wrong labels; the middle one of equally good ones. 0 for no texts.

    Between the texts on its two sides it lies at a third from the clean one: spellings that
    were not trained on score lower than those that were.
    """
    if not len(margin):
        return 0.0
    order = np.argsort(margin)
    margin, label = margin[order], label[order]
    # Texts below a cut count as clean, the others as toxic.
    wrong = np.concatenate([[0], np.cumsum(label)]) + np.concatenate([np.cumsum((1 - label)[::-1])[::-1], [0]])
    at = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[margin[0] - 1], margin, [margin[-1] + 1]])
    cut = at[len(at) // 2]
    return float((2 * edges[cut] + edges[cut + 1]) / 3)


_LAST: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """One scorer per Python worker, for the model of its present task."""
    if not _LAST or _LAST[0].model is not model:
        _LAST[:] = [Scorer(model)]
    return _LAST[0]


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_TEXTS, other: int = OTHER_TEXTS) -> Model | None:
    """Fit on about so many labelled texts of each kind; ids with remainder 0 modulo 5 stay out."""
    open_rows = labels.where(id_remainder(F.col("doc_id"), 5) != 0).where("doc_id is not null")
    chosen = [
        about(open_rows.where(F.col("toxic") == v).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), F.col("doc_id"), n, seed=6)
        for v, n in ((1, toxic), (0, other))
    ]
    rows = docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy("doc_id", "text").toPandas()
    texts, toxic = rows["text"].tolist(), rows["toxic"].tolist()
    del rows
    return fit(texts, toxic)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Only texts are inputs of a score. NULL texts count as empty; a text without letters scores as
    one passage without weights. NULL and repeated ids are rows like others. If a label is missing
    altogether, all scores are 0. The driver sees about ``TOXIC_TEXTS + OTHER_TEXTS`` texts.
    """
    model = train(docs.select("doc_id", "text"), labels)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.zeros(len(texts)))
        own = _scorer(shared.value)
        z = np.clip([own.margin(t) for t in texts], -30, 30)
        return pd.Series(1 / (1 + np.exp(-np.asarray(z, float))))

    return docs.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        run(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
