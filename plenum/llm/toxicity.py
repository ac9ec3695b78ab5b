"""Toxicity by a classifier chain of linear models over the presence of words.

Each category's model sees the words and the probabilities of the categories before it. In training these come from
models of the same kind that were fitted without the row's fold, so later models learn from probabilities as uncertain
as those that they get for new texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import settle

#: Labelled documents that are learned from, those of the smallest hashes of their ids; the bound of the training sample.
SAMPLE = 20_000
#: Words that the models use: all that are in so many documents of the sample and tell the classes apart so surely.
SUPPORT, SURE = 5, 4.0
FOLDS = 5
L2 = 0.1

#: Words of contempt by category, which divide the one toxicity label of the training rows.
LEXICON = {
    "intellect": ["idiot", "moron", "stupid", "dumb", "imbecile", "fool"],
    "worth": ["worthless", "pathetic", "loser", "useless", "failure", "clown"],
    "disgust": ["scum", "trash", "disgusting", "garbage", "filth", "vermin"],
}
CATEGORIES = [*LEXICON, "toxic"]


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words (runs of letters, lower case); none for null."""
    ws = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+")
    return F.transform(ws, lambda w: F.xxhash64(w))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, words, then a 0/1 column for each category): labelled documents, equal texts once.

    A document with several labels counts as toxic if half of them say so; labels without an id or a value are left out.
    """
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `sample` rows at most
    lower = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    said = {
        c: F.regexp_like(lower, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(ws)})(?!\p{{L}})")).cast("int") for c, ws in LEXICON.items()
    }
    return (
        rows.select(F.xxhash64("text").alias("h"), "toxic", F.array_distinct(word_hashes(F.col("text"))).alias("words"), *[e.alias(c) for c, e in said.items()])
        .groupBy("h")
        .agg(F.round(F.avg("toxic")).cast("int").alias("y"), F.first("words").alias("words"), *[F.first(c).alias(c) for c in said])
        .select("h", "words", *[(F.col(c) * F.col("y")).alias(c) for c in said], F.col("y").alias("toxic"))
    )


def choose_words(rows: DataFrame) -> list[int]:
    """The words that tell toxic rows from others: a test of two proportions; of the sample's words, those that pass reach the driver."""
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos or pos == n:
        return []
    seen = rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    share = F.col("n") / n
    z = (F.col("p") / pos - (F.col("n") - F.col("p")) / (n - pos)) / F.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))
    top = seen.where((F.col("n") >= SUPPORT) & (F.col("n") < n)).select("w", F.abs(z).alias("z")).where(F.col("z") >= SURE).orderBy(F.desc("z"), "w")
    return [r.w for r in top.collect()]


class Presence:
    """Rows of words, held as the places of the ones, and a few dense columns behind them."""

    def __init__(self, row: np.ndarray, place: np.ndarray, words: int, dense: np.ndarray):
        self.row, self.place, self.words, self.dense = row, place, words, dense

    @classmethod
    def of(cls, rows: list[list[int]] | np.ndarray, words: int = 0) -> Presence:
        """From lists of places of words, or all of it dense."""
        if isinstance(rows, np.ndarray):
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return cls(row, np.array([p for r in rows for p in r], np.int64), words, np.zeros((len(rows), 0)))

    def __len__(self) -> int:
        return len(self.dense)

    def beside(self, column: np.ndarray) -> Presence:
        return Presence(self.row, self.place, self.words, np.hstack([self.dense, column[:, None]]))

    def where(self, keep: np.ndarray) -> Presence:
        ones, new = keep[self.row], np.cumsum(keep) - 1
        return Presence(new[self.row[ones]], self.place[ones], self.words, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.place], len(self)) + self.dense @ w[self.words :]

    def sums(self, g: np.ndarray, power: int = 1) -> np.ndarray:
        return np.concatenate([np.bincount(self.place, g[self.row], self.words), (self.dense**power).T @ g])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: Presence, y: np.ndarray, l2: float = L2) -> np.ndarray:
    """Logistic regression; the last weight is the intercept, which is not held back.

    Newton's steps by conjugate gradients: only products with the sparse rows, no matrix of words by words.
    """
    a = x.beside(np.ones(len(x)))
    w = np.zeros(a.words + a.dense.shape[1])
    hold = np.full(len(w), l2)
    hold[-1] = 1e-3
    if not len(x):  # nothing learned: nothing is toxic
        w[-1] = -10.0
        return w

    def loss(w: np.ndarray) -> float:
        z = a.times(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (hold * w * w).sum() / 2)

    now = loss(w)
    for _ in range(30):
        p = _sigmoid(a.times(w))
        grad = a.sums(p - y) + hold * w
        curve = p * (1 - p)
        scale = a.sums(curve, 2) + hold
        step, left = np.zeros(len(w)), grad.copy()
        held = left / scale
        way, size = held.copy(), left @ held
        goal = size * 1e-6
        for _ in range(200):
            if size <= max(goal, 1e-18):
                break
            bent = a.sums(curve * a.times(way)) + hold * way
            far = size / (way @ bent)
            step += far * way
            left -= far * bent
            held = left / scale
            size, was = left @ held, size
            way = held + size / was * way
        part = 1.0
        while part > 1e-6 and loss(w - part * step) > now:
            part /= 2
        if part <= 1e-6:
            break
        w -= part * step
        now = loss(w)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _apply(w: np.ndarray, x: Presence) -> np.ndarray:
    return _sigmoid(x.times(w[:-1]) + w[-1])


@dataclass
class Chain:
    """Words and, for each category, the weights of the words, of the categories before it, and of 1."""

    words: list[int]
    categories: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: Presence | np.ndarray) -> np.ndarray:
        x = Presence.of(x) if isinstance(x, np.ndarray) else x
        for w in self.weights:
            x = x.beside(_apply(w, x))
        return x.dense[:, x.dense.shape[1] - len(self.weights) :]


def fit_chain(x: Presence | np.ndarray, y: np.ndarray, fold: np.ndarray, words: list[int], categories: list[str]) -> Chain:
    chain = Chain(words, categories)
    x = Presence.of(x) if isinstance(x, np.ndarray) else x
    for k in range(y.shape[1]):
        chain.weights.append(_fit(x, y[:, k]))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            if (fold != f).any():
                out[fold == f] = _apply(_fit(x.where(fold != f), y[fold != f, k]), x.where(fold == f))
        x = x.beside(out)
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: list[str] = CATEGORIES) -> Chain:
    """A chain fitted on at most `sample` labelled documents, which reach the driver as lists of chosen words."""
    rows = settle(training_rows(docs, labels, sample))
    words = choose_words(rows)
    place = {w: i for i, w in enumerate(words)}
    got = rows.select("h", _chosen(F.col("words"), words).alias("ws"), *categories).toPandas().sort_values("h")
    x = Presence.of([[place[w] for w in ws] for ws in got["ws"]], len(words))
    y = got[categories].to_numpy(float).reshape(len(got), len(categories))
    return fit_chain(x, y, (got["h"].to_numpy(np.int64) % FOLDS).astype(float), words, categories)


def _chosen(hashes: Column, words: list[int]) -> Column:
    known = F.split(F.lit(",".join(map(str, words))), ",") if words else F.array()  # one literal, however many words
    return F.array_intersect(hashes, known.cast("array<long>"))


def probabilities(text: Column, chain: Chain) -> Column:
    """struct of a probability for each category. A null or empty text has the probabilities of a text without known words."""
    place = {w: i for i, w in enumerate(chain.words)}

    @F.pandas_udf("struct<" + ",".join(f"{c}:double" for c in chain.categories) + ">")
    def of(found: pd.Series) -> pd.DataFrame:
        x = Presence.of([[place[w] for w in ws] for ws in found], len(place))
        return pd.DataFrame(chain.predict(x), columns=chain.categories)

    return of(_chosen(word_hashes(text), chain.words))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, a probability per category (rounded to 6 places), toxic_doc (the last one reaches threshold).

    Texts are read whole; null texts count as empty; null ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows. Without labelled rows of both kinds no document is toxic.
    """
    p = docs.select("doc_id", probabilities(F.col("text"), chain).alias("p"))
    return p.select(
        "doc_id", *[F.round(F.col("p")[c], 6).alias(f"p_{c}") for c in chain.categories], (F.col("p")[chain.categories[-1]] >= threshold).alias("toxic_doc")
    )
