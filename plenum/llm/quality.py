"""Quality by weak labels: EM over heuristic labellers, then a hashed linear scorer.

Labellers vote good (1), bad (0) or abstain (-1). Documents with the same votes are alike to the label model, so it works on
the counts of vote patterns over all documents: EM estimates the share of good documents and how often each labeller votes
what on good and on bad ones. The patterns' posteriors are labels for a linear model over hashed words and word shapes,
which scores whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, repeat
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import settle

#: Distinct texts that the scorer is fitted on, those of the smallest hashes; the bound of the training sample.
SAMPLE = 3_000
#: Buckets of hashed features.
BUCKETS = 1 << 16
ROUNDS = 200


_SYMBOLS = list(rb"#$%&*|~^<>{}\_=+")
_END = re.compile(rb"[.?!](?=\s|\Z)")
_RUNS = re.compile(rb"(\S)\1+")
#: Capitals, small letters and digits as A, a and 0; bytes of other than ASCII characters count as small letters.
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
STATISTICS = ["chars", "words", "upper", "lower", "symbols", "shouts", "ends", "distinct", "twins"]


def statistics(texts: pd.Series) -> dict[str, np.ndarray]:
    """Counts over whole texts that the labellers look at."""
    rows = np.zeros((len(texts), len(STATISTICS)), np.int64)
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        ws = b.split()
        h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        others = h[0xC2:].sum()  # first bytes of other than ASCII characters
        rows[i] = (
            len(t or ""), len(ws), h[65:91].sum(), h[97:123].sum() + others, h[_SYMBOLS].sum(), h[33],
            sum(1 for _ in _END.finditer(b)), len(set(ws)), sum(map(eq, ws, ws[1:])),
        )
    return dict(zip(STATISTICS, rows.T))


def labellers(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Overlapping heuristics: each votes 1 (good) or 0 (bad), or abstains (-1).

    Bad texts are bad in one way or another, so most labellers know one fault and abstain without it.
    """
    n, letters = s["words"], s["upper"] + s["lower"]
    bad = lambda x: np.where(x, 0, -1)
    good = lambda x: np.where(x, 1, -1)
    enough = n >= 5
    tidy = (letters > 0) & (s["symbols"] * 50 <= n) & (s["shouts"] * 50 <= n) & (s["upper"] * 5 <= letters)
    return {
        "symbols": bad(s["symbols"] * 10 > n * 3),
        "symbol_share": bad(s["symbols"] * 50 > s["chars"]),
        "capitals": bad(enough & (s["upper"] * 10 > letters * 3)),
        "shouting": bad(s["shouts"] * 10 > n),
        "repeats": bad(enough & (s["twins"] * 10 > n)),
        "variety": bad((n >= 20) & (n < 1000) & (s["distinct"] * 10 < n * 3)),
        "sentences": bad((n >= 30) & (s["ends"] * 80 < n)),
        "word_length": bad(enough & ((s["chars"] > n * 14) | (s["chars"] < n * 2))),
        "empty": bad(letters == 0),
        "tidy": good(tidy & (s["twins"] * 50 <= n)),
        "rhythm": good(tidy & ((n < 10) | (s["ends"] * 25 > n))),
        "wording": good(tidy & (s["chars"] <= n * 10) & (s["chars"] >= n * 4) & (s["distinct"] * 4 > n)),
    }


def votes(texts: pd.Series) -> np.ndarray:
    """A row of votes for each text, in the labellers' order."""
    return np.stack(list(labellers(statistics(texts)).values()), axis=1)


@dataclass
class LabelModel:
    """The share of good documents, and each labeller's chances to vote 0, 1 or -1 on bad and on good ones."""

    good: float
    votes: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.good, self.good]), (len(patterns), 1))
        for j in range(patterns.shape[1]):
            log += np.log(self.votes[j][:, patterns[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = (1 - self.good) * self.votes[:, 0, 0] + self.good * self.votes[:, 1, 1]
        cast = (1 - self.good) * self.votes[:, 0, :2].sum(axis=1) + self.good * self.votes[:, 1, :2].sum(axis=1)
        return right / np.maximum(cast, 1e-12)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM from the majority of votes; smoothed, and labellers are taken to be better than chance at the start."""
    n = counts.sum()
    share = np.array([((patterns == 1).sum(axis=1) + 0.5), ((patterns == 0).sum(axis=1) * 2 + 0.5)])
    post = share[0] / share.sum(axis=0)
    model = LabelModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        w = np.array([counts * (1 - post), counts * post])
        total = w.sum(axis=1)
        votes = np.array([[[(w[c] * (patterns[:, j] == v)).sum() + 0.01 for v in (0, 1, -1)] for c in (0, 1)] for j in range(patterns.shape[1])])
        model = LabelModel(float(np.clip(total[1] / max(n, 1), 0.01, 0.99)), votes / votes.sum(axis=2, keepdims=True))
        new = model.posterior(patterns)
        done = np.abs(new - post).max(initial=0.0) < 1e-9
        post = new
        if done:
            break
    return model


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and of their shapes, repeats included, and one for each word that follows itself."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ws = b.split()
    shapes = _RUNS.sub(rb"\1", b.translate(_SHAPE)).split()
    x = np.fromiter(chain(map(crc32, ws), map(crc32, shapes, repeat(1))), np.uint32) % BUCKETS
    return np.concatenate([x, np.full(sum(map(eq, ws, ws[1:])), crc32(b"twin", 2) % BUCKETS)]).astype(np.int32)


def _mean(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(r) for r in rows])
    if not size.sum():
        return np.zeros(len(rows))
    flat = weights[np.concatenate(rows)]
    ends = np.cumsum(size)
    sums = np.concatenate([[0.0], np.cumsum(flat)])
    return (sums[ends] - sums[ends - size]) / np.maximum(size, 1)


def fit_scorer(rows: list[np.ndarray], y: np.ndarray, passes: int = 60, rate: float = 20.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on mean-pooled features with soft labels y: gradient steps with each weight's own rate."""
    size = np.maximum([len(r) for r in rows], 1)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    w, b = np.zeros(BUCKETS), 0.0
    seen, seen_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(_mean(w, rows) + b, -30, 30)))
        err = (p - y) / max(len(rows), 1)
        g = np.bincount(flat, (err / size)[of], minlength=BUCKETS) + l2 * w
        seen += g * g
        seen_b += err.sum() ** 2
        w -= rate / passes**0.5 * g / np.sqrt(seen)
        b -= 0.5 * err.sum() / np.sqrt(seen_b)
    return w, b


def judge(docs: DataFrame, sample: int = SAMPLE, keep: float = 0.5) -> DataFrame:
    """One row per document: doc_id, votes (in the order of labellers()), posterior, score (the linear model's), keep.

    The posterior is the label model's, from all documents' votes; score is the linear model's estimate of it, fitted on
    `sample` distinct texts at most; keep says that the score reaches `keep`. Both are rounded to 6 places.

    A null text is empty; an empty text gets the empty labeller's vote. Texts are read whole; null ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    @F.pandas_udf("array<int>")
    def voted(texts: pd.Series) -> pd.Series:
        return pd.Series(list(votes(texts).astype(np.int32)))

    # 3 to the power of the labellers at most
    counted = told.select(voted("text").alias("votes")).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns = np.array([r.votes for r in counted], np.int64).reshape(len(counted), -1 if counted else 1)
    model = fit_label_model(patterns, np.array([r.n for r in counted], float))
    posterior = dict(zip(map(tuple, patterns.tolist()), model.posterior(patterns).tolist()))

    @F.pandas_udf("array<int>")
    def spread(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    hashed = told.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # only hashes meet in one task
    first = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))
    few = settle(first.select("h", voted("text").alias("votes"), spread("text").alias("f"))).toPandas()
    few = few.sort_values("h")
    w, b = fit_scorer([np.asarray(f, np.int32) for f in few["f"]], np.array([posterior[tuple(v)] for v in few["votes"]]))
    shared = docs.sparkSession.sparkContext.broadcast(w)  # half a megabyte

    @F.pandas_udf("struct<votes:array<int>,posterior:double,score:double>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        own = votes(texts).astype(np.int32)
        z = np.concatenate([np.zeros(0), *(_mean(shared.value, [features(t)]) for t in texts)]) + b
        return pd.DataFrame({"votes": list(own), "posterior": [posterior[tuple(v)] for v in own.tolist()], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return told.select("doc_id", rate("text").alias("r")).select(
        "doc_id",
        "r.votes",
        F.round("r.posterior", 6).alias("posterior"),
        F.round("r.score", 6).alias("score"),
        (F.col("r.score") >= keep).alias("keep"),
    )
