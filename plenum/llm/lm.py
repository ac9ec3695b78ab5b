"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

A document is scored by the evidence of the others: c is an n-gram's count in the whole corpus less its count in the document itself
(a copy of the document is another one). A word w after u, v scores c(uvw) / c(uv) if c(uvw) is at least min_count, else `alpha` times
what it scores after v alone; a word by itself scores its share of the others' words, where one that no other document holds counts
as if it occurred once.

The counts are tables partitioned by the n-grams' hashes. So that exploded n-grams cost little to move, they are summed
up and packed by chunks of documents first; a chunk's n-grams are joined to the tables by hash, the totals return to the
chunk, and its documents' scores are summed. A frequent n-gram thus moves once for each chunk, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 1
#: Characters of a chunk of documents, and n-grams of one order in a part of its count table, about.
CHUNK_CHARS, PART_GRAMS = 8_000_000, 1_000_000
#: Bits of an n-gram's hash.
BITS = 52

_MESSAGE = "n int, part int, chunk int, grams binary, counts binary"


def pack(x: np.ndarray) -> bytes:
    """Numbers that are small for the most part: their bytes by place, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for n = 1, ... the hashes of the n-grams that end at each word (0 where none does)."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    total = int(size.sum())
    one = np.fromiter((x for ws in words for x in map(xxhash.xxh64_intdigest, ws)), np.uint64, total)
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out, x = [], one
    for n in range(1, order + 1):
        if n > 1:
            x = np.concatenate([np.zeros(min(1, total), np.uint64), _mixed(x[:-1], one[1:])])
        out.append(np.where(place >= n - 1, (x >> np.uint64(64 - BITS)) | np.uint64(1), np.uint64(0)))
    return size, out


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the sorted keys begins, and the end: parts are ranges of hashes."""
    edges = np.arange(1, parts, dtype=np.float64) * (2.0**BITS / parts)
    return np.concatenate([[0], np.searchsorted(keys, edges.astype(np.uint64)), [len(keys)]])


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per document: doc_id, n_words, n_backoff (words whose longest n-gram the other documents hold fewer than min_count
    times), n_once (words whose longest n-gram occurs nowhere else, this document included), log_score (natural, 4 places), mean_log.

    Words are runs of other than ASCII white space, as they are. A null or empty text has no words, log_score 0
    and mean_log null. Null ids and repeated rows stay, and all count; texts are read whole; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chars, = told.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    chunks = max(1, round(chars / CHUNK_CHARS))
    parts = max(1, round(chars / 6 / PART_GRAMS))
    dealt = told.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(
        max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk"
    )

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        """A chunk's n-grams with their counts, by order and part of the hashes."""
        chunk = int(pdf["chunk"].iloc[0])
        _, found = grams(pdf["text"].tolist(), order)
        rows = []
        for n, x in enumerate(found, 1):
            keys, counts = np.unique(x[x > 0], return_counts=True)
            ends = _parts(keys, parts)
            for p in np.flatnonzero(np.diff(ends)):
                k = keys[ends[p] : ends[p + 1]]
                rows.append((n, int(p), chunk, pack(np.diff(k, prepend=np.uint64(0))), pack(counts[ends[p] : ends[p + 1]])))
        return pd.DataFrame(rows, columns=["n", "part", "chunk", "grams", "counts"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part of a count table, joined to the n-grams of each chunk: their totals, in the chunk's order."""
        each = [np.cumsum(unpack(b)) for b in pdf["grams"]]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(b) for b in pdf["counts"]])).astype(np.uint64)
        ends = np.cumsum([len(x) for x in each])
        return pd.DataFrame(
            {"n": pdf["n"], "part": pdf["part"], "chunk": pdf["chunk"], "grams": None, "counts": [pack(t) for t in np.split(total[at], ends[:-1])]}
        )

    sent = dealt.groupBy("chunk").applyInPandas(send, _MESSAGE)
    totals = sent.groupBy("n", "part").applyInPandas(count, _MESSAGE).select("n", "part", "chunk", "counts")
    words = told.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]

    def total_up(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_backoff": [], "n_once": [], "log_score": []})
        size, found = grams(pdf["text"].tolist(), order)
        if not len(got):  # no words in the chunk, and no columns in the frame
            got = pd.DataFrame({"n": [], "part": [], "counts": []})
        got = got.sort_values(["n", "part"])
        doc = np.repeat(np.arange(len(pdf)), size)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        seen, alone = [], np.zeros(len(doc), bool)
        for n, x in enumerate(found, 1):
            there = x > 0
            keys, at = np.unique(x[there], return_inverse=True)
            own = got.loc[got["n"] == n, "counts"]
            c = np.concatenate([unpack(b) for b in own]).astype(np.float64) if len(own) else np.zeros(0)
            # less what the document itself holds of them
            _, which, held = np.unique(doc[there] * max(len(keys), 1) + at, return_inverse=True, return_counts=True)
            full = np.zeros(len(x))
            full[there] = c[at] - held[which]
            seen.append(full)
            alone[there] = c[at] == 1
        value = np.log(np.maximum(seen[0], 1) / np.maximum(words - size[doc], 1))
        back = np.zeros(len(doc), np.int64)  # words that fell back below the longest history there is
        for n in range(2, order + 1):
            context = np.concatenate([[1.0], seen[n - 2][:-1]])[: len(doc)]
            there = place >= n - 1
            known = there & (seen[n - 1] >= min_count)
            value = np.where(known, np.log(np.maximum(seen[n - 1], 1) / np.maximum(context, 1)), np.where(there, value + np.log(alpha), value))
            back = np.where(there, ~known, back)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "n_words": size,
                "n_backoff": np.bincount(doc, back, minlength=len(pdf)).astype(np.int64),
                "n_once": np.bincount(doc, alone, minlength=len(pdf)).astype(np.int64),
                "log_score": np.bincount(doc, value, minlength=len(pdf)),
            }
        )

    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(
        total_up, "doc_id long, n_words long, n_backoff long, n_once long, log_score double"
    )
    return scored.select(
        "doc_id",
        "n_words",
        "n_backoff",
        "n_once",
        F.round("log_score", 4).alias("log_score"),
        F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 4)).alias("mean_log"),
    )
