"""Benchmark decontamination by a prefix-filtered set join. Built-in functions only.

An item's windows of 13 words are sets of shingles of up to three words. A document contains a window only if it
contains all its shingles, so a prefix of one shingle is necessary, and the rarest is the cheapest. Steps:

1. one pass over the documents keeps the places of shingles that the benchmark has, with the words around them;
2. counts of these places order the shingles by rarity; a window with an absent shingle cannot occur (length bound);
3. each window's rarest shingle is joined to its places; its offset fixes where the window starts, which has to lie
   inside the document (positional bound);
4. the words around the place are compared with the window, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import maybe_broadcast, settle, small_enough

WINDOW = 13
SHINGLE = 3
#: Rows of benchmark shingles or windows that may be broadcast; with more, the joins shuffle.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything below 0x80 but digits and small letters parts words.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAP)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows: w (words), n, and the shingles in them with their offsets."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cut = listed.select(
        "item_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window)
            )
        ).alias("w"),
    )
    return cut.distinct()


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n, w): each place (0-based) at which a window of n words, w, occurs in a document.

    doc_id may be of any type; rows of one doc_id have to hold one text. Null texts and items have no words, and without words
    on either side there are no rows.
    """
    found = settle(_windows(items, window).select("w").distinct())
    size = lambda ws: F.least(F.size(ws), F.lit(SHINGLE))
    told = settle(
        found.select(
            "w",
            F.size("w").alias("n"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - size("w") + 1), lambda i: F.array_join(F.slice("w", i, size("w")), " ")
                )
            ).alias("offset", "shingle"),
        )
    )
    sizes = sorted(r[0] for r in told.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # three at most
    keys = told.select("shingle").distinct()
    listed = docs.select("doc_id", words(F.col("text")).alias("ws"))

    def grams(k: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("ws") - k),
            lambda i: F.struct(
                i.alias("pos"), F.lit(k).alias("k"), F.concat_ws(" ", *[F.get("ws", i + j) for j in range(k)]).alias("shingle")
            ),
        )

    none = F.array().cast("array<struct<pos:int,k:int,shingle:string>>")
    places = F.concat(none, *[F.when(F.size("ws") >= k, grams(k)).otherwise(none) for k in sizes])
    if small_enough(keys, BROADCAST_ROWS):
        each = listed.select("doc_id", "ws", F.explode(places).alias("g")).select("doc_id", "ws", "g.*").join(F.broadcast(keys), "shingle")
    else:  # only places move; those that the benchmark has come back to their texts, which move once
        some = listed.select("doc_id", F.explode(places).alias("g")).select("doc_id", "g.*").join(keys, "shingle")
        at = some.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "k", "shingle")).alias("gs")).withColumnRenamed("doc_id", "of")
        texts = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
        back = texts.join(at, texts.doc_id.eqNullSafe(at.of)).select("doc_id", words(F.col("text")).alias("ws"), "gs")
        each = back.select("doc_id", "ws", F.explode("gs").alias("g")).select("doc_id", "ws", "g.*")
    whole = F.col("k") < SHINGLE  # the shingle is the window
    around = settle(
        each.select(
            "doc_id",
            "pos",
            "shingle",
            F.when(whole, 0).otherwise(F.least(F.col("pos"), F.lit(window))).alias("before"),
            F.slice(
                "ws", F.when(whole, F.col("pos")).otherwise(F.greatest(F.col("pos") - window, F.lit(0))) + 1, F.when(whole, F.col("k")).otherwise(2 * window + SHINGLE)
            ).alias("near"),
        )
    )
    rarity = around.groupBy("shingle").agg(F.count("*").alias("places"))
    # the first in the order of rarity; windows with an absent shingle go
    ranked = told.join(rarity, "shingle", "left")
    prefix = ranked.groupBy("w", "n").agg(
        F.min_by(F.struct("shingle", "offset"), F.struct("places", "shingle", "offset")).alias("first"),
        F.count_if(F.col("places").isNull()).alias("absent"),
    )
    needed = settle(prefix.where("absent = 0").select("w", "n", "first.shingle", "first.offset"))
    at = F.col("before") - F.col("offset")
    return (
        around.join(maybe_broadcast(needed, BROADCAST_ROWS), "shingle")
        .where((at >= 0) & (at + F.col("n") <= F.size("near")))
        .where(F.slice("near", at + 1, F.col("n")) == F.col("w"))
        .select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "n", "w")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window: 13 consecutive words of an item, or the whole of a shorter
    item that has words. contaminated: some word is hit, and `share` times the hits are at least the words.

    Each row is judged by its own text: rows are told apart by id and text, so null ids and ids that several texts share are
    documents like any other, and repeated rows each give the same row. A null text has no words; a null item_id is left out of
    the items' list; repeated items count once. Items without words never occur. Empty tables give no rows, or no hits. Other
    columns are ignored.
    """
    told = F.col("text").cast("string")
    key = F.struct("doc_id", F.xxhash64(told).alias("h"), F.hash(told).alias("g"))
    docs = docs.select("doc_id", "text")
    hits = settle(find_windows(docs.select(key.alias("doc_id"), "text"), items, window).distinct())
    covered = hits.groupBy("doc_id").agg(
        F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(F.collect_set(F.struct("start", "n")), lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))
                )
            )
        )
        .cast("long")
        .alias("n_hit")
    )
    owners = _windows(items, window).where("item_id is not null")
    named = (
        hits.select("doc_id", "w")
        .distinct()
        .join(maybe_broadcast(owners, BROADCAST_ROWS), "w")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    )
    sums = covered.join(named, "doc_id", "left").select(F.col("doc_id").alias("hit_key"), "n_hit", "ids")
    out = docs.select("doc_id", key.alias("key"), count_words(F.col("text")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.join(sums, F.col("key") == F.col("hit_key"), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
