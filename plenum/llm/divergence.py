"""Source divergence audit: how far the words of each source lie from those of its language and of the language's other sources.

A task counts words as bytes and hands on one row for each (lang, source, word) it met; Spark sums those. All that follows works on
count tables. Terms of a group with equal counts in the group and in the language have equal values, so values are worked out for such
cells, cells of equal value are merged, and only the cells that reach into the first ranks are expanded into their terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import maybe_broadcast, settle

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Entries of the count tables that a task holds before it hands them on.
HELD = 400_000
#: Groups, (lang, source), whose totals are broadcast; more are joined by shuffling.
FEW_GROUPS = 50_000
#: Entries of a block of cells by sources.
BLOCK = 2_000_000

#: Letters A to Z to a to z, other ASCII characters that are no letters to a space; all other bytes are parts of letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(body: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with only A to Z lower-cased."""
    return body.translate(_FOLD).split()


def _tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and of documents for each (lang, source, word) of a task; the empty word stands for the group itself."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pd.DataFrame:
        rows = [(lang, source, w, n[w], d) for (lang, source), (n, docs) in seen.items() for w, d in docs.items()]
        seen.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for frame in frames:
        for lang, source, body in zip(frame["lang"], frame["source"], frame["body"], strict=True):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            told = words(body)
            n.update(told)
            docs.update({b"", *told})
        if sum(len(docs) for _, docs in seen.values()) > HELD:
            yield out()
    if seen:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with any. A row with the empty term stands for each group."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    parts = clean.mapInPandas(_tally, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)) in whole numbers of 38 digits; null where no term is kept."""
    return F.when(F.col(kept) > 0, F.expr(f"1 + (cast({SCALE} as decimal(38, 0)) * (`{n}` + {PRIOR})) div (cast(`{total}` as decimal(38, 0)) + {PRIOR} * `{kept}`)"))


def _differences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each language of a task, the sums of abs(p - q) over its cells for all pairs of sources."""
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, part in frame.groupby("lang"):
            absent = np.asarray(part["absent"].iloc[0], dtype=np.int64)
            total = sums.setdefault(lang, np.zeros((len(absent), len(absent)), dtype=np.int64))
            step = max(1, BLOCK // len(absent))
            for at in range(0, len(part), step):
                some = part.iloc[at : at + step]
                p = np.tile(absent, (len(some), 1))
                for i, (where, values) in enumerate(zip(some["place"], some["p"], strict=True)):
                    p[i, np.asarray(where, dtype=np.int64)] = values
                times = some["times"].to_numpy(dtype=np.int64)
                for g in range(len(absent)):
                    total[g] += times @ np.abs(p - p[:, g : g + 1])
    for lang, total in sums.items():
        a, b = np.indices(total.shape)
        yield pd.DataFrame({"lang": lang, "a": a.ravel(), "b": b.ravel(), "value": total.ravel()})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source; nulls count as '').

    Each language keeps the terms found in at least min_docs of its documents. Part `pair` has a row for each other source of the
    language: the sum over kept terms of the difference of their shares, 0 where no term is kept. Part `term` has the first top kept
    terms by which a group exceeds its language. Values descend, ties go by the item's UTF-8 bytes. An empty table gives no rows;
    repeated rows and texts count each time; other columns of docs, whatever their names, are not read.

    What grows with the corpus is only the count tables. The pairs of sources are the result itself, so a language's sources are held
    as one vector; a language's terms are spread over tasks. The first ranks of a hot group are cut in each task before they meet.
    """
    counts = settle(term_counts(docs))
    groups = counts.where("term = ''").select("lang", "source")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= min_docs).drop("lang_docs")
    kept = settle(kept)
    rows = settle(counts.where("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = settle(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"]).withColumn("place", place))
    small = maybe_broadcast(totals, FEW_GROUPS)
    valued = rows.join(small, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")})
    return pairs(valued, totals).unionByName(leading(valued, top))


def pairs(valued: DataFrame, totals: DataFrame) -> DataFrame:
    """Part `pair`: terms with the same counts in all sources of a language are one cell, met once with its multiplicity."""
    absent = totals.withColumn("zero", F.lit(0).cast("long")).withColumn("p0", share("zero", "total", "kept"))
    absent = absent.where("kept > 0").groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "p0"))), lambda x: x["p0"]).alias("absent"))
    vectors = valued.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("vector"))
    cells = vectors.groupBy("lang", "vector").agg(F.count("*").alias("times")).join(maybe_broadcast(absent, FEW_GROUPS), "lang")
    told = cells.select("lang", F.col("vector.place").alias("place"), F.col("vector.p").alias("p"), "times", "absent")
    sums = told.mapInPandas(_differences, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = totals.select("lang", "source", F.col("place").alias("a"))
    two = totals.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    every = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(order))


def leading(valued: DataFrame, top: int) -> DataFrame:
    """Part `term`: cells ranked by what stands before them, those of equal value merged, and the first expanded term by term."""
    over = valued.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    cells = over.groupBy("lang", "source", "n", "lang_n").agg(F.first("value").alias("value"), F.count("*").alias("times"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # each value has a term at least, so values beyond the first `top` can't reach the ranks; this cut is made in every task
    first = merged.withColumn("nth", F.row_number().over(down)).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("times").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    same = Window.partitionBy("lang", "source", "value", "before").orderBy("term")
    told = over.select("lang", "source", "value", "term").join(first, ["lang", "source", "value"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= top)
    rank = (F.col("before") + F.col("nth")).cast("int")
    return told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"), rank.alias("rank")).where(F.col("rank") <= top)
