"""WebVTT captions: cues, rolling-line merging and plain text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.operators.intervals import assign_words

_TIME = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """One row per cue of each file: file, cue (0, 1, ...), start, end, lines. Blocks without a time line are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("vtt"))
    return cues(whole, "file", "vtt")


def cues(docs: DataFrame, key: str, vtt: str) -> DataFrame:
    block = F.posexplode(F.split(F.regexp_replace(vtt, "\r\n?", "\n"), r"\n\s*\n"))
    lines = F.split("block", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    each = docs.select(key, block.alias("n", "block")).select(key, "n", lines.alias("lines"), at.alias("at")).where("at > 0")
    time = F.get("lines", F.col("at") - 1)
    each = each.where(F.regexp_like(time, F.lit(_TIME)))
    # a time line's eight numbers by one match
    each = each.select(key, "n", "lines", "at", F.split(F.regexp_replace(time, f"(?s){_TIME}.*", " ".join(f"${g}," for g in range(1, 9))), ",").alias("t"))
    part = lambda g: F.coalesce(F.nullif(F.trim(F.get("t", F.lit(g - 1))), F.lit("")).cast("double"), F.lit(0.0))
    seconds = lambda g: part(g) * 3600 + part(g + 1) * 60 + part(g + 2) + part(g + 3) / 1000
    order = F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1
    return each.select(
        key, order.cast("long").alias("cue"), F.round(seconds(1), 3).alias("start"), F.round(seconds(5), 3).alias("end"),
        F.filter(F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "").alias("lines"),
    )


# Seconds by which a cue may begin after the last one's end and still roll on from it, and seconds of a cue that only shows again.
ROLLS, SNAPSHOT = 0.05, 0.05


def plain_line(line: Column) -> Column:
    """A caption line without tags, its basic references read."""
    x = F.regexp_replace(line, "<[^>]+>", "")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(char))
    return x


def merge_rolling(lines: Column) -> Column:
    """Caption lines as one text: of each line, the tokens that repeat the end of what is said so far (the longest such overlap) go.

    Tokens are compared without case and signs. A cue has a few lines of a few words, which are folded in place; each token is read once.
    """
    key = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    token = lambda w: F.struct(w.alias("word"), key(w).alias("key"))
    words = lambda x: F.transform(F.filter(F.split(plain_line(x), r"\s+"), lambda w: w != ""), token)

    def fold(said: Column, new: Column) -> Column:
        n = F.size(said)
        fits = F.filter(F.sequence(F.lit(0), F.least(n, F.size(new))), lambda k: (k == 0) | (F.slice(said, F.greatest(n - k + 1, F.lit(1)), k)["key"] == F.slice(new, F.lit(1), k)["key"]))
        return F.concat(said, F.slice(new, F.array_max(fits) + 1, F.size(new)))

    return F.array_join(F.aggregate(F.transform(lines, words), F.array().cast("array<struct<word: string, key: string>>"), fold)["word"], " ")


def overlap(said: list[str], new: list[str]) -> int:
    """The longest end of said that new begins with, in one pass: borders of new, a mark, and as much of said's end as new is long."""
    line = [*new, None, *said[-len(new) :]] if new else [None]
    border = [0] * len(line)
    for i in range(1, len(line)):
        k = border[i - 1]
        while k and line[i] != line[k]:
            k = border[k - 1]
        border[i] = k + (line[i] == line[k] and line[i] is not None)
    return border[-1] if len(line) > len(new) + 1 else 0


def _roll(cues: Iterable[tuple[float, float, str]]) -> Iterator[tuple[str, float, float]]:
    said: list[str] = []
    before: float | None = None
    for start, end, text in cues:
        tokens = text.split()
        new = [re.sub(r"\W+", "", t).casefold() for t in tokens]
        if end <= start or not tokens:
            continue
        again = overlap(said, new) if before is not None and start <= before + ROLLS else 0
        whole = again == len(new)
        if whole and end - start <= SNAPSHOT:
            before = end
            continue
        if whole and start >= before:  # said once more, not shown once more
            again = 0
        each = (end - start) / len(tokens)
        for i in range(again, len(tokens)):
            yield tokens[i], round(start + i * each, 3), round(start + (i + 1) * each, 3)
        said += new[again:]
        before = end


def timed_words(cues: DataFrame, key: str) -> DataFrame:
    """The words of rolling captions, each once: key, word_id (0, 1, ...), word, word_start, word_end.

    cues: key, cue (their order), start, end, lines. A cue repeats the longest end of what was said that it begins with; one that only
    shows this again is left out; one that says it again later is kept. A cue's words share its time evenly. What a cue repeats depends on
    all before it, so a recording is worked through in order, in one group as long as a recording is. No cues, no words.
    """
    told = cues.select(key, "cue", "start", "end", merge_rolling(F.col("lines")).alias("text"))
    kind = told.schema[key].dataType.simpleString()

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("cue")
        words = list(_roll(zip(df["start"], df["end"], df["text"], strict=True)))
        out = pd.DataFrame(words, columns=["word", "word_start", "word_end"])
        out.insert(0, key, df[key].iloc[0])
        out.insert(1, "word_id", range(len(words)))
        return out

    return told.groupBy(key).applyInPandas(one, f"`{key}` {kind}, word_id long, word string, word_start double, word_end double")


def caption_text(cues: DataFrame, key: str) -> DataFrame:
    """key and all that a recording's captions say, each word once."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word"))), lambda x: x["word"])
    return timed_words(cues, key).groupBy(key).agg(F.array_join(each, " ").alias("text"))


def align(cues: DataFrame, turns: DataFrame, offset: float = 0.0) -> DataFrame:
    """The turns with what captions say in them: meeting, segment_id, text (null for a turn without words).

    cues as cues() gives them, with the key meeting; offset seconds are taken off their times, for turns of a clip. Words go to turns as
    assign_words() says; words outside all turns are left out. Captions are worked through once.
    """
    words = timed_words(cues, "meeting").withColumns({c: F.col(c) - offset for c in ("word_start", "word_end")})
    told = assign_words(words, turns, width=60.0, keep=["word"])
    each = F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word"))), lambda x: x["word"])
    texts = told.where("segment_id is not null").groupBy("meeting", "segment_id").agg(F.array_join(each, " ").alias("text"))
    return turns.select("meeting", "segment_id").join(texts, ["meeting", "segment_id"], "left")
