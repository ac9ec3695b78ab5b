"""Minutes reconciled with an agenda and its speakers: which item and whom they mean, the votes to write, and where stored ones differ.

Everything is an equal-key join: acts by their whole reference or else by a number that counts only where it is alone on both sides;
names by the ends of the speakers' names, written out word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a carried motion's vote begins, and what the sides of a vote are called in a record.
WORDS = {"adopt": "Passed", "amend": "Passed", "continue": "Continued", "pull": "Pulled"}
SIDES = {"ayes": "aye", "nays": "nay", "abstain": "abstain"}
NUMBER = r"(?<!\d)(\d{4}-\d{1,3})\s*$"


def match_items(items: DataFrame, agenda: DataFrame, meeting: str) -> DataFrame:
    """items with item_id and matched_by; agenda: `meeting`, item_id, legislation_ref.

    exact: one agenda item has the reference. duplicate: several have it, none is meant. number: no item has it, and the bare number is
    alone among the minutes' items and among the agenda's. ambiguous: that number isn't alone. none: no item has the number either.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, NUMBER, 1), F.lit(""))
    known = agenda.where("legislation_ref is not null").select(F.col(meeting).alias("__m"), "item_id", F.col("legislation_ref").alias("__ref"), number(F.col("legislation_ref")).alias("__number"))
    count = lambda *by: known.groupBy(*by).agg(F.count("*").alias("n"), F.min("item_id").alias("id"))
    by_ref = count("__m", "__ref").select(F.col("__m").alias("__a"), "__ref", F.struct("n", "id").alias("whole"))
    by_number = count("__m", "__number").where("__number is not null").select(F.col("__m").alias("__b"), "__number", F.struct("n", "id").alias("bare"))
    own = items.withColumn("__own", number(F.col("legislation_ref")))
    said = own.groupBy(F.col(meeting).alias("__c"), F.col("__own").alias("__said")).agg(F.count("*").alias("times"))
    j = own.join(by_ref, (own[meeting] == F.col("__a")) & (own["legislation_ref"] == F.col("__ref")), "left")
    j = j.join(by_number, (own[meeting] == F.col("__b")) & (F.col("__own") == F.col("__number")), "left")
    j = j.join(said, (own[meeting] == F.col("__c")) & (F.col("__own") == F.col("__said")), "left")
    how = (
        F.when(F.col("whole.n") == 1, "exact").when(F.col("whole.n") > 1, "duplicate")
        .when((F.col("bare.n") == 1) & (F.col("times") == 1), "number").when(F.col("bare.n").isNotNull(), "ambiguous").otherwise("none")
    )
    item = F.when(how == "exact", F.col("whole.id")).when(how == "number", F.col("bare.id"))
    return j.select(*[own[c] for c in items.columns], item.alias("item_id"), how.alias("matched_by"))


def match_speakers(names: DataFrame, speakers: DataFrame, meeting: str) -> DataFrame:
    """(meeting, name, speaker_id, n): the one speaker whose name is, or ends with, a name of the minutes; n speakers do. Case counts nowhere."""
    words = F.split(F.lower("display_name"), " ")
    ends = F.array_distinct(F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, F.size(words)), " ")))
    known = speakers.select(F.col(meeting).alias("__m"), "speaker_id", F.explode(ends).alias("__end")).groupBy("__m", "__end").agg(F.count("*").alias("n"), F.min("speaker_id").alias("id"))
    asked = names.select(meeting, "name").distinct()
    j = asked.join(known, (asked[meeting] == known["__m"]) & (F.lower(F.trim("name")) == known["__end"]), "left")
    return j.select(asked[meeting], "name", F.when(F.col("n") == 1, F.col("id")).alias("speaker_id"), F.coalesce("n", F.lit(0)).alias("n"))


def result_text(kind: Column, ayes: Column, nays: Column, abstain: Column, carried: Column, tag: Column) -> Column:
    """`Passed 8–0, 1 abstaining`; only the count where a motion neither carried nor failed by its tag or its count."""
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    word = F.when(carried, F.try_element_at(words, kind)).when((tag == "FAILED") | (ayes < nays), "Failed")
    count = F.concat(ayes.cast("string"), F.lit("–"), nays.cast("string"))
    return F.concat(F.concat_ws(" ", word, count), F.when(abstain > 0, F.concat(F.lit(", "), abstain.cast("string"), F.lit(" abstaining"))).otherwise(""))


def planned_votes(motions: DataFrame, matched: DataFrame, speakers: DataFrame, meeting: str) -> DataFrame:
    """The votes to write: meeting, position, motion, resolution, description, result, item_id, records (speaker_id, position), skipped.

    motions as plenum.sources.motions has them, matched as match_items(). A motion counts if it was voted on and isn't procedural or unknown.
    Names that no speaker or several have are skipped and counted.
    """
    keys = [meeting, "position", "motion"]
    kept = motions.where(F.col("kind").isin(list(WORDS)) & F.col("ayes").isNotNull())
    called = lambda side: lambda x: F.struct(x.alias("name"), F.lit(side).alias("position"))
    sides = F.flatten(F.array(*[F.transform(f"{s}_names", called(p)) for s, p in SIDES.items()]))
    said = kept.select(*keys, F.posexplode(sides).alias("i", "s")).select(*keys, "i", "s.name", F.col("s.position").alias("side"))
    whom = match_speakers(said, speakers, meeting).select(F.col(meeting).alias("__m"), F.col("name").alias("__name"), "speaker_id")
    told = said.join(whom, (said[meeting] == whom["__m"]) & (said["name"] == whom["__name"]), "left")
    record = F.when(F.col("speaker_id").isNotNull(), F.struct("i", "speaker_id", F.col("side").alias("position")))
    held = told.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("r"), F.count_if(F.col("speaker_id").isNull()).alias("skipped"))
    items = matched.select(meeting, "position", "item_id")
    result = result_text(*[F.col(c) for c in ("kind", "ayes", "nays", "abstain", "carried", "tag")])
    records = F.transform(F.coalesce("r", F.array().cast(held.schema["r"].dataType)), lambda x: F.struct(x["speaker_id"].alias("speaker_id"), x["position"].alias("position")))
    return kept.join(items, [meeting, "position"], "left").join(held, keys, "left").select(
        *keys, F.col("legislation_ref").alias("resolution"), F.col("raw_text").alias("description"), result.alias("result"), "item_id", records.alias("records"), F.coalesce("skipped", F.lit(0)).alias("skipped")
    )


def outcome_updates(ended: DataFrame, matched: DataFrame, agenda: DataFrame, meeting: str) -> DataFrame:
    """(meeting, item_id, outcome, was): the outcomes that the minutes give to agenda items; was is what is stored, to be overwritten."""
    told = ended.where("disposition is not null").select(meeting, "position", "disposition").join(matched.select(meeting, "position", "item_id"), [meeting, "position"])
    stored = agenda.select(meeting, "item_id", F.col("outcome").alias("was"))
    return told.join(stored, [meeting, "item_id"]).select(meeting, "item_id", F.col("disposition").alias("outcome"), "was")


def vote_drift(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n: how many more of these votes are planned than stored (less, if negative); equal ones are left out. A bag difference by one sum."""
    both = planned.select(*keys, F.lit(1).alias("n")).unionByName(stored.select(*keys, F.lit(-1).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
