"""Links between speakers and people, and the upkeep of voice profiles, sections and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.checks import strong_match
from plenum.functions.rules import identity_key
from plenum.operators import gate

# Confidence from which a voice is enrolled without asking, and from which one is asked about.
ENROLL, ASK = 0.85, 0.70


def confident_targets(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Whom each asked (query, known) is linked to: query, person, slug, full_name, and action, link or review.

    A known person is the target, with slug and name of a hit that is them; otherwise the only hit, if it is a strong match. hits: query,
    person, slug, full_name. Hits are counted before they move, so a query with many of them is one row. Of equal hits the least counts.
    """
    found = hits.groupBy("query").agg(F.count("*").alias("__n"), F.min(F.struct("person", "slug", "full_name")).alias("__only"))
    own = hits.groupBy("query", F.col("person").alias("known")).agg(F.min(F.struct("slug", "full_name")).alias("__own"))
    sure = (F.col("__n") == 1) & strong_match(F.col("query"), F.col("__only.full_name"))
    known = F.nullif(F.trim("known"), F.lit(""))
    pick = lambda c: F.when(known.isNotNull(), F.col(f"__own.{c}")).when(sure, F.col(f"__only.{c}"))
    person = F.coalesce(known, F.when(sure, F.col("__only.person")))
    return (
        asked.join(found, "query", "left")
        .join(own, ["query", "known"], "left")
        .select(
            "query", person.alias("person"), pick("slug").alias("slug"),
            F.when(person.isNotNull(), F.coalesce(pick("full_name"), F.col("query"))).alias("full_name"),
            F.when(person.isNotNull(), "link").otherwise("review").alias("action"),
        )
    )


def auto_link(speakers: DataFrame, hits: DataFrame) -> DataFrame:
    """Speakers that get a link, with person and slug, and auto_linked as their method.

    Those with a name, without a link, a local slug or a status of their own, whose name has a confident target. Needs meeting, label,
    name, person, local, status.
    """
    free = speakers.where("trim(name) <> '' and person is null and local is null and coalesce(status, '') not in ('unidentified', 'non_speaker')")
    names = free.select(F.col("name").alias("query"), F.lit(None).cast("string").alias("known")).distinct()
    targets = confident_targets(names, hits).where("action = 'link'").select(F.col("query").alias("name"), F.col("person").alias("__person"), "slug")
    return free.join(targets, "name").select("meeting", "label", "name", F.col("__person").alias("person"), "slug", F.lit("auto_linked").alias("id_method"))


def relink(speakers: DataFrame, decisions: DataFrame) -> DataFrame:
    """Speakers whose link a decision (name, person, slug) changes, with the new one. Names are equal whatever their case and outer spaces;
    of several decisions on a name the least counts. Needs meeting, label, name, person, slug."""
    key = F.lower(F.trim("name"))
    one = decisions.where(key != "").groupBy(key.alias("__key")).agg(F.min(F.struct("person", "slug")).alias("__to"))
    return (
        speakers.withColumn("__key", key)
        .join(one, "__key")
        .where(~(F.col("person").eqNullSafe(F.col("__to.person")) & F.col("slug").eqNullSafe(F.col("__to.slug"))))
        .select("meeting", "label", "name", "__to.person", "__to.slug")
    )


def fold_profiles(profiles: DataFrame, moves: DataFrame) -> DataFrame:
    """Profiles after moves (source, target, display_name): a source's records go to its target, which is made if there is none.

    profiles: profile, display_name, slug, meetings (array), segments. A target that is there keeps its name; its link is its own, else the
    first of its sources in order that has one. One step: a target that moves itself takes along only what it had
    (roster.settle_moves follows chains first). Moves of unknown
    profiles and onto themselves do nothing; of several moves of a source the least target counts.
    """
    to = moves.where("source <> target").groupBy(F.col("source").alias("profile")).agg(F.min(F.struct("target", "display_name")).alias("__to"))
    moved = F.col("__to").isNotNull()
    rows = profiles.join(to, "profile", "left").select(
        F.coalesce("__to.target", "profile").alias("__key"), F.struct(moved.alias("moved"), F.col("profile").alias("from")).alias("__rank"),
        F.coalesce("__to.display_name", "display_name").alias("display_name"), "slug", "meetings", "segments",
    )
    seen = rows.select("__key", F.explode("meetings").alias("__m")).groupBy("__key").agg(F.array_sort(F.collect_set("__m")).alias("meetings"))
    folded = rows.groupBy("__key").agg(
        F.min_by("display_name", "__rank").alias("display_name"), F.min_by("slug", F.when(F.col("slug").isNotNull(), F.col("__rank"))).alias("slug"), F.sum("segments").alias("segments"),
    )
    return folded.join(seen, "__key", "left").select(F.col("__key").alias("profile"), "display_name", "slug", "segments", F.coalesce("meetings", F.array().cast("array<string>")).alias("meetings"))


def section_faults(sections: DataFrame, segments: DataFrame) -> DataFrame:
    """Each section with what is wrong with its bounds, null if nothing: missing, stale (no segment of the meeting has them) or inverted.

    sections: meeting, section_id, first, last; segments: meeting, segment_id. Two joins by equal keys; rows are neither lost nor added.
    """
    ids = segments.select("meeting", "segment_id").distinct()
    is_there = lambda c: ids.select("meeting", F.col("segment_id").alias(c), F.lit(True).alias(f"__{c}"))
    fault = (
        F.when(F.col("first").isNull() | F.col("last").isNull(), "missing")
        .when(F.col("__first").isNull() | F.col("__last").isNull(), "stale")
        .when(F.col("last") < F.col("first"), "inverted")
    )
    joined = sections.join(is_there("first"), ["meeting", "first"], "left").join(is_there("last"), ["meeting", "last"], "left")
    return joined.select("meeting", "section_id", "first", "last", fault.alias("fault"))


def claims(turns: DataFrame, auto: DataFrame, truth: DataFrame) -> DataFrame:
    """How much speech of each meeting an automatic run claims to know, and how much of that is right, by speech seconds.

    auto and truth: meeting, label, name, slug, id_method, status, one row a label. Claimed are trusted and probable tiers but for
    unidentified speakers; right is the same slug where both sides have one, else the same name without titles. Labels that are truly no
    speakers don't count. precision is 1 where nothing is claimed.
    """
    secs = gate.seconds_by_label(turns, auto)
    said = auto.select("meeting", "label", F.col("name").alias("a_name"), F.col("slug").alias("a_slug"))
    true = truth.select("meeting", "label", F.col("name").alias("t_name"), F.col("slug").alias("t_slug"), F.col("status").alias("t_status"))
    rows = secs.join(said, ["meeting", "label"], "left").join(true, ["meeting", "label"], "left").where("coalesce(t_status, '') <> 'non_speaker'")
    none = F.lit(None).cast("string")
    bare = lambda c: identity_key(none, none, F.col(c))
    slugs = lambda c: F.nullif(F.col(c), F.lit(""))
    named = (F.coalesce("a_name", F.lit("")) != "") & (F.coalesce("t_name", F.lit("")) != "")
    right = named & F.coalesce(slugs("a_slug") == slugs("t_slug"), bare("a_name") == bare("t_name"), F.lit(False))
    nobody = (F.coalesce("status", F.lit("")) == "unidentified") | (F.coalesce("t_status", F.lit("")) == "unidentified")
    claimed = F.col("tier").isin("trusted", "probable") & ~nobody
    total = lambda when: F.sum(F.when(when, F.col("seconds")).otherwise(0.0))
    sums = rows.groupBy("meeting").agg(total(claimed).alias("claimed"), total(claimed & right).alias("correct"), total(F.col("tier") == "trusted").alias("trusted"), F.sum("seconds").alias("seconds"))
    return sums.select(
        "meeting", F.round("claimed", 1).alias("claimed_seconds"), F.round("correct", 1).alias("correct_seconds"),
        F.when(F.col("claimed") > 0, F.round(F.col("correct") / F.col("claimed"), 4)).otherwise(1.0).alias("precision"),
        F.when(F.col("seconds") > 0, F.round(F.col("trusted") / F.col("seconds"), 4)).otherwise(0.0).alias("coverage"),
    )


def enrolment(speakers: DataFrame, voices: DataFrame, turns: DataFrame) -> DataFrame:
    """Speakers whose voice may be kept: enroll or ask, by confidence, with segments, speech seconds and a segment to listen to.

    speakers: meeting, label, name, confidence, status; voices: meeting, label, those with a vector; turns: meeting, label, segment_id,
    start_time, end_time, text. The sample stands at a third of the segments with text. Windows hold one label of one meeting.
    """
    w = Window.partitionBy("meeting", "label")
    spoken = F.coalesce(F.col("text"), F.lit("")) != ""
    place = F.greatest(F.lit(0), F.floor(F.sum(spoken.cast("int")).over(w) / 3) - 1) + 1
    nth = F.sum(spoken.cast("int")).over(w.orderBy("start_time", "segment_id").rowsBetween(Window.unboundedPreceding, 0))
    stats = (
        turns.withColumns({"__sample": spoken & (nth == place)})
        .groupBy("meeting", "label")
        .agg(F.count("*").alias("n_segments"), F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"), F.min(F.when(F.col("__sample"), F.col("segment_id"))).alias("sample"))
    )
    action: Column = F.when(F.col("confidence") >= ENROLL, "enroll").when(F.col("confidence") >= ASK, "ask")
    fit = speakers.where("coalesce(name, '') <> '' and coalesce(status, '') <> 'non_speaker'").withColumn("action", action).where("action is not null")
    return (
        fit.join(voices.select("meeting", "label").distinct(), ["meeting", "label"], "left_semi")
        .join(stats, ["meeting", "label"], "left")
        .select("meeting", "label", "name", "confidence", "action", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "sample")
    )


def description_chapters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The chapters that a description lists, a time and a title on each line: key, position, start_time, end_time (the next one's start),
    title. A description with fewer than two such lines has none. One pass over a row's own lines, without a shuffle."""
    stamp = r"^\s*(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(\S.*)$"
    part = lambda line, g: F.regexp_extract(line, stamp, g)
    seconds = lambda line: F.coalesce(F.nullif(part(line, 1), F.lit("")).cast("double"), F.lit(0.0)) * 3600 + part(line, 2).try_cast("double") * 60 + part(line, 3).try_cast("double")
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.rlike(stamp))
    listed = rows.select(key, F.transform(lines, lambda x: F.struct(seconds(x).alias("at"), F.rtrim(part(x, 4)).alias("title"))).alias("__c")).where(F.size("__c") >= 2)
    each = F.transform("__c", lambda c, i: F.struct(i.cast("long").alias("position"), c["at"].alias("start_time"), F.get(F.col("__c"), i + 1)["at"].alias("end_time"), c["title"].alias("title")))
    return listed.select(key, F.inline(each))


def shift_times(rows: DataFrame, columns: list[str], offset: Column) -> DataFrame:
    """Times of a clip as times of the whole: each column plus the offset, null offsets as 0; null times stay null."""
    return rows.withColumns({c: F.col(c) + F.coalesce(offset, F.lit(0.0)) for c in columns})
