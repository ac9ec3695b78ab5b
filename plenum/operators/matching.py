"""Rule tables, reference anchors, spoken-name patterns and tiered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles that announce a name, how sure each way of telling one is, offices, and words that begin no name.
TITLES = [
    "councilmember", "council member", "councilwoman", "councilman", "alderman", "alderwoman", "commissioner", "mayor", "vice mayor", "vicemayor",
    "president", "vice president", "vicepresident", "clerk", "secretary", "treasurer", "supervisor", "representative",
]
CONFIDENCE = {"roll_call": 0.95, "chair_recognition": 0.92, "self_identification": 0.90, "name_addressing": 0.80, "title_context": 0.75}
OFFICES = ["attorney", "clerk", "mayor", "treasurer", "manager", "administrator", "auditor", "comptroller"]
NO_NAMES = ["here", "present", "yes", "no", "thank", "thanks", "okay", "the", "this", "that", "what", "how", "who", "where", "when"]
#: Letters of a name at most.
LONGEST = 40

#: A token's class, one letter: of two words that are a title together the first has 1 and the second 2; T a title by itself.
_CLASSES = {
    **{w: "1" for w in ("council", "vice")}, "member": "2", "chair": "h", "recognizes": "r", "this": "t", "is": "i", "i": "e", "am": "m", "i'm": "s", "i’m": "s",
    ",": "k", "?": "q", **{t: "T" for t in TITLES if " " not in t},
}
#: Tokens that tell a name, by their classes. Each token is two letters: its class, and A if it is capitalised like a name, else z.
_TITLE, _NAME = "(?:T.|1.[2T].)", "((?:.A){1,3})"
_WAYS = {
    "roll_call": f"{_TITLE}{_NAME}q.",
    "chair_recognition": f"h.r.{_TITLE}{_NAME}",
    "self_identification": f"(?:t.i.|e.m.|s.){_TITLE}{_NAME}",
    "name_addressing": f"{_TITLE}{_NAME}k.",
}


def first_rule(rows: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's first rule (by ordinal) whose keyword its text contains; null without any. rules: ordinal, keyword, value.

    The rules are gathered into one array, which a table of rules by its nature is short enough for.
    """
    table = rules.agg(F.array_sort(F.collect_list(F.struct("ordinal", F.lower("keyword").alias("keyword"), "value"))).alias("__rules"))
    hit = F.get(F.filter("__rules", lambda r: F.contains(F.lower(F.col(text)), r["keyword"])), 0)
    return rows.join(F.broadcast(table), F.lit(True)).select(key, hit["value"].alias("value"))


def anchors(items: DataFrame, segments: DataFrame, pattern: str) -> DataFrame:
    """Where each item's reference is said: item_id and the sorted segment ids. References that several items share anchor none.

    References are read out of the texts and joined by equality, so no item is tried on every segment.
    """
    own = items.groupBy("ref").agg(F.count("*").alias("c"), F.min("item_id").alias("item_id")).where("c = 1")
    said = segments.select("segment_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("ref"))
    return said.join(own, "ref").groupBy("item_id").agg(F.array_sort(F.collect_set("segment_id")).alias("segments"))


def spoken_names(segments: DataFrame) -> DataFrame:
    """Candidates that a segment's text gives: segment_id, family, name, confidence; a family gives its first hit, if that can be a name.

    A text is cut into words and signs, and each gets a class (title, cue, comma, question mark, capitalised or not); a name is told by the
    classes before and behind it. title_context gives an office in place of a name. Whom a candidate is about is next_speaker()'s and
    roll_call_responder()'s part. Null and empty texts give none.
    """
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}'’-]+|[^\s\p{L}]"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])
    bare = lambda t: F.replace(F.lower(t), F.lit("-"), F.lit(""))
    code = lambda t: F.concat(F.coalesce(F.try_element_at(table, bare(t)), F.lit("o")), F.when(t.rlike(r"^\p{Lu}[\p{L}'’-]+$"), "A").otherwise("z"))
    cut = segments.select("segment_id", tokens.alias("tokens")).withColumn("classes", F.array_join(F.transform("tokens", code), ""))

    def told(way: str) -> Column:
        found = lambda g: F.regexp_extract("classes", f"^((?:..)*?{way.split(_NAME)[0]}){_NAME}{way.split(_NAME)[1]}", g)
        return F.array_join(F.slice("tokens", (F.length(found(1)) / 2).cast("int") + 1, (F.length(found(2)) / 2).cast("int")), " ")

    words = F.transform("tokens", lambda t: F.lower(t))
    # `as`, then `the` and `city` or not, then an office
    office = F.transform("tokens", lambda t, i: F.when(F.get(words, i) == "as", F.get(F.filter(F.slice(words, i + 2, 3), lambda w: ~w.isin("the", "city")), F.lit(0))))
    first = F.get(F.filter(office, lambda w: w.isin(OFFICES)), F.lit(0))
    each = [F.struct(F.lit(f).alias("family"), told(way).alias("name"), F.lit(CONFIDENCE[f]).alias("confidence")) for f, way in _WAYS.items()]
    each.append(F.struct(F.lit("title_context").alias("family"), F.coalesce(F.initcap(first), F.lit("")).alias("name"), F.lit(CONFIDENCE["title_context"]).alias("confidence")))
    can_be = lambda x: F.length(x["name"]).between(1, LONGEST) & ~F.lower(F.substring_index(x["name"], " ", 1)).isin(NO_NAMES)
    return cut.select("segment_id", F.explode(F.filter(F.array(*each), can_be)).alias("f")).select("segment_id", "f.*")


def roll_call_responder(segments: DataFrame, within: int = 4) -> DataFrame:
    """For each segment the label of the first of the next `within` segments that another speaks and that answers a roll call; null without.

    Needs meeting, segment_id (in order), label, text.
    """
    w = Window.partitionBy("meeting").orderBy("segment_id")
    answers = F.col("text").rlike(r"(?i)\b(?:present|here|aye|yes)\b")
    later = F.array(*[F.when((F.lead("label", k).over(w) != F.col("label")) & F.lead(answers, k).over(w), F.lead("label", k).over(w)) for k in range(1, within + 1)])
    return segments.withColumn("__later", later).select("meeting", "segment_id", F.get(F.filter("__later", lambda x: x.isNotNull()), 0).alias("responder"))


def tiered_lookup(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (ask_id, link, slug) with the first entry of the same link, else the first of the same slug if that is no number.

    entries: position, link, slug, value. tier is 1, 2 or null. Both tiers are equal-key joins of first entries.
    """
    first = lambda c: entries.groupBy(c).agg(F.min_by("value", "position").alias(f"by_{c}"))
    slug = F.when(~F.col("slug").rlike(r"^\d+$"), F.col("slug"))
    return (
        asked.join(first("link"), "link", "left")
        .join(first("slug").withColumnRenamed("slug", "__slug"), slug == F.col("__slug"), "left")
        .select("ask_id", F.coalesce("by_link", "by_slug").alias("value"), F.when(F.col("by_link").isNotNull(), 1).when(F.col("by_slug").isNotNull(), 2).cast("long").alias("tier"))
    )


def last_disposition(motions: DataFrame, by: list[str], decides: Column, outcome: Column, order: list[str]) -> DataFrame:
    """The outcome of the last motion of each group that decides; groups without one have null."""
    at = F.struct(*order)
    return motions.groupBy(*by).agg(F.max_by(F.when(decides, outcome), F.when(decides, at)).alias("outcome"), F.count_if(decides).alias("n_deciding"))


def chunk_sections(sections: DataFrame, by: str, slack: int) -> DataFrame:
    """Sections of one type that follow each other within `slack` places, merged; the longest title stays.

    Needs `by`, first, last, type, title; output: by, island, type, first, last, title, n.
    """
    w = Window.partitionBy(by).orderBy("first", "last", "title")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when((F.lag("type").over(w) == F.col("type")) & (F.col("first") <= reach + slack), 0).otherwise(1)
    marked = sections.withColumn("__cut", cut)
    numbered = marked.withColumn("island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "island").agg(
        F.first("type").alias("type"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max_by("title", F.struct(F.length("title"), "title")).alias("title"), F.count("*").alias("n"),
    )
