"""Agendas and roll calls as tables: texts are cut where a line opens a block, and a block's lines are read in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the printed formats: what a line says of itself, and how votes are called.
FORMS = {
    "section": r"^(\d{1,2})\. +(\S.*)$",
    "item": r"^([A-Z])\. +(\S.*)$",
    "sponsor": r"(?i)^council sponsors? *[-–—:] *(.+)$",
    "footnote": r"(?i)^\d* *https?://",
}
#: A line that opens a block, and a footnote with all lines behind it up to a sponsor, in a text of lines.
OPENS = r"(?:\d{1,2}|[A-Z])\. +\S.*[\u0085\u2028\u2029]?(?:\n|\z)"
NOTED = r"(?i)\n\d* *https?://[^\n]*+(?:\n(?!council sponsors? *[-–—:] *.)[^\n]*+)*+"
NO_SPONSOR = ["N/A", "NA", "NONE"]
ACT = r"\b(?:Appropriation\s+)?(?:Ordinance|Resolution)\s+\d{4}-\d+"
ROLL_MARK = "[Roll No"
#: Words of a tally's heading and what the names below it voted; the first that a heading has counts.
POSITIONS = [("NOT VOTING", "NOT_VOTING"), ("PRESENT", "PRESENT"), ("AYES", "YEA"), ("YEAS", "YEA"), ("NOES", "NAY"), ("NAYS", "NAY")]
#: What is done with a motion, and whether that carries it.
CARRIED = {
    "adopted": True, "agreed to": True, "confirmed": True, "ordered": True, "passed": True, "sustained": True,
    "failed": False, "lost": False, "rejected": False,
}
#: Words of a name at most.
NAME_WORDS = 6


def legislation_ref(title: Column) -> Column:
    """The first act with its number in a title, `Ordinance 2026-1` and the like, with one space between words; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(title, ACT, 0), r"\s+", " "), F.lit(""))


def kind(line: Column) -> Column:
    """Which of FORMS a line has, or other."""
    out = F.when(F.lit(False), "")
    for name, form in FORMS.items():
        out = out.when(line.rlike(form), name)
    return out.otherwise("other")


def _part(line: Column, form: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, FORMS[form], group), F.lit(""))


def agenda_items(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """One row per lettered item, and per numbered section without any: position, item_number, section, title_raw, legislation_ref, sponsor, extra_lines.

    Footnotes, addresses and what wraps behind them belong to nothing; a section's header goes on while its brackets are open;
    lines behind an item's sponsor are extra lines. Null and empty texts have no items.
    """
    # lines without white space around, footnotes with what wraps behind them taken out, cut before each line that opens a block
    flat = F.regexp_replace(F.concat(F.lit("\n"), F.replace(F.col(text), F.lit("\r"), F.lit("\n")), F.lit("\n")), r"(?<![ \t\f])[ \t\f]*+\n(?:[ \t\f]*+\n)*+ *+", "\n")
    blocks = F.transform(F.split(F.rtrim(flat, F.lit("\n")), rf"\n(?={OPENS})"), lambda b: F.regexp_replace(b, NOTED, ""))
    each = docs.select(key, F.posexplode(blocks).alias("block", "said")).where("block > 0").withColumn("lines", F.split("said", "\n"))
    line = F.get("lines", F.lit(0))
    each = each.select(key, "block", "lines", F.when(line.rlike(FORMS["section"]), "section").otherwise("item").alias("head"), line.alias("line"))
    part = lambda g: F.when(F.col("head") == "section", _part(F.col("line"), "section", g)).otherwise(_part(F.col("line"), "item", g))
    is_sponsor = lambda x: x.rlike(FORMS["sponsor"])
    each = each.withColumns({"mark": part(1), "words": part(2), "sponsors": F.filter("lines", is_sponsor), "at": F.array_position(F.transform("lines", is_sponsor), True).cast("int"), "closed": _closed(F.col("lines"))})
    section = F.col("head") == "section"
    last = F.when(section, F.col("closed")).otherwise(F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.size("lines")))
    wrapped = F.filter(F.slice("lines", F.lit(2), F.greatest(last - 1, F.lit(0))), lambda x: ~is_sponsor(x))
    extra = F.filter(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: ~is_sponsor(x))
    none = F.array().cast("array<string>")
    told = each.select(
        key, "block", "head", "mark",
        F.array_join(F.concat(F.array("words"), wrapped), " ").alias("title_raw"),
        F.trim(_part(F.try_element_at("sponsors", F.lit(-1)), "sponsor", 1)).alias("sponsor"),
        F.when((F.col("at") > 0) & ~section, extra).otherwise(none).alias("extra_lines"),
    )
    by = Window.partitionBy(key).orderBy("block")
    own = F.when(section, F.struct(F.col("mark").cast("int").alias("number"), "title_raw"))
    held = told.withColumns({"of": F.last(own, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("head").over(by)})
    held = held.where(F.col("of").isNotNull() & ((F.col("head") == "item") | ~F.col("next").eqNullSafe("item")))
    item = F.col("head") == "item"
    return held.select(
        key,
        F.row_number().over(by).cast("long").alias("position"),
        F.concat(F.col("of.number").cast("string"), F.when(item, F.col("mark")).otherwise("")).alias("item_number"),
        F.col("of.title_raw").alias("section"),
        F.col("of.number").alias("section_number"),
        "title_raw",
        F.when(item, legislation_ref(F.col("title_raw"))).alias("legislation_ref"),
        F.when(item & ~F.upper(F.trim("sponsor")).isin(NO_SPONSOR), F.col("sponsor")).alias("sponsor"),
        "extra_lines",
    )


def _closed(lines: Column) -> Column:
    """The first line (from 1) by whose end no more brackets are opened than closed; the number of lines if there is none."""
    balance = lambda x: F.length(F.replace(x, F.lit(")"))) - F.length(F.replace(x, F.lit("(")))

    def step(s: Column, x: Column) -> Column:
        held = s["held"] + balance(x)
        return F.struct((s["i"] + 1).alias("i"), held.alias("held"), F.when((s["at"] == 0) & (held <= 0), s["i"] + 1).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(0).alias("at"))
    return F.aggregate(lines, start, step, lambda s: F.when(s["at"] > 0, s["at"]).otherwise(F.size(lines)))


def _heading(line: Column) -> Column:
    """The position that a tally's heading (capitals, two hyphens, a count) announces, `-` for one that the table doesn't have; else null."""
    label, count = F.trim(F.substring_index(line, "--", 1)), F.trim(F.substring_index(line, "--", -1))
    heading = F.contains(line, F.lit("--")) & count.try_cast("int").isNotNull() & (label != "") & (F.upper(label) == label)
    position = F.lit("-")
    for words, means in reversed(POSITIONS):
        position = F.when(F.contains(label, F.lit(words)), means).otherwise(position)
    return F.when(heading, position)


def _is_name(line: Column) -> Column:
    """Some capitalised words of letters, with the signs that names have and no others."""
    return line.rlike(r"^[\p{L}\p{M} .,'’()-]+$") & ~line.rlike(r"(^|[ (])\p{Ll}") & (F.size(F.split(line, " +")) <= NAME_WORDS)


def roll_calls(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """One row per member's vote: roll_number, position (YEA, NAY, PRESENT, NOT_VOTING), place in the list, surname.

    A roll's block goes up to the next mark. A heading says what the names after it voted; lines that can't be names are skipped.
    """
    parts = docs.select(key, F.posexplode(F.split(text, F.lit(r"\Q" + ROLL_MARK + r"\E"))).alias("b", "block")).where("b > 0")
    number = F.regexp_replace(F.substring_index("block", "]", 1), r"\D+", "").try_cast("int")
    body = F.substring(F.col("block"), F.instr("block", "]") + 1, F.length("block"))
    told = parts.select(key, "b", number.alias("roll_number"), F.transform(F.split(body, "\n"), lambda x: F.trim(x)).alias("lines")).where("roll_number is not null")
    heads = F.filter(F.transform("lines", lambda x, i: F.struct(_heading(x).alias("position"), i.alias("at"))), lambda h: h["position"].isNotNull())
    told = told.withColumn("heads", heads)
    # a heading's names stand up to the next one; a position may have several headings
    below = lambda h, j: F.slice("lines", h["at"] + 2, F.coalesce(F.get("heads", j + 1)["at"], F.size("lines")) - h["at"] - 1)
    told = told.withColumn("held", F.transform("heads", lambda h, j: F.struct(h["position"].alias("position"), F.filter(below(h, j), _is_name).alias("names"))))
    of = lambda p: F.flatten(F.transform(F.filter("held", lambda h: h["position"] == p), lambda h: h["names"]))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), of(p).alias("names")) for p in dict.fromkeys(p for _, p in POSITIONS)]))
    voted = told.select(key, "roll_number", each.alias("e")).select(key, "roll_number", "e.position", F.posexplode("e.names").alias("i", "surname"))
    return voted.select(key, "roll_number", "position", (F.col("i") + 1).cast("long").alias("place"), "surname")


def _done(text: Column) -> Column:
    """For each `was` or `were` of a text what it says was done, if CARRIED has it: struct<phrase, passed>, in order."""
    carried = F.create_map(*[F.lit(x) for pair in CARRIED.items() for x in pair])

    def of(clause: Column) -> Column:
        words = F.split(clause, "[^a-z]+")
        no = F.get(words, F.lit(0)) == "not"
        one = F.get(words, F.when(no, 1).otherwise(0))
        two = F.concat_ws(" ", one, F.get(words, F.when(no, 2).otherwise(1)))
        verb = F.when(F.map_contains_key(carried, two), two).when(F.map_contains_key(carried, one), one)
        phrase = F.concat(F.when(no, "not ").otherwise(""), verb)
        told = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 100))
        return F.when(verb.isNotNull(), F.struct(told.alias("phrase"), (F.try_element_at(carried, verb) != no).alias("passed")))

    clauses = F.slice(F.split(F.lower(text), r"\b(?:was|were)\s+"), 2, 1 << 20)
    return F.filter(F.transform(clauses, of), lambda x: x.isNotNull())


def outcome(block: Column) -> Column:
    """struct<phrase, passed> that a roll's text announces; null without any.

    Announcements begin with `So`: the last of them that says what was done counts, by the first that it says. Without one, the last of
    the text does.
    """
    told = F.filter(F.transform(F.slice(F.split(block, r"\bSo\b"), 2, 1 << 20), lambda part: F.get(_done(part), F.lit(0))), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(told, F.lit(-1)), F.try_element_at(_done(block), F.lit(-1)))
