"""Minutes with motions: items, who moved and seconded what, the votes, and how each item ended.

Texts are cut into items where a line opens one. Inside an item the text is cut into motions, and each motion's text into the
results that stand in it. A result needn't belong to the motion it stands behind, so an item's results are folded in order over its
motions: each takes the motion that the rules give it, and a motion that has its result takes no other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.graph import settle
from plenum.sources.minutes import legislation_ref

# Fixed values of the printed format.
END = "memorandum prepared by"
MOVES, RESULT, VOTED = "seconded", "The motion", "received a roll call vote"
SIDES = ["ayes", "nays", "abstain"]
TAGS = ["FAILED", "PASSED"]
#: What a motion is to do, by what its clause says; the first kind that has one of its phrases counts.
KINDS = {
    "procedural": ["amend the agenda", "read by title", "be introduced", "discuss"],
    "amend": ["amendment"],
    "adopt": ["be adopted", "be approved"],
    "continue": ["for second reading", "postpone", "table", "tabled"],
    "pull": ["withdraw"],
}
#: Further words by which a result's own description tells its kind.
RESULT_KINDS = {"adopt": ["adopt", "approve"], "procedural": ["introduce"]}
#: Phrases that count as whole words only.
WHOLE = {"discuss", "amendment", "table", "tabled", "adopt", "approve", "introduce"}
#: How an item ends when a motion of a kind carries.
ENDS = {"adopt": "passed", "continue": "continued", "pull": "pulled"}
DATE_SIGNS = ["until", "to be held on"]
#: Signs that part a text while it is read; texts lose them.
CUT, PART = "\u0001", "\u0002"

#: One or two capitalised words; a vote's tag before a name is none of them.
_PERSON = rf"(?=\p{{Lu}})\b(?!(?:{'|'.join(TAGS)})\b)\p{{Lu}}[\p{{L}}\p{{N}}_'’.-]+(?: \p{{Lu}}[\p{{L}}\p{{N}}_'’.-]+)?"
_MOVED = rf"({_PERSON}) moved,? and ({_PERSON}) {MOVES} (?:that|to)\b"


def _says(text: Column, phrases: list[str]) -> Column:
    parts = [text.rlike(rf"\b{p}\b") if p in WHOLE else F.contains(text, F.lit(p)) for p in phrases]
    return reduce(lambda a, b: a | b, parts)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(clause: Column, result: bool = False) -> Column:
    """What a motion's clause, or a result's description, is about; `unknown` where no phrase tells."""
    return _once(F.lower(clause), lambda text: _kind(text, result))


def _kind(text: Column, result: bool) -> Column:
    out = reduce(lambda c, kv: c.when(_says(text, kv[1]), kv[0]), list(KINDS.items())[1:], F.when(_says(text, KINDS["procedural"]), "procedural"))
    for kind, phrases in RESULT_KINDS.items() if result else ():
        out = out.when(_says(text, phrases), kind)
    return out.otherwise("unknown")


def items(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """One row per numbered item that names an act: key, position, item_number, legislation_ref, wallclock, body (its lines, joined).

    `7. Title [7:01pm]` opens a section and gives its items their time, `7.2. Title` an item; either ends the item before it. What comes
    after the note of who prepared the minutes is left out. Null and empty texts have no items.
    """
    # lines without their white space at the ends, each behind one break; blocks are cut at the breaks before what opens one
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"[\r{CUT}{PART}]", "\n"), r" [ \t\x0B\f]+|[\t\x0B\f][ \t\x0B\f]*", " "), r" \n[ \n]*|\n[ \n]+", "\n")
    kept = F.get(F.split(F.concat(F.lit("\n"), F.ltrim(flat, F.lit(" \n"))), rf"(?i)\n{END}", 2), F.lit(0))
    blocks = F.split(kept, r"\n(?=\d+\.(?:\d+\.| \S))")
    each = docs.select(key, F.posexplode(blocks).alias("block", "said")).where("block > 0")
    each = each.select(key, "block", F.rtrim(F.substring_index("said", "\n", 1)).alias("line"), "said")
    sub = F.regexp_extract("line", r"^(\d+\.\d+)\.", 1)
    stamp = F.regexp_extract("line", r"\[(\d{1,2}:\d{2} ?[ap]m)\]$", 1)
    ref = F.when(F.col("item_number") != "", legislation_ref(F.regexp_replace("line", r"^\d+\.\d+\.", "")))
    by = Window.partitionBy(key).orderBy("block")
    time = F.last(F.when((F.col("item_number") == "") & (F.col("stamp") != ""), F.replace("stamp", F.lit(" "))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    told = each.select(key, "block", "line", "said", sub.alias("item_number"), stamp.alias("stamp")).withColumn("wallclock", time)
    told = told.withColumn("legislation_ref", ref).where("legislation_ref is not null")
    body = F.rtrim(F.replace(F.substring(F.col("said"), F.instr("said", "\n") + 1, F.length("said")), F.lit("\n"), F.lit(" ")))
    position = F.row_number().over(by).cast("long")
    return told.select(key, position.alias("position"), "item_number", "legislation_ref", "wallclock", F.when(F.contains("said", F.lit("\n")), body).otherwise("").alias("body"))


def _names(raw: Column, count: Column) -> Column:
    """The names on a side of a vote; none where their number isn't the side's count or one of them has another shape (a remark, say)."""
    shape = r"^\p{Lu}[\p{L}\p{N}_'’.-]*(?: \p{Lu}[\p{L}\p{N}_'’.-]*)?$"
    fine = lambda names: F.when((F.size(names) == count) & F.forall(names, lambda x: x.rlike(shape)), names)
    told = F.when(raw != "", _once(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""), fine))
    return F.coalesce(told, F.array().cast("array<string>"))


def _result(said: Column, owner: Column) -> Column:
    """A result out of what follows `The motion`; null if it is none."""
    side = lambda name: rf"{name}:\s*(\d+)\s*(?:\(([^)]*)\))?\s*[;,.]?\s*"
    whole = rf"(?is)^([^.]*?)\s*{VOTED.replace(' ', chr(92) + 's+')}(?:\s+of|:)?\s*{''.join(side(s) for s in SIDES)}({'|'.join(TAGS)})?.*$"

    def read(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i - 1))
        count = lambda i: part(i).try_cast("int")
        desc = F.trim(part(1))
        votes = {x: y for i, s in enumerate(SIDES) for x, y in ((s, count(2 + 2 * i)), (f"{s}_names", _names(part(3 + 2 * i), count(2 + 2 * i))))}
        fields = [owner.alias("owner"), F.when(desc != "", kind_of(desc, True)).alias("kind"), *[v.alias(k) for k, v in votes.items()], F.nullif(F.upper(part(8)), F.lit("")).alias("tag")]
        return F.when(F.size(parts) == 8, F.struct(*fields))

    # one pass of the pattern: its groups, or the text as it is, which has no PART
    return _once(F.split(F.regexp_replace(said, whole, PART.join(f"${i}" for i in range(1, 9))), PART), read)


def _owner(motions: Column, free: Column, r: Column) -> Column:
    """The motion (from 0) that a result settles, or null; free: the motions that have no result yet.

    Without a description: the motion it stands behind. With one of that motion's kind: that motion, if it is free. An amendment's result
    elsewhere: the one free amendment, if there is just one. An adoption's: the last free adoption.
    """
    own = F.get(motions, r["owner"])
    of = lambda kind: F.filter(free, lambda i: F.get(motions, i)["kind"] == kind)
    is_free = F.array_contains(free, r["owner"])
    there = lambda i: F.when(is_free, i)
    return (
        F.when(r["kind"].isNull(), there(r["owner"]))
        .when((r["kind"] != "unknown") & (r["kind"] == own["kind"]) & is_free, r["owner"])
        .when((r["kind"] == "amend") & (F.size(of("amend")) == 1), F.get(of("amend"), F.lit(0)))
        .when(r["kind"] == "adopt", F.try_element_at(of("adopt"), F.lit(-1)))
    )


def _voted(described: DataFrame) -> DataFrame:
    """With `settled`: for each result in order, the motion it settles or null."""
    none = F.array().cast("array<int>")
    every = F.when(F.size("motions") > 0, F.sequence(F.lit(0), F.size("motions") - 1)).otherwise(none)
    start = F.struct(every.alias("free"), none.alias("settled"))

    def take(state: Column, r: Column) -> Column:
        def with_owner(at: Column) -> Column:
            left = F.when(at.isNull(), state["free"]).otherwise(F.array_remove(state["free"], at))
            return F.struct(left.alias("free"), F.concat(state["settled"], F.array(at)).alias("settled"))

        return _once(_owner(F.col("motions"), state["free"], r).cast("int"), with_owner)

    return described.withColumn("settled", F.aggregate("results", start, take, lambda s: s["settled"]))


def _described(found: DataFrame) -> DataFrame:
    """Items with their motions (mover, seconder, kind, raw_text, continued_to) and results (owner, kind, votes, tag), and text for votes that neither explains."""
    marked = F.regexp_replace(F.col("body"), _MOVED, f"{CUT}$1{PART}$2{PART}$0{PART}")
    blocks = F.slice(F.split(marked, CUT), 2, 1 << 20)

    def motion(block: Column) -> Column:
        # who moved, who seconded, the words that say so, and what is behind them
        return _once(F.split(block, PART, 4), lambda parts: _once(F.substring_index(F.get(parts, 3), RESULT, 1), lambda clause: _once(kind_of(clause), lambda kind: described(parts, clause, kind))))

    def described(parts: Column, clause: Column, kind: Column) -> Column:
        date = F.regexp_extract(clause, rf"\b(?:{'|'.join(DATE_SIGNS)})\b.*?\b(\p{{Lu}}[a-z]+ \d{{1,2}}, \d{{4}})", 1)
        return F.struct(
            F.get(parts, 0).alias("mover"), F.get(parts, 1).alias("seconder"), kind.alias("kind"), F.trim(F.concat(F.get(parts, 2), F.get(parts, 3))).alias("raw_text"),
            F.when(kind == "continue", F.date_format(F.try_to_timestamp(date, F.lit("MMMM d, yyyy")), "yyyy-MM-dd")).alias("continued_to"),
        )

    def results(block: Column, i: Column) -> Column:
        return F.filter(F.transform(F.slice(F.split(F.substring_index(block, PART, -1), rf"(?i)(?=t)\b{RESULT}\b"), 2, 1 << 20), lambda said: _result(said, i)), lambda r: r.isNotNull())

    out = found.withColumn("blocks", blocks)
    out = out.withColumns({"motions": F.transform("blocks", motion), "results": F.flatten(F.transform("blocks", results))})
    votes = F.regexp_count("body", F.lit(rf"(?i){VOTED.split('received a ')[1].replace(' ', chr(92) + 's+')}"))
    return out.withColumn("unexplained", votes - F.size("results")).drop("blocks", "body")


def _carried(r: Column) -> Column:
    return r.isNotNull() & F.coalesce(r["tag"] != "FAILED", F.lit(True)) & (r["ayes"] > r["nays"])


def parsed(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Items with their motions, results and who took which, settled: motions_of() and dispositions_of() read it as often as they like."""
    return settle(_voted(_described(items(docs, key, text))))


def motions(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """motions_of() texts of minutes."""
    return motions_of(_voted(_described(items(docs, key, text))), key)


def dispositions(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """dispositions_of() texts of minutes, settled: what is joined to them again does not read the texts again."""
    return settle(dispositions_of(_voted(_described(items(docs, key, text))), key))


def motions_of(told: DataFrame, key: str = "doc") -> DataFrame:
    """One row per motion: key, position (of the item), legislation_ref, motion (from 1), mover, seconder, kind, votes, names, tag, carried, continued_to.

    A motion without a recorded vote has null counts and isn't carried. Names that don't agree with their count are dropped, the count stays.
    """
    each = told.select(key, "position", "legislation_ref", "results", "settled", F.posexplode("motions").alias("i", "m"))
    each = each.withColumn("r", F.get("results", (F.array_position("settled", F.col("i")) - 1).cast("int")))
    r = F.col("r")
    votes = [r[c].alias(c) for s in SIDES for c in (s, f"{s}_names")]
    return each.where(F.col("i") >= 0).select(
        key, "position", "legislation_ref", (F.col("i") + 1).cast("long").alias("motion"), "m.mover", "m.seconder", "m.kind", *votes, r["tag"].alias("tag"), _carried(r).alias("carried"), "m.continued_to", "m.raw_text"
    )


def dispositions_of(told: DataFrame, key: str = "doc") -> DataFrame:
    """One row per item: key, position, item_number, legislation_ref, wallclock, n_motions, disposition, decided_by (motion, from 1), dropped, unexplained.

    The last motion that decides: one to adopt that carried or is tagged FAILED, one to continue or withdraw that carried. dropped counts
    results that no motion could take, unexplained texts of roll calls that aren't results of the known form.
    """
    vote = lambda i: F.get("results", (F.array_position("settled", i) - 1).cast("int"))

    def end(m: Column, i: Column) -> Column:
        r = vote(i)
        how = F.when((m["kind"] == "adopt") & (r["tag"] == "FAILED"), "failed")
        for kind, says in ENDS.items():
            how = how.when((m["kind"] == kind) & _carried(r), says)
        return F.when(how.isNotNull(), F.struct(how.alias("disposition"), (i + 1).cast("long").alias("decided_by")))

    last = F.try_element_at(F.filter(F.transform("motions", end), lambda x: x.isNotNull()), F.lit(-1))
    dropped = F.size(F.filter("settled", lambda x: x.isNull())).cast("long")
    return told.withColumn("last", last).select(
        key, "position", "item_number", "legislation_ref", "wallclock", F.size("motions").cast("long").alias("n_motions"), "last.disposition", "last.decided_by", dropped.alias("dropped"), F.col("unexplained").cast("long").alias("unexplained")
    )
