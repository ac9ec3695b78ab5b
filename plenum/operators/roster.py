"""Aliases of people, and moves of profiles that lead to further moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.graph import forget, settle
from plenum.functions.text import unmarked

# fixed values: words that a title may lose, and the offices that then stand for it
DROPPED = ["Council", "Vice", "Deputy"]
OFFICES = ["President", "Chair", "Mayor", "Speaker", "Clerk"]


def short_title(title: Column) -> Column:
    """A title without its first word where that is one of DROPPED and an office of OFFICES follows, else null."""
    words = F.split(F.trim(title), r"\s+")
    return F.when(F.get(words, 0).isin(DROPPED) & F.get(words, 1).isin(OFFICES), F.array_join(F.slice(words, 2, F.size(words)), " "))


def spellings(form: Column) -> Column:
    """A form, and then it in ASCII; each also with spaces for hyphens."""
    plain = F.array_compact(F.array(form, F.nullif(unmarked(form), F.lit(""))))
    return F.flatten(F.transform(plain, lambda s: F.array(s, F.replace(s, F.lit("-"), F.lit(" ")))))


def aliases(full: Column, preferred: Column, title: Column) -> Column:
    """What a person may be called, in order, each once whatever its case: the full name, the last one, first and last, preferred and last,
    title and last, short title and last, each in all its spellings. Null parts count as empty; no full name, no aliases."""
    name, called, office = (F.trim(F.coalesce(x, F.lit(""))) for x in (full, preferred, title))
    words = F.split(name, r"\s+")
    first, last = F.get(words, 0), F.element_at(words, -1)
    forms = F.array(
        name,
        last,
        F.when(first != last, F.concat_ws(" ", first, last)),
        F.when((called != "") & (called != first), F.concat_ws(" ", called, last)),
        F.when(office != "", F.concat_ws(" ", office, last)),
        F.concat(short_title(office), F.lit(" "), last),
    )
    every = F.flatten(F.transform(F.array_compact(forms), spellings))
    keyed = F.transform(every, lambda s: F.struct(s.alias("s"), F.lower(s).alias("key")))
    # bound to a name, so that spellings are worked out once and not again for each of them
    once = F.transform(F.array(keyed), lambda ks: F.filter(ks, lambda k, i: F.array_position(F.transform(ks, lambda x: x["key"]), k["key"]) == i + 1))
    return F.when(name != "", F.transform(F.get(once, 0), lambda k: k["s"])).otherwise(F.array().cast("array<string>"))


def alias_index(people: DataFrame) -> DataFrame:
    """(person, place, alias, holders): each alias of each person, from place 1, and how many people have it whatever its case.

    people: person, full_name, preferred_name, title; other columns are ignored. Rows of one person are counted once, but all stay; a
    null person counts as nobody. Counts are combined before they are shuffled, then joined by the alias.
    """
    told = people.select("person", F.posexplode(aliases(F.col("full_name"), F.col("preferred_name"), F.col("title"))).alias("at", "alias"))
    held = told.groupBy(F.lower("alias").alias("key")).agg(F.count_distinct("person").alias("holders"))
    each = told.withColumn("key", F.lower("alias"))
    return each.join(held, "key").select("person", (F.col("at") + 1).alias("place"), "alias", "holders")


def settle_moves(moves: DataFrame) -> DataFrame:
    """(source, target, display_name): where each source ends if moves are followed to their end, with the last move's name.

    Of several moves of a source the least target counts, then the least name; moves onto themselves and with a null end do nothing.
    A source whose moves go round in a circle, or into one, moves nowhere: the moves contradict each other. Each round doubles the steps
    taken, so a chain of n moves takes about log n rounds of one join each; rounds are settled, and end when no more chains are finished.
    """
    one = moves.where("source <> target").groupBy("source").agg(F.min(F.struct("target", "display_name")).alias("to")).select("source", "to.*")
    held, left = settle(one.withColumn("open", F.lit(True))), None
    while True:
        then = held.select(F.col("source").alias("target"), F.struct("target", "display_name").alias("then"))
        nxt = settle(
            held.join(then, "target", "left").select(
                "source", F.coalesce("then.target", "target").alias("target"),
                F.when(F.col("then").isNotNull(), F.col("then.display_name")).otherwise(F.col("display_name")).alias("display_name"),
                F.col("then").isNotNull().alias("open"),
            )
        )
        forget(held)
        held, now = nxt, nxt.where("open").count()
        if now == 0 or now == left:
            return held.where("not open").drop("open")
        left = now
