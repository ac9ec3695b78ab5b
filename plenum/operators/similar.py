"""Names that are nearly alike: a similarity join by shared letters, and rosters that correct what was heard.

The measure is the share of letters in matching stretches: the longest common stretch, and again what is left and right of it. It can't
exceed the share of letters that two names have in common at all, so names are joined by their rarest letters: two names that are alike
share some of each one's first few letters in order of rarity, and their lengths are near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import text as T
from plenum.functions.graph import maybe_broadcast

#: How alike two surnames must be.
LEAST = 0.80
#: Letters with their number in a name (the second `e`, say) that are counted and sent to all tasks at most.
LETTERS = 100_000
#: Letters together by which names are looked up.
KEY = 3


def matching_letters(a: Column, b: Column) -> Column:
    """Letters of two texts in matching stretches, the longest first; of equal ones the first in a, then in b."""

    def longest(p: Column) -> Column:
        n = F.length(p["x"])
        lengths = F.sequence(F.least(n, F.length(p["y"])), F.lit(1), F.lit(-1))
        pieces = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(k.alias("k"), i.alias("i")))))
        first = F.get(F.filter(pieces, lambda q: F.contains(p["y"], F.substring(p["x"], q["i"], q["k"]))), F.lit(0))
        # bound by a lambda, so that it is looked for once
        placed = F.transform(F.array(first), lambda f: F.struct(f["k"].alias("k"), f["i"].alias("i"), F.instr(p["y"], F.substring(p["x"], f["i"], f["k"])).alias("j")))
        return F.get(placed, F.lit(0))

    def split(p: Column, h: Column) -> Column:
        before = F.struct(F.substring(p["x"], F.lit(1), h["i"] - 1).alias("x"), F.substring(p["y"], F.lit(1), h["j"] - 1).alias("y"))
        after = F.struct(F.substring(p["x"], h["i"] + h["k"], F.length(p["x"])).alias("x"), F.substring(p["y"], h["j"] + h["k"], F.length(p["y"])).alias("y"))
        return F.filter(F.array(before, after), lambda q: (q["x"] != "") & (q["y"] != ""))

    def step(state: Column, _: Column) -> Column:
        left = F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        p = F.try_element_at(state["open"], F.lit(-1))
        done = F.transform(
            F.array(longest(p)),
            lambda h: F.struct((state["n"] + F.coalesce(h["k"], F.lit(0))).alias("n"), F.when(h["k"].isNull(), left).otherwise(F.concat(left, split(p, h))).alias("open")),
        )
        return F.when(F.size(state["open"]) > 0, F.get(done, F.lit(0))).otherwise(state)

    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    both = F.filter(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda q: (q["x"] != "") & (q["y"] != ""))
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(x), F.length(y)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("n"), both.alias("open")), step, lambda s: s["n"])


def alike(a: Column, b: Column) -> Column:
    """Twice the matching letters over all letters of two texts, whatever their case; 1 for two empty ones. Null counts as empty."""
    n = F.length(F.coalesce(a, F.lit(""))) + F.length(F.coalesce(b, F.lit("")))
    return F.when(n == 0, 1.0).otherwise(2.0 * matching_letters(a, b) / n)


def _parts(df: DataFrame) -> int:
    """Parts for rows that are few bytes but much work: given, as adaptive execution would choose one part by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lettered(names: DataFrame, name: str) -> DataFrame:
    """(name, n, letters): each distinct name with its letters, of which equal ones are numbered."""
    letters = F.split(F.lower(F.col(name)), "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i), lambda d: d == c)).cast("string")))
    each = names.select(name).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct().repartition(_parts(names), name)
    return each.select(name, F.length(name).alias("n"), numbered.alias("letters"))


def _keys(prefix: Column, k: Column) -> Column:
    """All choices of k letters of a short list, as texts."""
    more = lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda c: c["k"] < k), lambda c: F.struct((c["k"] + 1).alias("k"), F.concat(c["key"], F.lit("|"), x).alias("key"))))
    every = F.aggregate(prefix, F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("key"))), more)
    return F.transform(F.filter(every, lambda c: c["k"] == k), lambda c: c["key"])


def similar_names(a: DataFrame, b: DataFrame, name_a: str, name_b: str, least: float = LEAST) -> DataFrame:
    """(name_a, name_b, score): all pairs of distinct names of the two tables whose score is `least` or more; least is over 0.

    Null and empty names take no part. Names of n and m letters that are alike have at least o = ceil(least * (n + m) / 2) letters in
    common, so k of them are among the n - o + k rarest of the one and the m - o + k rarest of the other. Names are looked up by both
    lengths and each choice of k such letters, k being KEY or o; one letter alone would leave most pairs where an alphabet is small.
    """
    x, y = _lettered(a, name_a), _lettered(b, name_b)
    often = maybe_broadcast(x.select(F.explode("letters").alias("letter")).union(y.select(F.explode("letters").alias("letter"))).groupBy("letter").agg(F.count("*").alias("c")), LETTERS)

    def rare(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        each = df.select(name, "n", F.explode("letters").alias("letter")).join(often, "letter")
        held = each.repartition(_parts(df), name).groupBy(name, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "letter"))), lambda s: s["letter"]).alias("letters"))
        shortest, most = F.ceil(F.lit(least / (2 - least)) * F.col("n") - 1e-9), F.floor(F.lit((2 - least) / least) * F.col("n") + 1e-9)
        met = held.select(name, F.col("n").cast("int").alias(own), "letters", F.explode(F.sequence(F.greatest(shortest, F.lit(1)).cast("int"), most.cast("int"))).alias(other))
        common = F.ceil(F.lit(least / 2) * (F.col(own) + F.col(other)) - 1e-9).cast("int")
        k = F.least(common, F.lit(KEY))
        return met.select(name, own, other, F.col("letters").alias(f"letters_{own}"), F.explode(_keys(F.slice("letters", F.lit(1), F.col(own) - common + k), k)).alias("key"))

    keys = ["n_a", "n_b", "key"]
    enough = F.size(F.array_intersect("letters_n_a", "letters_n_b")) >= F.lit(least / 2) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = rare(x, name_a, "n_a", "n_b").join(rare(y, name_b, "n_b", "n_a"), keys).where(enough).select(name_a, name_b).repartition(_parts(a), name_a, name_b).distinct()
    score = F.filter(F.array(alike(F.col(name_a), F.col(name_b))), lambda s: s >= least)
    return pairs.select(name_a, name_b, F.explode(score).alias("score"))


def surnames_on_roster(names: DataFrame, roster: DataFrame, least: float) -> DataFrame:
    """(name, on_roster): whether a name's surname is nearly that of an alias; roster: ordinal, canonical, aliases."""
    said = names.select("name").distinct().withColumn("a", F.lower(T.surname(F.col("name"))))
    known = roster.select(F.explode("aliases").alias("alias")).select(F.lower(T.surname(F.col("alias"))).alias("b"))
    found = similar_names(said, known, "a", "b", least).select("a").distinct().withColumn("on_roster", F.lit(True))
    return said.join(found, "a", "left").select("name", F.coalesce("on_roster", F.lit(False)).alias("on_roster"))


def correct_names(names: DataFrame, roster: DataFrame, least: float = LEAST, fuzzy: bool = True) -> DataFrame:
    """(name, corrected, tier): each distinct name as the roster has it (ordinal, canonical, aliases), or trimmed as it is, with tier null.

    1: it is a canonical name. 2: it is an alias. 3: it has an alias of one word among its words, or one of several words in it. 4, if
    `fuzzy`: its surname is nearly that of an alias, the nearest. Case counts nowhere, and of equals the roster's first counts. All tiers are
    joins by equal keys: names, words, ends of words, rare letters. Null names stay null; an empty roster corrects nothing.
    """
    n = names.select("name").distinct().withColumns({"low": F.lower(F.trim("name")), "sn": F.lower(T.surname(F.trim("name")))})
    aliases = roster.select("ordinal", "canonical", F.posexplode("aliases").alias("place", "alias")).withColumn("low", F.lower("alias"))
    entry = F.struct("tier", "rank", "ordinal", "place", "canonical")
    whole = roster.select(F.lower("canonical").alias("low"), "ordinal", "canonical", F.lit(0).alias("place"), F.lit(1).alias("tier"))
    whole = whole.unionByName(aliases.select("low", "ordinal", "canonical", "place", F.lit(2).alias("tier")))
    found = [n.join(whole, "low").withColumn("rank", F.lit(0.0))]
    one = aliases.where(~F.contains("alias", F.lit(" "))).withColumnRenamed("low", "word")
    words = n.select("name", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word"))
    found.append(words.join(one, "word").withColumns({"tier": F.lit(3), "rank": F.lit(0.0)}))
    # an alias of several words begins at the end of a word
    several = aliases.where(F.contains("alias", F.lit(" "))).withColumnRenamed("low", "many").withColumn("end", F.substring_index("many", " ", 1))
    parts = F.split("low", " ")
    ends = F.array_distinct(F.flatten(F.transform(parts, lambda w: F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.substring(w, F.length(w) - i + 1, i)))))
    found.append(n.select("name", "low", F.explode(ends).alias("end")).join(several, "end").where(F.contains("low", F.col("many"))).withColumns({"tier": F.lit(3), "rank": F.lit(0.0)}))
    if fuzzy:
        known = aliases.withColumn("b", F.lower(T.surname(F.col("alias"))))
        near = similar_names(n, known, "sn", "b", least).join(n, "sn").join(known.select("b", "ordinal", "place", "canonical"), "b")
        found.append(near.withColumns({"tier": F.lit(4), "rank": -F.col("score")}))
    every = found[0].select("name", entry.alias("e"))
    for f in found[1:]:
        every = every.unionByName(f.select("name", entry.alias("e")))
    best = every.groupBy("name").agg(F.min("e").alias("e"))
    return n.join(best, "name", "left").select("name", F.coalesce("e.canonical", F.trim("name")).alias("corrected"), F.col("e.tier").cast("long").alias("tier"))
