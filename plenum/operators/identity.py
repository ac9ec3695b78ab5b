"""Who speaks: voices, names, votes and layered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import text as T
from plenum.functions.vectors import cosine


def centroids(vectors: DataFrame, by: list[str], vector: str = "vector", weight: str | None = None) -> DataFrame:
    """The mean vector of each group, weighted if asked for (weights of 0 or less are left out).

    Sums by place combine before the shuffle, so a group of any size costs a task no more than its partial sums.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    each = vectors.where(w > 0).select(*by, w.alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = each.groupBy(*by, "__i").agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__m"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid"))


def similar(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_vector: str, right_vector: str) -> DataFrame:
    """Cosine of each left row with every profile on the right; the right side is a table of centroids.

    Profiles are compared in blocks: the rows of a block are gathered into one row, so the join pairs left rows with blocks.
    """
    block = right.withColumn("__block", F.pmod(F.xxhash64(right_key), F.lit(16))).groupBy("__block").agg(F.collect_list(F.struct(F.col(right_key).alias("k"), F.col(right_vector).alias("v"))).alias("__profiles"))
    many = left.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return (
        many.join(block, "__block")
        .select(*left.columns, F.explode("__profiles").alias("p"))
        .select(*[c for c in left.columns if c != left_vector], F.col("p.k").alias(right_key), cosine(F.col(left_vector), F.col("p.v")).alias("similarity"))
    )


def best_match(similarities: DataFrame, key: str, profile: str, threshold: Column) -> DataFrame:
    """The most similar profile of each key (the least profile of equals) if above 0; matched says whether it reaches threshold."""
    top = similarities.where("similarity > 0").groupBy(key).agg(
        F.min_by(F.struct(F.col(profile).alias("profile"), "similarity", threshold.alias("threshold")), F.struct(-F.col("similarity"), F.col(profile))).alias("top")
    )
    return top.select(key, F.col("top.profile").alias(profile), F.col("top.similarity").alias("similarity"), (F.col("top.similarity") >= F.col("top.threshold")).alias("matched"))


def dedupe_identities(mappings: DataFrame) -> DataFrame:
    """Within a meeting a person holds one label: the most confident, the first of equals; the others lose name and link.

    Needs meeting, ordinal, label, name, person, confidence. First by name, then by person among those that kept theirs.
    """
    kept = mappings
    for key in ("name", "person"):
        w = Window.partitionBy("meeting", key).orderBy(F.col("confidence").desc_nulls_last(), "ordinal")
        lost = F.col(key).isNotNull() & (F.row_number().over(w) > 1)
        kept = kept.withColumn("__lost", lost)
        kept = kept.select(
            *[c for c in kept.columns if c not in ("name", "person", "needs_review", "__lost")],
            F.when(~F.col("__lost"), F.col("name")).alias("name"),
            F.when(~F.col("__lost"), F.col("person")).alias("person"),
            (F.col("__lost") | (F.col("needs_review") if "needs_review" in kept.columns else F.lit(False))).alias("needs_review"),
        )
    return kept


def layered(candidates: DataFrame, review: float = 0.7) -> DataFrame:
    """The candidate that stands for each (meeting, label).

    Needs layer (1 voice, 2 pattern, 3 model, 4 record), name, confidence, ordinal. A later layer replaces an earlier
    one only with more confidence; a record of at least 0.5 replaces any. needs_review: less than `review`.
    """
    record = (F.col("layer") == 4) & (F.col("confidence") >= 0.5)
    w = Window.partitionBy("meeting", "label").orderBy(record.desc(), F.col("confidence").desc_nulls_last(), "layer", "ordinal")
    return (
        candidates.where(F.col("name").isNotNull())
        .withColumn("__n", F.row_number().over(w))
        .where("__n = 1")
        .select("meeting", "label", "layer", "name", "confidence", (F.col("confidence") < review).alias("needs_review"))
    )


def majority(votes: DataFrame, key: list[str], choice: str, least: float = 0.5) -> DataFrame:
    """The choice with most votes: ambiguous on a tie or below `least`, unresolved without votes.

    Needs a row per ballot, with a null choice where nothing matched. confidence is the winner's share of all ballots.
    """
    counted = votes.groupBy(*key, choice).agg(F.count("*").alias("n"))
    ranked = counted.groupBy(*key).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col(choice).isNotNull(), F.col("n"))), F.lit(0)).alias("matched"),
        F.max(F.when(F.col(choice).isNotNull(), F.col("n"))).alias("most"),
        F.array_sort(F.collect_list(F.when(F.col(choice).isNotNull(), F.struct((-F.col("n")).alias("minus"), F.col(choice).alias("choice"))))).alias("list"),
    )
    tie = F.coalesce(F.get("list", 1)["minus"] == F.get("list", 0)["minus"], F.lit(False))
    share = F.col("most") / F.col("total")
    status = F.when(F.col("matched") == 0, "unresolved").when(tie | (share < least), "ambiguous").otherwise("resolved")
    return ranked.select(*key, status.alias("status"), F.when(status == "resolved", F.get("list", 0)["choice"]).alias(choice), F.round(F.coalesce(share, F.lit(0.0)), 4).alias("confidence"))


def unlinked(speakers: DataFrame) -> DataFrame:
    """Named speakers without a link, by name: how often, in how many meetings, and the id that this name has if it has just one.

    Needs meeting, name, person (null if unlinked), status.
    """
    key = F.lower(F.trim("name"))
    named = speakers.where("name is not null and trim(name) <> ''").withColumn("key", key)
    known = named.where("person is not null").groupBy("key").agg(F.when(F.count_distinct("person") == 1, F.min("person")).alias("known_id"))
    open_ = named.where("person is null and (status is null or status not in ('unidentified', 'non_speaker'))")
    return open_.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("meeting").alias("n_meetings")).join(known, "key", "left").select("key", "n", "n_meetings", "known_id")


def roster_match(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Each name's roster entry: its canonical name, else an alias, else the only one with its surname; the first of a tier.

    Needs name; roster has ordinal, canonical, aliases. tier is 1, 2, 3 or null. Equal keys all, so it shuffles by name, not by pairs.
    """
    n = names.select("name").distinct().select("name", F.lower(F.trim("name")).alias("k"), T.surname(F.col("name")).alias("sn"))
    r = roster.select("ordinal", "canonical", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("tier"), F.lower("canonical").alias("k"))), F.transform("aliases", lambda a: F.struct(F.lit(2).alias("tier"), F.lower(a).alias("k"))))).alias("m")).select("ordinal", "canonical", "m.*")
    exact = n.join(r, "k").select("name", "tier", "ordinal", "canonical")
    by_surname = roster.select("ordinal", "canonical", T.surname(F.col("canonical")).alias("sn")).groupBy("sn").agg(F.count("*").alias("c"), F.min("ordinal").alias("ordinal"), F.min("canonical").alias("canonical")).where("c = 1")
    loose = n.join(by_surname, "sn").select("name", F.lit(3).alias("tier"), "ordinal", "canonical")
    best = exact.union(loose).groupBy("name").agg(F.min(F.struct("tier", "ordinal", "canonical")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.col("b.canonical").alias("canonical"), F.col("b.tier").cast("long").alias("tier"))


def resolve_unique(asked: DataFrame, known: DataFrame, on: list[str], narrow: str, value: str) -> DataFrame:
    """Rows of `asked` with the one `known` value of equal keys; `narrow` counts only where it leaves some.

    status: resolved, ambiguous (with the number of choices) or unknown. asked needs ask_id. `known` is counted by its keys, with `narrow`
    and without, before it is joined, so a key that many share is one row.
    """
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(on)]
    found = F.struct(F.count(value).alias("n"), F.min(value).alias("v"), F.count(F.lit(1)).alias("rows"))
    every = known.groupBy(*keys).agg(found.alias("__all"))
    near = known.where(F.col(narrow).isNotNull()).groupBy(*keys, F.col(narrow).alias("__narrow")).agg(found.alias("__near"))
    a = asked.select("ask_id", *on, F.col(narrow).alias("__n"))
    same = lambda df: [a[c] == df[f"__k{i}"] for i, c in enumerate(on)]
    joined = a.join(every, same(every), "left").join(near, [*same(near), a["__n"] == near["__narrow"]], "left")
    f = F.coalesce("__near", "__all")
    choices = F.coalesce(f["n"], F.lit(0))
    return joined.select(
        "ask_id",
        F.when(choices == 1, "resolved").when(choices > 1, "ambiguous").otherwise("unknown").alias("status"),
        F.when(choices == 1, f["v"]).alias(value),
        choices.alias("choices"),
    )
