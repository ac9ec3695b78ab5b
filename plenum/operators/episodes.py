"""Which entry of a show's feed an episode page is: by its address, else by its slug inside an entry's addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram by which slugs find the addresses that may hold them.
GRAM = 6


def address_key(x: Column) -> Column:
    """Host in small letters and path of a web address, without query and closing slashes; other texts without closing slashes; null if blank."""
    t = F.trim(x)
    web = F.regexp_like(t, F.lit("^(?i:https?)://"))
    host = F.lower(F.regexp_extract(t, "^[^:]*://([^/?#]*)", 1))
    return F.nullif(F.rtrim(F.when(web, F.concat(host, _path(t))).otherwise(t), F.lit("/")), F.lit(""))


def _path(t: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def slug(x: Column) -> Column:
    """The last part of an address's path, in small letters; null where there is none or it is only a number, which names a whole show."""
    last = F.lower(F.try_element_at(F.filter(F.split(F.concat(F.lit("/"), _path(F.trim(x))), "/"), lambda s: s != ""), F.lit(-1)))
    return F.when(~F.regexp_like(last, F.lit(r"^\p{Nd}+$")), last)


def _grams(x: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(x) - size + 1, F.lit(1)))
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def match_entries(pages: DataFrame, entries: DataFrame, address: str = "address") -> DataFrame:
    """pages with tier (link or slug) and place of the first entry of their show's feed that is theirs; null for both where none is.

    pages: show, the address and others; entries: show, place (order in the feed), link, guid, audio_url. An equal link or guid comes before
    any slug. A slug is looked up once for all pages that share it: by its gram that the fewest entries of the show hold, then in the
    whole text of these entries, so no page meets all entries. Slugs shorter than a gram are looked up by grams of their own length.
    """
    keyed = pages.select("show", F.struct("*").alias("page"), address_key(F.col(address)).alias("key"), slug(F.col(address)).alias("slug"))
    by_key = (
        entries.select("show", "place", F.explode(F.array(address_key(F.col("link")), address_key(F.col("guid")))).alias("key"))
        .where("key is not null")
        .groupBy("show", "key")
        .agg(F.min("place").alias("linked"))
    )
    # a key that no entry has can't be found by an equal join; only its slug goes on
    exact = keyed.join(by_key, ["show", "key"], "left")
    slugs = exact.where("linked is null and slug is not null").select("show", "slug").distinct()
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("audio_url", "guid", "link")]))
    hay = entries.select("show", "place", text.alias("hay"))
    short = [r.n for r in slugs.where(F.length("slug") < GRAM).select(F.length("slug").alias("n")).distinct().collect()]  # at most GRAM - 1 rows
    sizes = [*sorted(short), GRAM]
    # an address has hundreds of grams and Spark takes exploded rows to be as many as before, so these joins are told to be shuffled
    held = hay.select("show", "place", F.explode(F.concat(*[_grams(F.col("hay"), n) for n in sizes])).alias("gram")).hint("merge")
    often = held.groupBy("show", "gram").agg(F.count("*").alias("n")).hint("merge")
    own = F.when(F.length("slug") < GRAM, F.array("slug")).otherwise(_grams(F.col("slug"), GRAM))
    rare = (
        slugs.select("show", "slug", F.explode(own).alias("gram"))
        .join(often, ["show", "gram"])
        .groupBy("show", "slug")
        .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    )
    maybe = rare.join(held, ["show", "gram"]).join(hay.hint("merge"), ["show", "place"])
    found = maybe.where(F.contains("hay", F.col("slug"))).groupBy("show", "slug").agg(F.min("place").alias("held"))
    tier = F.when(F.col("linked").isNotNull(), "link").when(F.col("held").isNotNull(), "slug")
    return exact.join(found, ["show", "slug"], "left").select("page.*", tier.alias("tier"), F.coalesce("linked", "held").alias("place"))
