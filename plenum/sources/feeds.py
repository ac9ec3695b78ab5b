"""Feeds of videos, podcasts and news as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["outlet_id", "url", "title", "description", "published_at", "via"]
_ATOM = (
    "entry array<struct<id:string,`yt:videoId`:string,title:string,published:string,updated:string,summary:string,"
    "link:array<struct<_rel:string,_href:string>>,`media:group`:struct<`media:description`:string>>>"
)
_RSS = (
    "channel struct<title:string,item:array<struct<title:string,link:string,description:string,pubDate:string,`dc:date`:string,"
    "guid:struct<_VALUE:string,_isPermaLink:string>,enclosure:struct<_url:string,_type:string>>>>"
)


def _text(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def video_feed(feeds: DataFrame) -> DataFrame:
    """Atom entries of (outlet_id, xml): the alternate link, else the watch page of the id; entries without either are left out."""
    e = feeds.select("outlet_id", F.explode(F.from_xml("xml", _ATOM)["entry"]).alias("e"))
    link = F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    video = _text(F.col("e.`yt:videoId`"))
    return e.select(
        "outlet_id",
        F.coalesce(_text(link), F.concat(F.lit("https://www.youtube.com/watch?v="), video)).alias("url"),
        _text(F.col("e.title")).alias("title"),
        _text(F.coalesce(F.col("e.`media:group`")["media:description"], F.col("e.summary"))).alias("description"),
        F.coalesce("e.published", "e.updated").alias("published_at"),
        F.lit("video_feed").alias("via"),
    ).where("url is not null")


def item_feed(feeds: DataFrame, via: str = "podcast_feed") -> DataFrame:
    """RSS items of (outlet_id, xml): link, else a permanent guid, else the enclosure; dates as ISO in UTC or null; only web addresses stay."""
    e = feeds.select("outlet_id", F.explode(F.from_xml("xml", _RSS)["channel"]["item"]).alias("e"))
    permanent = F.when(F.coalesce(F.col("e.guid._isPermaLink"), F.lit("true")) != "false", _text(F.col("e.guid._VALUE")))
    when = F.coalesce(
        F.try_to_timestamp(F.regexp_replace("e.pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace("e.pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z")),
        F.col("e.`dc:date`").try_cast("timestamp"),
    )
    return e.select(
        "outlet_id",
        F.coalesce(_text(F.col("e.link")), permanent, _text(F.col("e.enclosure._url"))).alias("url"),
        _text(F.col("e.title")).alias("title"),
        _text(F.col("e.description")).alias("description"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.lit(via).alias("via"),
    ).where("url rlike '^https?://'")
