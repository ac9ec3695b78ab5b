"""Episode pages, podcast feeds and lists of a record's parts, read as VARIANT or by columns, without a schema of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of a linked-data block that name an episode, the kind that dates it, the least letters of a telling word, the
# least characters of a spoken paragraph, and the classes of a record's parts by chamber.
EPISODES, ARTICLE = ["RadioEpisode", "PodcastEpisode", "AudioObject"], "NewsArticle"
TELLING, SPOKEN = 5, 20
CHAMBERS = {"house": "HOUSE", "senate": "SENATE"}

_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
_ITEMS = (
    "struct<channel:struct<title:string,`itunes:author`:string,item:array<struct<title:string,link:string,description:string,pubDate:string,"
    "guid:struct<_VALUE:string>,enclosure:array<struct<_url:string,_type:string>>,`itunes:image`:struct<_href:string>>>>>"
)


def read_references(x: Column) -> Column:
    """Text with its numeric character references and the basic named ones read, once; others stay as they are."""
    parts = F.split(x, "&")

    def one(p: Column) -> Column:
        at = lambda pattern: F.regexp_extract(p, pattern, 1)
        digits, hexed, name = at(r"^#0*(\d{1,7});"), at(r"^#[xX]0*([0-9a-fA-F]{1,6});"), at("^([a-z]+);")
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        char = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for known, c in _NAMED.items():
            char = F.coalesce(char, F.when(name == known, F.lit(c)))
        return F.coalesce(F.concat(char, F.substring(p, F.instr(p, ";") + 1, F.length(p))), F.concat(F.lit("&"), p))

    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))


def card(html: Column, name: str) -> Column:
    """What a page's first meta element says of itself as `og:name`; null where none does."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"<[mM][eE][tT][aA]\s[^>]*>"), 0), lambda t: F.regexp_like(t, F.lit(rf"""(?i)\bproperty=["']og:{name}["'].*\bcontent=["']""")))
    said = F.regexp_extract(F.get(tags, 0), r"""(?is)\bproperty=.*\bcontent=["']([^"']*)""", 1)
    return F.when(F.size(tags) > 0, read_references(said))


def linked_data(html: Column) -> Column:
    """The objects of a page's linked-data blocks in page order, as array<variant>; blocks that are not JSON give none."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype=["']application/ld\+json["'][^>]*>(.*?)</script"""), 1)
    each = F.transform(blocks, lambda b: F.try_parse_json(b))
    return F.flatten(F.transform(each, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def page_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with meta (in place of such a column): struct of date, title, outlet, image, description.

    The title is the first name of an episode block, else the first headline of an article block; the date the first ten characters of
    an article's. A block may have one kind or several. Null where a page says nothing; null html says nothing.
    """
    said = lambda o, at: F.nullif(F.try_variant_get(o, at, "string"), F.lit(""))
    kinds = lambda o: F.coalesce(F.try_variant_get(o, "$['@type']", "array<string>"), F.array(F.try_variant_get(o, "$['@type']", "string")))
    told = F.transform(
        linked_data(F.col(html)),
        lambda o: F.struct(
            F.when(F.arrays_overlap(kinds(o), F.array(*[F.lit(k) for k in EPISODES])), said(o, "$.name")).alias("name"),
            F.when(F.array_contains(kinds(o), ARTICLE), said(o, "$.headline")).alias("headline"),
            F.when(F.array_contains(kinds(o), ARTICLE) & (F.length(said(o, "$.datePublished")) >= 10), F.substring(said(o, "$.datePublished"), 1, 10)).alias("date"),
        ),
    )
    first = lambda field: F.get(F.filter(F.transform("told", lambda o: o[field]), lambda x: x.isNotNull()), 0)
    meta = F.struct(
        first("date").alias("date"),
        F.coalesce(first("name"), first("headline")).alias("title"),
        card(F.col("page")[html], "site_name").alias("outlet"),
        card(F.col("page")[html], "image").alias("image"),
        card(F.col("page")[html], "description").alias("description"),
    )
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c != "meta"]
    return pages.select(F.struct("*").alias("page"), told.alias("told")).select(*kept, meta.alias("meta"))


def episode_audio(html: Column, headline: Column, host: str) -> Column:
    """The page's audio file on `host`: the first whose file name holds a telling word of the headline, else the first; null if none."""
    links = F.transform(F.regexp_extract_all(html, F.lit(r"""https?://[^"'\s]+"""), 0), lambda u: F.regexp_extract(u, r"(?i)^(.*\.mp3)", 1))
    files = F.filter(links, lambda u: F.contains(F.lower(u), F.lit(host)))
    words = F.filter(F.split(F.lower(F.coalesce(headline, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= TELLING)
    telling = F.filter(files, lambda u: F.exists(words, lambda w: F.contains(F.lower(F.substring_index(u, "/", -1)), w)))
    return F.coalesce(F.get(telling, 0), F.get(files, 0))


def spoken_paragraphs(html: Column) -> Column:
    """The paragraphs of a page's article (else its body) that are long enough to be speech, each white space in them one space, a blank line between;
    null if none."""
    inside = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\b|$)", 1)
    held = F.when(F.regexp_like(html, F.lit(r"(?i)<article\b")), inside("article")).otherwise(inside("body"))
    begun = F.split(held, r"(?i)<p(?:\s[^>]*)?>")
    raw = F.transform(F.slice(begun, 2, F.size(begun)), lambda p: F.get(F.split(p, r"(?i)</p\b"), 0))
    texts = F.transform(raw, lambda p: F.trim(F.regexp_replace(read_references(F.regexp_replace(p, "<[^>]*>", " ")), r"\s+", " ")))
    long = F.filter(texts, lambda t: F.length(t) >= SPOKEN)
    return F.when(F.size(long) > 0, F.array_join(long, "\n\n"))


def record_parts(lists: DataFrame, chamber: str, text: str = "text") -> DataFrame:
    """The parts of JSON lists that are one chamber's: lists' other columns, place, granule_id, granule_class, title ('' if none).

    An empty class counts as none, then the older field counts; parts without an id are left out. What is not JSON holds no parts.
    """
    parts = F.try_variant_get(F.try_parse_json(F.col(text)), "$.granules", "array<variant>")
    said = lambda at: F.nullif(F.try_variant_get("part", at, "string"), F.lit(""))
    each = lists.select(*[c for c in lists.columns if c != text], F.posexplode(parts).alias("place", "part"))
    return each.select(
        *[c for c in lists.columns if c != text],
        "place",
        said("$.granuleId").alias("granule_id"),
        F.coalesce(said("$.granuleClass"), said("$.docClass")).alias("granule_class"),
        F.coalesce(said("$.title"), F.lit("")).alias("title"),
    ).where((F.col("granule_class") == CHAMBERS[chamber.lower()]) & F.col("granule_id").isNotNull())


def podcast_entries(feeds: DataFrame) -> DataFrame:
    """Items of (show, xml) in feed order: show, place, title, link, guid, audio_url, date, description, image, outlet.

    The audio is the first enclosure of an audio type or file name, else the first; the date is null where it is none.
    """
    e = feeds.select("show", F.from_xml("xml", _ITEMS)["channel"].alias("c")).select("show", F.coalesce("c.title", "c.`itunes:author`").alias("outlet"), F.posexplode("c.item").alias("place", "e"))
    audio = lambda x: F.startswith(F.coalesce(x["_type"], F.lit("")), F.lit("audio")) | F.regexp_like(x["_url"], F.lit(r"(?i)\.(mp3|m4a)$"))
    linked = F.filter("e.enclosure", lambda x: x["_url"].isNotNull())
    day = F.regexp_replace("e.pubDate", r"^\w+,\s*", "")
    when = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")))
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    return e.select(
        "show",
        "place",
        text(F.col("e.title")).alias("title"),
        text(F.col("e.link")).alias("link"),
        text(F.col("e.guid._VALUE")).alias("guid"),
        F.coalesce(F.get(F.filter(linked, audio), 0), F.get(linked, 0))["_url"].alias("audio_url"),
        F.date_format(when, "yyyy-MM-dd").alias("date"),
        F.coalesce("e.description", F.lit("")).alias("description"),
        F.col("e.`itunes:image`._href").alias("image"),
        "outlet",
    )
