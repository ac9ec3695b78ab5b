"""Names, slugs, times, addresses and other strings, as column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no part of a name, for comparing names, for surnames on a roster, and for identity keys.
HONORIFICS = (
    "mr mrs ms dr rep sen senator representative president chair chairman chairwoman chairperson councilmember council member mayor the hon honorable "
    "gov governor speaker"
).split()
ROSTER_TITLES = (
    "councilmember councilwoman councilman alderman alderwoman commissioner mayor vice-mayor president vice-president clerk secretary treasurer "
    "supervisor representative city council member"
).split()
KEY_TITLES = (
    "councilmember councilwoman councilman alderman alderwoman commissioner mayor vice-mayor president vice-president clerk secretary treasurer "
    "supervisor representative chair chairman chairwoman dr mr mrs ms"
).split()


def normalise(x: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one space, trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(normalise(x), " "), lambda t: t != "")


def significant_tokens(x: Column) -> Column:
    """Tokens of two characters or more without honorifics."""
    return F.filter(tokens(x), lambda t: (F.length(t) >= 2) & ~t.isin(HONORIFICS))


def surname(x: Column) -> Column:
    """The last word that is no title, else the whole name; lower case."""
    ws = F.filter(F.split(F.trim(F.lower(F.coalesce(x, F.lit("")))), r"\s+"), lambda w: ~w.isin(ROSTER_TITLES))
    return F.coalesce(F.nullif(F.try_element_at(ws, F.lit(-1)), F.lit("")), F.lower(F.coalesce(x, F.lit(""))))


def slug(x: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def content_words(x: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct words of at least `least` characters that are no stop words, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(stop))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared values over the smaller array's size; 0 where one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), (s % 60).cast("long")


def hhmmss(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", *_hms(seconds))


def clock(seconds: Column) -> Column:
    """M:SS below an hour, else H:MM:SS."""
    h, m, s = _hms(seconds)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds cut off."""
    ms = F.floor((F.greatest(seconds, F.lit(0.0)) * 1000) % 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", *_hms(seconds), ms)


def spell_duration(seconds: Column) -> Column:
    """2h 14m, or 14m below an hour."""
    h, m, _ = _hms(seconds)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def parse_clock(x: Column) -> Column:
    """SS, MM:SS or HH:MM:SS as seconds; null for other texts and for minutes or seconds of 60 and more behind a colon."""
    p = F.split(F.trim(x), ":")
    n = F.size(p)
    part = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    fine = F.regexp_like(F.trim(x), F.lit(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$")) & ((n < 2) | (part(-1) < 60)) & ((n < 3) | (part(-2) < 60))
    return F.when(fine, F.coalesce(F.when(n == 3, part(1)), F.lit(0.0)) * 3600 + F.coalesce(F.when(n >= 2, part(-2)), F.lit(0.0)) * 60 + part(-1))


# Query parameters that say where a link came from, hosts of one video service, and its paths that an id follows.
TRACKING = ["t", "feature", "utm_source", "utm_medium", "utm_campaign", "si", "pp"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"]
SHORT_HOST = "youtu.be"
VIDEO_PATHS = ["shorts", "embed", "live", "v"]


def _url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a web address; empty for others."""
    part = lambda g: F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/?#]*)([^?#]*)\??([^#]*)", g)
    return F.lower(part(1)), part(2), part(3)


def source_key(url: Column) -> Column:
    """One key for one recording: `youtube:` and its id, or `url:` host, path without trailing slashes and the query, its names and
    values decoded, sorted as pairs without tracking and empty values, and encoded anew; `file:` for what is no web address; empty for blank ones."""
    host, path, asked = _url(url)
    text = lambda x: F.coalesce(F.try_url_decode(x), x)
    safe = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("name"), text(F.substring(p, F.instr(p, "=") + 1, 1 << 20)).alias("value"))
    pairs = F.transform(F.filter(F.split(asked, "&"), lambda p: F.contains(p, F.lit("=")) & ~F.endswith(p, F.lit("="))), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(TRACKING)))
    kept = F.transform(kept, lambda p: F.concat(safe(p["name"]), F.lit("="), safe(p["value"])))
    rest = F.concat(host, F.rtrim(path, F.lit("/")), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    video, raw = youtube_id(url), F.trim(F.coalesce(url, F.lit("")))
    return F.when(raw == "", "").when(video.isNotNull(), F.concat(F.lit("youtube:"), video)).when(raw.rlike("^(?i:https?)://"), F.concat(F.lit("url:"), rest)).otherwise(F.concat(F.lit("file:"), raw))


def youtube_id(url: Column) -> Column:
    """The id of a watch, short, live, embed or short-host link; null for any other address."""
    host, path, asked = _url(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    watch = F.get(F.filter(F.transform(F.filter(F.split(asked, "&"), lambda p: p.startswith("v=")), lambda p: F.substring(p, 3, 1000)), lambda v: v != ""), 0)
    behind = F.when(F.get(parts, 0).isin(VIDEO_PATHS), F.get(parts, 1))
    return F.when(host == SHORT_HOST, F.nullif(F.get(F.split(F.ltrim(path, F.lit("/")), "/"), 0), F.lit(""))).when(host.isin(VIDEO_HOSTS), F.coalesce(watch, behind))


# Words that announce an event, limits in seconds between clips and whole events, and days after which an item is old.
EVENT_TERMS = ["debate", "forum", "town hall", "townhall", "town-hall", "interview", "q&a", "one-on-one", "sits down", "candidates"]
SHORT_CLIP, FULL_EVENT, MAX_AGE = 480, 1500, 630
#: Letters with marks and what they are without, by decomposition.
_MARKED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and d[0] != chr(c)]


#: Combining accents, which go without anything in their place.
_COMBINING = "".join(chr(c) for c in range(0x300, 0x370))


def fold(x: Column) -> Column:
    """Lower case without accents, anything but a-z, 0-9 and white space as a space, white space collapsed; empty for null."""
    x = F.coalesce(x, F.lit(""))
    bare = F.translate(x, "".join(a for a, _ in _MARKED) + _COMBINING, "".join(b for _, b in _MARKED))
    bare = F.when(F.octet_length(x) == F.length(x), x).otherwise(bare)  # ASCII has no accents
    return F.trim(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", " "))


def _once(x: Column, f) -> Column:
    """f of x, where x is worked out once for a row however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unmarked(x: Column) -> Column:
    """x without its accents, and without what is then not ASCII; ligatures and letters beyond U+024F count as not ASCII."""
    bare = F.translate(x, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.regexp_replace(bare, r"[^\x00-\x7F]", "")


def _named(title: Column, description: Column, names: Column) -> Column:
    """The names of two words and more that stand whole in a folded title or description."""
    hay = F.concat(F.lit(" "), title, F.lit(" "), description, F.lit(" "))
    return _once(hay, lambda h: F.filter(names, lambda n: _once(fold(n), lambda m: F.contains(m, F.lit(" ")) & F.contains(h, F.concat(F.lit(" "), m, F.lit(" "))))))


def match_names(title: Column, description: Column, names: Column) -> Column:
    """The names of two words and more that stand whole in a title or description."""
    return _named(fold(title), fold(description), names)


def _plain_term(term: str) -> str:
    return re.sub("[^a-z0-9]+", " ", term.lower()).strip()


def _announced(title: Column, description: Column) -> Column:
    hay = F.concat(title, F.lit(" "), description)
    return _once(hay, lambda h: functools.reduce(lambda a, b: a | b, [F.contains(h, F.lit(_plain_term(t))) for t in EVENT_TERMS]))


def has_event_term(title: Column, description: Column) -> Column:
    return _announced(fold(title), fold(description))


def duration_signal(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unknown").when(seconds < SHORT_CLIP, "short").when(seconds >= FULL_EVENT, "long").otherwise("neutral")


def prefilter(title: Column, description: Column, seconds: Column, names: Column) -> Column:
    """struct<passes, matched, duration_signal, reason> of a found item: it passes with a name, if it is no short clip without an event term.

    Title and description are folded once for a row, and searched for names and terms once.
    """
    signal = duration_signal(seconds)

    def judged(f: Column) -> Column:
        none, short = F.size(f["matched"]) == 0, (signal == "short") & ~f["event"]
        reason = F.when(none, "no tracked candidate name").when(short, "short clip without event term").otherwise("name match")
        return F.struct((~none & ~short).alias("passes"), f["matched"].alias("matched"), signal.alias("duration_signal"), reason.alias("reason"))

    def found(t: Column) -> Column:
        return F.struct(_named(t["title"], t["description"], names).alias("matched"), _announced(t["title"], t["description"]).alias("event"))

    folded = F.struct(fold(title).alias("title"), fold(description).alias("description"))
    return _once(_once(folded, found), judged)


def is_stale(published: Column, today: Column) -> Column:
    """Whether an item is older than MAX_AGE days; those without a readable date are not."""
    return F.coalesce(F.datediff(today, F.try_to_date(F.substring(published, 1, 10), "yyyy-MM-dd")) > MAX_AGE, F.lit(False))


def strip_html(html: Column) -> Column:
    """Text of a page by patterns: comments and elements without text go, tags become spaces, the five basic references are read, white space collapses."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for name in ("script", "style", "nav", "header", "footer", "form", "noscript", "svg", "aside", "iframe"):
        x = F.regexp_replace(x, rf"(?is)<{name}\b[^>]*>.*?</{name}>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))
