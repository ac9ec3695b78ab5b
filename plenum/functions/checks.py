"""Checks of single rows before they are published: playback, kinds and roles, evidence in a text, links, and whose voice a turn has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import youtube_id
from plenum.functions.vectors import cosine

# Kinds of events, those with a host and guests, the roles that a local person may have by kind (the first is the default),
# and file endings by kind of playback.
EVENT_KINDS = ["council", "school_board", "debate", "forum", "community_meeting", "floor", "news_clip", "press_conference", "podcast", "other"]
INTERVIEW_KINDS = ["news_clip", "press_conference", "podcast"]
CIVIC_ROLES = ["public_comment", "staff", "official", "presenter"]
CAMPAIGN_ROLES = ["candidate", "moderator", "panelist"]
ROLES = {
    "council": CIVIC_ROLES, "school_board": CIVIC_ROLES, "community_meeting": CIVIC_ROLES, "floor": CIVIC_ROLES,
    "press_conference": ["official", "staff", "presenter", "public_comment"],
    "podcast": CAMPAIGN_ROLES, "forum": CAMPAIGN_ROLES, "debate": CAMPAIGN_ROLES,
}
ENDINGS = {"file": ["mp4", "m4v", "mov", "webm"], "audio": ["mp3", "m4a", "aac", "ogg", "wav"], "hls": ["m3u8"]}

# What is said when an item ends in some way; numbers as words; words that tell no person in a name, and in a slug.
OUTCOMES = {
    "passed": ["adopted", "passes", "passed", "carries", "carried", "is approved", "ayes have it", "so ordered"],
    "failed": ["does not carry", "does not pass", "fails", "failed", "defeated", "rejected", "nays have it"],
    "continued": ["postponed", "continued", "tabled"],
    "pulled": ["withdrawn", "withdraw"],
}
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve".split()
NO_PERSON = "councilmember council president vice mayor clerk the of common city member district association office".split()
NO_PERSON_SLUG = "h j s the of".split()

#: What may stand between the words of a reference.
_PAUSE = r"[\s\-–—]+"


def _texts(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _by_key(table: dict[str, list[str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _texts(v))]), key)


def playback(address: Column) -> Column:
    """struct(kind, url) by what an address can be played as: youtube (url is the video's id), file, audio or hls; null for other addresses."""
    url = F.trim(address)
    ending = F.lower(F.regexp_extract(url, r"^https?://[^/?#]*[^?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kind = F.when(youtube_id(url).isNotNull(), "youtube")
    for k, endings in ENDINGS.items():
        kind = kind.when(ending.isin(endings), k)
    kind = F.when(url.rlike("^https?://"), kind)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(youtube_id(url), url).alias("url")))


def iso_date(x: Column) -> Column:
    """The day that a text names as year, month and day, as YYYY-MM-DD; null for any other text."""
    return F.date_format(F.try_to_date(F.when(F.trim(x).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.trim(x)), "yyyy-M-d"), "yyyy-MM-dd")


def local_role(said: Column, kind: Column) -> Column:
    """The role that an answer picks among those of an event's kind: the default for nothing and for numbers out of range, a role's
    number from 1, or any other role as a slug with underscores."""
    answer = F.trim(F.coalesce(said, F.lit("")))
    offered = F.coalesce(_by_key(ROLES, kind), _texts(CAMPAIGN_ROLES + CIVIC_ROLES))
    number = F.when(answer.rlike(r"^\d{1,9}$"), answer.try_cast("int"))
    own = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(answer), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))
    return F.coalesce(F.when(answer.rlike(r"^\d+$"), F.get(offered, number - 1)).otherwise(own), F.get(offered, F.lit(0)))


def entities_fault(kind: Column, chamber: Column, race: Column) -> Column:
    """Why an event's kind and what it is linked to can't be published; null if they can. Only interviews may have both links."""
    is_id = lambda x: F.regexp_replace(x, r"urn:|uuid:|[{}\-]", "").rlike("^[0-9A-Fa-f]{32}$")
    return (
        F.when(kind.isNull() | ~F.trim(kind).isin(EVENT_KINDS), "unknown kind")
        .when(~is_id(chamber), "chamber is no id")
        .when(~is_id(race), "race is no id")
        .when(chamber.isNotNull() & race.isNotNull() & ~F.trim(kind).isin(INTERVIEW_KINDS), "chamber and race")
    )


def tally_said(text: Column) -> Column:
    """Whether a text has a count on both sides of `to` or, in figures, of a dash: two figures at most, or numbers up to twelve as words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\w+|[^\w\s]"), F.lit(0))
    at = lambda i: F.get(tokens, i)
    figures = lambda i: F.coalesce(at(i).rlike(r"^\d{1,2}$"), F.lit(False))
    word = lambda i: F.coalesce(at(i).isin(NUMBERS), F.lit(False))
    between = lambda i: figures(i - 1) & figures(i + 1) & at(i).isin("to", "-", "–") | word(i - 1) & word(i + 1) & (at(i) == "to")
    return F.exists(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.coalesce(between(i), F.lit(False)))


def outcome_said(outcome: Column, text: Column) -> Column:
    """Whether a text has words for an outcome, or for passed and failed a tally; false for null texts and unknown outcomes."""
    low = F.lower(text)
    words = F.exists(_by_key(OUTCOMES, outcome), lambda p: F.contains(low, p))
    return F.coalesce(words, F.lit(False)) | F.coalesce(outcome.isin("passed", "failed") & tally_said(text), F.lit(False))


def title_said(title: Column, text: Column, least: int = 2) -> Column:
    """Whether a text has that many of a title's different words of six letters and more; false for null."""
    long = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{6,}"), F.lit(0)))
    return F.coalesce(F.size(F.filter(long, lambda w: F.contains(F.lower(text), w))) >= least, F.lit(False))


def reference_said(ref: Column, text: Column) -> Column:
    """Whether a text has a reference (kind and number) in full, with spaces or dashes between its words; an ordinance is not found inside
    an appropriation ordinance. False for null."""
    kind = F.regexp_extract(ref, r"^(.*) \S+$", 1)
    heard = F.when(F.lower(kind) == "ordinance", F.regexp_replace(text, rf"(?i)\bappropriation{_PAUSE}ordinance", "|")).otherwise(text)
    words = F.transform(F.split(ref, r"\s+"), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.coalesce(F.regexp_like(heard, F.concat(F.lit("(?i)"), F.array_join(words, _PAUSE))), F.lit(False))


def strong_match(name: Column, full_name: Column) -> Column:
    """Whether all words of a name are words of the full one, in any order and case; false for none."""
    ws = lambda x: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != "")
    return (F.size(ws(name)) > 0) & (F.size(F.array_except(ws(name), ws(full_name))) == 0)


def inconsistent_link(name: Column, slug: Column) -> Column:
    """Whether a name and the slug that it is linked to both tell a person, and no word in common."""
    ws = lambda x, no: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(no))
    a, b = ws(name, NO_PERSON), ws(slug, NO_PERSON_SLUG)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def whose_voice(turn: Column, dominant: Column, interrupter: Column, margin: float = 0.10) -> Column:
    """Which of two voices a turn's vector is nearer to by more than a margin of cosine: dominant, interrupter, else ambiguous;
    unembeddable where a cosine can't be told."""
    lead = cosine(turn, dominant) - cosine(turn, interrupter)
    return F.when(lead.isNull(), "unembeddable").when(lead > margin, "dominant").when(lead < -margin, "interrupter").otherwise("ambiguous")


def library_status(live: Column, review: Column, stage: Column) -> Column:
    """Where a meeting stands: live, ready (its review passed), needs-review (the fourth stage is done) or processing."""
    return F.when(live, "live").when(review == "pass", "ready").when(stage >= 4, "needs-review").otherwise("processing")
