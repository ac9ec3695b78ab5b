"""Decisions on single rows: identity keys, labels, seeds, vocabularies and grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import HONORIFICS, KEY_TITLES, tokens


def identity_key(essentials: Column, local: Column, name: Column) -> Column:
    """The first of a linked slug, a local slug and a normalised name, with its kind in front; null without any. The name loses titles unless it has nothing else."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    ws = F.filter(F.split(F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("."), F.lit("")), r"\s+"), lambda t: t != "")
    own = F.filter(ws, lambda t: ~t.isin(KEY_TITLES))
    plain = F.nullif(F.array_join(F.when(F.size(own) > 0, own).otherwise(ws), " "), F.lit(""))
    return F.coalesce(F.concat(F.lit("essentials:"), blank(essentials)), F.concat(F.lit("local:"), blank(local)), F.concat(F.lit("name:"), plain))


def speaker_label(x: Column) -> Column:
    """SPEAKER_nn from trailing digits, else the value as an upper-case slug."""
    digits = F.regexp_extract(x, r"(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("SPEAKER_"), F.lpad(digits.cast("int").cast("string"), F.greatest(F.length(digits.cast("int").cast("string")), F.lit(2)), F.lit("0")))).otherwise(
        F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]+", "_")
    )


def seed(*parts: Column) -> Column:
    """The first 64 bits of the SHA-256 of the parts, joined by a bar, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def in_vocabulary(keys: Column, vocabulary: Column) -> Column:
    """The keys that the vocabulary has, once each, in their order."""
    return F.array_distinct(F.filter(keys, lambda k: F.array_contains(vocabulary, k)))


def distinct_ignoring_case(items: Column) -> Column:
    """The first of the items that differ in case only, in their order: sorted by lower case and place, and cut where that changes."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    # the sorted list is bound by a lambda, so that it is sorted once and not for each item
    first = F.get(F.transform(F.array(placed), lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p["low"] != F.get(ps, i - 1)["low"]))), F.lit(0))
    return F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])


def ungrounded(generated: Column, source: Column) -> Column:
    """Numbers of a generated text that its source doesn't have, once each, in order."""
    found = F.array_distinct(F.regexp_extract_all(generated, F.lit(r"\d+(?:[.,-]\d+)*"), F.lit(0)))
    return F.filter(found, lambda t: ~F.contains(source, t))


def first_and_more(items: Column, most: int = 3) -> Column:
    """`a, b, c +2 more`; empty for none."""
    rest = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def event_name_slug(name: Column) -> Column:
    """`adams_jane` from `Dr. Jane Adams`: the last token first, without honorifics."""
    t = F.filter(tokens(name), lambda w: ~w.isin(HONORIFICS))
    return F.concat_ws("_", F.try_element_at(t, F.lit(-1)), *[F.when(F.size(t) > 1, F.array_join(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), "_"))])
