"""A chamber's printed record: paragraphs, speakers' turns, and whom a turn's designation names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, as the record prints them: titles of members, offices of who presides, the slug of each office (the first whose words a
# designation has), and states with their codes.
TITLES = ["Mr.", "Mrs.", "Ms.", "Miss", "Mr", "Mrs", "Ms"]
OFFICES = ["presiding officer", "speaker", "vice president", "president", "chief justice", "chair", "clerk"]
OFFICE_SLUGS = {
    "presiding": "presiding_officer", "speaker": "speaker", "president pro tempore": "president_pro_tempore", "vice president": "vice_president",
    "chief justice": "chief_justice", "chair": "chair", "clerk": "clerk",
}
STATES = (
    "Alabama AL, Alaska AK, Arizona AZ, Arkansas AR, California CA, Colorado CO, Connecticut CT, Delaware DE, Florida FL, Georgia GA, Hawaii HI, "
    "Idaho ID, Illinois IL, Indiana IN, Iowa IA, Kansas KS, Kentucky KY, Louisiana LA, Maine ME, Maryland MD, Massachusetts MA, Michigan MI, "
    "Minnesota MN, Mississippi MS, Missouri MO, Montana MT, Nebraska NE, Nevada NV, New Hampshire NH, New Jersey NJ, New Mexico NM, New York NY, "
    "North Carolina NC, North Dakota ND, Ohio OH, Oklahoma OK, Oregon OR, Pennsylvania PA, Rhode Island RI, South Carolina SC, South Dakota SD, "
    "Tennessee TN, Texas TX, Utah UT, Vermont VT, Virginia VA, Washington WA, West Virginia WV, Wisconsin WI, Wyoming WY, District of Columbia DC, "
    "Puerto Rico PR, Guam GU, American Samoa AS, Virgin Islands VI, Northern Mariana Islands MP"
)

#: Lines that belong to the page: in brackets, the source's note, rules.
PAGE = r"(?m)^[ \t]*(?:\[.*\]|From the Congressional Record Online.*|_{5,})[ \t]*$"


def paragraphs(text: Column) -> Column:
    """A text's paragraphs, each in one line. One begins after a blank line or a line of the page, and where a line is set in by two spaces."""
    cut = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), PAGE, ""), r"\n[ \t]*(?=\n)|\n(?=  +\S)")
    return F.filter(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")


def _office(words: Column) -> Column:
    """The office that words name in small letters, `acting` before it and `pro tempore` behind it included; null if they name none."""
    said = F.lower(F.array_join(words, " "))
    bare = F.when(said.startswith("acting "), F.substring(said, 8, 1 << 10)).otherwise(said)
    bare = F.when(F.endswith(bare, F.lit(" pro tempore")), F.substring_index(bare, " pro tempore", 1)).otherwise(bare)
    return F.when(bare.isin(OFFICES), said)


def designation(paragraph: Column) -> Column:
    """struct<designation, text> of a paragraph that begins with who speaks; null for others.

    Its first words up to one that ends in a full stop (a title's own stop is none) are read one by one: a title, a capitalised name and,
    with `of`, a capitalised place; or `The`, an office and, in brackets, who holds it.
    """
    words = F.split(paragraph, " ")
    title = lambda w: F.ltrim(w, F.lit("(")).isin(TITLES)
    n = F.array_position(F.transform(words, lambda w: F.endswith(w, F.lit(".")) & ~title(w)), True).cast("int")
    last = F.get(words, n - 1)
    head = F.concat(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.substring(last, F.lit(1), F.length(last) - 1)))
    at = lambda i: F.get(head, F.lit(i))
    capital = lambda w, least=1: w.rlike(rf"^\p{{Lu}}[\p{{L}}.'-]{{{least},}}$")
    place = (at(2) == "of") & (n > 3) & capital(at(3)) & F.forall(F.slice(head, 4, 1 << 10), lambda w: w.rlike(r"^\p{L}+$"))
    member = title(at(0)) & ~at(0).startswith("(") & capital(at(1)) & ((n == 2) | F.coalesce(place, F.lit(False)))
    held = F.endswith(F.get(head, n - 1), F.lit(")")) & F.get(head, n - 2).startswith("(") & title(F.get(head, n - 2)) & F.get(head, n - 1).rlike(r"^\p{L}+\)$")
    office = (at(0) == "The") & _office(F.slice(head, F.lit(2), F.greatest(F.when(held, n - 3).otherwise(n - 1), F.lit(0)))).isNotNull()
    text = F.trim(F.array_join(F.slice(words, n + 1, 1 << 20), " "))
    fine = (n > 1) & (text != "") & (F.coalesce(member, F.lit(False)) | F.coalesce(office, F.lit(False)))
    return F.when(fine, F.struct(F.array_join(head, " ").alias("designation"), text.alias("text")))


def turns(granules: DataFrame, key: str, text: str) -> DataFrame:
    """Speakers' turns of each granule: key, position (0, 1, ...), designation, text.

    A paragraph that begins with a designation begins a turn; others with small letters in them go on with it; headings, and what is before
    the first designation, are left out. Paragraphs are rows, and a running count of designations numbers the turns; null texts have none.
    """
    told = granules.select(key, F.posexplode(paragraphs(F.col(text))).alias("n", "p")).withColumn("d", designation(F.col("p")))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("turn", F.count("d").over(upto)).where((F.col("turn") > 0) & (F.col("d").isNotNull() | F.col("p").rlike(r"\p{Ll}")))
    part = F.struct("n", F.coalesce("d.text", "p").alias("p"))
    each = told.groupBy(key, "turn").agg(F.max("d.designation").alias("designation"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), " ").alias("text"))
    return each.select(key, (F.col("turn") - 1).alias("position"), "designation", "text")


def resolve(spoken: DataFrame, roster: DataFrame) -> DataFrame:
    """spoken with whom its designation names on a chamber's roster (member, surname, state): member, role, method, needs_review.

    method: surname or surname_state for a member whom these single out, presiding_parenthetical for one who presides, role, ambiguous
    (several members) or unresolved. A state that none of a surname's members is from is passed over. The roster is counted by surname
    and by state before it is joined, so a common surname is one row.
    """
    what = F.trim(F.coalesce("designation", F.lit("")))
    # who presides stands in brackets; else a title, a name and perhaps a place; else an office
    opening = "the presiding officer ("
    in_brackets = F.lower(what).startswith(opening) & F.endswith(what, F.lit(")"))
    person = F.when(in_brackets, F.substring(what, F.lit(len(opening) + 1), F.length(what) - len(opening) - 1)).otherwise(what)
    titled = F.substring_index(person, " ", 1).isin(TITLES) & F.contains(person, F.lit(" "))
    named = F.when(titled, F.trim(F.substring(person, F.instr(person, " ") + 1, 1 << 10)))
    name = F.lower(F.when(in_brackets, named).otherwise(F.trim(F.substring_index(named, " of ", 1))))
    codes = F.create_map(*[F.lit(x) for s in STATES.split(", ") for x in (s[:-3].lower(), s[-2:])])
    state = F.when(~in_brackets & F.contains(named, F.lit(" of ")), F.try_element_at(codes, F.lower(F.trim(F.substring(named, F.instr(named, " of ") + 4, 1 << 10)))))
    words = F.split(what, " ")
    said = F.when(in_brackets & titled, "presiding officer").when(F.get(words, F.lit(0)) == "The", _office(F.slice(words, 2, 1 << 10)))
    slug = F.when(F.lit(False), "")
    for words, s in OFFICE_SLUGS.items():
        slug = slug.when(F.contains(said, F.lit(words)), s)
    slug = slug.otherwise(F.replace(said, F.lit(" "), F.lit("_")))
    # a member's surname may hold " of ": the whole is tried as it stands only where no state is behind it
    counted = lambda *by: roster.groupBy(*[F.lower(c).alias(f"__{c}") if c == "surname" else F.col(c).alias(f"__{c}") for c in by]).agg(F.count("*").alias("n"), F.min("member").alias("m"))
    alone = counted("surname").select("__surname", F.struct("n", "m").alias("__all"))
    at_home = counted("surname", "state").select(F.col("__surname").alias("__s"), "__state", F.struct("n", "m").alias("__here"))
    rows = spoken.withColumns({"__name": name, "__code": state, "__role": F.when(said.isNotNull(), slug), "__brackets": in_brackets})
    joined = rows.join(alone, F.col("__name") == F.col("__surname"), "left").join(at_home, (F.col("__name") == F.col("__s")) & (F.col("__code") == F.col("__state")), "left")
    found = F.coalesce("__here", "__all")
    sure = F.coalesce(found["n"] == 1, F.lit(False))
    several = F.coalesce(found["n"] > 1, F.lit(False))
    method = (
        F.when(sure & F.col("__brackets"), "presiding_parenthetical")
        .when(sure, F.when(F.col("__here").isNotNull(), "surname_state").otherwise("surname"))
        .when(several, "ambiguous")
        .when(F.col("__role").isNotNull(), "role")
        .otherwise("unresolved")
    )
    return joined.select(*[F.col(f"`{c}`") for c in spoken.columns], F.when(sure, found["m"]).alias("member"), F.when(~sure, F.col("__role")).alias("role"), method.alias("method"), several.alias("needs_review"))
