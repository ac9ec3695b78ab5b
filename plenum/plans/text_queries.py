"""Queries over names, addresses, times, pages and texts; each with its DuckDB statement."""

from __future__ import annotations

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.functions.graph import maybe_broadcast, settle
from plenum.operators import search
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.plans.views import TURNS
from plenum.sources.rttm import rttm_line

QUERIES, ORACLES, query = registry()
#: Documents whose words are summed up in one task.
TOGETHER = 5_000
T = V.table
STOP = ["the", "and", "that", "for", "with", "are", "was", "this", "from", "les", "des", "que", "der", "die", "und", "los", "las"]
_STOP = ", ".join(f"'{w}'" for w in STOP)


_HONORIFICS = ", ".join(f"'{w}'" for w in X.HONORIFICS)
_TITLES = ", ".join(f"'{w}'" for w in X.ROSTER_TITLES)


@query(f"""select c_custkey, trim(regexp_replace(lower(' Hon. ' || c_name || '  Jr.'), '[^a-z0-9]+', ' ', 'g')) as normal,
array_to_string(list_filter(string_split(trim(regexp_replace(lower('Council President ' || c_name || ' ' || c_mktsegment || ' x'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 2 and t not in ({_HONORIFICS})), ' ') as significant,
case when c_custkey % 2 = 0 then lower(c_name) else lower(c_mktsegment) end as surname from customer""")
def normalize_name(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Council President "), "c_name")).otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("  Clerk")))
    return c.select(
        "c_custkey",
        X.normalise(F.concat(F.lit(" Hon. "), "c_name", F.lit("  Jr."))).alias("normal"),
        F.array_join(X.significant_tokens(F.concat(F.lit("Council President "), "c_name", F.lit(" "), "c_mktsegment", F.lit(" x"))), " ").alias("significant"),
        X.surname(said).alias("surname"),
    )


@query("""select p_partkey, substr(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20) as slug from part""")
def slugify(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!")), 20).alias("slug"))


@query("""with u as (select page_id, 'url:' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') as key from pages)
select page_id, key from u union all select page_id + 1000000, 'youtube:abc-' || page_id::varchar from pages union all select page_id + 2000000, 'youtube:x_' || page_id::varchar from pages
union all select page_id + 3000000, 'youtube:s' || page_id::varchar from pages union all select page_id + 4000000, key || '?a=1&ref=z' from u
union all select page_id + 5000000, case when page_id % 2 = 0 then '' else 'file:/tmp/' || page_id::varchar end from pages""")
def source_key_urls(spark, sf_dir):
    """Keys of each page's address, of video links in four forms, of the address with tracking, and of what is no address."""
    p, k = F.col("url"), F.col("page_id").cast("string")
    bare = F.regexp_extract(p, r"^([^?#]*)", 1)
    forms = [
        bare,
        F.concat(F.lit("https://www.youtube.com/watch?t=3&v=abc-"), k, F.lit("&pp=q")),
        F.concat(F.lit(" https://youtu.be/x_"), k, F.lit("/more?si=x")),
        F.concat(F.lit("http://music.youtube.com/shorts/s"), k, F.lit("?feature=share")),
        F.concat(bare, F.lit("?utm_source=y&ref=z&t=9&a=1&empty=#top")),
        F.when(F.col("page_id") % 2 == 0, "  ").otherwise(F.concat(F.lit("/tmp/"), k)),
    ]
    told = T(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "u"))
    return told.select((F.col("page_id") + F.col("form") * 1000000).alias("page_id"), X.source_key(F.col("u")).alias("key"))


def _strip_sql() -> str:
    x = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for name in ("script", "style", "nav", "header", "footer", "form", "noscript", "svg", "aside", "iframe"):
        x = f"regexp_replace({x}, '<{name}\\b[^>]*>.*?</{name}>', ' ', 'gsi')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'gs')"
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"select page_id, sha256({_strip_sql()}) as text_sha256, length({_strip_sql()})::bigint as n_chars from pages")
def html_text(spark, sf_dir):
    t = X.strip_html(F.col("html"))
    return T(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).cast("long").alias("n_chars"))


_WORDS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 3 and w not in ({_STOP}))))"


@query(f"""with w as (select doc_id, {_WORDS} as ws from documents), p as (select a.doc_id, a.ws as a, b.ws as b from w a join w b on b.doc_id = a.doc_id + 1)
select doc_id, len(a)::bigint as n, case when len(list_distinct(list_concat(a, b))) = 0 then 0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 5) end as jaccard,
case when least(len(a), len(b)) = 0 then 0 else round(len(list_intersect(a, b)) / least(len(a), len(b)), 5) end as overlap from p""")
def word_overlap(spark, sf_dir):
    """Jaccard and overlap coefficients of neighbouring documents' content words."""
    w = T(spark, sf_dir, "documents").select("doc_id", X.content_words(F.col("text"), STOP).alias("a"))
    n = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return w.join(n, "doc_id").select("doc_id", F.size("a").cast("long").alias("n"), F.round(X.jaccard(F.col("a"), F.col("b")), 5).alias("jaccard"), F.round(X.overlap_coefficient(F.col("a"), F.col("b")), 5).alias("overlap"))


@query("""with s as (select event_id, value * 97 as sec from events), p as (select event_id, floor(sec)::bigint as s, floor((sec * 1000) % 1000)::bigint as ms from s)
select event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) as hms, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) else printf('%d:%02d', s // 60, s % 60) end as clock,
printf('%02d:%02d:%02d,%03d', s // 3600, s // 60 % 60, s % 60, ms) as srt, case when s >= 3600 then printf('%dh %dm', s // 3600, s // 60 % 60) else printf('%dm', s // 60) end as spelt, s::double as back from p""")
def format_times(spark, sf_dir):
    e = T(spark, sf_dir, "events").select("event_id", (F.col("value") * 97).alias("s"))
    s = F.col("s")
    return e.select("event_id", X.hhmmss(s).alias("hms"), X.clock(s).alias("clock"), X.srt_time(s).alias("srt"), X.spell_duration(s).alias("spelt"), X.parse_clock(X.clock(s)).alias("back"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_quantity::bigint <> l_linenumber then l_quantity::bigint end as yeas, case when l_quantity::bigint <> l_linenumber then l_linenumber::bigint end as nays from lineitem""")
def tally_regex(spark, sf_dir):
    """Announced tallies read back from sentences; sentences without a tally have none."""
    yes, no = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    said = F.when(yes != no, F.concat(F.lit("On this vote the "), F.when(F.col("l_linenumber") % 2 == 0, "Ayes").otherwise("yeas"), F.lit(" are "), yes, F.lit(" and the nays are "), no, F.lit(". The motion is adopted."))).otherwise("There is no quorum.")
    m = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("text"))
    pattern = r"(?i)\b(?:yeas|ayes) are (\d+)\b.*?\bnays are (\d+)"
    return m.select("l_orderkey", "l_linenumber", "l_partkey", *[F.nullif(F.regexp_extract("text", pattern, g), F.lit("")).cast("long").alias(n) for g, n in ((1, "yeas"), (2, "nays"))])


@query("""select event_id, (props->>'k')::bigint as k, least(greatest((props->>'k')::double / 10, 0.0), 1.0) as confidence, case when (props->>'k')::bigint % 3 = 0 then 'debate' when (props->>'k')::bigint % 3 = 1 then 'forum' else 'other' end as kind from events""")
def verdict_json(spark, sf_dir):
    """Tolerant reading of a JSON verdict: a confidence clamped to [0, 1] and a kind out of a list."""
    k = F.from_json("props", "k long")["k"]
    kind = F.when(k % 3 == 0, "debate").when(k % 3 == 1, "forum").otherwise("other")
    return T(spark, sf_dir, "events").select("event_id", k.alias("k"), F.least(F.greatest(k.cast("double") / 10, F.lit(0.0)), F.lit(1.0)).alias("confidence"), kind.alias("kind"))


@query(f"""with d as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 3 and w not in ({_STOP}))) as word, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 3 and w not in ({_STOP}))) as n from documents),
i as (select doc_id, word, count(*) as tf, max(n) as length from d group by 1, 2),
q as (select distinct item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 3 and w not in ({_STOP}))) as word from benchmark),
h as (select item_id, doc_id, round(sum(tf / length), 6) as score, count(*) as n_words from q join i using (word) group by 1, 2)
select * from (select *, row_number() over (partition by item_id order by score desc, n_words desc, doc_id) as place from h) where place <= 5""")
def fts_search(spark, sf_dir):
    """The five best documents of each benchmark item, by words of three letters and more that are no stop words."""
    long_words = lambda: F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(STOP))
    docs = T(spark, sf_dir, "documents")
    asked = T(spark, sf_dir, "benchmark").select("item_id", F.explode(long_words()).alias("word")).distinct()
    index = search.token_table(docs, "doc_id", long_words(), asked, max(8, math.ceil(docs.count() / TOGETHER)))
    return search.rank(asked, index, "item_id", "doc_id", 5)


def _stem_sql(word):
    for end, instead in search.ENDINGS:
        word = f"regexp_replace({word}, '{end.replace(chr(39), chr(39) * 2)}', '{instead}')"
    return word


_INDEX = f"""with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as ws from documents),
t as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as place from d),
x as (select doc_id, {_stem_sql('w')} as word, place from t where w not in ({_STOP})),
b as (select item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as ws from benchmark),
parts as (
  select item_id, 0 as alt, 0 as part, false as neg, [ws[1], ws[2]] as said from b where item_id % 3 = 0
  union all select item_id, 0, 1, false, [ws[5]] from b where item_id % 3 = 0
  union all select item_id, 0, 0, false, [ws[1]] from b where item_id % 3 = 1
  union all select item_id, 0, 1, true, [ws[2]] from b where item_id % 3 = 1
  union all select item_id, 1, 2, false, [ws[3], ws[4], ws[5]] from b where item_id % 3 = 1
  union all select item_id, 0, 0, false, [ws[1]] from b where item_id % 3 = 2
  union all select item_id, 1, 1, false, [ws[2]] from b where item_id % 3 = 2
  union all select item_id, 1, 2, false, [ws[3]] from b where item_id % 3 = 2),
w as (select item_id, alt, part, neg, said[i + 1] as raw, i from (select *, unnest(range(len(said))) as i from parts)),
q as (select item_id, alt, part, neg, {_stem_sql('raw')} as word, i from w where raw not in ({_STOP})),
need as (select item_id, alt, part, neg, count(*) as n from q group by all),
wanted as (select item_id, alt, count(*) as n_parts from need where not neg group by all),
st as (select item_id, alt, part, doc_id, place - i as start from q join x using (word) group by all having count(distinct i) = any_value((select n from need where need.item_id = q.item_id and need.alt = q.alt and need.part = q.part))),
ok as (select st.item_id, st.alt, doc_id from st join need using (item_id, alt, part) join wanted using (item_id, alt) group by all having count(distinct part) filter (not neg) = any_value(n_parts) and not bool_or(neg)),
o as (select st.* from st join ok using (item_id, alt, doc_id)),
c as (select o.item_id, o.alt, o.doc_id, o.start as last, p.part, max(p.start) as latest from o join o p on o.item_id = p.item_id and o.alt = p.alt and o.doc_id = p.doc_id and p.start <= o.start group by all),
cov as (select item_id, alt, doc_id, last, min(latest) as first from c join wanted using (item_id, alt) group by item_id, alt, doc_id, last having count(*) = any_value(n_parts)),
short as (select item_id, alt, doc_id, first, min(last) as last from cov group by all),
s as (select item_id, alt, doc_id, round(sum(1.0::double / (last - first + 1)), 6) as score from short group by all),
h as (select item_id, doc_id, max(score) as score from s group by all)"""


@query(f"""{_INDEX} select item_id, doc_id, score, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from h) where place <= 10""")
def fts_phrases(spark, sf_dir):
    """The ten best documents of each benchmark item's query: a phrase and a word, a word without another or a phrase, a word or two others."""
    return search.page(_found(spark, sf_dir), "item_id", "doc_id", 10)


@query(f"""{_INDEX}, p as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from h) select item_id, doc_id, score, place - 10 as place from p where place between 11 and 20""")
def fts_next_page(spark, sf_dir):
    """The next ten, by what the first page ended with."""
    found = settle(_found(spark, sf_dir))  # read for the first page and for the next
    ended = settle(search.page(found, "item_id", "doc_id", 10).where("place = 10"))
    more = found.join(maybe_broadcast(ended.select("item_id"), search.ASKED), "item_id", "left_semi")
    return search.page(more, "item_id", "doc_id", 10, ended)


def _found(spark, sf_dir):
    # a text's own `or` is a word like others, so words are quoted
    word = lambda i: F.coalesce(F.get(F.regexp_extract_all("text", F.lit(r"(?i)[a-z0-9']+"), F.lit(0)), F.lit(i)), F.lit(""))
    k = F.col("item_id") % 3
    said = (
        F.when(k == 0, F.format_string('"%s %s" "%s"', word(0), word(1), word(4)))
        .when(k == 1, F.format_string('"%s" -"%s" or "%s, %s %s"', word(0), word(1), word(2), word(3), word(4)))
        .otherwise(F.format_string('"%s" OR "%s" "%s"', word(0), word(1), word(2)))
    )
    parts = search.asked(T(spark, sf_dir, "benchmark").select("item_id", said.alias("q")), "item_id", "q", STOP)
    docs = T(spark, sf_dir, "documents")
    index = search.positions(docs, "doc_id", "text", STOP, parts, max(8, math.ceil(docs.count() / TOGETHER)))
    return search.hits(search.matches(parts, index, "item_id", "doc_id"), "item_id", "doc_id").select("item_id", "doc_id", "score")


@query("""with d(bucket) as (values ('for'), ('against'), ('abstain'), ('other')), o as (select o_custkey % 50 as vote, case o_orderstatus when 'F' then 'for' when 'O' then 'against' else case when o_orderkey % 2 = 0 then 'abstain' else 'other' end end as bucket from orders),
c as (select vote, bucket, count(*) as n from o group by 1, 2), v as (select distinct vote from o)
select v.vote, d.bucket, coalesce(n, 0) as n from v cross join d left join c on c.vote = v.vote and c.bucket = d.bucket where n > 0 or d.bucket in ('for', 'against')""")
def vote_buckets(spark, sf_dir):
    """Records by bucket; for and against are always there."""
    o = T(spark, sf_dir, "orders")
    b = F.when(F.col("o_orderstatus") == "F", "for").when(F.col("o_orderstatus") == "O", "against").when(F.col("o_orderkey") % 2 == 0, "abstain").otherwise("other")
    counted = o.groupBy((F.col("o_custkey") % 50).alias("vote"), b.alias("bucket")).agg(F.count("*").alias("n"))
    base = o.select((F.col("o_custkey") % 50).alias("vote")).distinct().withColumn("bucket", F.explode(F.array(F.lit("for"), F.lit("against"))))
    return base.join(counted, ["vote", "bucket"], "full_outer").select("vote", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select conv_id, turn, role, len(regexp_extract_all(lower(text), 'tion'))::bigint as hits, sha256(regexp_replace(text, '(tion)', '[[[\\1]]]', 'gi')) as marked_sha256 from conversations where contains(lower(text), 'tion')""")
def transcript_search(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("tion")))
    marked = search.highlight(F.col("text"), F.lit("tion"))
    hits = F.size(F.filter(search.segments_of_snippet(marked), lambda s: s["hit"]))
    return c.select("conv_id", "turn", "role", hits.cast("long").alias("hits"), F.sha2(marked, 256).alias("marked_sha256"))


@query("""with s as (select conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as parts from conversations),
p as (select conv_id, turn, unnest(generate_series(1, len(parts))) as k, unnest(parts) as said from s),
w as (select *, sum(length(said)) over (partition by conv_id, turn order by k) as upto, sum(length(said)) over (partition by conv_id, turn) as total from p),
t as (select *, turn * 30 + 30.0 * (upto - length(said)) / total as begins, turn * 30 + 30.0 * upto / total as ends from w)
select conv_id, row_number() over (partition by conv_id order by turn, k) as entry, said, round(begins, 3) as begins, round(ends, 3) as ends from t""")
def srt_export(spark, sf_dir):
    """Caption entries: sentences of each turn, whose 30 seconds are shared out by length."""
    c = T(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")).alias("k", "said"))
    w = Window.partitionBy("conv_id", "turn").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    upto, total = F.sum(F.length("said")).over(w), F.sum(F.length("said")).over(Window.partitionBy("conv_id", "turn"))
    t = c.withColumn("upto", upto).withColumn("total", total)
    return t.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")).cast("long").alias("entry"),
        "said",
        F.round(F.col("turn") * 30 + F.lit(30.0) * (F.col("upto") - F.length("said")) / F.col("total"), 3).alias("begins"),
        F.round(F.col("turn") * 30 + F.lit(30.0) * F.col("upto") / F.col("total"), 3).alias("ends"),
    )


@query("""select conv_id, sha256(string_agg('**[' || printf('%02d:%02d:%02d', turn * 30 // 3600, turn * 30 // 60 % 60, turn * 30 % 60) || '] ' || role || ':** ' || trim(text), chr(10) || chr(10) order by turn)) as markdown_sha256, count(*) as n from conversations where trim(text) <> '' group by 1""")
def markdown_export(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").where(F.trim("text") != "")
    line = F.concat(F.lit("**["), X.hhmmss((F.col("turn") * 30).cast("double")), F.lit("] "), "role", F.lit(":** "), F.trim("text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"), F.count("*").alias("n"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n"), 256).alias("markdown_sha256"), "n")


@query(f"""with {TURNS} select meeting, strftime(meeting, '%b ') || day(meeting)::varchar || ', ' || year(meeting)::varchar as shown, sha256(string_agg('SPEAKER ' || meeting::varchar || ' 1 ' || printf('%d.%03d', floor((start_time) * 1000 + 0.5)::bigint // 1000, floor((start_time) * 1000 + 0.5)::bigint % 1000) || ' ' || printf('%d.%03d', floor((end_time - start_time) * 1000 + 0.5)::bigint // 1000, floor((end_time - start_time) * 1000 + 0.5)::bigint % 1000) || ' <NA> <NA> ' || label || ' <NA> <NA>', chr(10) order by start_time, segment_id)) as rttm_sha256 from turns group by meeting""")
def rttm_export(spark, sf_dir):
    t = V.turns(spark, sf_dir)
    g = t.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("start_time", "segment_id", rttm_line().alias("line")))).alias("ls"))
    return g.select("meeting", F.date_format("meeting", "MMM d, yyyy").alias("shown"), F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 256).alias("rttm_sha256"))


_N = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_EVENT = " or ".join(f"contains(n, '{re.sub('[^a-z]+', ' ', t)}')" for t in X.EVENT_TERMS)


@query(f"""with d as (select doc_id, n_chars, {_N} as n, source from documents), m as (select *, ' ' || n || ' ' like '% ' || regexp_extract(n, '^(\\S+ \\S+)', 1) || ' %' and contains(n, ' ') as named, ({_EVENT}) as event from d)
select doc_id, case when n_chars < 480 then 'short' when n_chars >= 1500 then 'long' else 'neutral' end as duration_signal, case when named and doc_id % 3 > 0 then 1 else 0 end::bigint as n_matched,
named and doc_id % 3 > 0 and (n_chars >= 480 or event) as passes, case when not (named and doc_id % 3 > 0) then 'no tracked candidate name' when n_chars < 480 and not event then 'short clip without event term' else 'name match' end as reason,
case when doc_id % 5 = 0 then false else (doc_id % 1300) > 630 end as stale from m""")
def prefilter(spark, sf_dir):
    """Found items by whole names, event terms, duration and age: the name is each text's first two words, for two texts of three."""
    d = T(spark, sf_dir, "documents").withColumn("today", F.to_date(F.lit("2026-01-01")))
    first = F.get(F.regexp_extract_all(X.fold(F.col("text")), F.lit(r"^(\S+ \S+)"), F.lit(1)), F.lit(0))
    names = F.array(F.lit("Cher"), F.when(F.col("doc_id") % 3 > 0, F.upper(first)).otherwise("Nobody Atall"))
    day = F.when(F.col("doc_id") % 5 == 0, "undated").otherwise(F.concat(F.date_sub("today", (F.col("doc_id") % 1300).cast("int")).cast("string"), F.lit("T10:00:00Z")))
    v = X.prefilter(F.col("source"), F.col("text"), F.col("n_chars"), names)
    return d.select("doc_id", v.alias("v"), X.is_stale(day, F.col("today")).alias("stale")).select(
        "doc_id", F.col("v.duration_signal"), F.size("v.matched").cast("long").alias("n_matched"), F.col("v.passes"), F.col("v.reason"), "stale"
    )


@query("""with d as (select o_custkey as race, max(cast(o_orderdate as date)) as swept, max(cast(o_orderdate as date)) + 5 + (o_custkey % 90)::integer as election from orders group by 1), t as (select max(swept) + 4 as today from d)
select race, case when election < today then false else today - swept >= case when election - today > 60 then 7 when election - today > 30 then 3 else 2 end end as due from d, t""")
def sweep_due(spark, sf_dir):
    d = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("race")).agg(F.max(F.to_date("o_orderdate")).alias("swept"))
    d = d.withColumn("election", F.date_add("swept", (5 + F.col("race") % 90).cast("int")))
    d = d.join(F.broadcast(d.agg(F.date_add(F.max("swept"), 4).alias("today"))), F.lit(True))  # one row
    left = F.datediff("election", "today")
    every = F.when(left > 60, 7).when(left > 30, 3).otherwise(2)
    return d.select("race", F.when(left < 0, False).otherwise(F.datediff("today", "swept") >= every).alias("due"))
