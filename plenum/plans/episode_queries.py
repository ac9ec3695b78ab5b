"""Episode pages, feeds, lists of parts and stages of work, written out from whole tables; each query with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions.graph import settle
from plenum.operators import episodes as E
from plenum.operators import stages as G
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.sources import episodes as S

QUERIES, ORACLES, query = registry()


@query(r"""with b as (select page_id, page_id // 10 as feed, page_id % 10 as place, page_id % 6 as kind, rtrim(regexp_replace(url, '[?#].*$', ''), '/') as base,
  case page_id % 6 when 4 then 'e' || (page_id % 10) when 5 then page_id::varchar else page_id || '-part-' || substr(md5(page_id::varchar), 1, 8) end as slug from pages),
e as (select *, case when kind = 0 then base || '/' || slug || '/' end as link, case kind when 1 then base || '/' || slug when 3 then 'other-' || page_id end as guid,
  case kind when 2 then 'https://cdn.example.net/a/' || slug || '.mp3' when 4 then 'https://cdn.example.net/a/' || slug || '.m4a' when 5 then 'https://cdn.example.net/' || slug || '.mp3' end as audio from b),
t as (select *, lower(concat_ws(' ', coalesce(audio, ''), coalesce(guid, ''), coalesce(link, ''))) as hay, regexp_replace(rtrim(coalesce(link, ''), '/'), '^https?://', '') as k1, regexp_replace(rtrim(coalesce(guid, ''), '/'), '^https?://', '') as k2 from e),
m as (select p.page_id, min(case when regexp_replace(p.base, '^https?://', '') || '/' || p.slug in (t.k1, t.k2) then t.place end) as l, min(case when p.kind <> 5 and contains(t.hay, p.slug) then t.place end) as s from b p join t using (feed) group by 1)
select m.page_id, case when l is not null then 'link' when s is not null then 'slug' end as tier, coalesce(l, s)::int as place, case when t.place is not null then 'Part ' || t.page_id end as title, t.audio as audio_url,
  case when t.place is not null then strftime(date '2024-01-01' + (t.page_id % 300)::int, '%Y-%m-%d') end as date
from m left join t on t.feed = m.page_id // 10 and t.place = coalesce(l, s)""")
def episode_matches(spark, sf_dir):
    """Pages against feeds of ten items each, which are written as XML and read back."""
    n = F.col("page_id")
    kind = n % 6
    slug = F.when(kind == 4, F.concat(F.lit("e"), (n % 10).cast("string"))).when(kind == 5, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("-part-"), F.substring(F.md5(n.cast("string")), 1, 8)))
    p = V.table(spark, sf_dir, "pages").select("page_id", F.floor(n / 10).alias("show"), kind.alias("kind"), F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")).alias("base"), slug.alias("slug"))
    pages = p.select("page_id", "show", F.concat("base", F.lit("/"), "slug", F.lit("?from=x")).alias("address"))
    element = lambda name, *x: F.concat(F.lit(f"<{name}>"), *x, F.lit(f"</{name}>"))
    sound = lambda *x: F.concat(F.lit('<enclosure url="https://cdn.example.net/'), *x, F.lit('" type="audio/mpeg" length="1"/>'))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "d MMM yyyy")
    item = F.concat(
        F.lit("<item><title>Part "), n.cast("string"), F.lit("</title>"),
        F.when(F.col("kind") == 0, element("link", "base", F.lit("/"), "slug", F.lit("/"))).otherwise(""),
        F.when(F.col("kind") == 1, element("guid", "base", F.lit("/"), "slug")).when(F.col("kind") == 3, element("guid", F.lit("other-"), n.cast("string"))).otherwise(""),
        F.when(F.col("kind") == 2, sound(F.lit("a/"), "slug", F.lit(".mp3"))).when(F.col("kind") == 4, sound(F.lit("a/"), "slug", F.lit(".m4a"))).when(F.col("kind") == 5, sound("slug", F.lit(".mp3"))).otherwise(""),
        element("pubDate", day, F.lit(" 08:00:00 +0000")), F.lit("</item>"),
    )
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), "")
    feeds = p.groupBy("show").agg(F.concat(F.lit("<rss><channel><title>Show</title>"), items, F.lit("</channel></rss>")).alias("xml"))
    entries = settle(S.podcast_entries(feeds))
    return E.match_entries(pages, entries).join(entries, ["show", "place"], "left").select("page_id", "tier", "place", "title", "audio_url", "date")


_PAGE = r"""p as (select page_id, html, case page_id % 5 when 0 then '{"@type":"NewsArticle","headline":"Council ' || page_id || '","datePublished":"2024-01-02T03:04"}'
  when 1 then '[{"@type":["Thing","NewsArticle"],"headline":"Debate ' || page_id || '","datePublished":"2024"},{"@type":"PodcastEpisode","name":"Hearing ' || page_id || '"}]'
  when 2 then '{not json' when 3 then '{"@type":"AudioObject","name":""}' else '{"@type":"Thing","name":"no"}' end as j from pages)"""


@query(rf"""with {_PAGE},
v as (select page_id, try_cast(j as json) as j from p), w as (select page_id, unnest(case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') else [j] end) as o from v where j is not null),
t as (select page_id, case json_type(o -> '$."@type"') when 'ARRAY' then (o ->> '$."@type"[*]') else [o ->> '$."@type"'] end as kinds, o ->> '$.name' as name, o ->> '$.headline' as headline, o ->> '$.datePublished' as d from w),
m as (select page_id, min(case when list_has_any(kinds, ['RadioEpisode', 'PodcastEpisode', 'AudioObject']) then nullif(name, '') end) as name, min(case when list_contains(kinds, 'NewsArticle') then headline end) as headline,
  min(case when list_contains(kinds, 'NewsArticle') and length(d) >= 10 then d[:10] end) as date from t group by 1),
a as (select page_id, list_filter(list_transform(string_split_regex(regexp_extract(replace(html, '&', '+'), '(?is)<article\b[^>]*>(.*?)(</article\b|$)', 1), '(?i)<p(\s[^>]*)?>')[2:],
  lambda x: trim(regexp_replace(regexp_replace(string_split_regex(x, '(?i)</p\b')[1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 20) as ps from p)
select page_id, date, coalesce(name, headline) as title, 'A & <b> é😀 ' || page_id as outlet, null::varchar as image, '' as description,
  'https://audio.example.org/' || case when page_id % 5 = 1 then 'x/the-hearing-web' else 'first' end || '.mp3' as audio, length(array_to_string(ps, '|')) as paragraph_chars, len(ps) as paragraphs
from p left join m using (page_id) join a using (page_id)""")
def page_metadata(spark, sf_dir):
    """Every page behind a head of linked data and a card; the paragraphs are those of its own article, references left as signs."""
    n = F.col("page_id")
    say = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    s = n.cast("string")
    data = (
        F.when(n % 5 == 0, say('{"@type":"NewsArticle","headline":"Council ', s, '","datePublished":"2024-01-02T03:04"}'))
        .when(n % 5 == 1, say('[{"@type":["Thing","NewsArticle"],"headline":"Debate ', s, '","datePublished":"2024"},{"@type":"PodcastEpisode","name":"Hearing ', s, '"}]'))
        .when(n % 5 == 2, "{not json")
        .when(n % 5 == 3, '{"@type":"AudioObject","name":""}')
        .otherwise('{"@type":"Thing","name":"no"}')
    )
    links = '<a href="https://other.example.org/hearing.mp3"></a><a href="https://audio.example.org/first.mp3?x=1"></a><a href="https://audio.example.org/x/the-hearing-web.mp3"></a>'
    head = say('<SCRIPT type="application/ld+json">', data, '</SCRIPT><meta name="x" property="og:site_name" content="A &amp; &lt;b&gt; &#233;&#x1F600; ', s, '"><meta property="og:description" content="">', links)
    pages = S.page_meta(V.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("own"), F.concat(head, F.col("html")).alias("html")))
    said = S.spoken_paragraphs(F.replace("own", F.lit("&"), F.lit("+")))
    paragraphs = F.when(said.isNull(), F.array().cast("array<string>")).otherwise(F.split(said, "\n\n"))
    return pages.select(
        "page_id", "meta.*", S.episode_audio(F.col("html"), F.col("meta.title"), "audio.example.org").alias("audio"), F.length(F.array_join(paragraphs, "|")).cast("long").alias("paragraph_chars"), F.size(paragraphs).cast("long").alias("paragraphs")
    )


@query("""select l_orderkey as list, (row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey % 2 = 0, case when l_linenumber % 3 > 0 then 'Part ' || l_partkey end) - 1)::int as place, 'G' || l_orderkey || '-' || l_linenumber as granule_id, 'SENATE' as granule_class,
  case when l_linenumber % 3 > 0 then 'Part ' || l_partkey else '' end as title from lineitem
qualify [null, 'SENATE', 'HOUSE', 'SENATE'][(l_orderkey + l_linenumber) % 4 + 1] = 'SENATE' or ((l_orderkey + l_linenumber) % 4 = 0 and l_suppkey % 2 = 0)""")
def record_lists(spark, sf_dir):
    """The Senate's parts of one JSON list an order, some with the older field only."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    part = F.struct(
        F.col("l_linenumber").alias("n"),
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("granuleId"),
        F.when(k.isin(1, 3), "SENATE").when(k == 2, "HOUSE").alias("granuleClass"),
        F.when(F.col("l_suppkey") % 2 == 0, "SENATE").otherwise("DIGEST").alias("docClass"),
        F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("title"),
    )
    lists = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("list")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(part)).alias("granules"))).alias("text"))
    return S.record_parts(lists, "Senate")


_LOG = "g as (select user_id as meeting, event_id as seq, ['done', 'done', 'progress', 'done', 'rewind', 'done', 'done', 'retag', 'done'][event_id % 9 + 1] as action, (event_id // 9) % 8 as value from events)"


@query(f"""with {_LOG},
a as (select *, case action when 'done' then value when 'rewind' then greatest(value, 2) - 1 when 'retag' then 3 end as stop from g),
m as (select meeting, coalesce(arg_max(stop, seq) filter (stop is not null), 0)::int as completed, max(seq) filter (action = 'rewind' and stop < 3) as reset from a group by 1),
f as (select meeting, unnest([2, 3, 4, 5, 7]) as stage from m),
d as (select f.meeting, f.stage, max(seq) filter (action = 'done' and value = f.stage) as made, max(seq) filter ((action = 'rewind' and stop < f.stage) or (action = 'retag' and f.stage = 4)) as gone from f join a using (meeting) group by all),
l as (select meeting, list(['', 'diarized', 'transcribed', 'identified', 'summarized', '', 'exported'][stage] order by stage) filter (made is not null and (gone is null or made > gone)) as live from d group by 1),
p as (select meeting, arg_max(value, seq)::int as n from a left join m using (meeting) where action = 'progress' and (reset is null or seq > reset) group by 1)
select meeting, completed, coalesce(n, 0)::int as progress, coalesce(array_to_string(live, ','), '') as live,
  array_to_string(['ingested', 'diarized', 'transcribed', 'identified', 'summarized', 'enrolled', 'exported'][completed + 1:], ',') as open
from m left join l using (meeting) left join p using (meeting)""")
def stage_states(spark, sf_dir):
    n = F.col("event_id")
    action = F.get(F.array(*[F.lit(x) for x in ("done", "done", "progress", "done", "rewind", "done", "done", "retag", "done")]), (n % 9).cast("int"))
    log = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting"), n.alias("seq"), action.alias("action"), (F.floor(n / 9) % 8).cast("int").alias("value"))
    return G.stage_states(log).withColumns({"live": F.array_join("live", ","), "open": F.array_join("open", ",")})


@query("""select c_custkey as meeting, m as marker, case when coalesce(m, '') = '' then 'wait' when m is distinct from k then 'run' when o is null then 'heal' else 'skip' end as action
from (select c_custkey, ['v1', 'v2', '', null][c_custkey % 4 + 1] as m, case when c_custkey % 3 > 0 then 'v1' end as k from customer) left join (select distinct o_custkey as o from orders where o_totalprice > 300000) on o = c_custkey""")
def poll_plan(spark, sf_dir):
    k = F.col("c_custkey")
    c = V.table(spark, sf_dir, "customer").select(k.alias("meeting"), F.get(F.array(*[F.lit(x).cast("string") for x in ("v1", "v2", "", None)]), (k % 4).cast("int")).alias("marker"))
    state = c.where("meeting % 3 > 0").select("meeting", F.lit("v1").alias("marker"))
    facts = V.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("meeting"))
    return G.poll_plan(c, state, facts, "meeting")
