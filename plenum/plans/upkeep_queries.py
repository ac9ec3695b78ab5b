"""Checks before publishing, links, profile upkeep and words at turn borders; each with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import checks as C
from plenum.operators import upkeep as U
from plenum.operators import words as W
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.plans.views import SECTIONS, SPEAKERS, TURNS, VECTORS

QUERIES, ORACLES, query = registry()
T = V.table
_TRUSTED = "('human_review', 'human_confirmed', 'voice_profile', 'voice_profile (far)', 'roll_call', 'chair_recognition')"


def _case(at, *values):
    """The value at a number from 0, null beyond."""
    return F.get(F.array(*[v if not isinstance(v, str) and v is not None else F.lit(v).cast("string") for v in values]), at)


def _str(x):
    return F.col(x).cast("string")


@query("""with c as (select c_custkey, c_custkey % 8 as k, c_custkey::varchar as s from customer)
select c_custkey, [ 'youtube', 'file', 'audio', 'hls', null, null, 'youtube', null ][k + 1] as kind,
['vid-' || s, 'https://x.org/a/' || s || '.MP4?x=1', 'http://x.org/' || s || '.mp3#t', 'https://x.org/' || s || '.m3u8', null, null, 'w' || s, null][k + 1] as url from c""")
def playback_kinds(spark, sf_dir):
    s = _str("c_custkey")
    url = _case(
        F.col("c_custkey").cast("int") % 8, F.concat(F.lit("https://youtu.be/vid-"), s), F.concat(F.lit(" https://x.org/a/"), s, F.lit(".MP4?x=1")), F.concat(F.lit("http://x.org/"), s, F.lit(".mp3#t")),
        F.concat(F.lit("https://x.org/"), s, F.lit(".m3u8 ")), F.concat(F.lit("ftp://x.org/"), s, F.lit(".mp4")), "https://x.org/page", F.concat(F.lit("https://www.youtube.com/watch?a=b&v=w"), s),
    )
    return T(spark, sf_dir, "customer").select("c_custkey", C.playback(url).alias("p")).select("c_custkey", "p.kind", "p.url")


@query("""with p as (select p_partkey, case when p_partkey % 10 = 0 then 'May 2' else '2023-' || (p_partkey % 14)::varchar || '-' || (p_partkey % 33)::varchar end as s from part)
select p_partkey, strftime(try_strptime(s, '%Y-%m-%d'), '%Y-%m-%d') as day from p""")
def iso_dates(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.when(k % 10 == 0, "May 2").otherwise(F.concat(F.lit(" 2023-"), (k % 14).cast("string"), F.lit("-"), (k % 33).cast("string")))
    return T(spark, sf_dir, "part").select("p_partkey", C.iso_date(said).alias("day"))


@query("""with c as (select c_custkey, c_custkey % 5 as s, [['public_comment', 'staff'], ['official', 'staff'], ['candidate', 'moderator'], ['candidate', 'moderator'], ['candidate', 'moderator'], ['public_comment', 'staff']][c_custkey % 6 + 1] as r, lower(c_mktsegment) as m from customer)
select c_custkey, case s when 1 then r[2] when 3 then m || '_lead' else r[1] end as role from c""")
def local_roles(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    said = _case(k % 5, "", " 2 ", "9", F.concat(F.lit("-"), F.col("c_mktsegment"), F.lit(" -- Lead!")))
    return T(spark, sf_dir, "customer").select("c_custkey", C.local_role(said, _case(k % 6, "council", "press_conference", "podcast", "unheard of", None, "floor")).alias("role"))


@query("""select o_orderkey, case o_orderkey % 7 when 0 then 'unknown kind' when 1 then 'chamber is no id' when 2 then 'race is no id' when 3 then 'chamber and race' end as fault from orders""")
def entity_faults(spark, sf_dir):
    k = F.col("o_orderkey").cast("int") % 7
    uid = F.concat(F.substring(F.md5(_str("o_orderkey")), 1, 8), F.lit("-"), F.substring(F.md5(_str("o_orderkey")), 9, 24))
    kind = _case(k, "party", "council", "debate", "forum", "podcast", " council ", "other")
    chamber, race = _case(k, uid, "12-34", None, uid, uid, uid, None), _case(k, uid, None, "zz", uid, uid, None, uid)
    return T(spark, sf_dir, "orders").select("o_orderkey", C.entities_fault(kind, chamber, race).alias("fault"))


@query("""select l_orderkey, l_linenumber, l_partkey, case l_partkey % 5 when 0 then l_returnflag = 'A' when 1 then l_returnflag = 'N' when 2 then l_returnflag in ('A', 'R') else false end as ok from lineitem""")
def outcome_evidence(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "R", "failed").otherwise("continued")
    text = _case(F.col("l_partkey").cast("int") % 5, "The motion CARRIES.", "It was tabled, then", "by a vote of Seven to two", "Now Ordinance 2026-15")
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.outcome_said(outcome, text).alias("ok"))


@query("""with p as (select p_partkey, lower(p_name || ' ' || p_type || ' Section') as title, lower(case when p_partkey % 3 = 0 then p_type else 'part' end || ' of ' || p_name) as text from part)
select p_partkey, len(list_filter(list_distinct(regexp_extract_all(title, '[a-z]{6,}')), lambda x: contains(text, x))) >= 2 as ok from p""")
def title_evidence(spark, sf_dir):
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("Section"))
    text = F.concat_ws(" of ", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("PART"), "p_name")
    return T(spark, sf_dir, "part").select("p_partkey", C.title_said(title, text).alias("ok"))


@query("select o_orderkey, o_orderkey % 6 in (1, 3, 5) as ok from orders")
def reference_evidence(spark, sf_dir):
    n = F.concat(F.lit("2026-"), _str("o_orderkey"))
    k = F.col("o_orderkey").cast("int") % 6
    ref = F.concat(_case(k, "Ordinance ", "Ordinance ", "Ordinance ", "Appropriation Ordinance ", "Resolution ", "Resolution "), n)
    text = F.concat(_case(k, "on appropriation - ordinance ", "On ORDINANCE – ", "the ordinance", "Appropriation  ordinance-", "ordinance ", "appropriation resolution "), n, F.lit(", read twice"))
    return T(spark, sf_dir, "orders").select("o_orderkey", C.reference_said(ref, text).alias("ok"))


@query("""with c as (select c_custkey, c_custkey % 6 as k from customer) select c_custkey, k in (0, 3) as stale from c""")
def inconsistent_links(spark, sf_dir):
    k = F.col("c_custkey").cast("int") % 6
    name = _case(k, "Councilmember Ann Lee", "Ann Lee", "The Mayor", "J. Roe", "H Roe")
    slug = _case(k, "bo-tran", "lee-a", "ann-lee", "j-poe", "roe-h", "ann")
    return T(spark, sf_dir, "customer").select("c_custkey", C.inconsistent_link(name, slug).alias("stale"))


@query(f"""with {VECTORS}, s as (select a.vec_id, list_cosine_similarity(a.vector, b.vector) - list_cosine_similarity(a.vector, c.vector) as lead
from vectors a left join vectors b on b.vec_id = a.vec_id + 1 left join vectors c on c.vec_id = a.vec_id + 2)
select vec_id, case when lead is null then 'unembeddable' when lead > 0.1 then 'dominant' when lead < -0.1 then 'interrupter' else 'ambiguous' end as voice from s""")
def wedged_voices(spark, sf_dir):
    v = V.vectors(spark, sf_dir).select("vec_id", "vector")
    near = lambda k, name: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("vector").alias(name))
    return v.join(near(1, "u"), "vec_id", "left").join(near(2, "w"), "vec_id", "left").select("vec_id", C.whose_voice(F.col("vector"), F.col("u"), F.col("w")).alias("voice"))


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'live' when o_orderkey % 3 = 0 then 'ready' when o_orderkey % 7 >= 4 then 'needs-review' else 'processing' end as status from orders""")
def library_status(spark, sf_dir):
    k = F.col("o_orderkey")
    live = F.when(k % 2 == 0, F.col("o_orderstatus") == "P").otherwise(F.nullif(F.col("o_orderstatus") == "P", F.lit(False)))
    return T(spark, sf_dir, "orders").select("o_orderkey", C.library_status(live, F.when(k % 3 == 0, "pass").when(k % 3 == 1, "hold"), k % 7).alias("status"))


def _hits(spark, sf_dir):
    k = F.col("c_custkey")
    g = F.floor(k / 3).cast("string")
    full = F.when(k % 7 == 0, F.concat(F.lit("Annie Q"), g)).otherwise(F.concat(F.lit("q"), g, F.lit(" Lee  ANN")))
    return T(spark, sf_dir, "customer").where((k % 2 == 0) | (F.floor(k / 3) % 4 == 0)).select(
        F.concat(F.lit("Ann Q"), g).alias("query"), F.concat(F.lit("p-"), k.cast("string")).alias("person"), F.when(k % 5 > 0, F.concat(F.lit("s-"), k.cast("string"))).alias("slug"), full.alias("full_name")
    )


_HITS = """hits as (select 'Ann Q' || (c_custkey // 3)::varchar as query, 'p-' || c_custkey::varchar as person, case when c_custkey % 5 > 0 then 's-' || c_custkey::varchar end as slug,
  case when c_custkey % 7 = 0 then 'Annie Q' || (c_custkey // 3)::varchar else 'q' || (c_custkey // 3)::varchar || ' Lee  ANN' end as full_name, c_custkey % 7 > 0 as strong
  from customer where c_custkey % 2 = 0 or c_custkey // 3 % 4 = 0)"""


@query(f"""with {_HITS}, a as (select distinct 'Ann Q' || (c_custkey // 3)::varchar as query, case when c_custkey // 3 % 5 = 0 then 'p-' || (c_custkey // 3 * 3 + 1)::varchar end as known from customer),
n as (select query, min(person) as person, min(slug) as slug, min(full_name) as full_name from hits group by 1 having count(*) = 1 and bool_and(strong))
select a.query, coalesce(known, n.person) as person, case when known is null then n.slug else h.slug end as slug, case when known is not null then coalesce(h.full_name, a.query) else n.full_name end as full_name,
case when known is null and n.person is null then 'review' else 'link' end as action from a left join n on n.query = a.query left join hits h on h.query = a.query and h.person = known""")
def link_targets(spark, sf_dir):
    g = F.floor(F.col("c_custkey") / 3)
    asked = T(spark, sf_dir, "customer").select(F.concat(F.lit("Ann Q"), g.cast("string")).alias("query"), F.when(g % 5 == 0, F.concat(F.lit("p-"), (g * 3 + 1).cast("string"))).alias("known")).distinct()
    return U.confident_targets(asked, _hits(spark, sf_dir))


@query(f"""with {_HITS}, n as (select query, min(person) as person, min(slug) as slug from hits group by 1 having count(*) = 1 and bool_and(strong))
select o_orderkey as meeting, o_orderpriority as label, n.query as name, n.person, n.slug, 'auto_linked' as id_method from orders join n on n.query = 'Ann Q' || (o_custkey // 3)::varchar
where o_orderkey % 4 > 0 and o_orderkey % 5 > 0 and o_orderstatus <> 'P'""")
def auto_links(spark, sf_dir):
    k = F.col("o_orderkey")
    speakers = T(spark, sf_dir, "orders").select(
        k.alias("meeting"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("Ann Q"), F.floor(F.col("o_custkey") / 3).cast("string")).alias("name"),
        F.when(k % 4 == 0, "p").alias("person"), F.when(k % 5 == 0, "l").alias("local"), F.when(F.col("o_orderstatus") == "P", "unidentified").alias("status"),
    )
    return U.auto_link(speakers, _hits(spark, sf_dir))


@query(f"""with {TURNS}, {SPEAKERS}, s as (select *, substr(label, 2, 2)::int as x from speakers where name is not null)
select meeting, label, name, 'p-' || label as person, 'slug' as slug from s where x % 3 > 0 and not (x % 2 = 0 and day(meeting) % 2 = 0)""")
def relinked(spark, sf_dir):
    x = F.substring("label", 2, 2).cast("int")
    person = F.concat(F.lit("p-"), "label")
    s = V.speakers(spark, sf_dir).where("name is not null")
    decisions = s.where(x % 3 > 0).select(F.concat(F.lit(" "), F.lower("name"), F.lit(" ")).alias("name"), person.alias("person"), F.lit("slug").alias("slug")).distinct()
    now = s.select("meeting", "label", "name", F.when(x % 2 == 0, person).alias("person"), F.when(F.day("meeting") % 2 == 0, "slug").alias("slug"))
    return U.relink(now, decisions)


@query("""with p as (select label as k, 'v' || lpad(label::varchar, 3, '0') as profile, 'Voice ' || label::varchar as display_name, case when label % 3 = 1 then 's-' || label::varchar end as slug, list(distinct (vec_id % 20)::varchar) as meetings, count(*) as segments from embeddings group by label),
r as (select case k % 4 when 1 then 'v' || lpad((k - 1)::varchar, 3, '0') when 2 then 'new' || (k // 8)::varchar else profile end as key, case when k % 4 = 2 then 'New' else display_name end as display_name, slug, meetings, segments, (k % 4 in (1, 2))::int as moved, profile from p),
m as (select key, unnest(meetings) as m from r)
select key as profile, arg_min(display_name, (moved, profile)) as display_name, arg_min(slug, (moved, profile)) filter (slug is not null) as slug, sum(segments)::bigint as segments,
(select array_to_string(list_sort(list(distinct m.m)), ',') from m where m.key = r.key) as meetings from r group by key""")
def profile_folds(spark, sf_dir):
    k = F.col("label")
    id_ = lambda x: F.concat(F.lit("v"), F.lpad(x.cast("string"), 3, "0"))
    e = T(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_set((F.col("vec_id") % 20).cast("string")).alias("meetings"), F.count("*").alias("segments"))
    profiles = e.select(id_(k).alias("profile"), F.concat(F.lit("Voice "), k.cast("string")).alias("display_name"), F.when(k % 3 == 1, F.concat(F.lit("s-"), k.cast("string"))).alias("slug"), "meetings", "segments")
    new = F.concat(F.lit("new"), F.floor(k / 8).cast("string"))
    moves = e.where(k % 4 != 3).select(id_(k).alias("source"), F.when(k % 4 == 1, id_(k - 1)).when(k % 4 == 2, new).otherwise(id_(k)).alias("target"), F.when(k % 4 == 2, "New").alias("display_name"))
    return U.fold_profiles(profiles, moves).withColumn("meetings", F.array_join("meetings", ","))


@query(f"""with {TURNS}, {SECTIONS}, s as (select meeting, section_id, section_id as first, case when section_id % 11 > 0 then section_id + section_id % 3 - 1 end as last from sections)
select s.meeting, section_id, first, last, case when last is null then 'missing' when t.segment_id is null then 'stale' when last < first then 'inverted' end as fault
from s left join turns t on t.meeting = s.meeting and t.segment_id = s.last""")
def section_faults(spark, sf_dir):
    k = F.col("section_id")
    s = V.sections(spark, sf_dir).select("meeting", "section_id", k.alias("first"), F.when(k % 11 > 0, k + k % 3 - 1).alias("last"))
    return U.section_faults(s, V.turns(spark, sf_dir))


def _claims(spark, sf_dir):
    x = F.substring("label", 2, 2).cast("int")
    s = V.speakers(spark, sf_dir)
    auto = s.select("meeting", "label", "name", F.when(x % 2 == 0, F.concat(F.lit("s-"), "label")).alias("slug"), "id_method", F.lit(None).cast("string").alias("status"))
    name = F.when(x % 5 > 0, F.concat(F.lit("Dr. N"), "label")).otherwise("Zed")
    slug = F.when(x % 3 == 0, F.when(x % 4 == 0, F.concat(F.lit("s-"), "label")).otherwise("else"))
    status = F.when(x == 9, "non_speaker").when(x % 7 == 0, "unidentified")
    truth = s.select("meeting", "label", name.alias("name"), slug.alias("slug"), F.lit("human_review").alias("id_method"), status.alias("status"))
    return U.claims(V.turns(spark, sf_dir), auto, truth)


_CLAIMS = f"""c as (select s.meeting, seconds, name is not null and id_method in {_TRUSTED} as trusted,
    name is not null and (id_method in {_TRUSTED} or id_method = 'voice_profile (returning_2)') and x % 7 > 0 as claimed, case when x % 6 = 0 then x % 4 = 0 else x % 5 > 0 end as fits
    from (select meeting, label, sum(greatest(0, end_time - start_time)) as seconds from turns group by all) s join (select *, substr(label, 2, 2)::int as x from speakers) p on p.meeting = s.meeting and p.label = s.label where x <> 9),
  sums as (select meeting, coalesce(sum(seconds) filter (claimed), 0) as claimed, coalesce(sum(seconds) filter (claimed and fits), 0) as correct, coalesce(sum(seconds) filter (trusted), 0) as trusted, sum(seconds) as seconds from c group by 1),
  claims as (select meeting, round(claimed, 1) as claimed_seconds, round(correct, 1) as correct_seconds, case when claimed > 0 then round(correct / claimed, 4) else 1 end as precision, case when seconds > 0 then round(trusted / seconds, 4) else 0 end as coverage from sums)"""


@query(f"with {TURNS}, {SPEAKERS}, {_CLAIMS} select * from claims")
def claimed_precision(spark, sf_dir):
    return _claims(spark, sf_dir)


@query(f"""with {TURNS}, {SPEAKERS}, {_CLAIMS} select ['council', 'debate', 'community_meeting', 'unheard of'][day(meeting) % 4 + 1] as event_kind, count(*) as n_meetings,
min(coverage) as least_coverage, round(avg(precision), 4) as mean_precision, min(precision) as least_precision from claims group by 1""")
def precision_by_kind(spark, sf_dir):
    c = _claims(spark, sf_dir).join(V.kinds(spark, sf_dir), "meeting")
    return c.groupBy("event_kind").agg(
        F.count("*").alias("n_meetings"), F.min("coverage").alias("least_coverage"), F.round(F.avg("precision"), 4).alias("mean_precision"), F.min("precision").alias("least_precision")
    )


@query(f"""with {TURNS}, {SPEAKERS}, t as (select *, id_method <> 'view' as spoken from turns),
n as (select meeting, label, segment_id, end_time - start_time as seconds, spoken, count(*) filter (spoken) over (partition by meeting, label order by start_time, segment_id rows unbounded preceding) as nth, count(*) filter (spoken) over (partition by meeting, label) as of from t),
a as (select meeting, label, count(*) as n_segments, round(sum(seconds), 3) as seconds, min(segment_id) filter (spoken and nth = greatest(0, of // 3 - 1) + 1) as sample from n group by all)
select s.meeting, s.label, name, (60 + day(s.meeting) * 7 % 40) / 100 as confidence, case when 60 + day(s.meeting) * 7 % 40 >= 85 then 'enroll' else 'ask' end as action, n_segments, seconds, sample
from speakers s join a on a.meeting = s.meeting and a.label = s.label where name is not null and status is null and day(s.meeting) * 7 % 40 >= 10 and substr(s.label, 2, 2)::int % 4 > 0""")
def enrolment(spark, sf_dir):
    s = V.speakers(spark, sf_dir)
    confident = s.withColumn("confidence", (F.lit(60) + F.day("meeting") * 7 % 40) / 100)
    turns = V.turns(spark, sf_dir).withColumn("text", F.when(F.col("id_method") != "view", "Thank you."))
    got = U.enrolment(confident, s.where(F.substring("label", 2, 2).cast("int") % 4 > 0), turns)
    return got.withColumn("seconds", F.round("seconds", 3))


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 2 = 0 then 3600.0 else 0.0 end + l_quantity * 60 + l_linenumber as sec, 'Part ' || l_partkey::varchar as title from lineitem where l_partkey % 3 > 0),
c as (select l_orderkey, row_number() over w - 1 as position, sec::double as start_time, (lead(sec) over w)::double as end_time, title, count(*) over (partition by l_orderkey) as n from l window w as (partition by l_orderkey order by l_linenumber, l_partkey, sec))
select * exclude n from c where n >= 2""")
def description_chapters(spark, sf_dir):
    k = F.col("l_partkey")
    stamp = F.concat(F.when(k % 2 == 0, "  1:").otherwise(""), F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.lpad(_str("l_linenumber"), 2, "0"))
    line = F.when(k % 3 == 0, F.concat(F.lit("at "), stamp)).otherwise(F.concat(stamp, F.lit("  Part "), k.cast("string"), F.lit(" ")))
    at = F.col("l_quantity") + F.when(k % 2 == 0, 60).otherwise(0)
    texts = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", at.alias("at"), line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return U.description_chapters(texts, "l_orderkey", "text")


@query(None)
def snapped_words(spark, sf_dir):
    """Words of conversations, with signs of a change of speakers by hash; order and moves within a conversation make it no SQL."""
    c = T(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("turn_id"), (F.col("turn") * 10000.0).alias("start_time"))
    each = c.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("turn_id"), F.posexplode(F.split("text", r"\s+")).alias("i", "said"))
    begin = F.col("turn_id") * 10000.0 + F.col("i")
    words = each.select(
        "meeting", "turn_id", (F.col("turn_id") * 1000000 + F.col("i")).alias("word_id"), F.when(F.pmod(F.xxhash64("meeting", "turn_id", "i"), F.lit(6)) == 0, W.MARKER).otherwise(F.col("said")).alias("word"),
        begin.alias("word_start"), (begin + 0.5).alias("word_end"),
    )
    return W.snap(words, turns)


@query(f"""with {TURNS} select meeting, segment_id, start_time + case when day(meeting) % 2 = 0 then 0 else 90.5 end as start_time, end_time + case when day(meeting) % 2 = 0 then 0 else 90.5 end as end_time from turns""")
def shifted_times(spark, sf_dir):
    offset = F.when(F.day("meeting") % 2 == 1, 90.5)
    return U.shift_times(V.turns(spark, sf_dir), ["start_time", "end_time"], offset).select("meeting", "segment_id", "start_time", "end_time")


@query("select o_custkey as race, o_orderkey as candidate from orders where o_orderstatus is null or o_orderstatus not in ('P', 'F')")
def race_roster(spark, sf_dir):
    """Candidates of each race but those that withdrew or were removed; an unknown status is an active one."""
    o = T(spark, sf_dir, "orders").where(~F.coalesce("o_orderstatus", F.lit("active")).isin("P", "F"))
    return o.select(F.col("o_custkey").alias("race"), F.col("o_orderkey").alias("candidate"))


@query("select l_orderkey as body, min(l_suppkey) as chamber from lineitem group by 1 having count(distinct l_suppkey) = 1")
def sole_chamber(spark, sf_dir):
    """The chamber of each body that has just one."""
    one = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("body")).agg(F.min("l_suppkey").alias("chamber"), F.max("l_suppkey").alias("__most"))
    return one.where("chamber = __most").drop("__most")


@query("select distinct o_custkey as race from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def races_of_people(spark, sf_dir):
    people = T(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T(spark, sf_dir, "orders").join(people, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("race")).distinct()


@query(f"with {TURNS} select meeting, label, arg_min(segment_id, (start_time, segment_id)) as segment_id from turns where id_method = 'purchase' group by all")
def first_reviewed(spark, sf_dir):
    """The first reviewed segment of each label, which names it."""
    t = V.turns(spark, sf_dir).where("id_method = 'purchase'")
    return t.groupBy("meeting", "label").agg(F.min_by("segment_id", F.struct("start_time", "segment_id")).alias("segment_id"))
