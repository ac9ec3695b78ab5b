"""Queries on the quality gate, voices, names and votes; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions.graph import components
from plenum.functions.vectors import cosine, rounded
from plenum.operators import gate
from plenum.operators import identity as D
from plenum.operators.similar import correct_names, similar_names
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.plans.views import SPEAKERS, TURNS, VECTORS

QUERIES, ORACLES, query = registry()

_TIER = """case when coalesce(name, '') = '' then 'unknown' when id_method in ('human_review', 'human_confirmed', 'roll_call', 'self_identification', 'chair_recognition') then 'trusted'
when id_method like 'voice_profile%returning\\_%' escape '\\' then 'probable' when id_method like 'voice_profile%' then 'trusted' when id_method in ('llm', 'name_addressing', 'title_context') then 'unverified' else 'unknown' end"""
_LABELS = f"""with {TURNS}, {SPEAKERS}, b as (select meeting, label, {_TIER} as tier, status, seconds
  from (select meeting, label, sum(greatest(0.0, end_time - start_time)) as seconds from turns group by all) join speakers using (meeting, label))"""


@query(f"{_LABELS} select meeting, label, tier, round(seconds, 3) as seconds from b")
def gate_tier_seconds(spark, sf_dir):
    return gate.seconds_by_label(V.turns(spark, sf_dir), V.speakers(spark, sf_dir)).select("meeting", "label", "tier", F.round("seconds", 3).alias("seconds"))


@query(f"""{_LABELS}, q as (select *, status is distinct from 'non_speaker' as speaks from b),
e as (select *, case when bool_or(speaks and seconds >= 60) over (partition by meeting) then speaks and seconds >= 60 else speaks end as eligible from q),
s as (select meeting, sum(seconds) as speech, count(*) filter (eligible) as n_eligible, coalesce(sum(seconds) filter (eligible), 0) as base, {", ".join(f"coalesce(sum(seconds) filter (eligible and tier = '{t}'), 0) as {t}" for t in gate.TIERS)} from e group by meeting),
c as (select *, case when base > 0 then (trusted + 0.5 * probable) / base else 0 end as eff, case day(meeting) % 4 when 1 then 0.95 when 2 then 0.70 else 0.90 end as high, case day(meeting) % 4 when 1 then 0.60 when 2 then 0.40 else 0.50 end as low from s)
select meeting, n_eligible, round(speech, 3) as speech, {", ".join(f"round(case when base > 0 then {t} / base else 0 end, 4) as {t}_coverage" for t in gate.TIERS)}, round(eff, 4) as effective_coverage,
  case when speech <= 0 then 'failed' when eff >= high then 'pass' when eff >= low then 'review' else 'failed' end as verdict from c""")
def gate_verdict(spark, sf_dir):
    return gate.evaluate(V.turns(spark, sf_dir), V.speakers(spark, sf_dir), V.kinds(spark, sf_dir))


_CENTROIDS = """cen as (
  select profile, list(m order by i) as centroid from (select profile, i, avg(vector[i]) as m from (select profile, vector, unnest(range(1, 65)) as i from vectors) group by profile, i) group by profile)"""


@query(f"with {VECTORS}, {_CENTROIDS} select profile, list_transform(centroid, lambda x: round(x, 5)) as centroid from cen")
def centroids(spark, sf_dir):
    return D.centroids(V.vectors(spark, sf_dir), ["profile"]).select("profile", F.transform("centroid", lambda x: rounded(x, 5)).alias("centroid"))


@query(f"""with {VECTORS}, s as (select profile, i, sum(vector[i]) as s, count(*) as n from (select profile, vector, unnest(range(1, 65)) as i from vectors) group by profile, i),
m as (select profile, meeting, i, sum(vector[i]) as s, count(*) as n from (select profile, meeting, vector, unnest(range(1, 65)) as i from vectors) group by profile, meeting, i)
select m.profile, m.meeting, list(round((s.s - m.s) / (s.n - m.n), 5) order by m.i) as centroid from m join s on m.profile = s.profile and m.i = s.i where s.n > m.n group by m.profile, m.meeting""")
def centroids_leave_one_out(spark, sf_dir):
    """Each profile's mean vector without one meeting's part: sums of all less the sums of that meeting."""
    each = V.vectors(spark, sf_dir).select("profile", "meeting", F.posexplode("vector").alias("i", "x"))
    part = each.groupBy("profile", "meeting", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = part.groupBy("profile", "i").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    left = part.join(whole, ["profile", "i"]).where("all_n > n").withColumn("m", (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")))
    ordered = F.array_sort(F.collect_list(F.struct("i", rounded(F.col("m"), 5).alias("m"))))
    return left.groupBy("profile", "meeting").agg(F.transform(ordered, lambda x: x["m"]).alias("centroid"))


@query(f"""with {VECTORS}, w as (select profile, i, sum(vector[i] * (vec_id % 7 - 1)) / sum(vec_id % 7 - 1) as m from (select *, unnest(range(1, len(vector) + 1)) as i from vectors where vec_id % 7 - 1 > 0) group by profile, i)
select profile, i as place, round(m, 5) as value from w""")
def weighted_centroid_merge(spark, sf_dir):
    """Every place of each profile's weighted mean."""
    v = V.vectors(spark, sf_dir).withColumn("weight", (F.col("vec_id") % 7 - 1).cast("double"))
    c = D.centroids(v, ["profile"], weight="weight")
    return c.select("profile", F.posexplode("centroid").alias("i", "m")).select("profile", (F.col("i") + 1).cast("long").alias("place"), rounded(F.col("m"), 5).alias("value"))


_MATCH = f"""with {VECTORS}, {_CENTROIDS}, sim as (select v.vec_id, c.profile, list_cosine_similarity(v.vector, c.centroid) as similarity from vectors v, cen c where v.vec_id % 20 = 0)"""


def _similarities(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    asked = v.where("vec_id % 20 = 0").select("vec_id", "vector")
    return D.similar(asked, D.centroids(v, ["profile"]), "vec_id", "profile", "vector", "centroid")


@query(_MATCH + """, r as (select *, row_number() over (partition by vec_id order by similarity desc, profile) as n from sim where similarity > 0)
select vec_id, profile, round(similarity, 4) as similarity, similarity >= case when profile % 3 = 0 then 0.78 else 0.85 end as matched from r where n = 1""")
def voice_best_match(spark, sf_dir):
    threshold = F.when(F.col("profile") % 3 == 0, 0.78).otherwise(0.85)
    return D.best_match(_similarities(spark, sf_dir), "vec_id", "profile", threshold).withColumn("similarity", F.round("similarity", 4))


@query(_MATCH + """ select vec_id, string_agg(profile::varchar, ',' order by similarity desc, profile) as profiles, count(*) as n from sim where similarity >= 0.2 group by vec_id""")
def voice_soft_match(spark, sf_dir):
    s = _similarities(spark, sf_dir).where("similarity >= 0.2")
    return s.groupBy("vec_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "profile"))), lambda x: x["profile"].cast("string")), ",").alias("profiles"),
        F.count("*").alias("n"),
    )


@query(f"with {VECTORS}, {_CENTROIDS} select a.profile as a, b.profile as b, round(list_cosine_similarity(a.centroid, b.centroid), 4) as similarity from cen a, cen b where a.profile < b.profile")
def pairwise_cosine(spark, sf_dir):
    """Profiles of one store pair off; a store holds a body's people, so the pairs are few."""
    c = D.centroids(V.vectors(spark, sf_dir), ["profile"])
    left, right = c.select(F.col("profile").alias("a"), F.col("centroid").alias("u")), c.select(F.col("profile").alias("b"), F.col("centroid").alias("v"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("u"), F.col("v")), 4).alias("similarity"))


@query(f"""with recursive {VECTORS}, n as (select vec_id, vec_id // 25 as meeting, vector from vectors),
e as (select a.vec_id as x, b.vec_id as y from n a join n b on a.meeting = b.meeting and a.vec_id <> b.vec_id where list_cosine_similarity(a.vector, b.vector) >= 0.35),
r(node, seen) as (select vec_id, vec_id from n union select r.node, e.y from r join e on r.seen = e.x)
select node, min(seen) as component from r group by node""")
def speaker_components(spark, sf_dir):
    """Voices of a meeting (25 vectors) that are alike, directly or through others."""
    n = V.vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 25).alias("m"), "vector")
    other = n.select(F.col("vec_id").alias("other"), "m", F.col("vector").alias("w"))
    e = n.join(other, "m").where("vec_id < other").where(cosine(F.col("vector"), F.col("w")) >= 0.35)
    return components(n, e, "vec_id", "vec_id", "other")


_MAPPINGS = f"""with {TURNS}, m as (
  select meeting, label, min(segment_id) as ordinal, 'N' || (max(segment_id) % 7)::varchar as name, case when min(segment_id) % 3 > 0 then 'P' || (min(segment_id) % 5)::varchar end as person, (count(*) % 11) / 10.0 as confidence
  from turns group by meeting, label)"""


def _mappings(spark, sf_dir):
    return V.turns(spark, sf_dir).groupBy("meeting", "label").agg(
        F.min("segment_id").alias("ordinal"),
        F.concat(F.lit("N"), (F.max("segment_id") % 7).cast("string")).alias("name"),
        F.when(F.min("segment_id") % 3 > 0, F.concat(F.lit("P"), (F.min("segment_id") % 5).cast("string"))).alias("person"),
        ((F.count("*") % 11) / 10.0).alias("confidence"),
    )


@query(_MAPPINGS + """, a as (select *, row_number() over (partition by meeting, name order by confidence desc, ordinal) > 1 as lost from m),
b as (select meeting, label, ordinal, confidence, case when not lost then name end as name, case when not lost then person end as person, lost from a),
c as (select *, person is not null and row_number() over (partition by meeting, person order by confidence desc, ordinal) > 1 as lost2 from b)
select meeting, label, ordinal, round(confidence, 2) as confidence, case when not lost2 then name end as name, case when not lost2 then person end as person, lost or lost2 as needs_review from c""")
def identity_dedupe(spark, sf_dir):
    return D.dedupe_identities(_mappings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 2))


@query(f"""with {TURNS}, c as (select meeting, label, segment_id as ordinal, 1 + segment_id % 4 as layer, case when segment_id % 9 > 0 then 'N' || (segment_id % 6)::varchar end as name, (segment_id * 37 % 100) / 100.0 as confidence from turns),
r as (select *, row_number() over (partition by meeting, label order by (layer = 4 and confidence >= 0.5) desc, confidence desc, layer, ordinal) as n from c where name is not null)
select meeting, label, layer, name, round(confidence, 2) as confidence, confidence < 0.7 as needs_review from r where n = 1""")
def layer_override(spark, sf_dir):
    c = V.turns(spark, sf_dir).select(
        "meeting", "label", F.col("segment_id").alias("ordinal"), (1 + F.col("segment_id") % 4).alias("layer"),
        F.when(F.col("segment_id") % 9 > 0, F.concat(F.lit("N"), (F.col("segment_id") % 6).cast("string"))).alias("name"),
        ((F.col("segment_id") * 37 % 100) / 100.0).alias("confidence"),
    )
    return D.layered(c).withColumn("confidence", F.round("confidence", 2))


@query("""with v as (select l_orderkey as ballot, case when l_linenumber % 4 > 0 then l_returnflag end as choice from lineitem),
c as (select ballot, choice, count(*) as n from v group by all),
t as (select ballot, sum(n) as total, coalesce(sum(n) filter (choice is not null), 0) as matched, max(n) filter (choice is not null) as most from c group by ballot),
w as (select c.ballot, min(choice) as choice, count(*) as winners from c join t on c.ballot = t.ballot and c.n = t.most where choice is not null group by c.ballot)
select t.ballot, case when matched = 0 then 'unresolved' when winners > 1 or most / total < 0.5 then 'ambiguous' else 'resolved' end as status,
  case when matched > 0 and winners = 1 and most / total >= 0.5 then w.choice end as choice, round(coalesce(most / total, 0), 4) as confidence from t left join w on t.ballot = w.ballot""")
def majority_vote(spark, sf_dir):
    v = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ballot"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_returnflag")).alias("choice"))
    return D.majority(v, ["ballot"], "choice")


@query("""with s as (select cast(o_orderdate as date) as meeting, case when o_orderkey % 2 = 0 then 'Clerk ' else ' CLERK ' end || (o_custkey % 400)::varchar as name,
  case when o_orderstatus = 'F' then o_custkey % 800 end as person, case when o_custkey % 11 = 0 then 'unidentified' end as status from orders),
k as (select lower(trim(name)) as key, case when count(distinct person) = 1 then min(person) end as known_id from s where person is not null group by 1)
select lower(trim(name)) as key, count(*) as n, count(distinct meeting) as n_meetings, min(known_id) as known_id from s left join k on lower(trim(name)) = k.key
where person is null and (status is null or status not in ('unidentified', 'non_speaker')) group by 1""")
def unlinked_speakers(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return D.unlinked(o.select(
        F.to_date("o_orderdate").alias("meeting"),
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Clerk ").otherwise(" CLERK "), (F.col("o_custkey") % 400).cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 800).alias("person"),
        F.when(F.col("o_custkey") % 11 == 0, "unidentified").alias("status"),
    ))


@query("""select lower(trim(p_name)) as key, string_agg(p_partkey::varchar, ',' order by p_partkey) as labels, count(*) as n from part group by 1 having count(*) > 1""")
def duplicate_names(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.array_sort(F.collect_list("p_partkey")).alias("l"), F.count("*").alias("n"))
    return p.where("n > 1").select("key", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("labels"), "n")


@query("""with r as (select s_suppkey as ordinal, s_name as canonical, 'S' || s_suppkey::varchar as alias from supplier),
n as (select 'Mayor  ' || replace(c_name, 'Customer', 'Supplier') as name from customer union select lower(s_name) from supplier union select 'S' || s_suppkey::varchar from supplier),
k as (select name, lower(trim(name)) as k, list_last(string_split(lower(name), ' ')) as sn from n),
s as (select sn, min(ordinal) as ordinal, min(canonical) as canonical from (select *, lower(canonical) as sn from r) group by sn having count(*) = 1),
m as (select name, 1 as tier, ordinal, canonical from k join r on k.k = lower(canonical) union all select name, 2, ordinal, canonical from k join r on k.k = lower(alias) union all select name, 3, ordinal, canonical from k join s on k.sn = s.sn)
select k.name, arg_min(canonical, (tier, ordinal)) as canonical, arg_min(tier, (tier, ordinal))::bigint as tier from k left join m on k.name = m.name group by k.name""")
def roster_exact_alias(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    alias = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    roster = s.select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("canonical"), F.array(alias).alias("aliases"))
    names = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("Mayor  "), F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name")).union(s.select(F.lower("s_name"))).union(s.select(alias))
    return D.roster_match(names, roster)


@query("""with p as (select c_custkey as ask_id, s_suppkey as member, coalesce(c_nationkey = s_nationkey, false) as near from customer left join supplier on c_custkey % 60 = s_suppkey % 60),
k as (select * from (select *, bool_or(near) over (partition by ask_id) as any_near from p) where near or not any_near)
select ask_id, case when count(member) = 1 then 'resolved' when count(member) > 1 then 'ambiguous' else 'unknown' end as status, case when count(member) = 1 then min(member) end as member, count(member) as choices from k group by ask_id""")
def surname_resolve(spark, sf_dir):
    a = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ask_id"), (F.col("c_custkey") % 60).alias("k"), F.col("c_nationkey").alias("state"))
    known = V.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("k"), F.col("s_nationkey").alias("state"), F.col("s_suppkey").alias("member"))
    return D.resolve_unique(a, known, ["k"], "state", "member")


@query("select l_orderkey as surname, min(l_suppkey) as id from lineitem group by 1 having count(distinct l_suppkey) = 1")
def unambiguous_index(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("surname")).agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("id"))
    return li.where("n = 1").select("surname", "id")


@query(_MAPPINGS + " select t.meeting, segment_id, t.label, case when confidence >= 0.3 then name end as speaker_name, case when confidence >= 0.3 then round(confidence, 2) end as confidence from turns t left join m on t.meeting = m.meeting and t.label = m.label")
def apply_mappings(spark, sf_dir):
    m = _mappings(spark, sf_dir).where("confidence >= 0.3").select("meeting", "label", F.col("name").alias("speaker_name"), F.round("confidence", 2).alias("confidence"))
    return V.turns(spark, sf_dir).select("meeting", "segment_id", "label").join(m, ["meeting", "label"], "left")


@query(_MAPPINGS + """ select 'low_confidence' as kind, meeting, label from m where confidence < 0.2
union all select 'unlinked', meeting, label from m where person is null and confidence >= 0.5
union all select 'same_name', meeting, label from (select *, count(*) over (partition by meeting, name) as c from m) where c > 1""")
def enrollment_warnings(spark, sf_dir):
    m = _mappings(spark, sf_dir)
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), "meeting", "label")
    same = m.withColumn("c", F.count("*").over(Window.partitionBy("meeting", "name"))).where("c > 1")
    return kind("low_confidence", m.where("confidence < 0.2")).unionByName(kind("unlinked", m.where("person is null and confidence >= 0.5"))).unionByName(kind("same_name", same))


#: Surnames of customers and suppliers by their keys, and how alike each two of them are: stretches that are still to be compared are kept in a list.
_ALIKE = """recursive c as (select c_custkey, translate(lpad(((c_custkey % 400) * 2503 % 1000000)::varchar, 6, '0'), '0123456789', 'abdeiklnor') as a from customer),
s as (select s_suppkey, translate(lpad((s_suppkey * 2503 % 1000000 + s_suppkey % 3)::varchar, (6 + s_suppkey % 2)::int, '0'), '0123456789', 'abdeiklnor') as b from supplier),
f as (
  select a, b, 0 as n, [{'x': a, 'y': b}] as todo from (select a from c union select a || 'q' from c), (select distinct b from s)
  union all
  select a, b, n + coalesce(h.k, 0), case when h is null then rest else list_concat(rest, list_filter([
      {'x': left(p.x, h.i - 1), 'y': left(p.y, instr(p.y, substr(p.x, h.i, h.k)) - 1)},
      {'x': substr(p.x, h.i + h.k), 'y': substr(p.y, instr(p.y, substr(p.x, h.i, h.k)) + h.k)}], lambda q: q.x <> '' and q.y <> '')) end
  from (select *, todo[-1] as p, todo[:-2] as rest, list_filter(flatten(list_transform(range(least(len(todo[-1].x), len(todo[-1].y)), 0, -1), lambda k: list_transform(range(1, len(todo[-1].x) - k + 2), lambda i: {'k': k, 'i': i}))),
      lambda q: contains(todo[-1].y, substr(todo[-1].x, q.i, q.k)))[1] as h from f where len(todo) > 0)),
alike as (select a, b, 2.0 * n / (len(a) + len(b)) as score from f where len(todo) = 0 and 2.0 * n / (len(a) + len(b)) >= 0.8)"""


def _letters(x, n):
    return F.translate(F.lpad(x.cast("string"), n, F.lit("0")), "0123456789", "abdeiklnor")


def _surnames(spark, sf_dir):
    k = F.col("s_suppkey")
    c = V.table(spark, sf_dir, "customer").select("c_custkey", _letters((F.col("c_custkey") % 400) * 2503 % 1000000, F.lit(6)).alias("a"))
    return c, V.table(spark, sf_dir, "supplier").select("s_suppkey", _letters(k * 2503 % 1000000 + k % 3, (6 + k % 2).cast("int")).alias("b"))


@query(f"with {_ALIKE} select c_custkey, s_suppkey, round(score, 4) as score from c join alike using (a) join s using (b)")
def surname_ratio(spark, sf_dir):
    """All customers and suppliers whose surnames are alike."""
    c, s = _surnames(spark, sf_dir)
    return similar_names(c, s, "a", "b").join(c, "a").join(s, "b").select("c_custkey", "s_suppkey", F.round("score", 4).alias("score"))


@query(f"""with {_ALIKE}, n as (select c_custkey, case c_custkey % 4 when 0 then ' Member ' || a || ' ' when 1 then 'Bo ' || upper(a) when 2 then 'Ann ' || a else 'xbo ' || a || 'q' end as name, a || case when c_custkey % 4 = 3 then 'q' else '' end as sn from c),
m as (select s_suppkey, 'Bo ' || b as canonical, b from s),
t as (select n.name, 1 as tier, 0.0 as rank, s_suppkey, canonical from n join m on lower(trim(n.name)) = lower(canonical)
  union all select n.name, 3, 0.0, s_suppkey, canonical from n join m on list_contains(string_split(lower(trim(n.name)), ' '), b) or contains(lower(trim(n.name)), 'bo ' || b)
  union all select n.name, 4, -score, s_suppkey, canonical from n join alike on alike.a = n.sn join m using (b)),
best as (select name, arg_min({{'tier': tier, 'canonical': canonical}}, {{'tier': tier, 'rank': rank, 'ordinal': s_suppkey}}) as e from t group by name)
select distinct n.name, coalesce(e.canonical, trim(n.name)) as corrected, e.tier::bigint as tier from n left join best using (name)""")
def roster_corrections(spark, sf_dir):
    """Customers' names in four forms, by a roster of the suppliers."""
    c, s = _surnames(spark, sf_dir)
    k, a = F.col("c_custkey") % 4, F.col("a")
    name = F.when(k == 0, F.concat(F.lit(" Member "), a, F.lit(" "))).when(k == 1, F.concat(F.lit("Bo "), F.upper(a))).when(k == 2, F.concat(F.lit("Ann "), a)).otherwise(F.concat(F.lit("xbo "), a, F.lit("q")))
    roster = s.select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("Bo "), "b").alias("canonical"), F.array("b", F.concat(F.lit("bo "), "b")).alias("aliases"))
    return correct_names(c.select(name.alias("name")), roster)
