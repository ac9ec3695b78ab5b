"""The registered queries of this subpackage and, where SQL can say it, what they must return."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import chat, decontaminate, divergence, gif, html, lm, negatives, pieces, pii, quality, repeats, simhash, toxicity
from plenum.llm.common import table


#: Where the public tokenizers' files lie; only the driver reads there.
TOKENIZERS = os.environ.get("PLENUM_TOKENIZERS", "/opt/tokenizers")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(probe)))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn,
    count(*) over (partition by conv_id) as n,
    length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?INST\]|/?s>|</?(SYS|ROLE)>>|</TURN>>)', '\1\\\2', 'g')) as body,
    case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7
      else 17 + 9 + length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?INST\]|/?s>|</?(SYS|ROLE)>>|</TURN>>)', '\1\\\2', 'g')) end as marks
  from t),
c as (select *, sum(body + marks) over (partition by conv_id order by rn) as upto from r)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or rn = n), 0)::bigint as formatted_chars,
  (count(*) filter (role = 'assistant'))::bigint as n_examples
from c group by conv_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with d as materialized (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark),
win as (
  select distinct item_id, list_slice(ws, i, i + 12) as w
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as i from b where len(ws) > 0)),
sizes as (select distinct len(w) as n from win),
occ as (
  select r, i, n, list_slice(ws, i, i + n - 1) as w
  from (select r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, sizes where len(ws) >= n)),
hit as (select o.r, o.i, o.n, win.item_id from occ o join win on o.w = win.w),
cov as (
  select r, count(distinct p) as n_hit
  from (select r, unnest(generate_series(i, i + n - 1)) as p from hit) group by r),
its as (
  select r, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct r, item_id::varchar as s from hit where item_id is not null) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join cov on d.r = cov.r left join its on d.r = its.r
"""

def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    coded = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), blob)
    n = F.coalesce(F.size("coded.ids"), F.lit(0)).cast("long")
    return coded.select(
        "doc_id", n.alias("n_tokens"), "coded.ids_sha256", "coded.decoded_chars", "coded.decoded_sha256", "coded.round_trip",
        "coded.n_likely", "coded.likely_sha256", "coded.likely_score", "coded.ids",
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
t as (select r, unnest(generate_series(1, len(ws))) as i, unnest(ws) as w from d),
g as (select r, i, w, lag(w) over (partition by r order by i) as v, lag(w, 2) over (partition by r order by i) as u from t),
-- each document's own counts, and the totals over all documents less these
o1 as (select r, w, count(*) as own from t group by r, w),
o2 as (select r, v, w, count(*) as own from g where i > 1 group by r, v, w),
o3 as (select r, u, v, w, count(*) as own from g where i > 2 group by r, u, v, w),
c1 as (select *, sum(own) over (partition by w) as total, total - own as c from o1),
c2 as (select *, sum(own) over (partition by v, w) as total, total - own as c from o2),
c3 as (select *, sum(own) over (partition by u, v, w) as total, total - own as c from o3),
s as (
  select g.r, g.i, ln(greatest(c1.c, 1) / greatest(n.n - d.n, 1)) as one,
    case when i > 1 then case when c2.c >= 1 then ln(c2.c / cv.c) else ln(0.4) + one end end as two,
    case when i > 2 then case when c3.c >= 1 then ln(c3.c / uv.c) else ln(0.4) + two end end as three,
    case when i > 2 then (c3.c < 1)::int when i = 2 then (c2.c < 1)::int else 0 end as back,
    (case when i > 2 then c3.total when i = 2 then c2.total else c1.total end = 1)::int as once
  from g cross join (select count(*) as n from t) n join (select r, len(ws) as n from d) d on g.r = d.r
    join c1 on g.r = c1.r and g.w = c1.w left join c1 cv on g.r = cv.r and g.v = cv.w
    left join c2 on g.r = c2.r and g.v = c2.v and g.w = c2.w left join c2 uv on g.r = uv.r and g.u = uv.v and g.v = uv.w
    left join c3 on g.r = c3.r and g.u = c3.u and g.v = c3.v and g.w = c3.w)
select doc_id, len(ws)::bigint as n_words, coalesce(sum(back), 0)::bigint as n_backoff, coalesce(sum(once), 0)::bigint as n_once,
  round(coalesce(sum(coalesce(three, two, one)), 0), 4) as log_score, case when len(ws) > 0 then round(sum(coalesce(three, two, one)) / len(ws), 4) end as mean_log
from d left join s on d.r = s.r group by d.r, doc_id, ws
"""


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
with e as materialized (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.r <> b.r),
p as (
  select ar, anchor_id, br, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by ar order by score desc, vec_id, br) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    (row_number() over (partition by p.ar, p.br order by s.score desc, s.vec_id, s.br))::int as rank
  from p join s on s.ar = p.ar and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by lang, source, term),
kept as (select lang, term, sum(n) as lang_n from c group by lang, term having sum(docs) >= 30),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
own as (select c.lang, c.source, c.term, c.n from c join kept using (lang, term)),
tot as (
  select g.lang, g.source, v.v, v.lang_total, coalesce(sum(own.n), 0) as total
  from g join v on g.lang = v.lang left join own on own.lang = g.lang and own.source = g.source
  group by g.lang, g.source, v.v, v.lang_total),
p as (
  select t.lang, t.source, k.term, coalesce(o.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)::hugeint) // (t.total + 5 * t.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.lang_n + 5)::hugeint) // (t.lang_total + 5 * t.v)::hugeint as q
  from tot t join kept k on k.lang = t.lang left join own o on o.lang = t.lang and o.source = t.source and o.term = k.term),
s as (
  select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, rank from (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
where part = 'pair' or rank <= 50
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_html": op5_html,
    "op6_pieces": op6_pieces,
    "op7_pii": op7_pii,
    "op8_gif": op8_gif,
    "op9_backoff": op9_backoff,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_repeats": op12_repeats,
    "op13_divergence": op13_divergence,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op4_decontaminate": OP4_SQL, "op9_backoff": OP9_SQL, "op11_negatives": OP11_SQL, "op13_divergence": OP13_SQL}
