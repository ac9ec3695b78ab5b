"""Rolling captions, written out from the events and read back; each query with its DuckDB statement, which rolls the cues anew."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions.graph import settle
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.sources import captions as C

QUERIES, ORACLES, query = registry()
_LONG = [2.0, 1.5, 0.04, 2.5, 0.0]

#: Each cue says what the last three events were; w has the words that are left.
_ROLL = f"""recursive e as (
  select strftime(ts, '%Y%m%d') || '-' || (user_id % 12)::varchar as meeting, event_id, event_type as c, row_number() over w - 1 as i, coalesce(lag(event_type) over w, 'view') as b, coalesce(lag(event_type, 2) over w, 'view') as a
  from events window w as (partition by cast(ts as date), user_id % 12 order by event_id)),
q as (select meeting, i, i * 2.0::double as s, i * 2.0::double + {_LONG}[event_id % 5 + 1] as e, case when a = b and b = c then [a, b || ','] when a = c and b = c then [a, b, c] else [a, b, c] end as said, case when a = b and b = c then [a, b] else [a, b, c] end as keys from e),
f as (
  select meeting, -1::bigint as i, []::varchar[] as tail, null::double as past, 0 as k, false as told from (select distinct meeting from q)
  union all
  select meeting, i, case when told then list_slice(list_concat(tail, keys[k + 1:]), -3, -1) else tail end, case when told or shown then e else past end, k, told
  from (select *, not empty and not shown as told, case when k0 = len(keys) and s >= past then 0 else k0 end as k
    from (select *, e <= s as empty, e > s and e - s <= 0.05 and k0 = len(keys) as shown
      from (select q.meeting, q.i, q.s, q.e, q.keys, f.tail, f.past,
          case when f.past is null or q.s > f.past + 0.05 then 0 else coalesce(list_max(list_filter(range(1, least(len(q.keys), len(f.tail)) + 1), lambda j: f.tail[len(f.tail) - j + 1:] = q.keys[1:j])), 0) end as k0
        from f join q on q.meeting = f.meeting and q.i = f.i + 1)))),
p as (select f.meeting, f.i, q.s, (q.e - q.s) / len(q.keys) as each, q.said, unnest(range(f.k + 1, len(q.keys) + 1)) as j from f join q on q.meeting = f.meeting and q.i = f.i where f.told),
w as (select meeting, row_number() over (partition by meeting order by i, j) - 1 as word_id, said[j] as word, round(s + (j - 1) * each, 3) as word_start, round(s + j * each, 3) as word_end from p)"""


def _cues(spark, sf_dir):
    """Captions as text, one file for each day and twelfth of the users, read back as cues."""
    e = V.table(spark, sf_dir, "events")
    meeting = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), (F.col("user_id") % 12).cast("string"))
    w = Window.partitionBy("meeting").orderBy("event_id")
    e = e.withColumn("meeting", meeting).withColumns({"i": F.row_number().over(w) - 1, "b": F.lag("event_type", 1, "view").over(w), "a": F.lag("event_type", 2, "view").over(w)})
    long = F.get(F.array(*[F.lit(x) for x in _LONG]), (F.col("event_id") % 5).cast("int"))

    def stamp(x):
        ms = F.round(x * 1000).cast("long")
        part = lambda by, most, n: F.lpad((F.floor(ms / by) % most).cast("string"), n, "0")
        return F.concat(part(3600000, 100, 2), F.lit(":"), part(60000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))

    start = F.col("i") * 2.0
    cue = F.concat(stamp(start), F.lit(" --> "), stamp(start + long), F.lit(" align:start\n"), "a", F.lit(" <c>"), "b", F.lit(",</c>\n"), F.upper("b"), F.lit(" "), F.col("event_type"))
    text = e.groupBy("meeting").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cue.alias("x")))), lambda x: x["x"]), "\n\n").alias("vtt"))
    return C.cues(text.withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt")), "meeting", "vtt")


@query(f"with {_ROLL} select meeting, word_id, replace(word, ',', '') as word, word_start, word_end from w")
def caption_words(spark, sf_dir):
    words = C.timed_words(_cues(spark, sf_dir), "meeting")
    return words.withColumn("word", F.replace("word", F.lit(","), F.lit("")))


@query(f"""with {_ROLL}, t as (select meeting, unnest(range(max(i) // 3 + 1)) as segment_id from q group by meeting),
o as (select w.*, segment_id, (word_start + word_end) / 2 >= 6 * segment_id and (word_start + word_end) / 2 < 6 * segment_id + 5 as holds, least(word_end, 6 * segment_id + 5) - greatest(word_start, 6 * segment_id) as shared
  from w join t on w.meeting = t.meeting and 6 * segment_id < word_end and 6 * segment_id + 5 > word_start),
b as (select * from o qualify row_number() over (partition by meeting, word_id order by holds desc, round(shared, 6) desc, segment_id) = 1),
g as (select meeting, segment_id, string_agg(replace(word, ',', ''), ' ' order by word_id) as text from b group by 1, 2)
select t.meeting, t.segment_id, g.text from t left join g using (meeting, segment_id)""")
def caption_alignment(spark, sf_dir):
    """Captions of each file in turns of five seconds with a second between them."""
    c = settle(_cues(spark, sf_dir))  # read for the turns and for the words
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.max("cue") / 3))).alias("segment_id")
    t = c.groupBy("meeting").agg(i).withColumns({"start_time": F.col("segment_id") * 6.0, "end_time": F.col("segment_id") * 6.0 + 5})
    return C.align(c, t).withColumn("text", F.replace("text", F.lit(","), F.lit("")))
