"""Aggregations and window functions over streams, segments and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.alignment import aligned
from tessitura.functions.tokenize import tokenize
from tessitura.operators.asof import micros
from tessitura.operators.intervals import to_ms
from tessitura.plans.common import SQL_PREDICTIONS, SQL_TRUTH, predictions, sql_tokens, timed_truths, truth
from tessitura.plans.joins import _OUT, _out
from tessitura.operators.windows import previous, running, trailing
from tessitura.session import materialize, table

#: Slots of time in which long sequences are swept: a week of events, ten minutes of a stream.
WEEK_US, STREAM_US = 7 * 86_400_000_000, 600_000_000


def _slot(ts: str, width: int = WEEK_US):
    return F.floor(micros(ts) / width)


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {SQL_PREDICTIONS} select distinct dataset_name, pipeline from pred")
def distinct_pipelines(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("dataset_name", "pipeline").distinct()


#: Edges of the latency histogram in seconds: 31 from 0 to 10, rounded to two places, and one wide bin behind.
EDGES = [round(i * 10 / 30, 2) for i in range(31)] + [1000.0]


@query(f"""with {_OUT}, d as (select (epoch_us(get_ts) - epoch_us(put_ts)) / 1e6 as x, rec_id, seq from out where get_ts is not null),
edge as (select unnest({EDGES[:-1]}) as lo, unnest({EDGES[1:]}) as hi)
select lo, hi, count(x) as n, sum((seq % 5 = 0)::int) as marked, sum((seq % 5 = 0)::int) / count(x) as share
from edge left join d on x >= lo and (x < hi or (hi = 1000.0 and x <= hi)) group by 1, 2""")
def delay_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Delays from put to get by fixed edges: the bin is found by comparing with 32 literals, then counted by a partial aggregate; an empty bin has no share."""
    x = (micros("get_ts") - micros("put_ts")) / 1e6
    d = _out(spark, sf).filter("get_ts is not null").select(x.alias("x"), "seq").filter(F.col("x").between(0, EDGES[-1]))
    edges = F.array(*[F.lit(e) for e in EDGES[:-1]])
    d = d.withColumn("lo", F.array_max(F.filter(edges, lambda e: e <= F.col("x"))))
    counted = d.groupBy("lo").agg(F.count("*").alias("n"), F.sum((F.col("seq") % 5 == 0).cast("int")).alias("marked"))
    bins = spark.createDataFrame(list(zip(EDGES[:-1], EDGES[1:])), "lo double, hi double")
    return bins.join(counted, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "marked", F.try_divide("marked", "n").alias("share"))


@query(f"with {_OUT} select rec_id, seq, round((epoch_us(put_ts) - min(epoch_us(put_ts)) over (partition by rec_id)) / 1e6, 6) as sent, done as processed from out")
def latency_curve(spark: SparkSession, sf: str) -> DataFrame:
    o = _out(spark, sf)
    start = o.groupBy("rec_id").agg(F.min(micros("put_ts")).alias("a"))
    return o.join(start, "rec_id").select("rec_id", "seq", F.round((micros("put_ts") - F.col("a")) / 1e6, 6).alias("sent"), F.col("done").alias("processed"))


@query(f"with {_OUT} select rec_id, seq, (epoch_us(put_ts) - min(epoch_us(put_ts)) over (partition by rec_id)) as put_us, (epoch_us(get_ts) - min(epoch_us(put_ts)) over (partition by rec_id)) as get_us from out")
def reset_time(spark: SparkSession, sf: str) -> DataFrame:
    """Times from a recording's first put on; the first is a partial aggregate, so no recording is gathered in one task."""
    o = _out(spark, sf)
    start = o.groupBy("rec_id").agg(F.min(micros("put_ts")).alias("a"))
    return o.join(start, "rec_id").select("rec_id", "seq", (micros("put_ts") - F.col("a")).alias("put_us"), (micros("get_ts") - F.col("a")).alias("get_us"))


@query(f"with {_OUT} select rec_id, seq, done from out qualify row_number() over (partition by rec_id order by put_ts desc, seq desc) = 1")
def last_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """The final state of each recording."""
    o = _out(spark, sf)
    return o.groupBy("rec_id").agg(F.max(F.struct("put_ts", "seq", "done")).alias("m")).select("rec_id", "m.seq", "m.done")


_DUR = """dia as (select distinct rec_id, diar_id, speaker_idx, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e from diarization_segment
  where start_time is not null and end_time is not null and speaker_idx is not null and rec_id is not null)"""


@query(f"with {_DUR}, d as (select rec_id, speaker_idx, sum(greatest(e - s, 0)) as ms from dia group by 1, 2) select rec_id, speaker_idx, ms, row_number() over (partition by rec_id order by ms desc, speaker_idx) - 1 as new_idx from d")
def speaker_reorder(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "diarization_segment").select("rec_id", "diar_id", "speaker_idx", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e")).dropna().distinct()
    t = d.groupBy("rec_id", "speaker_idx").agg(F.sum(F.greatest(F.col("e") - F.col("s"), F.lit(0))).alias("ms"))
    place = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("ms"), "speaker_idx")) - 1
    return t.select("rec_id", "speaker_idx", "ms", place.cast("bigint").alias("new_idx"))


@query("""select epoch_us(time_bucket(interval 6 hour, ts)) as at_us, count(*) as n, avg(value) as mean, quantile_cont(value, 0.5) as median, max(value) as most from events group by 1""")
def load_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"))
    return e.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("most")).select(micros("w.start").alias("at_us"), "n", "mean", "median", "most")


@query(f"""with {_OUT}, ev as (select rec_id, put_ts as t, 1 as d from out where get_ts is not null union all select rec_id, get_ts, -1 from out where get_ts is not null),
g as (select rec_id, t, sum(d) as d from ev group by 1, 2)
select rec_id, epoch_us(t) as t_us, cast(sum(d) over (partition by rec_id order by t) as bigint) as inflight from g""")
def inflight_count(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under way at each instant: +1 at put, -1 at get, folded per instant before the running sum."""
    o = _out(spark, sf).filter("get_ts is not null")
    ev = o.select("rec_id", F.explode(F.array(F.struct(F.col("put_ts").alias("t"), F.lit(1).alias("d")), F.struct(F.col("get_ts").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    g = ev.groupBy("rec_id", micros("x.t").alias("t_us")).agg(F.sum("x.d").alias("d"))
    return running(g, ["rec_id"], ["t_us"], F.floor(F.col("t_us") / STREAM_US), {"inflight": ("sum", F.col("d"))}).select("rec_id", "t_us", "inflight")


@query("select event_id, avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row) as smooth from events")
def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return trailing(e, ["user_id"], ["ts", "event_id"], _slot("ts"), 20, lambda w: F.avg("value").over(w), "smooth").select("event_id", "smooth")


@query("""with r as (select rec_id, dataset_name, max(len(audio.array) / audio.sampling_rate) as sec from recording where audio.sampling_rate > 0 and audio.array is not null group by 1, 2)
select dataset_name, count(*) as n, avg(sec) as mean, min(sec) as least, max(sec) as most from r group by 1""")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "recording").filter("audio.sampling_rate > 0 and audio.array is not null")
    r = r.select("rec_id", "dataset_name", (F.size("audio.array") / F.col("audio.sampling_rate")).alias("sec")).groupBy("rec_id", "dataset_name").agg(F.max("sec").alias("sec"))
    return r.groupBy("dataset_name").agg(F.count("*").alias("n"), F.avg("sec").alias("mean"), F.min("sec").alias("least"), F.max("sec").alias("most"))


_TERMS = f"w as (select doc_id, unnest({sql_tokens('text')}) as w from documents)"


def _doc_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(tokenize(F.col("text"))).alias("w"))


@query(f"with {_TERMS} select w, count(*) as n from w group by 1 having count(*) < 20")
def rare_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_words(spark, sf).groupBy("w").agg(F.count("*").alias("n")).filter("n < 20")


@query(f"with {_TERMS}, c as (select w, count(*) as n from w group by 1) select w, n, round(log10(n / (sum(n) over ()) * 1e9), 6) as zipf from c")
def word_zipf(spark: SparkSession, sf: str) -> DataFrame:
    """Zipf frequency of every word of the corpus; the total is one row that joins each count."""
    c = _doc_words(spark, sf).groupBy("w").agg(F.count("*").alias("n"))
    # Read by two branches: written once, the corpus is cut into words once.
    c = materialize(c, "word-counts")
    total = c.agg(F.sum("n").alias("total")).scalar()
    return c.select("w", "n", F.round(F.log10(F.col("n") / total * 1e9), 6).alias("zipf"))


@query(f"""with {SQL_TRUTH}, spoken as (select distinct unnest({sql_tokens("text")}) as w from truth), {_TERMS.replace("w as", "dw as")}, c as (select w, count(*) as n from dw group by 1)
select s.w, coalesce(c.n, 0) as n from spoken s left join c on s.w = c.w where coalesce(c.n, 0) < 50 and s.w <> '<*>'""")
def domain_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the recordings that are rare in the documents."""
    spoken = truth(spark, sf).select(F.explode(tokenize(F.col("text"))).alias("w")).filter("w != '<*>'").distinct()
    c = _doc_words(spark, sf).groupBy("w").agg(F.count("*").alias("n"))
    return spoken.join(c, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n")).filter("n < 50")


@query("""with l as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as lag from events),
m as (select user_id, max(lag) as most from l where lag is not null group by 1) select quantile_cont(most, 0.95) as p95 from m""")
def p95_lag(spark: SparkSession, sf: str) -> DataFrame:
    lag = (micros("ts") - micros("before")) / 1e6
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    e = previous(e, ["user_id"], ["ts", "event_id"], _slot("ts"), {"before": "ts"}).filter("before is not null")
    return e.groupBy("user_id").agg(F.max(lag).alias("most")).agg(F.percentile("most", 0.95).alias("p95"))


@query("""with x as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events),
g as (select *, sum((before is null or before <> event_type)::int) over (partition by user_id order by ts, event_id) as g, row_number() over (partition by user_id order by ts, event_id) - 1 as i from x)
select user_id, event_type, min(i) as first, max(i) + 1 as last from g group by user_id, g, event_type""")
def run_length_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    x = previous(e, ["user_id"], ["ts", "event_id"], _slot("ts"), {"before": "event_type"})
    fresh = (F.col("before").isNull() | (F.col("before") != F.col("event_type"))).cast("int")
    g = running(x, ["user_id"], ["ts", "event_id"], _slot("ts"), {"g": ("sum", fresh), "i": ("sum", F.lit(1))})
    return g.groupBy("user_id", "g", "event_type").agg((F.min("i") - 1).alias("first"), F.max("i").alias("last")).select("user_id", "event_type", "first", "last")


@query("""with x as (select event_id, user_id, value, lag(value) over (partition by user_id order by ts, event_id) as before from events) select user_id, count(*) as n from x where value < before group by 1""")
def monotonic_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return previous(e, ["user_id"], ["ts", "event_id"], _slot("ts"), {"before": "value"}).filter("value < before").groupBy("user_id").agg(F.count("*").alias("n"))


#: Tokens of one slot.
TOKENS = 10_000


@query(None)
def insertion_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Where each inserted word of an alignment can lie: behind all words of the truth before it and before all behind, for timed truths."""
    p = predictions(spark, sf).join(timed_truths(spark, sf).withColumnRenamed("truth", "text"), ["rec_id", "text"])
    m = p.select("rec_id", "pipeline", "times", aligned("text", "h").alias("a")).select("rec_id", "pipeline", "times", F.posexplode("a.matches").alias("i", "m"))
    word, by = F.get("times", F.col("m.true_uid")), W.partitionBy("rec_id", "pipeline").orderBy("i")
    left = F.max(word["end_time"]).over(by.rowsBetween(W.unboundedPreceding, -1))
    right = F.min(word["start_time"]).over(by.rowsBetween(1, W.unboundedFollowing))
    m = m.select("rec_id", "pipeline", F.col("m.pred_uid").alias("pred_uid"), F.col("m.status").alias("status"), F.coalesce(left, F.lit(0.0)).alias("left_end"), F.coalesce(right, F.lit(1000.0)).alias("right_start"))
    return m.filter("status = 'insertion'").drop("status")


@query("""with x as (select event_id, user_id, bool_and(event_type in ('view', 'click')) over (partition by user_id order by ts desc, event_id desc) as tail from events) select user_id, event_id from x where tail""")
def not_yet_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The run at the end of each stream in which only views and clicks follow."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", (-micros("ts")).alias("t"), (-F.col("event_id")).alias("i"))
    e = running(e, ["user_id"], ["t", "i"], F.floor(F.col("t") / WEEK_US), {"tail": ("min", F.col("event_type").isin("view", "click").cast("int"))})
    return e.filter("tail = 1").select("user_id", "event_id")


@query("""with tok as (select distinct rec_id, token_id, value, start_time, end_time from transcript_token),
n as (select *, lag(token_id) over w as p, lag(end_time) over w as a, lead(token_id) over w as f, lead(start_time) over w as b from tok window w as (partition by rec_id order by token_id))
select token_id, case when p is null then 0 else a end as start_time, case when f is null then 1000 else b end as end_time from n where value = '<*>'""")
def anything_time_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Times of each wildcard from its neighbours; null where a neighbour has none."""
    t = table(spark, sf, "transcript_token").select("rec_id", "token_id", "value", "start_time", "end_time").distinct().withColumn("back", -F.col("token_id"))
    t = t.withColumns({"s": F.struct("start_time"), "e": F.struct("end_time")})
    t = previous(t, ["rec_id"], ["token_id"], F.floor(F.col("token_id") / TOKENS), {"a": "e"})
    t = previous(t, ["rec_id"], ["back"], F.floor(F.col("back") / TOKENS), {"b": "s"})
    start, end = F.when(F.col("a").isNull(), 0.0).otherwise(F.col("a.end_time")), F.when(F.col("b").isNull(), 1000.0).otherwise(F.col("b.start_time"))
    return t.filter("value = '<*>'").select("token_id", start.alias("start_time"), end.alias("end_time"))


_TEXTS = """ch as (select rec_id, seq, uid, text, put_ts, coalesce(uid, '#' || cast(seq as varchar)) as k from output_chunk
  where rec_id is not null and seq is not null and not coalesce(is_finish, false) and text is not null qualify row_number() over (partition by rec_id, seq order by put_ts, text) = 1)"""


def _chunks(spark, sf):
    c = table(spark, sf, "output_chunk").filter("rec_id is not null and seq is not null and not coalesce(is_finish, false) and text is not null")
    c = c.groupBy("rec_id", "seq").agg(F.min(F.struct("put_ts", "text", "uid", F.col("seconds_processed").alias("done"))).alias("m")).select("rec_id", "seq", "m.*")
    return c.withColumn("k", F.coalesce("uid", F.concat(F.lit("#"), F.col("seq").cast("string"))))


@query(f"with {_TEXTS}, last as (select rec_id, k, min(seq) as first, arg_max(text, seq) as text from ch group by 1, 2) select rec_id, string_agg(text, ' ' order by first) as text from last group by 1")
def chunk_join_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert join: each chunk at the place where it was first seen, with its last text."""
    last = _chunks(spark, sf).groupBy("rec_id", "k").agg(F.min("seq").alias("first"), F.max_by("text", "seq").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("first", "text")))
    return last.groupBy("rec_id").agg(parts.alias("p")).select("rec_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
