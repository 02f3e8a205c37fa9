"""Replays of chunk streams and the alignment of what was known at each instant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.alignment import ALIGNED, align, positions
from tessitura.functions.multivariant import parse, starting_part
from tessitura.functions.tokenize import tokenize
from tessitura.operators.asof import micros
from tessitura.operators.replay import known_after_each, news, rechunk as cut_anew, remap_times, send_cutoffs, state_ticks
from tessitura.operators.windows import previous, running
from tessitura.plans.aggregates import _TEXTS, EDGES, WEEK_US, _chunks
from tessitura.plans.common import timed_truths, truth
from tessitura.plans.joins import _OUT, _out
from tessitura.session import parallelism, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REC = "rec as (select rec_id, max(len(audio.array)) as n, max(audio.sampling_rate) as rate from recording where audio.sampling_rate > 0 and len(audio.array) > 0 group by 1)"


def _rec(spark, sf):
    r = table(spark, sf, "recording").filter("audio.sampling_rate > 0 and size(audio.array) > 0")
    return r.groupBy("rec_id").agg(F.max(F.size("audio.array")).alias("n"), F.max("audio.sampling_rate").alias("rate"))


@query(f"""with {_REC}, k as (select *, unnest(generate_series(0, greatest(cast(ceil(n / rate / 2.0 - 1e-6) as bigint), 1))) as k from rec)
select rec_id, cast(k * 1.0 as double) as t_real, cast(least(k * 2.0, n / rate) as double) as t_audio, least(cast(floor(least(k * 2.0, n / rate) * rate + 1e-6) as bigint), n) as arr_pos from k""")
def send_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Audio sent every second, twice as fast as it runs."""
    return _rec(spark, sf).select("rec_id", F.explode(send_cutoffs(F.col("n"), F.col("rate"), 1.0, 2.0)).alias("c")).select("rec_id", "c.*")


@query(f"with {_OUT} select rec_id, unnest(generate_series(min(epoch_us(put_ts)), max(epoch_us(put_ts)) + 999990, 1000000)) as at_us from out group by 1")
def sampling_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = _out(spark, sf).groupBy("rec_id").agg(F.min(micros("put_ts")).alias("a"), F.max(micros("put_ts")).alias("b")).filter("a is not null")
    return g.select("rec_id", F.explode(F.sequence(F.col("a"), F.col("b") + 999_990, F.lit(1_000_000).cast("bigint"))).alias("at_us"))


@query(f"""with {_TEXTS}, d as (select rec_id, k, seq, length(text) - coalesce(lag(length(text)) over (partition by rec_id, k order by seq), 0) as dl, (lag(seq) over (partition by rec_id, k order by seq) is null)::int as dn from ch)
select rec_id, seq, cast(sum(dn) over (partition by rec_id order by seq) as bigint) as n_chunks, cast(sum(dl) over (partition by rec_id order by seq) as bigint) as n_chars from d""")
def partial_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and characters known after every change: each change adds what it differs from its forerunner, so no prefix is joined anew."""
    slot = F.floor(F.col("seq") / 10_000)
    c = _chunks(spark, sf).select("rec_id", "k", "seq", F.length("text").alias("n"))
    d = previous(c, ["rec_id", "k"], ["seq"], slot, {"m": "n"})
    more = {"n_chunks": ("sum", F.col("m").isNull().cast("int")), "n_chars": ("sum", F.col("n") - F.coalesce("m", F.lit(0)))}
    return running(d, ["rec_id"], ["seq"], slot, more).select("rec_id", "seq", "n_chunks", "n_chars")


@query("""with c as (select distinct rec_id, seq, put_ts, coalesce(is_finish, false) as fin from output_chunk where rec_id is not null and seq is not null),
f as (select rec_id, min(put_ts) as done from c where fin group by 1)
select c.rec_id, c.seq, c.put_ts > f.done as late from c join f on c.rec_id = f.rec_id where not fin""")
def finish_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that were put after their recording's FINISH, told from those in time."""
    c = table(spark, sf, "output_chunk").filter("rec_id is not null and seq is not null").select("rec_id", "seq", "put_ts", F.coalesce("is_finish", F.lit(False)).alias("fin")).distinct()
    f = c.filter("fin").groupBy("rec_id").agg(F.min("put_ts").alias("done"))
    return c.filter("not fin").join(f, "rec_id").select("rec_id", "seq", (F.col("put_ts") > F.col("done")).alias("late"))


@query("""with x as (select user_id, event_id as seq, cast(floor(value) as bigint) as n from events), s as (select user_id, sum(n) as total, max(seq) as final from x group by 1), c as (select *, sum(n) over (partition by user_id order by seq) as upto from x),
p as (select user_id, total, final, unnest(range(0, cast(ceil(total / 100.0) as bigint))) as piece from s)
select p.user_id, p.piece, least(100, total - piece * 100) as n, case when (p.piece + 1) * 100 > p.total then any_value(p.final) else min(c.seq) end as seq
from p join c on p.user_id = c.user_id and c.upto >= least(total, (piece + 1) * 100) group by p.user_id, p.piece, p.total""")
def rechunk(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.floor("value").alias("n"))
    return cut_anew(x, ["user_id"], 100)


@query(f"with {_REC} select rec_id, unnest(range(0, cast(ceil(n / rate) as bigint))) as second, cast(unnest(range(0, cast(ceil(n / rate) as bigint))) as varchar) as text from rec")
def dummy_asr(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a recogniser: the number of every second begun, from 0."""
    r = _rec(spark, sf).select("rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("rate")) - 1)).alias("second"))
    return r.withColumn("text", F.col("second").cast("string"))


_PLAN = """ins as (select user_id, event_id as seq, epoch_us(ts) as get_us, 1704067200000000 + row_number() over (partition by user_id order by ts, event_id) * 21600000000 as planned from events where event_type in ('view', 'click')),
d as (select *, greatest(0, max(case when r > 1 then planned - get_us end) over (partition by user_id order by get_us, seq)) as delay from (select *, row_number() over (partition by user_id order by get_us, seq) as r from ins)),
lastd as (select user_id, get_us, max(delay) as delay from d group by 1, 2),
outs as (select user_id, event_id as seq, epoch_us(ts) as put_us from events where event_type = 'purchase')"""


@query(f"""with {_PLAN} select user_id, seq, 'in' as side, planned as put_us, get_us + delay as get_us from d
union all select o.user_id, o.seq, 'out', o.put_us + coalesce(l.delay, 0), o.put_us + coalesce(l.delay, 0) from outs o asof left join lastd l on o.user_id = l.user_id and o.put_us >= l.get_us""")
def remap_time(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of views and clicks replayed with one chunk every six hours."""
    e = table(spark, sf, "events")
    ins = e.filter("event_type in ('view', 'click')").select("user_id", F.col("event_id").alias("seq"), micros("ts").alias("get_us"))
    ins = running(ins, ["user_id"], ["get_us", "seq"], F.floor(F.col("get_us") / WEEK_US), {"k": ("sum", F.lit(1))})
    ins = ins.select("user_id", "seq", "get_us", (F.lit(1_704_067_200_000_000).cast("bigint") + F.col("k") * 21_600_000_000).alias("planned"))
    outs = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("seq"), micros("ts").alias("put_us"))
    a, b = remap_times(ins, outs, ["user_id"], WEEK_US)
    return a.select("user_id", "seq", F.lit("in").alias("side"), "put_us", "get_us").unionAll(b.select("user_id", "seq", F.lit("out").alias("side"), "put_us", "get_us"))


_KNOWN = f"""{_TEXTS}, t as (select rec_id from recording where transcription is not null group by 1), c as (select ch.*, epoch_us(put_ts) as us from ch join t using (rec_id)),
e as (select rec_id, min(us) as a, max(us) as b from c group by 1), g as (select rec_id, a, unnest(generate_series(1, cast(ceil((b - a) / 5e6) as bigint) + 1)) as tick from e),
v as (select g.rec_id, g.tick, c.k, arg_max(c.text, (us, seq)) as text from g join c on g.rec_id = c.rec_id and c.us < g.a + g.tick * 5000000 group by 1, 2, 3),
f as (select rec_id, k, min(seq) as first from c group by 1, 2),
known as (select v.rec_id, v.tick, string_agg(v.text, ' ' order by f.first) as text from v join f using (rec_id, k) group by 1, 2)"""


def _put(spark, sf):
    c = _chunks(spark, sf)
    return c.select("rec_id", "seq", F.col("k").alias("key"), "text", micros("put_ts").alias("put_us"), "done").filter("put_us is not null")


def _states(spark, sf):
    """What was known after each chunk of each recording that has a truth; the others have nothing to be aligned with, see known_news."""
    return known_after_each(_put(spark, sf).join(truth(spark, sf).select("rec_id").distinct(), "rec_id", "left_semi"), ["rec_id"])


@query(f"with {_KNOWN} select rec_id, tick, text from known")
def known_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text known of each recording that has a truth, every five seconds."""
    return _states(spark, sf).select("rec_id", F.explode(state_ticks(5_000_000)).alias("tick"), "text")


@query(f"""with {_TEXTS}, c as (select *, epoch_us(put_ts) as us from ch where put_ts is not null), e as (select rec_id, min(us) as a from c group by 1)
select rec_id, (us - a) // 5000000 + 1 as tick, count(*) as n, string_agg(text, ' ' order by us, seq) as text from c join e using (rec_id) group by 1, 2""")
def known_news(spark: SparkSession, sf: str) -> DataFrame:
    """What became known in each five seconds of every stream, those without a truth or an end included."""
    return news(_put(spark, sf), ["rec_id"], 5_000_000)


#: Seconds between two partial alignments.
STEP = 0.25


_DOUBLES = T.ArrayType(T.DoubleType())
_COUNTS = T.StructType(ALIGNED.fields[:4])
_PLACED = T.StructType([T.StructField("status", T.ArrayType(T.StringType())), T.StructField("start_time", _DOUBLES), T.StructField("end_time", _DOUBLES)])


def _said(texts: pd.Series, starts: pd.Series, ends: pd.Series, at: pd.Series, preds: pd.Series):
    """For each row the alignment of a hypothesis' words with what of a timed truth was said by a time, and the times of the truth's words; None for an unreadable truth."""
    blocks, last, times = [], None, []
    for t, s, e, x, p in zip(texts, starts, ends, at, preds):
        if s is None:
            yield None
            continue
        if t != last:  # states of a recording come one after the other
            blocks, last, times = parse(t), t, [{"start_time": a, "end_time": b} for a, b in zip(s.tolist(), e.tolist())]
            for w in (w for b in blocks for o in b["options"] for w in o):
                w |= times[w["uid"]]
        yield align(starting_part(blocks, x), list(p)), times


@F.pandas_udf(_COUNTS)
def _counted(text: pd.Series, start: pd.Series, end: pd.Series, at: pd.Series, pred: pd.Series) -> pd.DataFrame:
    rows = [[None] * 4 if r is None else [r[0][c] for c in _COUNTS.names] for r in _said(text, start, end, at, pred)]
    return pd.DataFrame(rows, columns=_COUNTS.names).astype("Int32")


@F.pandas_udf(_PLACED)
def _placed(text: pd.Series, start: pd.Series, end: pd.Series, at: pd.Series, pred: pd.Series) -> pd.DataFrame:
    rows = [[None] * 3 if r is None else [list(c) for c in zip(*positions(r[0]["matches"], r[1], x))] or [[], [], []] for r, x in zip(_said(text, start, end, at, pred), at)]
    return pd.DataFrame(rows, columns=_PLACED.names)


#: States of one recording that are aligned one after the other.
RUN = 16


def partial_alignments(spark: SparkSession, sf: str, what) -> DataFrame:
    """The states of known_after_each with a: what a function tells of the alignment of what was known after each chunk with what of the timed truth had been processed by then.

    One alignment for each chunk, however many ticks it lasts. Aligning is heavy for its size, so the rows are spread over all cores, in
    short runs of neighbouring states.
    """
    t = timed_truths(spark, sf).select("rec_id", "truth", "times.start_time", "times.end_time")
    j = _states(spark, sf).join(t, "rec_id").repartition(parallelism(spark), "rec_id", F.floor(F.col("state") / RUN)).sortWithinPartitions("rec_id", "state")
    return j.select("rec_id", "seq", "put_us", "next_us", "first_us", "last_us", "processed", what.asNondeterministic()("truth", "start_time", "end_time", "processed", tokenize(F.col("text"))).alias("a"))


@query(None)
def partial_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """At each tick of 0.25 s the alignment of the last state before it: word errors, length and correct words, for timed truths."""
    return partial_alignments(spark, sf, _counted).select("rec_id", "seq", "processed", F.explode(state_ticks(int(STEP * 1e6))).alias("tick"), "a.n_word_errors", "a.true_len", "a.n_correct")


@query(None)
def error_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the matches of every partial alignment lie in time, and how long before what was processed."""
    m = partial_alignments(spark, sf, _placed).select("rec_id", "seq", "processed", F.posexplode(F.arrays_zip("a.status", "a.start_time", "a.end_time")).alias("i", "p"))
    return m.select("rec_id", "seq", "i", "p.*", (F.col("processed") - (F.col("p.start_time") + F.col("p.end_time")) / 2).alias("time_delta"))


@query(None)
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Of all words of all partial alignments, by how long they were processed before: the shares that were right, wrong and not there yet.

    The last edge belongs to its bin; what lies outside is dropped; an empty bin has no shares.
    """
    kind = F.when(F.col("status").isin("correct", "not_yet"), F.col("status")).otherwise("error")
    d = error_positions(spark, sf).select(kind.alias("kind"), "time_delta").filter(F.col("time_delta").between(0, EDGES[-1]))
    edges = F.array(*[F.lit(e) for e in EDGES[:-1]])
    d = d.withColumn("lo", F.array_max(F.filter(edges, lambda e: e <= F.col("time_delta"))))
    n = [F.sum((F.col("kind") == k).cast("bigint")).alias(k) for k in ("correct", "error", "not_yet")]
    bins = spark.createDataFrame(list(zip(EDGES[:-1], EDGES[1:])), "lo double, hi double")
    b = bins.join(d.groupBy("lo").agg(F.count("*").alias("n"), *n), "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "correct", "error", "not_yet")
    return b.select("lo", "hi", "n", *[F.try_divide(k, F.col("n")).alias(k) for k in ("correct", "error", "not_yet")])
