"""Joins: equality, absence, as of a time, overlap, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators.asof import asof, micros, overlap_pairs
from tessitura.operators.fuzzy import cosine_topk_blocks, edit_neighbours
from tessitura.operators.intervals import to_ms
from tessitura.operators.windows import running
from tessitura.plans.common import SQL_PREDICTIONS, SQL_TRUTH, predictions, sql_distance, sql_tokens, truth
from tessitura.functions.tokenize import tokenize
from tessitura.session import table
from tessitura.sources.registry import pending

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {SQL_PREDICTIONS} select p.pipeline, p.rec_id, len(p.h) as n_pred, length(t.text) as n_chars, t.split_name from pred p join truth t on p.rec_id = t.rec_id")
def predictions_join_truth(spark: SparkSession, sf: str) -> DataFrame:
    """N:1 join; Spark broadcasts the truths only while their measured size is below its limit, and sorts otherwise."""
    p = predictions(spark, sf).select("pipeline", "rec_id", F.size("h").cast("bigint").alias("n_pred"))
    return p.join(truth(spark, sf).select("rec_id", F.length("text").cast("bigint").alias("n_chars"), "split_name"), "rec_id").select("pipeline", "rec_id", "n_pred", "n_chars", "split_name")


@query(f"with {SQL_TRUTH} select dataset_name, sample_idx from truth where rec_id not in (select rec_id from transcript_token where rec_id is not null)")
def pending_samples(spark: SparkSession, sf: str) -> DataFrame:
    return pending(truth(spark, sf), table(spark, sf, "transcript_token").select("rec_id"), ["rec_id"]).select("dataset_name", "sample_idx")


#: A stream from events: per user, views and clicks are input chunks, purchases are probes.
_INPUTS = "inputs as (select user_id, ts, max(event_id) as seq, arg_max(value, event_id) as v from events where event_type in ('view', 'click') group by 1, 2)"


def _inputs(spark, sf):
    return table(spark, sf, "events").filter("event_type in ('view', 'click')").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("value").alias("v"))


def _probes(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))


@query(f"""with {_INPUTS} select p.event_id, p.user_id, coalesce(i.v, 0) as sent from (select * from events where event_type = 'purchase') p
asof left join inputs i on p.user_id = i.user_id and p.ts > i.ts""")
def asof_sent(spark: SparkSession, sf: str) -> DataFrame:
    j = asof(_probes(spark, sf), _inputs(spark, sf), ["user_id"], micros("at"), micros("ts"), F.col("seq"), ["v"], slot=7 * 86_400_000_000)
    return j.select("event_id", "user_id", F.coalesce("v", F.lit(0.0)).alias("sent"))


_OUT = """out as (select rec_id, seq, arg_min(seconds_processed, put_ts) as done, min(put_ts) as put_ts, min(get_ts) as get_ts from output_chunk
  where rec_id is not null and seq is not null and not coalesce(is_finish, false) group by 1, 2)"""


def _out(spark, sf):
    c = table(spark, sf, "output_chunk").filter("rec_id is not null and seq is not null and not coalesce(is_finish, false)")
    return c.groupBy("rec_id", "seq").agg(F.min_by("seconds_processed", "put_ts").alias("done"), F.min("put_ts").alias("put_ts"), F.min("get_ts").alias("get_ts"))


@query(f"""with {_OUT}, ev as (select rec_id, put_ts, max(done) as done from (
  select rec_id, put_ts, done, row_number() over (partition by rec_id, put_ts order by seq desc) r from out where done is not null) where r = 1 group by 1, 2)
select o.rec_id, o.seq, coalesce(e.done, 0) as processed from out o asof left join ev e on o.rec_id = e.rec_id and o.get_ts > e.put_ts""")
def asof_processed(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds known to be processed when each chunk was fetched: strictly before, 0 at first."""
    o = _out(spark, sf)
    ev = o.filter("done is not null").select("rec_id", "put_ts", F.col("seq").alias("es"), F.col("done").alias("processed"))
    j = asof(o.select("rec_id", "seq", "get_ts"), ev, ["rec_id"], micros("get_ts"), micros("put_ts"), F.col("es"), ["processed"], slot=600_000_000)
    return j.select("rec_id", "seq", F.coalesce("processed", F.lit(0.0)).alias("processed"))


@query(f"""with {_OUT}, grid as (select rec_id, unnest(generate_series(min(put_ts), max(put_ts), interval 5 second)) as at from out group by 1),
st as (select rec_id, put_ts, max(seq) as state from out group by 1, 2)
select g.rec_id, epoch_us(g.at) as at_us, s.state from grid g asof left join st s on g.rec_id = s.rec_id and g.at > s.put_ts""")
def asof_partial_state(spark: SparkSession, sf: str) -> DataFrame:
    """On a grid of 5 seconds, the last chunk that was put before."""
    o = _out(spark, sf)
    grid = o.groupBy("rec_id").agg(F.min("put_ts").alias("a"), F.max("put_ts").alias("b")).filter("a is not null")
    grid = grid.select("rec_id", F.explode(F.sequence("a", "b", F.expr("interval 5 seconds"))).alias("at"))
    ev = o.select("rec_id", "put_ts", F.col("seq").alias("state"))
    j = asof(grid.select("rec_id", micros("at").alias("at_us")), ev, ["rec_id"], F.col("at_us"), micros("put_ts"), F.col("state"), ["state"], slot=600_000_000)
    return j.select("rec_id", "at_us", "state")


@query(f"""with {_INPUTS}, n as (select user_id, ts, min(seq) as seq from (select user_id, ts, event_id as seq from events where event_type in ('view', 'click')) group by 1, 2)
select p.event_id, p.user_id, i.seq as nxt, epoch_us(i.ts) - epoch_us(p.ts) as delay from (select * from events where event_type = 'purchase') p
asof left join n i on p.user_id = i.user_id and p.ts <= i.ts""")
def asof_forward_delay(spark: SparkSession, sf: str) -> DataFrame:
    """The first input at or after each probe, and how long it took."""
    ev = _inputs(spark, sf).select("user_id", "ts", F.col("seq").alias("nxt"), micros("ts").alias("us"))
    j = asof(_probes(spark, sf), ev, ["user_id"], micros("at"), micros("ts"), F.col("nxt"), ["nxt", "us"], strict=False, forward=True, slot=7 * 86_400_000_000)
    return j.select("event_id", "user_id", "nxt", (F.col("us") - micros("at")).alias("delay"))


@query(f"""with {_OUT} select rec_id, count(*) as n, sum((put_ts > get_ts)::int) as put_after_get,
sum((done < m)::int) as went_back from (select *, max(done) over (partition by rec_id order by put_ts, seq rows between unbounded preceding and 1 preceding) m from out) group by 1""")
def consistency_check(spark: SparkSession, sf: str) -> DataFrame:
    o = running(_out(spark, sf), ["rec_id"], ["put_ts", "seq"], F.floor(micros("put_ts") / 600_000_000), {"m": ("max", F.col("done"))}, inclusive=False)
    return o.groupBy("rec_id").agg(F.count("*").alias("n"), F.sum((F.col("put_ts") > F.col("get_ts")).cast("int")).alias("put_after_get"), F.sum((F.col("done") < F.col("m")).cast("int")).alias("went_back"))


_SEG = """seg as (select distinct rec_id, seg_id, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e from timed_text where end_time is not null),
dia as (select distinct rec_id, diar_id, speaker_idx, cast(round(start_time * 1000) as bigint) rs, cast(round(end_time * 1000) as bigint) re from diarization_segment
  where start_time is not null and end_time is not null and speaker_idx is not null and rec_id is not null)"""


def _seg(spark, sf):
    t = table(spark, sf, "timed_text").select("rec_id", "seg_id", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e")).filter("e is not null")
    d = table(spark, sf, "diarization_segment").select("rec_id", "diar_id", "speaker_idx", to_ms(F.col("start_time")).alias("rs"), to_ms(F.col("end_time")).alias("re")).dropna()
    return t.distinct(), d.distinct(), (t, d)


@query(f"with {_SEG} select seg_id, diar_id, least(e, re) - greatest(s, rs) as overlap from seg join dia using (rec_id) where s < re and rs < e and e >= s and re >= rs")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    t, d, raw = _seg(spark, sf)
    return overlap_pairs(t, d, ["rec_id"], 30_000, raw).select("seg_id", "diar_id", "overlap")


@query(f"""with {_SEG}, hit as (select seg_id, speaker_idx, e - s as len, sum(least(e, re) - greatest(s, rs)) as o from seg join dia using (rec_id) where s < re and rs < e and e >= s and re >= rs group by 1, 2, 3)
select seg_id, speaker_idx, o / len as ratio, row_number() over (partition by seg_id order by o desc, speaker_idx) as place from hit""")
def speaker_ratios(spark: SparkSession, sf: str) -> DataFrame:
    t, d, raw = _seg(spark, sf)
    hit = overlap_pairs(t, d, ["rec_id"], 30_000, raw).groupBy("seg_id", "speaker_idx", (F.col("e") - F.col("s")).alias("len")).agg(F.sum("overlap").alias("o"))
    place = F.row_number().over(W.partitionBy("seg_id").orderBy(F.desc("o"), "speaker_idx")).cast("bigint")
    return hit.select("seg_id", "speaker_idx", (F.col("o") / F.col("len")).alias("ratio"), place.alias("place"))


@query(f"""with {_SEG} select a.rec_id, a.speaker_idx, count(*) as n from dia a join dia b on a.rec_id = b.rec_id and a.speaker_idx = b.speaker_idx and a.diar_id < b.diar_id
where a.rs < b.re and b.rs < a.re and a.re >= a.rs and b.re >= b.rs group by 1, 2""")
def self_overlap_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of segments in which a speaker overlaps itself."""
    _, d, (_, raw) = _seg(spark, sf)
    a = d.select("rec_id", "speaker_idx", F.col("diar_id").alias("x"), F.col("rs").alias("s"), F.col("re").alias("e"))
    return overlap_pairs(a, d, ["rec_id", "speaker_idx"], 30_000, (raw.select(F.col("rs").alias("s"), F.col("re").alias("e")), raw)).filter("x < diar_id").groupBy("rec_id", "speaker_idx").agg(F.count("*").alias("n"))


@query(f"with {SQL_PREDICTIONS} select a.rec_id, a.pipeline as first, b.pipeline as second, cast(len(a.h) - len(b.h) as bigint) as more from pred a join pred b on a.rec_id = b.rec_id and a.pipeline < b.pipeline")
def self_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different pipelines within a sample (i < j); a sample has as many rows as there are pipelines."""
    p = predictions(spark, sf).select("rec_id", "pipeline", F.size("h").alias("n"))
    rows = p.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("pipeline", "n"))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x["pipeline"].alias("first"), y["pipeline"].alias("second"), (x["n"] - y["n"]).cast("bigint").alias("more")))))
    return rows.select("rec_id", F.explode(pairs).alias("p")).select("rec_id", "p.*")


@query(f"with {SQL_PREDICTIONS} select rec_id, pipeline, cast(sum((a = b)::int) as bigint) as same from (select rec_id, pipeline, unnest(t) as a, unnest(h) as b from pred where len(t) = len(h)) group by 1, 2")
def zip_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and hypothesis word by word, where they have equally many."""
    p = predictions(spark, sf).filter(F.size("t") == F.size("h")).filter(F.size("t") > 0)
    return p.select("rec_id", "pipeline", F.aggregate(F.zip_with("t", "h", lambda a, b: (a == b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("same"))


_WORDS = f"""{SQL_TRUTH}, spoken as (select distinct unnest({sql_tokens("text")}) as w from truth),
said as (select w from spoken where regexp_matches(w, '[\\p{{L}}\\p{{N}}]')),
dict as (select d from (select distinct unnest({sql_tokens("p_name")}) as d from part) where regexp_matches(d, '[\\p{{L}}\\p{{N}}]')),
apart as (select w, d, {sql_distance("w", "d")} as dist from said, dict where abs(length(w) - length(d)) <= 3)"""


def said_and_dictionary(spark, sf):
    """All words of the truths and all words of the dictionary, each once; signs, blocks' bars and wildcards are no words."""
    words = lambda df, text, name: df.select(F.explode(tokenize(F.col(text))).alias(name)).filter(F.col(name).rlike(r"[\p{L}\p{N}]")).distinct()
    return words(truth(spark, sf), "text", "w"), words(table(spark, sf, "part"), "p_name", "d")


@query(f"with {_WORDS} select w, d, dist from apart where dist <= 2")
def fuzzy_dict_match(spark: SparkSession, sf: str) -> DataFrame:
    """Spoken words and dictionary words at most two edits apart, by deletion neighbourhoods: an equality join, not all pairs."""
    said, d = said_and_dictionary(spark, sf)
    return edit_neighbours(said, d, "w", "d", 2).select("w", "d", F.col("dist").cast("bigint").alias("dist"))


_UNIT = "unit as (select vec_id, label, embedding as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm from embeddings)"


@query(f"""with {_UNIT}, s as (select q.vec_id as query, u.vec_id as hit, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: cast(q.v[i] as double) * u.v[i])) / (q.norm * u.norm), 6) as score
  from unit q, unit u where q.vec_id % 100 = 0 and u.vec_id <> q.vec_id)
select query, hit, score, row_number() over (partition by query order by score desc, hit) as place from s qualify place <= 5""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query (every row whose number is divisible by 100), against all rows, in blocks."""
    return cosine_topk_blocks(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5)
