"""Frames, segments and chunks; packing and correcting text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.multivariant import MultivariantError, parse, parse_multivariant, render, starting_part
from tessitura.functions.sequences import argmax, baseline_words, chunk_bounds, ctc_collapse as collapse, fill_times, forced_alignment, merge_sentences, pack_by_space as pack, splice
from tessitura.functions.tokenize import tokenize
from tessitura.operators.corrector import EDITS, correct_texts, domain_words, substitute, without_titles, word_corrections, zipf
from tessitura.operators.fuzzy import edit_neighbours, grid
from tessitura.operators.intervals import to_ms
from tessitura.operators.windows import previous, running, trailing
from tessitura.plans.common import SQL_TRUTH, sql_distance, sql_tokens, truth
from tessitura.plans.joins import _WORDS, said_and_dictionary
from tessitura.session import materialize, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Frames of one slot.
FRAMES = 10_000
#: Frames: label names the recording, vec_id the frame; symbols are the strongest class, folded to eight.
_SYM = "f as (select label, vec_id, (list_position(embedding, list_max(embedding)) - 1) % 8 as sym from embeddings where embedding is not null)"


def _frames(spark, sf):
    return table(spark, sf, "embeddings").filter("embedding is not null").select("label", "vec_id", (argmax(F.col("embedding")) % 8).alias("sym"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best from embeddings")
def frame_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("best"))


@query(f"with {_SYM} select label, vec_id, cast(sym as integer) as sym from (select *, lag(sym) over (partition by label order by vec_id) as p from f) where sym <> 0 and (p is null or p <> sym)")
def ctc_collapse(spark: SparkSession, sf: str) -> DataFrame:
    f = previous(_frames(spark, sf), ["label"], ["vec_id"], F.floor(F.col("vec_id") / FRAMES), {"p": "sym"})
    return f.filter("sym != 0 and (p is null or p != sym)").select("label", "vec_id", "sym")


@query(f"with {_SYM} select label, string_agg(chr(cast(96 + sym as integer)), '' order by vec_id) as text from (select *, lag(sym) over (partition by label order by vec_id) as p from f) where sym <> 0 and (p is null or p <> sym) group by 1")
def ctc_greedy(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "sym"))).alias("s"))
    symbols = collapse(F.transform("s", lambda x: x["sym"]), F.lit(0))
    return f.select("label", F.array_join(F.transform(symbols, lambda x: F.char(96 + x)), "").alias("text")).filter("text != ''")


@query("""with c as (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as class from embeddings),
m as (select label, class, round(avg(cast(x as double)), 6) as mean from c group by 1, 2)
select label, class, mean, row_number() over (partition by label order by mean desc, class) as place from m qualify place <= 9""")
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("class", "x"))
    m = c.groupBy("label", F.col("class").cast("bigint").alias("class")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("mean"), "class")).cast("bigint")
    return m.withColumn("place", place).filter("place <= 9")


@query(f"""with {_SYM}, g as (select *, row_number() over (partition by label order by vec_id) - 1 as i from f),
s as (select *, sum((sym = 7)::int) over (partition by label order by i) as w from g),
w as (select label, w, min(case when sym <> 0 then i end) as a, max(case when sym <> 0 then i end) as b from s where sym <> 7 group by 1, 2)
select label, a / 25 as start_time, (b + 1) / 25 as end_time from w where a is not null""")
def word_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Words are what stands between spaces (symbol 7), from their first to their last letter, at 25 frames a second."""
    s = running(_frames(spark, sf), ["label"], ["vec_id"], F.floor(F.col("vec_id") / FRAMES), {"i": ("sum", F.lit(1)), "w": ("sum", (F.col("sym") == 7).cast("int"))})
    letter = F.when(F.col("sym") != 0, F.col("i") - 1)
    w = s.filter("sym != 7").groupBy("label", "w").agg(F.min(letter).alias("a"), F.max(letter).alias("b")).filter("a is not null")
    return w.select("label", (F.col("a") / 25).alias("start_time"), ((F.col("b") + 1) / 25).alias("end_time"))


_LEN = "rec as (select rec_id, max(cast(round(len(audio.array) * 1000.0 / audio.sampling_rate) as bigint)) as ms from recording where audio.sampling_rate > 0 and len(audio.array) > 0 group by 1)"


def _lengths(spark, sf):
    r = table(spark, sf, "recording").filter("audio.sampling_rate > 0 and size(audio.array) > 0")
    return r.groupBy("rec_id").agg(F.max(F.round(F.size("audio.array") * 1000.0 / F.col("audio.sampling_rate")).cast("bigint")).alias("ms"))


_CHUNKS = f"""{_LEN}, k as (select rec_id, ms, unnest(generate_series(0, cast(ceil((ms - 30000) / 10000.0) as bigint) - 1)) as i from rec where ms > 30000),
chunk as (select rec_id, 0 as a, ms as b from rec where ms <= 30000 union all select rec_id, i * 10000, i * 10000 + 30000 from k union all select rec_id, ms - 30000, ms from rec where ms > 30000)"""


@query(f"with {_CHUNKS} select rec_id, a as start_ms, b as end_ms from chunk")
def chunk_audio(spark: SparkSession, sf: str) -> DataFrame:
    return _lengths(spark, sf).select("rec_id", F.explode(chunk_bounds(F.col("ms"), 30_000, 10_000)).alias("c")).select("rec_id", F.col("c.a").alias("start_ms"), F.col("c.b").alias("end_ms"))


@query(f"""with {_CHUNKS}, tick as (select rec_id, a, cast(round_even(a / 1000.0, 0) as bigint) as t0, greatest((b - a) // 1000, 1) as n, unnest(range(0, greatest((b - a) // 1000, 1))) as j from chunk),
v as (select rec_id, t0 + j as tick, cast((a // 1000 * 7 + j) % 11 as double) as v, case when n = 1 then 0.0 else j / (n - 1) end as x from tick)
select rec_id, tick, round(sum((0.01 + 630 * pow(x, 4) * pow(1 - x, 4)) * v) / sum(0.01 + 630 * pow(x, 4) * pow(1 - x, 4)), 6) as value from v group by 1, 2""")
def overlap_average(spark: SparkSession, sf: str) -> DataFrame:
    """Features of overlapping chunks averaged per tick of a second, by a bell of weights over each chunk (a polynomial)."""
    c = chunk_audio(spark, sf).withColumn("n", F.greatest(F.floor((F.col("end_ms") - F.col("start_ms")) / 1000), F.lit(1)))
    t = c.select("rec_id", "start_ms", "n", F.bround(F.col("start_ms") / 1000, 0).cast("bigint").alias("t0"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
    x = F.when(F.col("n") == 1, 0.0).otherwise(F.col("j") / (F.col("n") - 1))
    w = 0.01 + 630 * F.pow(x, F.lit(4)) * F.pow(1 - x, F.lit(4))
    t = t.select("rec_id", (F.col("t0") + F.col("j")).alias("tick"), ((F.floor(F.col("start_ms") / 1000) * 7 + F.col("j")) % 11).cast("double").alias("v"), w.alias("w"))
    return t.groupBy("rec_id", "tick").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("value"))


_DIA = """dia as (select distinct rec_id, diar_id, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e from diarization_segment
  where start_time is not null and end_time is not null and rec_id is not null)"""


def _dia(spark, sf):
    return table(spark, sf, "diarization_segment").select("rec_id", "diar_id", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e")).dropna().distinct()


@query(f"""with {_DIA}, n as (select *, cast(ceil((e - s) / 5000.0) as bigint) as n from dia where e - s >= 100),
p as (select rec_id, diar_id, unnest(range(0, n)) as i, s, e, n from n)
select rec_id, diar_id, s + (e - s) * i / n as a, s + (e - s) * (i + 1) / n as b from p where n = 1 or (e - s) / n > 500""")
def segment_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Segments below 0.1 s dropped, above 5 s split evenly; pieces of a split kept if above 0.5 s."""
    n = F.ceil((F.col("e") - F.col("s")) / 5000)
    p = _dia(spark, sf).filter("e - s >= 100").withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    at = lambda i: F.col("s") + (F.col("e") - F.col("s")) * i / F.col("n")
    return p.filter("n = 1 or (e - s) / n > 500").select("rec_id", "diar_id", at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b"))


@query(f"with {_LEN}, {_DIA} select rec_id, 0 as a, ms as b from rec where ms < 30000 union all select rec_id, s, e from dia join rec using (rec_id) where ms >= 30000 and e > s")
def longform_vad(spark: SparkSession, sf: str) -> DataFrame:
    """What a transcriber is given: short audio whole, long audio by its voiced segments."""
    r = _lengths(spark, sf)
    short = r.filter("ms < 30000").select("rec_id", F.lit(0).cast("bigint").alias("a"), F.col("ms").alias("b"))
    return short.unionAll(_dia(spark, sf).filter("e > s").join(r.filter("ms >= 30000"), "rec_id").select("rec_id", "s", "e"))


#: Words of context before a text.
HISTORY = 100

_SEGWORDS = f"""seg as (select distinct rec_id, seg_id, start_time, {sql_tokens('text')} as w from timed_text where text is not null and len({sql_tokens('text')}) > 0)"""


@query(f"""with {_SEGWORDS}, h as (select rec_id, seg_id, flatten(list(w) over (partition by rec_id order by start_time, seg_id rows between {HISTORY} preceding and 1 preceding)) as h from seg)
select rec_id, seg_id, array_to_string(coalesce(h[-{HISTORY}:], []), ' ') as history from h""")
def context_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred words said before each text: every text has one at least, so a hundred rows before it are enough."""
    seg = table(spark, sf, "timed_text").filter("text is not null").select("rec_id", "seg_id", "start_time", tokenize(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    slot = F.floor(F.col("start_time") / 600)
    h = trailing(seg, ["rec_id"], ["start_time", "seg_id"], slot, HISTORY, lambda w: F.flatten(F.collect_list("w").over(w)), "h", own=False)
    last = F.when(F.size("h") > HISTORY, F.slice("h", -HISTORY, HISTORY)).otherwise(F.col("h"))
    return h.select("rec_id", "seg_id", F.array_join(last, " ").alias("history"))


@query(f"""with recursive {SQL_TRUTH}, tx as (select rec_id, min(text) as text from truth group by 1),
tt as (select row_number() over (order by rec_id) as place, list_transform({sql_tokens('text')}, lambda w: 1 + (31 * length(w) + unicode(w)) % 63) as tokens from tx),
fr as (select label, row_number() over (partition by label order by vec_id) as t, list_transform(embedding, lambda y: cast(y as double)) as x from embeddings where embedding is not null and label is not null),
lab as (select label, row_number() over (order by label) as place, n from (select label, count(*) as n from fr group by 1)),
job as (select label, n, tokens, flatten([[0], flatten(list_transform(tokens, lambda k: [k, 0]))]) as sym,
  len(tokens) + len(list_filter(range(2, len(tokens) + 1), lambda i: tokens[i] = tokens[i - 1])) as need from lab join tt using (place) where len(tokens) > 0),
v as (
  select label, n, sym, 1 as t, list_transform(range(1, len(sym) + 1), lambda s: case when s <= 2 then x[sym[s] + 1] else -1e300 end) as score, [cast([] as bigint[])] as back
  from job join fr using (label) where t = 1 and n >= need
  union all
  select label, n, sym, t, list_transform(o, lambda z: z.best + x[z.sym + 1]), list_append(back, list_transform(o, lambda z: z.move)) from (
    select v.label, v.n, v.sym, f.t, f.x, v.back, list_transform(list_transform(range(1, len(v.sym) + 1), lambda s: {{'s': s, 'a': v.score[s], 'b': case when s > 1 then v.score[s - 1] else -1e301 end,
      'c': case when s > 2 and v.sym[s] <> 0 and v.sym[s] <> v.sym[s - 2] then v.score[s - 2] else -1e301 end}}),
      lambda q: {{'best': greatest(q.a, q.b, q.c), 'sym': v.sym[q.s], 'move': case when q.a >= q.b and q.a >= q.c then 0 when q.b >= q.c then 1 else 2 end}}) as o
    from v join fr f on v.label = f.label and f.t = v.t + 1)),
path as (
  select label, t, back, sym, case when score[-1] > score[-2] then len(sym) else len(sym) - 1 end as s from v where t = n
  union all select label, t - 1, back, sym, s - back[t][s] from path where t > 1),
spans as (select label, s // 2 - 1 as token, any_value(sym[s]) as sym, min(t) - 1 as first, max(t) as last from path where s % 2 = 0 group by 1, 2),
few as (select label, unnest(range(0, len(tokens))) as token, unnest(tokens) as sym, null as first, null as last from job where n < need)
select cast(label as integer) as label, cast(token as integer) as token, cast(sym as integer) as sym, cast(first as integer) as first, cast(last as integer) as last from (select * from spans union all select * from few)""")
def forced_align(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each word of a given transcript, by the most probable path through its classes; null where there are too few frames.

    The transcripts come from elsewhere: labels and truths are paired in the order of their numbers, words are classes 1 to 63 by their length and first letter.
    """
    schema = "label int, token int, sym int, first int, last int"

    def run(frames: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        if frames.empty or text.empty:
            return pd.DataFrame(columns=["label", "token", "sym", "first", "last"])
        logp = _log_probabilities(frames)
        tokens = [int(c) for c in text["tokens"].iloc[0]]
        try:
            rows = forced_alignment(logp, tokens, 0)
        except ValueError:
            rows = [(k, None, None) for k in range(len(tokens))]
        return pd.DataFrame({"label": frames["label"].iloc[0], "token": [k for k, _, _ in rows], "sym": [tokens[k] for k, _, _ in rows], "first": [a for _, a, _ in rows], "last": [b for _, _, b in rows]}).astype({"first": "Int32", "last": "Int32"})

    e, t = _frames_and_truths(spark, sf)
    t = t.select("of", F.transform(tokenize(F.col("text")), lambda w: (1 + (31 * F.length(w) + F.ascii(w)) % 63).cast("int")).alias("tokens"))
    return e.groupBy("label").cogroup(t.groupBy("of")).applyInPandas(run, schema)


def _frames_and_truths(spark, sf):
    """Frames of all labels, and the truth paired with each: of, rec_id, text."""
    e = table(spark, sf, "embeddings").filter("embedding is not null and label is not null").select("label", "vec_id", "embedding")
    t = truth(spark, sf).groupBy("rec_id").agg(F.min("text").alias("text")).select(F.row_number().over(W.orderBy("rec_id")).alias("place"), "rec_id", "text")
    return e, e.select("label").distinct().withColumn("place", F.row_number().over(W.orderBy("label"))).join(t, "place").select(F.col("label").alias("of"), "rec_id", "text")


def _log_probabilities(frames: pd.DataFrame) -> np.ndarray:
    x = np.stack(frames.sort_values("vec_id")["embedding"].to_numpy()).astype(np.float64)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


_CUT = T.StructType([T.StructField("cut", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_CUT)
def _said_by(text: pd.Series, seconds: pd.Series, at: pd.Series) -> pd.DataFrame:
    """The truth cut at a time, its baseline spread evenly."""
    rows = []
    for t, n, x in zip(text, seconds, at):
        try:
            blocks = parse(t)
            count = len(baseline_words(blocks))
            step = n / max(count, 1)
            rows.append((render(starting_part(fill_times(blocks, [(i * step, (i + 1) * step) for i in range(count)], n), x)), None))
        except (ValueError, MultivariantError) as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["cut", "error"])


@query(None)
def fill_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Times of all words of a truth, variants and wildcards included, by forced alignment of its baseline with frames, 25 a second; or why there are none.

    Labels' frames and truths are paired in the order of their numbers, as in forced_align. A label's frames lie in one task, since each
    frame of the best path depends on all others: at 25 a second an hour has 90,000.
    """
    schema = "label int, rec_id bigint, uid int, word string, start_time double, end_time double, error string"

    def run(frames: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frames) and len(text):
            label, rec, t = int(frames["label"].iloc[0]), int(text["rec_id"].iloc[0]), text["text"].iloc[0]
            try:
                blocks = parse(t)
                words = baseline_words(blocks)
                spans = forced_alignment(_log_probabilities(frames), [1 + (31 * len(w["value"]) + ord(w["value"][0])) % 63 for w in words], 0)
                timed = fill_times(blocks, [(a / 25, b / 25) for _, a, b in spans], len(frames) / 25)
                rows = [(label, rec, w["uid"], w["value"], w["start_time"], w["end_time"], None) for b in timed for o in b["options"] for w in o]
            except (ValueError, MultivariantError) as e:
                rows = [(label, rec, None, None, None, None, str(e))]
        return pd.DataFrame(rows, columns=["label", "rec_id", "uid", "word", "start_time", "end_time", "error"]).astype({"uid": "Int32", "start_time": "float64", "end_time": "float64"})

    e, t = _frames_and_truths(spark, sf)
    return e.groupBy("label").cogroup(t.groupBy("of")).applyInPandas(run, schema)


@query(None)
def prefix_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Each truth as far as it is said by the middle of its recording."""
    t = truth(spark, sf).join(_lengths(spark, sf), "rec_id")
    return t.select("rec_id", _said_by.asNondeterministic()("text", F.col("ms") / 1000, F.col("ms") / 2000).alias("x")).select("rec_id", "x.cut", "x.error")


@query(f"""with {SQL_TRUTH}, b as (select rec_id, unnest(regexp_extract_all(text, '\\{{[^{{}}]*\\}}')) as block from truth), d as (select distinct block from b),
o as (select block, unnest(string_split(block[2:-2], '|')) as o, unnest(range(0, len(string_split(block[2:-2], '|')))) as i from d),
t as (select block, i, {sql_tokens('o')} as w from o), s as (select block, i, length(array_to_string(w, ' ')) + case when len(w) = 1 then 0.5 else 0 end as score from t)
select block, i as option, cast(score as double) as score, row_number() over (partition by block order by score desc, i) as place from s""")
def option_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Options of every block, the longest first, single words before as long ones of several."""
    b = truth(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("block")).distinct()
    o = b.select("block", F.posexplode(F.split(F.expr("substring(block, 2, length(block) - 2)"), r"\|")).alias("option", "o")).withColumn("w", tokenize(F.col("o")))
    score = (F.length(F.array_join("w", " ")) + F.when(F.size("w") == 1, 0.5).otherwise(0.0)).cast("double")
    place = F.row_number().over(W.partitionBy("block").orderBy(F.desc("score"), "option"))
    return o.select("block", F.col("option").cast("bigint").alias("option"), score.alias("score")).withColumn("place", place.cast("bigint"))


@query(f"""with recursive {SQL_TRUTH}, w as (select rec_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from truth),
p as (select rec_id, w, 1 as i, [w[1]] as parts from w where len(w) > 0
  union all select rec_id, w, i + 1, case when length(parts[-1]) + 1 + length(w[i + 1]) <= 40 then list_concat(parts[:-2], [parts[-1] || ' ' || w[i + 1]]) else list_append(parts, w[i + 1]) end from p where i < len(w))
select rec_id, parts from p where i = len(w)""")
def pack_by_space(spark: SparkSession, sf: str) -> DataFrame:
    return truth(spark, sf).select("rec_id", pack(F.col("text"), 40).alias("parts")).filter(F.size("parts") > 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _merged(parts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else merge_sentences(list(p), 230, 60) for p in parts])


@query(f"""with recursive {SQL_TRUTH}, s as (select rec_id, unnest(l) as s, unnest(range(0, len(l))) as k from (select rec_id, list_filter(regexp_split_to_array(text, '[.!?]+ +'), lambda x: x <> '') as l from truth)),
w as (select rec_id, k, s, list_filter(string_split(s, ' '), lambda x: x <> '') as w from s where length(s) > 230),
p as (select rec_id, k, w, 1 as i, [w[1]] as parts from w where len(w) > 0
  union all select rec_id, k, w, i + 1, case when length(parts[-1]) + 1 + length(w[i + 1]) <= 230 then list_concat(parts[:-2], [parts[-1] || ' ' || w[i + 1]]) else list_append(parts, w[i + 1]) end from p where i < len(w)),
short as (select rec_id, k, [s] as parts from s where length(s) <= 230 union all select rec_id, k, parts from p where i = len(w)),
m as (select rec_id, coalesce(flatten(list(parts order by k) filter (parts is not null)), []) as parts, 1 as i from truth left join short using (rec_id) group by 1
  union all select rec_id, list_concat(list_concat(parts[:i - 1], [parts[i] || ' ' || parts[i + 1]]), parts[i + 2:]), i from (
    select rec_id, parts, list_min(list_filter(list_transform(range(1, len(parts)), lambda j: {{'n': length(parts[j]) + length(parts[j + 1]) + 1, 'i': j, 's': least(length(parts[j]), length(parts[j + 1]))}}), lambda x: x.n <= 230 and x.s < 60)).i as i from m)
  where i is not null)
select rec_id, length(array_to_string(parts, ' ')) as chars, parts from m qualify row_number() over (partition by rec_id order by len(parts)) = 1""")
def sentence_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences, those over 230 characters split by space first, merged to at most 230; a longer word stands alone. Their number of characters joined, and the parts."""
    sentences = F.filter(F.split("text", "[.!?]+ +"), lambda x: x != "")
    short = F.flatten(F.transform(sentences, lambda x: F.when(F.length(x) > 230, pack(x, 230)).otherwise(F.array(x))))
    parts = truth(spark, sf).select("rec_id", _merged(short).alias("parts"))
    return parts.select("rec_id", F.length(F.array_join("parts", " ")).cast("bigint").alias("chars"), "parts")


@query(f"""with {_WORDS}, lim as (select unnest(range(0, 10)) as n, unnest({list(EDITS)}) as k),
near as (select w, d, dist from apart, lim where lim.n = least(length(w), 9) and dist <= lim.k),
best as (select w, min(dist) as dist from near group by 1)
select near.w, min(d) as correction, near.dist from near join best on near.w = best.w and near.dist = best.dist where near.dist > 0 group by 1, 3 having count(*) = 1""")
def fuzzy_correct(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the recordings corrected to the one nearest dictionary word within the edits their length allows."""
    said, d = said_and_dictionary(spark, sf)
    limit = F.get(F.array(*map(F.lit, EDITS)), F.least(F.length("w"), F.lit(9)))
    near = edit_neighbours(said, d, "w", "d", 3).filter(F.col("dist") <= limit)
    best = near.groupBy("w").agg(F.min(F.struct("dist", "d")).alias("m"), F.collect_list("dist").alias("all"))
    one = F.size(F.filter("all", lambda x: x == F.col("m.dist"))) == 1
    return best.filter(one & (F.col("m.dist") > 0)).select("w", F.col("m.d").alias("correction"), F.col("m.dist").cast("bigint").alias("dist"))


@query(f"""with {SQL_TRUTH}, cut as (select *, regexp_replace(text, '\\{{[^{{}}]*\\}}', chr(1), 'g') as bare from truth)
select rec_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: case when regexp_full_match(x, '[0-9]+') then '#' else x end), '') as text
from cut where not regexp_matches(bare, '[{{}}]|[^\\s\\p{{Z}}]\\x01|\\x01[^\\s\\p{{Z}}]')""")
def apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers put by a sign, from right to left at the offsets of their tokens."""
    t = truth(spark, sf).select("rec_id", "text", parse_multivariant("text").alias("p")).filter("p.error is null")
    tokens = F.flatten(F.flatten(F.transform("p.blocks", lambda b: b["options"])))
    # Spellings that a written option only stands for are not in the text.
    written = lambda k: F.substr(F.col("text"), k["start_pos"] + 1, k["end_pos"] - k["start_pos"]) == k["value"]
    numbers = F.transform(F.filter(tokens, lambda k: k["value"].rlike("^[0-9]+$") & written(k)), lambda k: F.struct(k["start_pos"].alias("start_pos"), k["end_pos"].alias("end_pos"), F.lit("#").alias("value")))
    return t.select("rec_id", splice(F.col("text"), numbers).alias("text"))


#: Words that are no terms.
STOPWORDS = ("что", "как", "это", "его", "для", "при", "или", "наш", "после", "только", "ещё")
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[а-яё]{{3,}}')) as term from documents) select term, count(distinct doc_id) as docs, count(*) as n from w where term not in ({_STOP}) group by 1")
def term_extract(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[а-яё]{3,}"), F.lit(0))).alias("term"))
    per = w.filter(~F.col("term").isin(*STOPWORDS)).groupBy("term", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("term").agg(F.count("*").alias("docs"), F.sum("k").alias("n"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""with p as (select p_partkey as k, lower(p_name) as name, list_transform(string_split('{_LETTERS}', ''), lambda c: cast(length(lower(p_name)) - length(replace(lower(p_name), c, '')) as double)) as v from part),
s as (select q.k as query, p.k as hit, round(0.6 * list_cosine_similarity(q.v, p.v) + 0.4 * (1 - levenshtein(q.name, p.name) / greatest(length(q.name), length(p.name))), 6) as score
  from p q, p where q.k % 100 = 0 and p.k <> q.k)
select query, hit, score, row_number() over (partition by query order by score desc, hit) as place from s where score > 0.7 qualify place <= 5""")
def term_similarity_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Terms most like each query term (every number divisible by 100) by 0.6 cosine of letters + 0.4 edit likeness, above 0.7: five each."""
    name = F.lower("p_name")
    vector = F.transform(F.array(*map(F.lit, _LETTERS)), lambda c: (F.length(name) - F.length(F.replace(name, c, F.lit("")))).cast("double"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("hit"), name.alias("name"), vector.alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    p = p.withColumn("n", norm(F.col("v")))
    q = p.filter("hit % 100 = 0").select(F.col("hit").alias("query"), F.col("name").alias("qname"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    rows, asked = grid(p, q, "hit", "query")
    met = rows.join(asked, "__cell").filter("query != hit")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    score = F.round(0.6 * dot / (F.col("n") * F.col("qn")) + 0.4 * (1 - F.levenshtein("qname", "name") / F.greatest(F.length("qname"), F.length("name"))), 6)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "hit")).cast("bigint")
    return met.select("query", "hit", score.alias("score")).filter("score > 0.7").withColumn("place", place).filter("place <= 5")


@query(f"with {SQL_TRUTH}, w as (select rec_id, {sql_tokens('text')} as t from truth) select rec_id, array_to_string(list_transform(t, lambda x, i: case when i % 4 = 0 then '{{' || x || '|' || x || x || '}}' else x end), ' ') as text from w")
def mv_inject(spark: SparkSession, sf: str) -> DataFrame:
    """Variants put in for every fourth word."""
    t = truth(spark, sf).select("rec_id", tokenize(F.col("text")).alias("t"))
    return t.select("rec_id", F.array_join(F.transform("t", lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("{"), x, F.lit("|"), x, x, F.lit("}"))).otherwise(x)), " ").alias("text"))


@query("select distinct token_id, value from transcript_token where regexp_full_match(value, '[\\x{0400}-\\x{04FF} ]+')")
def is_script(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcript_token").select("token_id", "value").filter(F.col("value").rlike("^[Ѐ-ӿ ]+$")).distinct()


@query("""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<a [^>]*>([^<]*)</a>', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_#`]+', '', 'g'), '[ \\t]+', ' ', 'g'), ' ') as text from documents""")
def clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    for pattern, by in (("<a [^>]*>([^<]*)</a>", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("[*_#`]+", ""), ("[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return table(spark, sf, "documents").select("doc_id", F.trim(text).alias("text"))


def _frequency(spark, sf):
    """w, n, zipf of every word of the documents."""
    c = materialize(table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "word-counts")
    return c.select("w", "n", zipf(F.col("n"), c.agg(F.sum("n").alias("t")).scalar()).alias("zipf"))


_SEGMENTED = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')"
_DOMAIN = f"""freq as (select w, n, log10(n / (sum(n) over ()) * 1e9) as zipf from (select w, count(*) as n from (select unnest({sql_tokens("text")}) as w from documents) group by 1)),
dom0 as (select distinct unnest([lower(w), replace(lower(w), 'ё', 'е')]) as w from (select unnest({sql_tokens("p_name")}) as w from part)),
dom as (select w from dom0 where w not in (select w from freq where zipf >= 6))"""


@query(f"with {_DOMAIN} select w from dom")
def rare_domain_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the dictionary of parts, as far as they are rare in the documents."""
    words = table(spark, sf, "part").select(F.explode(tokenize(F.col("p_name"))).alias("w"))
    return domain_words(words, _frequency(spark, sf), 6.0)


@query(f"""with {SQL_TRUTH}, {_DOMAIN}, r as (select distinct rec_id, text from truth), seg as (select rec_id, unnest({_SEGMENTED}) as x, unnest(range(0, len({_SEGMENTED}))) as i from r),
lim as (select unnest(range(0, 10)) as n, unnest({list(EDITS)}) as k),
said as (select distinct x as w, replace(lower(x), 'ё', 'е') as lemma from seg, lim where regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]') and n = least(length(x), 9) and k > 0),
odd as (select * from said where lemma not in (select w from freq where zipf > 1)),
apart as (select lemma, d.w as entry, {sql_distance("lemma", "d.w")} as dist from (select distinct lemma from odd), dom d where abs(length(lemma) - length(d.w)) <= 3),
best as (select lemma, min(dist) as dist from apart group by 1),
one as (select lemma, any_value(entry) as entry, dist from apart join best using (lemma, dist) group by 1, 3 having count(*) = 1),
fix as (select w, case when w[1] <> lower(w[1]) then upper(entry[1]) || lower(entry[2:]) else entry end as c from odd join one using (lemma), lim where n = least(length(w), 9) and dist <= k and entry <> lemma)
select rec_id, string_agg(coalesce(c, x), '' order by i) as text from seg left join fix on x = w group by 1""")
def corrected_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The recordings' texts, words unknown to the documents corrected by the dictionary of parts."""
    t = truth(spark, sf).select("rec_id", "text")
    words = t.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    frequency = _frequency(spark, sf)
    domain = domain_words(table(spark, sf, "part").select(F.explode(tokenize(F.col("p_name"))).alias("w")), frequency, 6.0)
    return correct_texts(t, "rec_id", "text", word_corrections(words, domain, frequency)).filter("text != ''")


@query(f"""with {_DOMAIN}, p as (select p_partkey, unnest({sql_tokens("p_name")}) as w from part)
select p_partkey, case when bool_or(n is null) then 0.0 else round(log10(1e9 / sum(t / n)), 6) end as zipf from p left join freq using (w), (select sum(n) as t from freq) group by 1""")
def phrase_zipf(spark: SparkSession, sf: str) -> DataFrame:
    """How frequent a name of several words is: 1 / f is the sum of its words' 1 / f; 0 if a word is unknown."""
    f = _frequency(spark, sf)
    p = table(spark, sf, "part").select("p_partkey", F.explode(tokenize(F.col("p_name"))).alias("w")).join(f, "w", "left")
    whole = F.log10(F.lit(1e9) / F.sum(F.pow(F.lit(10.0), 9 - F.col("zipf"))))
    return p.groupBy("p_partkey").agg(F.when(F.bool_or(F.col("n").isNull()), 0.0).otherwise(F.round(whole, 6)).alias("zipf"))


#: Phrases and what is accepted for them; some hold others.
PHRASES = {"word lattice": "{word lattice|lattice}", "lattice": "{lattice|word lattice}", "pause detector": "{pause detector|detector}", "detector": "{detector|pause finder}", "forty two": "{forty two|42}", "two": "{two|2}"}


def _sql_phrases(text: str) -> str:
    keys = sorted(PHRASES, key=lambda k: (-len(k), k))
    for i, k in enumerate(keys):
        text = f"replace({text}, '{k}', chr(57344) || '{i}' || chr(57345))"
    for i, k in enumerate(keys):
        text = f"replace({text}, chr(57344) || '{i}' || chr(57345), '{PHRASES[k]}')"
    return text


@query(f"with {SQL_TRUTH} select distinct rec_id, {_sql_phrases('text')} as text from truth")
def mv_substitute(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of the truths put by the variants that are accepted for them."""
    return truth(spark, sf).select("rec_id", substitute(F.col("text"), PHRASES).alias("text")).distinct()


@query("select doc_id, url from documents where not coalesce(contains(lower(url), 'shop-') or contains(lower(url), 'tags-'), false)")
def title_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all sites but those of shops and tags."""
    return without_titles(table(spark, sf, "documents").select("doc_id", "url"), "url", ["Shop-", "tags-"])
