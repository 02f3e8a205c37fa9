"""Scans, sinks, projections, tokenization and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.multivariant import parse_multivariant
from tessitura.functions.tokenize import pattern, tokenize
from tessitura.operators.windows import running
from tessitura.plans.common import SQL_PREDICTIONS, SQL_TRUTH, predictions, quoted, sql_tokens, truth
from tessitura.session import shared_folder, table
from tessitura.sources.registry import pcm16, pending, read_predictions, srt_block, write_predictions

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("select lang, source, count(*) as n, sum(length(text)) as chars from documents group by all")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select doc_id, row_number() over (order by md5('0:' || cast(doc_id as varchar)), doc_id) as place from documents qualify place <= 200")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 of a seeded shuffle: a top-k, so no task sorts the table."""
    order = F.md5(F.concat(F.lit("0:"), F.col("doc_id").cast("string")).cast("binary"))
    top = table(spark, sf, "documents").select("doc_id", order.alias("o")).orderBy("o", "doc_id").limit(200)
    return top.select("doc_id", F.row_number().over(W.orderBy("o", "doc_id")).cast("bigint").alias("place"))


@query("select doc_id as id, text as transcription, cast(n_chars as double) as n_chars from documents")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").drop("lang", "source", "url", "crawled_at")
    return df.withColumnsRenamed({"doc_id": "id", "text": "transcription"}).withColumn("n_chars", F.col("n_chars").cast("double"))


@query("select split_name, rec_id, sample_idx from (select distinct rec_id, split_name, sample_idx from recording) where split_name in ('test', 'train', 'validation')")
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits of one table are its rows of three names: one scan, where the names are pushed down."""
    rec = table(spark, sf, "recording").select("split_name", "rec_id", "sample_idx")
    return rec.filter(F.col("split_name").isin("test", "train", "validation")).distinct()


@query(f"with {SQL_TRUTH} select rec_id, dataset_name, sample_idx from truth order by dataset_name nulls first, sample_idx nulls first, rec_id limit 50")
def topk_samples(spark: SparkSession, sf: str) -> DataFrame:
    return truth(spark, sf).orderBy("dataset_name", "sample_idx", "rec_id").select("rec_id", "dataset_name", "sample_idx").limit(50)


@query(f"with {SQL_PREDICTIONS} select pipeline, dataset_name, sample_idx, rec_id, array_to_string(h, ' ') as text from pred where pipeline in ('drop7', 'swap5')")
def predictions_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written by pipeline and dataset and read back for two pipelines: the third one's folders are not opened."""
    path = shared_folder(spark, "predictions")
    write_predictions(predictions(spark, sf).select("pipeline", "dataset_name", "sample_idx", "rec_id", F.array_join("h", " ").alias("text")), path)
    back = read_predictions(spark, path, "sample_idx int, rec_id bigint, text string, pipeline string, dataset_name string")
    return back.filter(F.col("pipeline").isin("drop7", "swap5")).select("pipeline", "dataset_name", "sample_idx", "rec_id", "text")


@query(f"with {SQL_PREDICTIONS} select pipeline, rec_id from pred where not (pipeline = 'drop7' or (pipeline = 'swap5' and coalesce(lang, '') = 'en'))")
def incremental_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).select("pipeline", "rec_id", "lang")
    done = p.filter("pipeline = 'drop7' or (pipeline = 'swap5' and lang = 'en')")
    return pending(p, done, ["pipeline", "rec_id"]).select("pipeline", "rec_id")


@query("select event_id, user_id, event_type, value from events")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("j"))
    return e.select(F.from_json("j", "event_id bigint, user_id bigint, event_type string, value double").alias("x")).select("x.*")


@query("select event_type, sum(cast(json_extract_string(props, '$.k') as bigint)) as total, count(*) as n from events group by all")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("""
with seg as (select distinct rec_id, seg_id, start_time, text from timed_text where text is not null)
select rec_id, string_agg(text, ' ' order by start_time, seg_id) as text from seg group by 1""")
def timed_text_join(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "timed_text").filter("text is not null").select("rec_id", "seg_id", "start_time", "text").distinct()
    parts = F.array_sort(F.collect_list(F.struct("start_time", "seg_id", "text")))
    return seg.groupBy("rec_id").agg(parts.alias("s")).select("rec_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


@query("""
with seg as (select distinct rec_id, seg_id, start_time, text from timed_text where text is not null),
timed as (select rec_id, string_agg(text, ' ' order by start_time, seg_id) as text from seg group by 1),
plain as (select rec_id, min(transcription) as text from recording where rec_id is not null group by 1)
select p.rec_id, case when t.rec_id is null then 'transcription' else 'timed_transcription' end as type, case when t.rec_id is null then p.text else t.text end as text
from plain p left join timed t using (rec_id)""")
def result_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a result of either type: timed results are their segments joined, in order of time, the others their output."""
    seg = table(spark, sf, "timed_text").filter("text is not null").select("rec_id", "seg_id", "start_time", "text").distinct()
    timed = seg.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "seg_id", "text"))).alias("segments"))
    r = table(spark, sf, "recording").filter("rec_id is not null").groupBy("rec_id").agg(F.min("transcription").alias("output")).join(timed, "rec_id", "left")
    r = r.withColumn("type", F.when(F.col("segments").isNull(), "transcription").otherwise("timed_transcription"))
    text = F.when(F.col("type") == "timed_transcription", F.array_join(F.transform("segments", lambda s: s["text"]), " ")).otherwise(F.col("output"))
    return r.select("rec_id", "type", text.alias("text"))


@query("""
select distinct rec_id, cast(len(audio.array) as double) / audio.sampling_rate as seconds from recording
where audio.sampling_rate > 0 and cast(len(audio.array) as double) / audio.sampling_rate <= 60""")
def duration_filter(spark: SparkSession, sf: str) -> DataFrame:
    rec = table(spark, sf, "recording").filter("audio.sampling_rate > 0 and audio.array is not null")
    return rec.select("rec_id", (F.size("audio.array").cast("double") / F.col("audio.sampling_rate")).alias("seconds")).filter("seconds <= 60").distinct()


@query("""
with seg as (select distinct rec_id, seg_id, start_time, end_time, text from timed_text where text is not null and start_time is not null and end_time is not null),
n as (select *, row_number() over (partition by rec_id order by start_time, seg_id) as k,
  cast(round(start_time * 1000) as bigint) a, cast(round(end_time * 1000) as bigint) b from seg)
select rec_id, seg_id, cast(k as varchar) || chr(10)
  || format('{:02d}:{:02d}:{:02d},{:03d}', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> '
  || format('{:02d}:{:02d}:{:02d},{:03d}', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) as srt from n""")
def srt_render(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "timed_text").filter("text is not null and start_time is not null and end_time is not null").select("rec_id", "seg_id", "start_time", "end_time", "text").distinct()
    seg = running(seg, ["rec_id"], ["start_time", "seg_id"], F.floor(F.col("start_time") / 600), {"n": ("sum", F.lit(1))})
    return seg.select("rec_id", "seg_id", srt_block(F.col("n"), F.col("start_time"), F.col("end_time"), F.col("text")).alias("srt"))


@query("""
select rec_id, max(list_sum(list_transform(audio.array, lambda x: case when x is null or isnan(x) then 0
  else greatest(least(cast(trunc(cast(x as float) * 32768) as bigint), 32767), -32768) end))) as total, max(len(audio.array)) as n
from recording where audio.array is not null group by 1""")
def pcm16_convert(spark: SparkSession, sf: str) -> DataFrame:
    rec = table(spark, sf, "recording").filter("audio.array is not null")
    total = F.when(F.size("audio.array") > 0, F.aggregate(pcm16(F.col("audio.array")), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return rec.select("rec_id", total.alias("total"), F.size("audio.array").alias("n")).groupBy("rec_id").agg(F.max("total").alias("total"), F.max("n").cast("bigint").alias("n"))


def _tokens(name: str, method: str, drop: bool) -> None:
    @query(f"with {SQL_TRUTH}, w as (select rec_id, unnest({sql_tokens('text', method, drop)}) as token from truth) select rec_id, token, count(*) as n from w group by all")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = truth(spark, sf).select("rec_id", F.explode(tokenize(F.col("text"), method, drop)).alias("token"))
        return w.groupBy("rec_id", "token").agg(F.count("*").alias("n"))

    QUERIES[name], ORACLE[name] = QUERIES.pop("run"), ORACLE.pop("run")


_tokens("tokenize_default", "default", True)
_tokens("tokenize_wordpunct", "wordpunct", True)
_tokens("tokenize_space", "space", True)
_tokens("tokenize_keep_punct", "default", False)


@query("select doc_id, translate(lower(text), 'ёЁ', 'еЕ') as text from documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    from tessitura.functions.tokenize import normalize

    return table(spark, sf, "documents").select("doc_id", normalize(F.col("text")).alias("text"))


def _sql_pieces(what: str) -> str:
    """Readable truths cut into matches of a pattern and single characters, with the place of each."""
    return f"""{SQL_TRUTH}, ok as (select distinct rec_id, text from truth where not regexp_matches(regexp_replace(text, '\\{{[^{{}}]*\\}}', chr(1), 'g'), '[{{}}]|[^\\s\\p{{Z}}]\\x01|\\x01[^\\s\\p{{Z}}]')),
cut as (select rec_id, regexp_extract_all(text, {quoted(what + "|(?s:.)")}) as p from ok),
piece as (select rec_id, unnest(p) as x, unnest(range(0, len(p))) as i from cut),
placed as (select rec_id, i, x, sum(length(x)) over (partition by rec_id order by i) as b from piece)"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return truth(spark, sf).select("rec_id", "text").distinct().select("rec_id", "text", parse_multivariant("text").alias("p")).filter("p.error is null")


@query(f"with {_sql_pieces(r'\{[^{}]*\}')} select rec_id, cast(b - length(x) as integer) as pos_start, cast(b as integer) as pos_end, x as block from placed where length(x) > 1")
def mv_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of variants that the parser finds, cut from the text at the places it tells."""
    b = _parsed(spark, sf).select("rec_id", "text", F.explode(F.filter("p.blocks", lambda b: b["is_mv"])).alias("b"))
    return b.select("rec_id", "b.pos_start", "b.pos_end", F.expr("substring(text, b.pos_start + 1, b.pos_end - b.pos_start)").alias("block"))


@query(f"""with {_sql_pieces(r'\{[^{}]*\}')}, o as (select rec_id, i, trim(unnest(string_split(x[2:-2], '|'))) as o from placed where length(x) > 1),
n as (select rec_id, i, sum(case when regexp_full_match(o, '[\\p{{L}}\\p{{N}}_]\\+') then 4 when regexp_full_match(o, '[\\p{{L}}\\p{{N}}_]+<[\\p{{L}}\\p{{N}}_]+>') then 3 else 1 end) as n from o group by 1, 2)
select rec_id, count(*) as n_blocks, cast(sum(greatest(n, 2)) as bigint) as n_options from n group by 1""")
def mv_option_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each truth and the options they stand for: what is written short expanded, and a single option with its absence."""
    mv = F.filter("p.blocks", lambda b: b["is_mv"])
    n = F.aggregate(mv, F.lit(0).cast("bigint"), lambda s, b: s + F.size(b["options"]))
    return _parsed(spark, sf).select("rec_id", F.size(mv).cast("bigint").alias("n_blocks"), n.alias("n_options")).filter("n_blocks > 0")


@query(f"""with {_sql_pieces(pattern())}, k as (select * from placed where x <> '|' and regexp_full_match(x, {quoted(pattern())}))
select rec_id, cast(row_number() over (partition by rec_id order by i) - 1 as integer) as uid, translate(lower(x), 'ёЁ', 'еЕ') as value, cast(b - length(x) as integer) as start_pos, cast(b as integer) as end_pos from k""")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every truth, options included, with its number and its place in the text."""
    tokens = F.flatten(F.flatten(F.transform("p.blocks", lambda b: b["options"])))
    return _parsed(spark, sf).select("rec_id", F.explode(tokens).alias("k")).select("rec_id", "k.uid", "k.value", "k.start_pos", "k.end_pos")


@query(f"""with {SQL_TRUTH}, p as (select rec_id, regexp_extract_all(translate(lower(text), 'ёЁ', 'еЕ'), '\\{{[^{{}}]*\\}}|' || {quoted(pattern())}) as parts from truth),
e as (select rec_id, list_transform(parts, lambda x: case when x[1] = '{{' then '{{' || array_to_string(list_transform(string_split(x[2:-2], '|'), lambda o: array_to_string(regexp_extract_all(o, {quoted(pattern())}), ' ')), '|')
  || (case when contains(x, '|') then '' else '|' end) || '}}' else x end) as parts from p)
select rec_id, array_to_string(parts, ' ') as text from e""")
def mv_render(spark: SparkSession, sf: str) -> DataFrame:
    """Truths written again from their blocks: variants as {a|b}, everything else normalised."""
    t = truth(spark, sf).select("rec_id", parse_multivariant("text").alias("p")).filter("p.error is null")
    join = lambda o: F.array_join(F.transform(o, lambda k: k["value"]), " ")
    block = lambda b: F.when(b["is_mv"], F.concat(F.lit("{"), F.array_join(F.transform(b["options"], join), "|"), F.lit("}"))).otherwise(join(b["options"][0]))
    return t.select("rec_id", F.array_join(F.transform("p.blocks", block), " ").alias("text"))


@query(f"""with {SQL_TRUTH},
first as (select rec_id, regexp_replace(text, '\\{{([^{{}}|]*)(\\|[^{{}}]*)?\\}}', '\\1', 'g') as text from truth)
select rec_id, {sql_tokens("text")} as words from first""")
def mv_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every block resolved to its first option."""
    t = truth(spark, sf).select("rec_id", parse_multivariant("text").alias("p")).filter("p.error is null")
    return t.select("rec_id", F.transform(F.flatten(F.transform("p.blocks", lambda b: b["options"][0])), lambda k: k["value"]).alias("words"))


@query("""
with tok as (select distinct rec_id, token_id, start_time, end_time from transcript_token)
select rec_id, bool_and(start_time is not null and end_time is not null and not isnan(start_time) and not isnan(end_time)) as timed, count(*) as n from tok group by 1""")
def all_timed(spark: SparkSession, sf: str) -> DataFrame:
    tok = table(spark, sf, "transcript_token").select("rec_id", "token_id", "start_time", "end_time").distinct()
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & ~F.isnan("start_time") & ~F.isnan("end_time")
    return tok.groupBy("rec_id").agg(F.bool_and(timed).alias("timed"), F.count("*").alias("n"))


@query("select distinct token_id, value from transcript_token where regexp_full_match(translate(lower(value), 'ё', 'е'), '[а-я]+')")
def encodable_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_token").select("token_id", "value")
    return t.filter(F.translate(F.lower("value"), "ё", "е").rlike("^[а-я]+$")).distinct()


@query(f"with {SQL_PREDICTIONS} select rec_id, sample_idx, pipeline, array_to_string(h, ' ') as text from pred where dataset_name = 'harbour-calls' and pipeline in ('drop7', 'swap5')")
def dashboard_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).filter((F.col("dataset_name") == "harbour-calls") & F.col("pipeline").isin("drop7", "swap5"))
    return p.select("rec_id", "sample_idx", "pipeline", F.array_join("h", " ").alias("text")).orderBy("sample_idx", "pipeline")


@query(f"""with {SQL_PREDICTIONS}, s as (select rec_id, array_to_string(h, ' ') as text from pred where pipeline in ('drop7', 'dup9'))
select rec_id, count(*) as n from s group by 1 having count(*) = 2 and min(text) <> max(text)""")
def unequal_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).filter(F.col("pipeline").isin("drop7", "dup9")).select("rec_id", F.array_join("h", " ").alias("text"))
    return p.groupBy("rec_id").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).filter("n = 2 and a <> b").select("rec_id", "n")


