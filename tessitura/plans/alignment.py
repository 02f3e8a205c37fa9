"""Alignment of hypotheses with truths, scores and error rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.alignment import aligned, capped_errors, word_errors
from tessitura.operators.windows import previous
from tessitura.plans.common import PIPELINES, SQL_BUCKETS, SQL_MATCHES, SQL_SCORES, predictions, sql_distance
from tessitura.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """rec_id, dataset_name, pipeline, n_errors, n_words of every prediction, as the kernel counts them; unreadable truths drop out.

    Truths without blocks and wildcards have one reading, whose errors the bit-parallel distance gives; the kernel takes the others.
    """
    p = predictions(spark, sf).withColumn("plain", ~F.col("text").rlike(r"[{}]|<\*>"))
    own = word_errors(F.when(F.col("plain"), F.col("t")), F.col("h"))
    p = p.withColumns({"own": own, "a": aligned(F.when(~F.col("plain"), F.col("text")), F.col("h"))}).filter("a.error is null")
    either = lambda x, y: F.when(F.col("plain"), x).otherwise(F.col(y))
    return p.select("rec_id", "dataset_name", "pipeline", either(F.col("own"), "a.n_word_errors").alias("n_errors"), either(F.size("t"), "a.true_len").alias("n_words"))


def kernel(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with the alignment of the kernel, variants and wildcards of the truth included; unreadable truths drop out."""
    p = predictions(spark, sf).select("rec_id", "dataset_name", "lang", "pipeline", aligned("text", "h").alias("a"))
    return p.filter("a.error is null")


@query(f"with {SQL_SCORES} select rec_id, pipeline, n_word_errors as n_errors from scored")
def align_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("rec_id", "pipeline", "n_errors")


@query(f"""with {SQL_SCORES} select pipeline, sum(n_word_errors) as n_errors, sum(true_len) as n_words, sum(n_word_errors) / greatest(1, sum(true_len)) as wer,
avg(n_word_errors / greatest(1, true_len)) as macro_wer from scored group by 1""")
def wer_by_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    s, n = F.sum("n_errors"), F.sum("n_words")
    macro = F.avg(F.col("n_errors") / F.greatest(F.lit(1), "n_words"))
    return scored(spark, sf).groupBy("pipeline").agg(s.alias("n_errors"), n.alias("n_words"), (s / F.greatest(F.lit(1), n)).alias("wer"), macro.alias("macro_wer"))


@query(f"""with {SQL_SCORES} select dataset_name, pipeline, grouping(dataset_name) + 2 * grouping(pipeline) as level, sum(n_word_errors) as n_errors, sum(true_len) as n_words
from scored join (select rec_id, pipeline, dataset_name from pred) using (rec_id, pipeline) group by rollup (pipeline, dataset_name)""")
def wer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    level = (F.grouping("dataset_name") + 2 * F.grouping("pipeline")).cast("bigint")
    return scored(spark, sf).rollup("pipeline", "dataset_name").agg(level.alias("level"), F.sum("n_errors").alias("n_errors"), F.sum("n_words").alias("n_words")).select("dataset_name", "pipeline", "level", "n_errors", "n_words")


@query(f"""with {SQL_SCORES}, j as (select * from scored where not (pipeline = 'dup9' and rec_id % 3 = 0)),
common as (select rec_id from j group by 1 having count(distinct pipeline) = 3)
select pipeline, count(*) as n, sum(n_word_errors) / greatest(1, sum(true_len)) as wer from j join common using (rec_id) group by 1""")
def common_samples_wer(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates over the samples that every pipeline has, where one pipeline lacks every third recording."""
    s = scored(spark, sf).filter("not (pipeline = 'dup9' and rec_id % 3 = 0)")
    common = s.groupBy("rec_id").agg(F.countDistinct("pipeline").alias("k")).filter("k = 3")
    rate = F.sum("n_errors") / F.greatest(F.lit(1), F.sum("n_words"))
    return s.join(common, "rec_id", "left_semi").groupBy("pipeline").agg(F.count("*").alias("n"), rate.alias("wer"))


@query(f"with {SQL_SCORES} select rec_id, pipeline, cast(true_len as bigint) as n from scored")
def true_len(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a truth that count, as the kernel counts them: those of the options it took, without wildcards."""
    return kernel(spark, sf).select("rec_id", "pipeline", F.col("a.true_len").cast("bigint").alias("n"))


@query(f"with {SQL_SCORES} select rec_id, pipeline, n_word_errors, n_char_errors, n_correct from scored")
def align_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, characters and correct words counted over the kernel's matches: what the alignment is made of adds up to its score."""
    m = F.col("a.matches")
    chars = F.aggregate(m, F.lit(0), lambda s, x: s + x["n_char_errors"])
    return kernel(spark, sf).select(
        "rec_id", "pipeline", F.size(F.filter(m, lambda x: x["status"] != "correct")).alias("n_word_errors"), chars.alias("n_char_errors"),
        F.size(F.filter(m, lambda x: (x["status"] == "correct") & ~x["is_any"])).alias("n_correct"),
    )


@query(f"with {SQL_SCORES} select rec_id, pipeline, array_to_string(t, ' ') as truth, array_to_string(h, ' ') as hyp from scored")
def align_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both texts rebuilt from the kernel's matches; a wildcard stands once however much it took, and of a block the option taken."""
    return readings(kernel(spark, sf)).select("rec_id", "pipeline", F.col("x").alias("truth"), F.col("y").alias("hyp"))


@query(f"with {SQL_MATCHES} select pipeline, status, count(*) as n, sum(n_char_errors) as n_char_errors from matches group by 1, 2")
def match_status(spark: SparkSession, sf: str) -> DataFrame:
    m = kernel(spark, sf).select("pipeline", F.explode("a.matches").alias("m"))
    return m.groupBy("pipeline", F.col("m.status").alias("status")).agg(F.count("*").alias("n"), F.sum("m.n_char_errors").alias("n_char_errors"))


@query(f"""
with w as (select distinct rec_id, token_id, value, lead(value) over (partition by rec_id order by token_id) as nxt from (select distinct rec_id, token_id, value from transcript_token))
select token_id, {sql_distance("value", "nxt")} as d from w where value is not null and nxt is not null""")
def char_distance(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_token").select("rec_id", "token_id", "value").distinct().withColumn("back", -F.col("token_id"))
    t = previous(t, ["rec_id"], ["back"], F.floor(F.col("back") / 10_000), {"nxt": "value"})
    return t.filter("value is not null and nxt is not null").select("token_id", F.levenshtein("value", "nxt").cast("bigint").alias("d"))


@query(f"""with {SQL_SCORES} select pipeline, sum(n_word_errors) as n_word_errors, sum(n_char_errors) as n_char_errors, sum(n_correct) as n_correct, sum(true_len) as true_len,
min(n_word_errors) as best from scored group by 1""")
def score_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Scores added over all samples of each pipeline, and the word errors of the least score in the order of scores."""
    k = kernel(spark, sf)
    return k.groupBy("pipeline").agg(*[F.sum(f"a.{c}").alias(c) for c in ("n_word_errors", "n_char_errors", "n_correct", "true_len")], F.min(F.struct("a.n_word_errors", "a.n_char_errors", (-F.col("a.n_correct")).alias("c")))["n_word_errors"].alias("best"))


def readings(k: DataFrame) -> DataFrame:
    """k with x, the text of the reading of the truth that each alignment took (a wildcard stands once), and y, that of the hypothesis."""
    words = lambda m: F.array_join(F.transform(m, lambda x: x["w"]), " ")
    # Neighbouring matches of one wildcard have its number; a truth's word has one match.
    true = F.filter("a.matches", lambda m, i: m["true_uid"].isNotNull() & ((i == 0) | ~m["true_uid"].eqNullSafe(F.get("a.matches", i - 1)["true_uid"])))
    pred = F.filter("a.matches", lambda m: m["pred_uid"].isNotNull())
    return k.withColumns({"x": words(F.transform(true, lambda m: F.struct(m["true"].alias("w")))), "y": words(F.transform(pred, lambda m: F.struct(m["pred"].alias("w"))))})


@query(f"""with {SQL_SCORES}, w as (select s.*, p.lang, array_to_string(s.t, ' ') as x, array_to_string(s.h, ' ') as y from scored s join (select rec_id, pipeline, lang from pred) p using (rec_id, pipeline))
select lang, pipeline, sum(n_char_errors) as by_words, sum({sql_distance("x", "y")}) as by_text, sum(length(x)) as n_chars from w group by 1, 2""")
def cer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Character errors by language: summed over word matches, and the distance of the texts written with spaces, of the reading the alignment took."""
    both = readings(kernel(spark, sf))
    return both.groupBy("lang", "pipeline").agg(F.sum("a.n_char_errors").alias("by_words"), F.sum(F.levenshtein("x", "y")).alias("by_text"), F.sum(F.length("x")).alias("n_chars"))


@query(f"""with {SQL_MATCHES}, runs as (select *, i - row_number() over (partition by rec_id, pipeline, status = 'insertion' order by i) as run from matches),
one as (select rec_id, pipeline, status = 'insertion' as ins, run, count(*) filter (status <> 'correct') as n from runs group by all)
select rec_id, pipeline, cast(n_word_errors as integer) as n_errors, cast(coalesce(sum(case when ins then least(n, 4) else n end), 0) as integer) as capped from scored left join one using (rec_id, pipeline) group by 1, 2, 3""")
def insertion_capped_errors(spark: SparkSession, sf: str) -> DataFrame:
    return kernel(spark, sf).select("rec_id", "pipeline", F.col("a.n_word_errors").alias("n_errors"), capped_errors(F.col("a.matches")).alias("capped"))


@query(f"with {SQL_SCORES} select rec_id, pipeline, cast(choice as integer[]) as options from scored")
def mv_selected(spark: SparkSession, sf: str) -> DataFrame:
    """The option that the alignment took of each block, in order."""
    return kernel(spark, sf).select("rec_id", "pipeline", F.col("a.options").alias("options"))


def buckets(k: DataFrame) -> DataFrame:
    """rec_id, pipeline, slot, true, words, has_error: slot 2i + 1 holds what met truth word i, slot 2i what came before it.

    Words that a wildcard took share its slot. The matches of one alignment are numbered where they are, in the row, so nothing is shuffled
    or gathered: a fold over them opens a slot or adds to the last one.
    """
    m = F.col("a.matches")
    empty = F.array().cast("array<struct<slot:int,true:string,words:array<string>,has_error:boolean,uid:int>>")

    def one(slot, x):
        said = F.when(x["pred_uid"].isNull(), F.array().cast("array<string>")).otherwise(F.array(x["pred"]))
        return F.struct(slot.cast("int").alias("slot"), x["true"].alias("true"), said.alias("words"), (x["status"] != "correct").alias("has_error"), x["true_uid"].alias("uid"))

    def add(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        place = F.coalesce(last["slot"], F.lit(0))
        gap = x["true_uid"].isNull()
        # Gaps are even, words odd; a second match of the same wildcard, or a second insertion in one gap, joins the last slot.
        joins = (F.size(acc) > 0) & F.when(gap, place % 2 == 0).otherwise(last["uid"].eqNullSafe(x["true_uid"]))
        slot = F.when(gap, F.floor((place + 1) / 2) * 2).otherwise(F.floor((place + 1) / 2) * 2 + 1)
        new = one(slot, x)
        more = F.struct(last["slot"].alias("slot"), last["true"].alias("true"), F.concat(last["words"], new["words"]).alias("words"), (last["has_error"] | new["has_error"]).alias("has_error"), last["uid"].alias("uid"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(acc, F.array(new)))

    b = k.select("rec_id", "pipeline", F.explode(F.aggregate(m, empty, add)).alias("b"))
    return b.select("rec_id", "pipeline", "b.slot", "b.true", F.array_join("b.words", " ").alias("words"), "b.has_error")


@query(f"with {SQL_BUCKETS} select rec_id, pipeline, cast(slot as integer) as slot, words, has_error from buckets")
def align_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The slots of each alignment in which anything stands."""
    return buckets(kernel(spark, sf)).select("rec_id", "pipeline", "slot", "words", "has_error")


def side_by_side(b: DataFrame, pipelines: Sequence[str]) -> DataFrame:
    """rec_id, slot, truth, and a column for each of any pipelines: the words of each slot, errors in capitals; slots in which nothing stands are left out."""
    cell = F.when(F.col("has_error"), F.upper("words")).otherwise(F.col("words"))
    side = [F.max(F.when(F.col("pipeline") == p, cell)).alias(p) for p in pipelines]
    stands = F.lit(False)
    for p in pipelines:
        stands = stands | (F.coalesce(F.col(p), F.lit("")) != "")
    return b.groupBy("rec_id", "slot").agg(F.max("true").alias("truth"), *side).filter(F.col("truth").isNotNull() | stands)


@query(f"""with {SQL_BUCKETS}, c as (select *, case when has_error then upper(words) else words end as cell from buckets)
select rec_id, cast(slot as integer) as slot, max("true") as truth, {", ".join(f"max(cell) filter (pipeline = '{p}') as {p}" for p in PIPELINES)} from c group by 1, 2""")
def multi_alignment_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and hypotheses side by side, a row for each slot of each recording in which anything stands; errors in capitals."""
    return side_by_side(buckets(kernel(spark, sf)), list(PIPELINES))
