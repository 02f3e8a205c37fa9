"""Queries of the llm operators, over whole tables with production parameters, with SQL where it can say the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.encode import encode_corpus
from tessitura.llm.lookalike import ALSO, SHAPES, consistent_texts, lookalike_classes, lookalike_pairs
from tessitura.llm.pack import certificate, packed_documents
from tessitura.llm.split import LIMIT_S, split_recordings
from tessitura.llm.stuffing import stuffed_pages, stuffing
from tessitura.llm.turns import calibrated_pause, rolling_captions, speaker_turns
from tessitura.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    cut = split_recordings(table(spark, sf, "recording"), table(spark, sf, "timed_text"))
    kinds = F.when(F.col("max_gap_us") > LIMIT_S * 1_000_000, F.array(F.lit("oversized"), F.lit("uncuttable"))).otherwise(F.array(F.lit("oversized")))
    return cut.filter(F.size("pieces") > 1).select("rec_id", F.explode(kinds).alias("kind"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    cut = split_recordings(table(spark, sf, "recording"), table(spark, sf, "timed_text"))
    return cut.select("rec_id", "rate", F.posexplode("pieces").alias("piece", "p")).select("rec_id", "piece", "rate", "p.*")


def _looked_at(spark: SparkSession, sf: str) -> DataFrame:
    """kind, of, id, text: transcriptions among each other, token values within their recording; one pass over both."""
    rec = table(spark, sf, "recording").select(F.lit("recording").alias("kind"), F.lit(0).cast("bigint").alias("of"), F.col("rec_id").alias("id"), F.col("transcription").alias("text"))
    tok = table(spark, sf, "transcript_token").select(F.lit("token").alias("kind"), F.col("rec_id").alias("of"), F.col("token_id").alias("id"), F.col("value").alias("text"))
    return rec.unionAll(tok)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(_looked_at(spark, sf), ["kind", "of"], "id", "text").select("kind", "id_a", "id_b")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_classes(_looked_at(spark, sf), ["kind", "of"], "id", "text").select("kind", "of", "id", "class_id", "n_rows", "n_links")


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    rec = consistent_texts(table(spark, sf, "recording").select("rec_id", "transcription").distinct(), ["rec_id"], "transcription")
    tok = consistent_texts(table(spark, sf, "transcript_token").select("token_id", "value").distinct(), ["token_id"], "value")
    return rec.select(F.lit("recording").alias("kind"), F.col("rec_id").alias("id"), "form", "mixed", "whole").unionAll(
        tok.select(F.lit("token").alias("kind"), F.col("token_id").alias("id"), "form", "mixed", "whole")
    )


def _turns(spark: SparkSession, sf: str, **options) -> DataFrame:
    return speaker_turns(table(spark, sf, "timed_text"), table(spark, sf, "diarization_segment"), table(spark, sf, "speaker_alias"), **options)


def p5_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf)


def p5_paused(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that also end at pauses longer than all but a twentieth of the table's."""
    return _turns(spark, sf, pause=calibrated_pause(table(spark, sf, "timed_text")))


def p5_captions(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_captions(table(spark, sf, "timed_text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, with_text=False).select("rec_id", "speaker_idx", "first_seg_id", "last_seg_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents"))


def p7_certificate(spark: SparkSession, sf: str) -> DataFrame:
    return certificate(packed_documents(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents")).filter("n_pieces > 1 and piece = 0").select("doc_id")


def p8_share(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(table(spark, sf, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p4_found": p4_found, "p4_forms": p4_forms, "p4_classes": p4_classes, "p5_found": p5_found, "p5_turns": p5_turns, "p5_paused": p5_paused, "p5_captions": p5_captions, "p6_ids": p6_ids, "p7_found": p7_found, "p7_containers": p7_containers, "p7_certificate": p7_certificate, "p8_found": p8_found, "p8_share": p8_share}
def _sql_look() -> tuple[str, str]:
    """Letters and wide forms for SQL's translate: what is written, and the sign it has the look of."""
    pairs = {c: sign for sign, forms in SHAPES.items() for c in forms.values() if c != sign} | dict(x.split(":") for x in ALSO.split())
    pairs |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for c in map(chr, range(0x0370, 0x0500)):  # composed Greek and Cyrillic letters: their sign with the accent composed anew
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in pairs and len(n := unicodedata.normalize("NFC", pairs[d[0]] + d[1:])) == 1:
            pairs[c] = n
    return "".join(pairs).replace("'", "''"), "".join(pairs.values()).replace("'", "''")


_LOOK = "nfc_normalize(translate(regexp_replace(regexp_replace(regexp_replace({0}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}\\x{{2800}}]', '', 'g'), '[\\s\\p{{Z}}]', ' ', 'g'), 'ﬁ', 'fi', 'g'), '{1}', '{2}'))".format("text", *_sql_look())
_LOOKED_AT = f"""with x as (
  select distinct 'recording' as kind, 0 as of, rec_id as id, transcription as text from recording union all
  select distinct 'token', rec_id, token_id, value from transcript_token where rec_id is not null),
l as (select *, {_LOOK} as look from x where id is not null and text <> ''),
s as (select * from l where trim(look) <> '')"""
ORACLE = {
    "p4_found": _LOOKED_AT + " select a.kind, a.id as id_a, b.id as id_b from s a join s b on a.kind = b.kind and a.of = b.of and a.look = b.look and a.id < b.id and a.text <> b.text",
    "p4_classes": _LOOKED_AT + """, c as (select kind, of, look, min(id) as class_id, count(*) as n_rows from s group by 1, 2, 3 having count(distinct text) > 1),
t as (select kind, of, look, text, count(*) as same from s group by 1, 2, 3, 4)
select kind, of, id, class_id, n_rows, n_rows - same as n_links from s join c using (kind, of, look) join t using (kind, of, look, text)""",
    "p1_found": """
with rec as (
  select rec_id, max(len(audio.array)) n, max(audio.sampling_rate) rate from recording
  where rec_id is not null and audio.sampling_rate > 0 and len(audio.array) > 30 * audio.sampling_rate group by 1),
txt as (
  select distinct rec_id, cast(round(start_time * 1000000) as bigint) s, cast(round(end_time * 1000000) as bigint) e
  from timed_text where end_time is not null and not isnan(end_time)),
cand as (
  select distinct rec_id, e from txt join rec using (rec_id) where e > 0 and e < round(n / rate * 1000000)),
bound as (
  select rec_id, e from cand c where not exists (select 1 from txt t where t.rec_id = c.rec_id and t.s < c.e and t.e > c.e)
  union all select rec_id, 0 from rec union all select rec_id, cast(round(n / rate * 1000000) as bigint) from rec),
gap as (select rec_id, e - lag(e) over (partition by rec_id order by e) g from bound)
select rec_id, 'oversized' as kind from rec
union all select rec_id, 'uncuttable' from gap group by rec_id having max(g) > 30000000""",
    "p5_captions": """
with t as (select distinct rec_id, seg_id, start_time, text from timed_text where rec_id is not null and seg_id is not null and start_time is not null and text is not null),
w as (select rec_id, seg_id, list_filter(string_split(text, ' '), lambda x: true) as w, lag(string_split(text, ' ')) over (partition by rec_id order by start_time, seg_id, text) as b from t),
l as (select rec_id, seg_id, list_transform(w, lambda x: lower(x)) as w, list_transform(b, lambda x: lower(x)) as b from w)
select rec_id, seg_id, cast(coalesce(list_max(list_filter(range(2, least(len(w), len(b)) + 1), lambda k: w[:k] = b[-k:])), 0) as integer) as n_repeated from l""",
}
