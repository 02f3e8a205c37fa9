"""Queries of the general operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.changefeed import standing_after_batches, standing_chunks
from tessitura.operators.intervals import speaker_periods
from tessitura.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return standing_chunks(table(spark, sf, "output_chunk")).select("rec_id", "seq")


def p2_text(spark: SparkSession, sf: str) -> DataFrame:
    return standing_chunks(table(spark, sf, "output_chunk"))


def p2_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a feed appended in three batches, over which repeated rows lie scattered."""
    rows = table(spark, sf, "output_chunk").withColumn("__batch", F.monotonically_increasing_id() % 3)
    return standing_after_batches([rows.filter(F.col("__batch") == k).drop("__batch") for k in (2, 0, 1)])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_periods(table(spark, sf, "diarization_segment"))


_STANDING = """
with changes as (
  select distinct on (rec_id, seq) * from output_chunk
  where not coalesce(is_finish, false) and rec_id is not null and seq is not null order by rec_id, seq, put_ts),
ranked as (
  select *, row_number() over (partition by rec_id, uid order by put_ts desc, seq desc) r from changes)
select {} from ranked
where (uid is null or r = 1) and not coalesce(lower(trim(op)) in ('delete', 'd', 'del', 'remove'), false)"""

_PERIODS = """
with seg as (
  select rec_id, speaker_idx, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e
  from diarization_segment where rec_id is not null and speaker_idx is not null and start_time is not null and end_time is not null),
ahead as (
  select *, max(e) over (partition by rec_id, speaker_idx order by s, e rows between unbounded preceding and 1 preceding) m
  from seg where e > s),
island as (
  select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by rec_id, speaker_idx order by s, e) g from ahead),
period as (select rec_id, speaker_idx, g, min(s) s, max(e) e from island group by 1, 2, 3)
select rec_id, speaker_idx, 'period' as kind, s as start_ms, e as end_ms from period
union all
select rec_id, speaker_idx, 'gap', l, s from (
  select *, lag(e) over (partition by rec_id, speaker_idx order by s) l from period) where l is not null"""

QUERIES = {"p2_found": p2_found, "p2_text": p2_text, "p2_batches": p2_batches, "p3_found": p3_found}
ORACLE = {"p2_found": _STANDING.format("rec_id, seq"), "p2_text": _STANDING.format("rec_id, seq, uid, text"), "p2_batches": _STANDING.format("rec_id, seq, uid, text"), "p3_found": _PERIODS}
