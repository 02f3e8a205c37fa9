"""As-of joins: for each probe the last event before it (or the next one), per key.

Probes and events are unioned and swept within slots of (key, time): a slot's window gives what happened in the slot, and one
row per slot carries the last event of all earlier slots. So a key with a third of all rows is spread over its slots, and no
pair of probe and event is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def asof(probes: DataFrame, events: DataFrame, by: Sequence[str], probe_at: Column, event_at: Column, event_seq: Column, values: Sequence[str], *, strict: bool = True, forward: bool = False, slot: int = 86_400_000_000) -> DataFrame:
    """All columns of probes, and the values of the event as of each probe (null where there is none).

    probe_at and event_at are whole numbers (BIGINT), event_seq orders events of equal time: the last wins (forward: the
    first). strict: an event at the probe's own time does not count. Probes and events with a null key or time match nothing;
    such probes are kept.
    """
    sign = -1 if forward else 1
    event = F.struct((sign * event_at.cast("bigint")).alias("at"), (sign * event_seq.cast("bigint")).alias("seq"), F.struct(*values).alias("v"))
    keys = [f"__k{i}" for i in range(len(by))]
    p = probes.select(*[F.col(k).alias(a) for k, a in zip(by, keys)], (sign * probe_at.cast("bigint")).alias("__at"), F.struct("*").alias("__p"))
    e = events.select(*[F.col(k).alias(a) for k, a in zip(by, keys)], (sign * event_at.cast("bigint")).alias("__at"), event.alias("__e")).dropna(subset=[*keys, "__at"])
    side = F.when(F.col("__p").isNotNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    rows = p.unionByName(e, allowMissingColumns=True).withColumn("__slot", F.floor(F.col("__at") / slot)).withColumn("__side", side)
    # One row per key and slot, made by a partial aggregate; struct order is (time, sequence).
    tops = rows.groupBy(*keys, "__slot").agg(F.max("__e").alias("__top"))
    before = W.partitionBy(*keys).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*keys, "__slot", F.max("__top").over(before).alias("__carry")).filter("__carry is not null")
    order = W.partitionBy(*keys, "__slot").orderBy("__at", "__side", F.col("__e.seq"))
    here = rows.withColumn("__here", F.last("__e", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("__p is not null")
    out = here.join(carry, [*keys, "__slot"], "left").withColumn("__v", F.coalesce("__here", "__carry"))
    return out.select("__p.*", *[F.col(f"__v.v.{v}").alias(v) for v in values])


#: Bins that an interval touches at most on its own level, as a power of two; each level's bins are so many times wider than the last one's.
_SPAN_BITS = 6


def _bin_width(level: Column, width: int) -> Column:
    return F.lit(width).cast("bigint") * F.pow(F.lit(2.0), level * _SPAN_BITS).cast("bigint")


def _level(s: Column, e: Column, width: int) -> Column:
    """The first level on which an interval touches few bins."""
    out, most = F.lit(0), width << _SPAN_BITS
    while most < 2**62:
        out, most = out + (e - s > F.lit(most)).cast("int"), most << _SPAN_BITS
    return out


def overlap_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], width: int, spans: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """left and right (columns s, e and others, apart from the keys of different names: right's are rs, re; whole numbers) that overlap, with the overlap.

    Each side meets the other only in bins of ``width`` that both touch; a pair counts in the first of them. An interval of more than
    64 bins lies in bins of a wider level, of which it touches 65 at most, so a far end costs no more than any other; the
    other side lies on its own level and on those above it that this side has (its highest level is a subquery of one row). A
    pair meets on the higher level of the two. ``spans`` may name cheaper tables of the same intervals (before rows were folded) to find the
    highest levels in.
    """
    a = left.filter("e >= s").withColumn("__level", _level(F.col("s"), F.col("e"), width))
    b = right.filter("re >= rs").withColumn("__level", _level(F.col("rs"), F.col("re"), width))
    top = lambda df, s, e: F.coalesce(df.agg(F.max(_level(F.col(s), F.col(e), width)).alias("t")).scalar(), F.lit(0))
    wide, long = spans or (left, right)

    def spread(df, s, e, other, own):
        on = df.select("*", F.explode(F.sequence(F.col("__level"), F.greatest(F.col("__level"), other))).alias("__on")).withColumnRenamed("__level", own)
        w = _bin_width(F.col("__on"), width)
        return on.select("*", F.explode(F.sequence(F.floor(s / w), F.floor(e / w))).alias("__bin"))

    x = spread(a, F.col("s"), F.col("e"), top(long, "rs", "re"), "__la")
    y = spread(b, F.col("rs"), F.col("re"), top(wide, "s", "e"), "__lb")
    both = x.join(y, [*by, "__on", "__bin"]).filter("s < re and rs < e and __on = greatest(__la, __lb)")
    both = both.filter(F.col("__bin") == F.floor(F.greatest("s", "rs") / _bin_width(F.col("__on"), width)))
    return both.withColumn("overlap", F.least("e", "re") - F.greatest("s", "rs")).drop("__on", "__bin", "__la", "__lb")
