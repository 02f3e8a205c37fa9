"""Replaying chunk streams: send schedules, remapped times, rechunking, state at each instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators.asof import asof
from tessitura.operators.windows import previous, running


def send_cutoffs(n_samples: Column, rate: Column, interval: float, speed: float = 1.0) -> Column:
    """Array of (t_real, t_audio, arr_pos): what of an audio has been sent after each interval; audio is sent ``speed`` times as fast as it runs."""
    seconds = n_samples / rate
    steps = F.ceil(seconds / (interval * speed) - 1e-6).cast("bigint")

    def cut(k):
        audio = F.least(k * F.lit(interval * speed), seconds)
        return F.struct((k * F.lit(interval)).alias("t_real"), audio.alias("t_audio"), F.least(F.floor(audio * rate + 1e-6), n_samples.cast("bigint")).alias("arr_pos"))

    return F.when(n_samples > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(steps, F.lit(1))), cut))


def remap_times(inputs: DataFrame, outputs: DataFrame, by: Sequence[str], slot: int = 600_000_000) -> tuple[DataFrame, DataFrame]:
    """Times of a run without delays as they would be with input chunks put at ``planned``.

    inputs: by, seq, planned, get_us; outputs: by, seq, put_us (whole microseconds). Whenever a chunk would be fetched before
    it is put, everything later waits for the difference: so the delay at any time is the largest planned - get of the chunks
    fetched up to then (the first chunk is fetched as it is), which is a running maximum, not a loop.
    """
    first = inputs.groupBy(*by).agg(F.min(F.struct("get_us", "seq")).alias("__first"))
    lag = F.when(F.struct("get_us", "seq") > F.col("__first"), F.col("planned") - F.col("get_us"))
    moved = running(inputs.join(first, list(by)), by, ["get_us", "seq"], F.floor(F.col("get_us") / slot), {"__most": ("max", lag)})
    moved = moved.withColumn("__delay", F.greatest("__most", F.lit(0).cast("bigint")))
    ins = moved.select(*by, "seq", F.col("planned").alias("put_us"), (F.col("get_us") + F.col("__delay")).alias("get_us"))
    events = moved.select(*by, F.col("get_us").alias("__g"), F.col("seq").alias("__s"), F.col("__delay").alias("delay"))
    outs = asof(outputs, events, by, F.col("put_us"), F.col("__g"), F.col("__s"), ["delay"], strict=False, slot=slot)
    put = F.col("put_us") + F.coalesce("delay", F.lit(0))
    return ins, outs.select(*by, "seq", put.alias("put_us"), put.alias("get_us"))


def rechunk(chunks: DataFrame, by: Sequence[str], size: int, slot: int = 10_000) -> DataFrame:
    """by, piece, n, seq: chunks of n samples cut anew into pieces of exactly ``size``; what is left comes with the last chunk.

    chunks: by, seq, n. seq is that of the chunk that completes the piece. Only sums are swept; each chunk names the pieces it
    completes.
    """
    ends = chunks.groupBy(*by).agg(F.max("seq").alias("__end"))
    c = running(chunks, by, ["seq"], F.floor(F.col("seq") / slot), {"__to": ("sum", F.col("n"))}).join(ends, list(by))
    c = c.withColumn("__from", F.col("__to") - F.col("n")).withColumn("__last", F.col("seq") == F.col("__end"))
    first, full = F.floor(F.col("__from") / size), F.floor(F.col("__to") / size)
    rest = F.col("__last") & (F.col("__to") % size > 0)
    last = full - 1 + rest.cast("bigint")
    c = c.filter(last >= first).select(*by, "seq", "__to", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("piece"))
    return c.select(*by, "piece", F.least(F.lit(size).cast("bigint"), F.col("__to") - F.col("piece") * size).alias("n"), "seq")


def known_after_each(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, state, seq, put_us, next_us, first_us, last_us, processed, text: the joined text as known after each chunk, in order of put_us, then seq.

    chunks: by, seq, key, text, put_us, done. A version of a key lives until the next version of it; a chunk keeps the place where its key
    was first seen. processed is the last done that is not null, at first 0.

    One shuffle by key serves all windows and the final grouping. A recording of n chunks has n texts, which grow with it: this is for
    recordings, whose length is bounded; streams without an end are followed by ``news``.
    """
    order = W.partitionBy(*by).orderBy("put_us", "seq")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    c = chunks.withColumns({
        "state": F.row_number().over(order), "next_us": F.lead("put_us").over(order), "processed": F.coalesce(F.last("done", ignorenulls=True).over(upto), F.lit(0.0)),
        "__n": F.count(F.lit(1)).over(whole), "first_us": F.min("put_us").over(whole), "last_us": F.max("put_us").over(whole),
    })
    own = W.partitionBy(*by, "key")
    c = c.withColumns({"__until": F.coalesce(F.lead("state").over(own.orderBy("state")) - 1, F.col("__n")), "__first": F.min("seq").over(own)})
    at = F.when(F.col("__i") == F.col("state"), F.struct("seq", "put_us", "next_us", "first_us", "last_us", "processed"))
    lives = c.select("*", F.explode(F.sequence(F.col("state"), F.col("__until").cast("int"))).alias("__i"))
    g = lives.groupBy(*by, "__i").agg(F.array_sort(F.collect_list(F.struct("__first", "text"))).alias("__p"), F.first(at, ignorenulls=True).alias("__a"))
    return g.select(*by, F.col("__i").alias("state"), "__a.*", F.array_join(F.transform("__p", lambda x: x["text"]), " ").alias("text"))


def state_ticks(step_us: int) -> Column:
    """Array of the ticks (of ``step_us`` after a recording's first put) before which a state of ``known_after_each`` was the last."""
    lo = F.floor((F.col("put_us") - F.col("first_us")) / step_us) + 1
    end = F.ceil((F.col("last_us") - F.col("first_us")) / step_us) + 1
    hi = F.when(F.col("next_us").isNull(), end).otherwise(F.floor((F.col("next_us") - F.col("first_us")) / step_us))
    return F.when(hi >= lo, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def news(chunks: DataFrame, by: Sequence[str], step_us: int) -> DataFrame:
    """by, tick, n, text: what was put within each tick, in order; for streams of any length, since only a tick's own chunks are gathered."""
    start = chunks.groupBy(*by).agg(F.min("put_us").alias("__a"))
    c = chunks.join(start, list(by)).withColumn("tick", F.floor((F.col("put_us") - F.col("__a")) / step_us) + 1)
    g = c.groupBy(*by, "tick").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("put_us", "seq", "text"))).alias("__p"))
    return g.select(*by, "tick", "n", F.array_join(F.transform("__p", lambda x: x["text"]), " ").alias("text"))
