"""The benchmark as an API: pipelines run on samples, predictions evaluated against truths, tables to look at.

Models are outside: a pipeline is any function of audio or text. Instances are made once in each task, not once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.alignment import aligned, capped_errors
from tessitura.functions.sequences import chunk_bounds
from tessitura.plans.models import CTC, ContextualTranscriber, Corrector, LongformCTC, LongformVAD, OfflineToStreaming, Segmenter, StreamingToOffline, StreamingTranscriber, TimedTranscriber, Transcriber, stream
from tessitura.sources.registry import pending, read_prediction_tree

__all__ = [
    "CTC", "ContextualTranscriber", "Corrector", "LongformCTC", "LongformVAD", "OfflineToStreaming", "Segmenter", "StreamingToOffline", "StreamingTranscriber", "TimedTranscriber", "Transcriber",
    "corrected", "evaluate", "evaluate_tree", "get_pipeline", "longform_pieces", "metrics", "register_pipeline", "run_pipeline", "run_shards", "run_streaming",
]

SAMPLE = ("dataset_name", "sample_idx")
SEGMENTS = "array<struct<start_time:double,end_time:double,text:string>>"


_PIPELINES: dict[str, Callable[[], object]] = {}


def register_pipeline(name: str):
    """Decorator: a class without arguments, or a function that makes an instance, under a name that must be new."""

    def add(make):
        if name in _PIPELINES:
            raise ValueError(f"pipeline {name!r} is registered already")
        _PIPELINES[name] = make
        return make

    return add


def get_pipeline(name: str) -> Callable[[], object]:
    if name not in _PIPELINES:
        raise ValueError(f"no pipeline {name!r}; there are {sorted(_PIPELINES)}")
    return _PIPELINES[name]


def run_pipeline(samples: DataFrame, name: str, done: DataFrame | None = None, make: Callable[[], object] | None = None) -> DataFrame:
    """pipeline, dataset_name, sample_idx, type, text, segments: a pipeline's output for the samples that are not done yet.

    samples: dataset_name, sample_idx, audio struct(array, sampling_rate). Samples without audio give a null text.
    """
    make = make or get_pipeline(name)
    todo = samples.select(*SAMPLE, F.col("audio.array").alias("samples"), F.col("audio.sampling_rate").alias("rate"))
    if done is not None:
        todo = pending(todo, done.filter(F.col("pipeline") == name), list(SAMPLE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            texts, parts = [], []
            for x, rate in zip(batch["samples"], batch["rate"]):
                if x is None or rate is None or rate != rate:
                    texts.append(None)
                    parts.append(None)
                elif isinstance(model, TimedTranscriber):
                    own = model.transcribe_timed(np.asarray(x), int(rate))
                    parts.append([{"start_time": float(a), "end_time": float(b), "text": t} for a, b, t in own])
                    texts.append(" ".join(t for _, _, t in own))
                else:
                    texts.append(model.transcribe(np.asarray(x), int(rate)))
                    parts.append(None)
            kind = "timed_transcription" if isinstance(model, TimedTranscriber) else "transcription"
            yield pd.DataFrame({"pipeline": name, "dataset_name": batch["dataset_name"], "sample_idx": batch["sample_idx"], "type": kind, "text": texts, "segments": parts})

    return todo.mapInPandas(run, f"pipeline string, dataset_name string, sample_idx int, type string, text string, segments {SEGMENTS}")


def run_streaming(samples: DataFrame, name: str, make: Callable[[], StreamingTranscriber] | None = None, chunk_s: float = 1.0) -> DataFrame:
    """pipeline, dataset_name, sample_idx, seq, uid, text, is_finish, seconds_processed, error: the changes a streaming model tells of each sample, in order.

    Each recording has a model of its own and its own order of chunks. An error ends its recording with one row that tells it, and no other:
    what the model had told before stays, and nothing follows. Samples without audio give FINISH alone.
    """
    make = make or get_pipeline(name)
    todo = samples.select(*SAMPLE, F.col("audio.array").alias("samples"), F.col("audio.sampling_rate").alias("rate"))
    fields = ["seq", "uid", "text", "is_finish", "seconds_processed", "error"]

    def one(x, rate) -> Iterator[tuple]:
        seq, at = 0, 0.0
        try:
            empty = x is None or rate is None or rate != rate
            for at, end, changes in [(0.0, True, [])] if empty else stream(make(), np.asarray(x), int(rate), chunk_s):
                for uid, text in changes:
                    yield seq, uid, text, False, at, None
                    seq += 1
                if end:
                    yield seq, None, None, True, at, None
        except Exception as e:
            yield seq, None, None, False, at, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, d, i, *r) for d, i, x, rate in zip(batch["dataset_name"], batch["sample_idx"], batch["samples"], batch["rate"]) for r in one(x, rate)]
            yield pd.DataFrame(rows, columns=["pipeline", *SAMPLE, *fields])

    return todo.mapInPandas(run, "pipeline string, dataset_name string, sample_idx int, seq bigint, uid string, text string, is_finish boolean, seconds_processed double, error string")


def run_shards(df: DataFrame, key: str, shards: int, out: str, work: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Writes work(part) for each of so many parts of df (by a hash of key) under out/shard=k; parts that are there are not made again.

    A part is written beside and takes its name when it is whole, so a run that was cut off goes on where it stopped. Returns the parts made.
    """
    spark = df.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for k in range(shards):
        final, part = f"{out}/shard={k}", f"{out}/_part-{k}"
        if files.exists(path(final)):
            continue
        work(df.filter(F.pmod(F.xxhash64(key), F.lit(shards)) == k)).write.mode("overwrite").parquet(part)
        if not files.rename(path(part), path(final)):
            raise OSError(f"{part} could not be renamed")
        made.append(k)
    return made


def corrected(text: Column, make: Callable[[], Corrector]) -> Column:
    """A text column through a corrector."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else model.correct(t))

    return run(text)


def evaluate(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Every prediction with its truth and alignment: pipeline, dataset_name, sample_idx, truth, text, a (fields of the alignment).

    predictions: pipeline, dataset_name, sample_idx, text; truths: dataset_name, sample_idx, text. Predictions without a truth drop out.
    """
    t = truths.select(*SAMPLE, F.col("text").alias("truth"))
    both = predictions.select("pipeline", *SAMPLE, "text").join(t, list(SAMPLE))
    return both.select("pipeline", *SAMPLE, "truth", "text", aligned("truth", "text").alias("a"))


def evaluate_tree(truths: DataFrame, root: str, cache: str) -> DataFrame:
    """``evaluate`` over a tree of results (pipeline/dataset/idx/transcription.json), kept in a table at ``cache``: only results that are not in it yet are aligned.

    The whole table comes back, those of earlier calls included, in partitions of pipeline and dataset.
    """
    spark = truths.sparkSession
    found = read_prediction_tree(spark, root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = evaluate(found, truths).schema
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if there:
        found = pending(found, spark.read.schema(schema).parquet(cache), ["pipeline", *SAMPLE])
    evaluate(found, truths).write.mode("append").partitionBy("pipeline", "dataset_name").parquet(cache)
    return spark.read.schema(schema).parquet(cache)


def metrics(evaluated: DataFrame, common: bool = True, max_insertions: int | None = None) -> DataFrame:
    """dataset_name, pipeline, samples, n_errors, n_words, wer, macro_wer, char_errors; with common, over the samples that all of a dataset's pipelines have."""
    rows = evaluated.filter("a.error is null and a.true_len is not null")
    if common:
        wanted = rows.groupBy("dataset_name").agg(F.countDistinct("pipeline").alias("k"))
        have = rows.groupBy(*SAMPLE).agg(F.countDistinct("pipeline").alias("n")).join(wanted, "dataset_name").filter("n = k")
        rows = rows.join(have.select(*SAMPLE), list(SAMPLE), "left_semi")
    errors = F.col("a.n_word_errors") if max_insertions is None else capped_errors(F.col("a.matches"), max_insertions)
    rows = rows.select("dataset_name", "pipeline", errors.alias("e"), F.col("a.true_len").alias("n"), F.col("a.n_char_errors").alias("c"))
    one = F.lit(1)
    return rows.groupBy("dataset_name", "pipeline").agg(
        F.count("*").alias("samples"), F.sum("e").alias("n_errors"), F.sum("n").alias("n_words"), (F.sum("e") / F.greatest(one, F.sum("n"))).alias("wer"),
        F.avg(F.col("e") / F.greatest(one, F.col("n"))).alias("macro_wer"), F.sum("c").alias("char_errors"),
    )


def longform_pieces(samples: DataFrame, segment_ms: int = 30_000, shift_ms: int = 10_000) -> DataFrame:
    """Long audio in overlapping pieces, for models of short audio: dataset_name, sample_idx, piece, start_ms, end_ms, audio."""
    s = samples.select(*SAMPLE, F.col("audio.array").alias("x"), F.col("audio.sampling_rate").alias("rate")).filter("rate > 0 and size(x) > 0")
    ms = F.round(F.size("x") * 1000.0 / F.col("rate")).cast("bigint")
    p = s.select("*", F.posexplode(chunk_bounds(ms, segment_ms, shift_ms)).alias("piece", "c"))
    a, b = (F.floor(F.col(f"c.{k}") * F.col("rate") / 1000) for k in "ab")
    return p.select(*SAMPLE, "piece", F.col("c.a").alias("start_ms"), F.col("c.b").alias("end_ms"), F.struct(F.slice("x", (a + 1).cast("int"), (b - a).cast("int")).alias("array"), F.col("rate").alias("sampling_rate")).alias("audio"))
