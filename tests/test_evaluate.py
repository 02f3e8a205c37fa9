import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.plans.evaluate import Corrector, TimedTranscriber, Transcriber, corrected, evaluate, get_pipeline, longform_pieces, metrics, register_pipeline, run_pipeline

SAMPLES = "dataset_name string, sample_idx int, audio struct<array:array<float>,sampling_rate:int>"


def makers():
    """Local functions, which travel to the workers by value."""

    def make_counter():
        class Counter(Transcriber):
            def transcribe(self, samples, rate):
                return " ".join(str(i) for i in range(len(samples) // rate))

        return Counter()

    def make_timed():
        class Timed(TimedTranscriber):
            def transcribe_timed(self, samples, rate):
                return [(0.0, 1.0, "a"), (1.0, len(samples) / rate, "b")]

        return Timed()

    return make_counter, make_timed


@pytest.fixture()
def samples(spark):
    rows = [("d", 0, (np.zeros(30).tolist(), 10)), ("d", 1, (np.zeros(20).tolist(), 10)), ("d", 2, None), ("e", 0, ([], 10))]
    return spark.createDataFrame(rows, SAMPLES)


def test_run(spark, samples):
    make_counter, make_timed = makers()
    register_pipeline("counter")(make_counter)
    with pytest.raises(ValueError):
        register_pipeline("counter")(make_counter)
    with pytest.raises(ValueError):
        get_pipeline("nothing")
    got = {(r.dataset_name, r.sample_idx): r.text for r in run_pipeline(samples, "counter", make=make_counter).collect()}
    assert got == {("d", 0): "0 1 2", ("d", 1): "0 1", ("d", 2): None, ("e", 0): ""}
    done = spark.createDataFrame([("counter", "d", 0), ("other", "d", 1)], "pipeline string, dataset_name string, sample_idx int")
    assert run_pipeline(samples, "counter", done, make_counter).count() == 3
    timed = {r.sample_idx: r for r in run_pipeline(samples.filter("dataset_name = 'd'"), "timed", make=make_timed).collect()}
    assert timed[0].text == "a b" and timed[0].type == "timed_transcription" and timed[0].segments[1].end_time == 3.0 and timed[2].text is None


def test_evaluate(spark):
    truths = spark.createDataFrame([("d", 0, "a {b|c} <*>"), ("d", 1, "x y"), ("d", 2, "{bad")], "dataset_name string, sample_idx int, text string")
    rows = [("p", "d", 0, "a c q w"), ("p", "d", 1, "x z"), ("p", "d", 2, "bad"), ("q", "d", 0, "a"), ("q", "d", 9, "a")]
    ev = evaluate(spark.createDataFrame(rows, "pipeline string, dataset_name string, sample_idx int, text string"), truths)
    m = {r.pipeline: r for r in metrics(ev).collect()}
    assert m["p"].samples == 1 and m["p"].wer == 0 and m["q"].n_errors == 1 and m["q"].wer == 0.5
    alone = {r.pipeline: r for r in metrics(ev, common=False, max_insertions=4).collect()}
    assert alone["p"].samples == 2 and alone["p"].n_errors == 1 and alone["p"].n_words == 4


def test_corrector_and_pieces(spark, samples):
    def make():
        class Upper(Corrector):
            def correct(self, text):
                return text.upper()

        return Upper()

    df = spark.createDataFrame([("a",), (None,)], "t string").select(corrected(F.col("t"), make).alias("t"))
    assert [r.t for r in df.collect()] == ["A", None]
    p = longform_pieces(samples, 2_000, 500).orderBy("sample_idx", "piece").collect()
    assert [(r.sample_idx, r.start_ms, r.end_ms, len(r.audio["array"])) for r in p] == [(0, 0, 2000, 20), (0, 500, 2500, 20), (0, 1000, 3000, 20), (1, 0, 2000, 20)]


def test_table_functions(spark):
    from tessitura.functions.udtf import register_table_functions

    register_table_functions(spark)
    got = [tuple(r) for r in spark.sql("select c.start_ms, c.end_ms from values (41L), (10L), (null) as t(n), lateral chunk_audio(n, 30L, 5L) c order by n, c.piece").collect()]
    assert got == [(0, 10), (0, 30), (5, 35), (10, 40), (11, 41)]
    got = [tuple(r) for r in spark.sql("select block, option, value from truth_tokens('a {b c|<*>}') order by uid").collect()]
    assert got == [(0, 0, "a"), (1, 0, "b"), (1, 0, "c"), (1, 1, "<*>")]
