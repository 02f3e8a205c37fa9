"""Extension points, compositions of models, tagged objects, resumable work."""

import dataclasses
import enum
import json
import os
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle

from tessitura.plans import evaluate as E
from tessitura.plans.models import average_overlapping, bell, piece_bounds
from tessitura.sources.objects import from_tagged, load_tagged, name_of, save_tagged, to_tagged


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not see the tests


class Letters(E.CTC):
    """One tick a second: the rounded mean of its samples is the class."""

    blank, tick = 0, 1.0

    def log_probabilities(self, samples, rate):
        rows = [np.full(4, 0.01) for _ in range(-(-len(samples) // rate))]
        for i, r in enumerate(rows):
            r[int(round(samples[i * rate : (i + 1) * rate].mean()))] = 0.97
        return np.log(np.array(rows))

    def decode(self, token):
        return "_abc"[token]


class Echo(E.ContextualTranscriber):
    def transcribe_after(self, samples, rate, history):
        return f"{len(samples)}<{history.replace(' ', '.')}>"


class Halves(E.Segmenter):
    def segments(self, samples, rate):
        n = len(samples) / rate
        return [(0.0, n / 2), (n / 2, n)]


def test_long_audio_by_a_ctc_of_short():
    path = [1, 1, 0, 1, 2, 2, 3, 0, 0, 3, 1]
    samples = np.repeat(np.array(path, float), 4)
    assert Letters().transcribe(samples, 4) == "aabcca"
    long = E.LongformCTC(Letters(), segment_s=4, shift_s=2)
    assert long.transcribe(samples, 4) == "aabcca" and len(long.log_probabilities(samples, 4)) == 11
    assert piece_bounds(41, 30, 5) == [(0, 30), (5, 35), (10, 40), (11, 41)] and piece_bounds(30, 30, 5) == [(0, 30)]
    a, b = np.array([[1.0], [1.0], [1.0]]), np.array([[3.0], [3.0], [3.0]])
    w = bell(3)
    got = average_overlapping([(0, a), (1, b)])[:, 0]
    assert got[0] == 1 and got[3] == 3 and got[1] == pytest.approx((w[1] + 3 * w[0]) / (w[1] + w[0]))
    with pytest.raises(ValueError):
        average_overlapping([(0, a), (5, b)])


def test_contexts_and_segments():
    assert Echo().transcribe(np.zeros(5), 1) == "5<>"
    assert E.LongformVAD(Echo(), Halves(), short_s=3).transcribe_timed(np.zeros(8), 1) == [(0.0, 4.0, "4<>"), (4.0, 8.0, "4<4<>>")]
    assert E.LongformVAD(Echo(), Halves()).transcribe(np.zeros(8), 1) == "8<>"


def samples(spark):
    rows = [("d", 0, ([1.0] * 8 + [2.0] * 4, 4)), ("d", 1, None), ("d", 2, ([1.0] * 40, 4)), ("d", 3, ([], 4))]
    return spark.createDataFrame(rows, "dataset_name string, sample_idx int, audio struct<array:array<float>,sampling_rate:int>")


def test_streaming_adapters_and_errors(spark):
    make = lambda: E.OfflineToStreaming(Letters(), interval_s=1.0, most_s=5.0)
    rows = sorted(E.run_streaming(samples(spark), "p", make, chunk_s=0.5).collect(), key=lambda r: (r.sample_idx, r.seq))
    of = lambda k: [(r.seq, r.uid, r.text, r.is_finish, r.error) for r in rows if r.sample_idx == k]
    assert of(0) == [(0, "0", "a", False, None), (1, "0", "a", False, None), (2, "0", "ab", False, None), (3, None, None, True, None)]
    assert of(1) == of(3) == [(0, None, None, True, None)]
    assert [r[:4] for r in of(2)[:4]] == [(i, "0", "a", False) for i in range(4)] and of(2)[4][3:] == (False, "ValueError: audio too long to be transcribed anew each time") and len(of(2)) == 5
    assert E.StreamingToOffline(make).transcribe(np.array([1.0] * 8 + [2.0] * 4), 4) == "ab"


def test_shards_go_on_where_they_stopped(spark, tmp_path):
    df, out = spark.range(100), str(tmp_path / "out")
    seen = []

    def work(part):
        seen.append(part.count())
        if len(seen) == 3:
            raise RuntimeError("cut off")
        return part.selectExpr("id", "id * 2 as twice")

    with pytest.raises(RuntimeError):
        E.run_shards(df, "id", 4, out, work)
    assert E.run_shards(df, "id", 4, out, work) == [2, 3] and E.run_shards(df, "id", 4, out, work) == []
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100))


def test_tree_is_aligned_once(spark, tmp_path):
    root, cache = tmp_path / "tree", str(tmp_path / "cache")
    put = lambda p, i, data: (os.makedirs(root / p / "d" / str(i)), (root / p / "d" / str(i) / "transcription.json").write_text(json.dumps(data)))
    put("one", 0, {"type": "transcription", "output": "a b"})
    put("one", 1, {"type": "timed_transcription", "segments": [{"start_time": 0.0, "end_time": 1.0, "text": "a"}, {"start_time": 1.0, "end_time": 2.0, "text": "c"}]})
    truths = spark.createDataFrame([("d", 0, "a {b|x}"), ("d", 1, "a b")], "dataset_name string, sample_idx int, text string")
    got = {(r.pipeline, r.sample_idx): r.a.n_word_errors for r in E.evaluate_tree(truths, str(root), cache).collect()}
    assert got == {("one", 0): 0, ("one", 1): 1}
    put("two", 1, {"type": "transcription", "output": "a b"})
    (root / "one" / "d" / "0" / "transcription.json").write_text(json.dumps({"type": "transcription", "output": "q q q"}))  # is in the table already
    got = {(r.pipeline, r.sample_idx): r.a.n_word_errors for r in E.evaluate_tree(truths, str(root), cache).collect()}
    assert got == {("one", 0): 0, ("one", 1): 1, ("two", 1): 0}


class Kind(enum.Enum):
    PLAIN = 1


@dataclasses.dataclass
class Part:
    text: str
    kind: Kind = Kind.PLAIN
    note: str | None = None
    inner: list | None = None


def test_tagged_objects(tmp_path):
    obj = {"parts": [Part("a", inner=[Part("b", note="n")]), 1.5, None], "at": Path("x/y")}
    data = to_tagged(obj)
    assert data["parts"][0] == {"_target_": name_of(Part), "text": "a", "kind": {"_enum_": name_of(Kind), "_name_": "PLAIN"}, "inner": [{"_target_": name_of(Part), "text": "b", "kind": {"_enum_": name_of(Kind), "_name_": "PLAIN"}, "note": "n"}]}
    save_tagged(obj, tmp_path / "deep" / "o.json")
    assert load_tagged(tmp_path / "deep" / "o.json", [Part, Kind]) == obj and os.listdir(tmp_path / "deep") == ["o.json"]
    with pytest.raises(LookupError):
        from_tagged(data)
    assert from_tagged({"_target_": "os.system", "*args": ["x"]}, lenient=True) == {"_target_": "os.system", "*args": ["x"]}
    for bad in ({(1, 2): 3}, object(), {1, 2}):
        with pytest.raises(TypeError):
            to_tagged(bad)
    with pytest.raises(TypeError):
        save_tagged(object(), tmp_path / "no.json")
    assert not (tmp_path / "no.json").exists()
