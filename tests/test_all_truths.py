"""Queries of the kernel and of corrections over truths of every kind."""

import itertools
import re

from tessitura.functions.alignment import aligned
from tessitura.plans import alignment
from tessitura.plans.common import predictions
from tessitura.plans.sequences import apply_corrections
from tests.test_scores import TRUTHS, folder, want  # noqa: F401


def test_matches_and_lengths_of_all_truths(spark, folder):  # noqa: F811
    expected = want(spark, folder)
    assert {(r.rec_id, r.pipeline): r.n_word_errors for r in alignment.align_matches(spark, folder).collect()} == {k: e for k, (e, _) in expected.items()}
    lengths = {(r.rec_id, r.pipeline): r.n for r in alignment.true_len(spark, folder).collect()}
    assert set(lengths) == set(expected) and all(n in expected[k][1] for k, n in lengths.items())


def test_buckets_hold_every_word_in_its_place(spark):
    rows = [(1, "p", "a <*> b d e {x y|} c", "a q a s t b d e x z c c".split()), (2, "p", "a b", ["b"]), (3, "p", "a", []), (4, "p", "<*>", ["k", "l"])]
    k = spark.createDataFrame(rows, "rec_id long, pipeline string, text string, h array<string>").select("rec_id", "pipeline", aligned("text", "h").alias("a"))
    got = sorted((r.rec_id, r.slot, r.true, r.words, r.has_error) for r in alignment.buckets(k).collect())
    assert got == [
        (1, 1, "a", "a", False), (1, 3, "<*>", "q a s t", False), (1, 5, "b", "b", False), (1, 7, "d", "d", False), (1, 9, "e", "e", False), (1, 11, "x", "x", False), (1, 13, "y", "z", True), (1, 15, "c", "c", False), (1, 16, None, "c", True),
        (2, 1, "a", "", True), (2, 3, "b", "b", False), (3, 1, "a", "", True), (4, 1, "<*>", "k l", False),
    ]
    side = {(r.rec_id, r.slot): (r.truth, r.p, r.other) for r in alignment.side_by_side(alignment.buckets(k), ["p", "other"]).collect()}
    assert side[1, 13] == ("y", "Z", None) and side[1, 16] == (None, "C", None) and side[2, 1] == ("a", "", None)


def test_roundtrip_is_a_reading_and_the_hypothesis(spark, folder):  # noqa: F811
    hyps = {(r.rec_id, r.pipeline): " ".join(r.h) for r in predictions(spark, folder).filter("rec_id < 9").collect()}
    rows = alignment.align_roundtrip(spark, folder).collect()
    assert {(r.rec_id, r.pipeline): r.hyp for r in rows} == hyps
    assert all(r.truth in {" ".join(" ".join(c).split()) for c in itertools.product(*TRUTHS[r.rec_id])} for r in rows)


def test_every_number_is_corrected(spark, tmp_path):
    texts = ["3.5 and 10:30", "1 2 3", "a1 22", "{3|three} 4-5", "{5+} 6", "", "семь 7,8 <*> 9"]
    rows = [(k, "d", "test", k, "en", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string").write.parquet(f"{tmp_path}/recording.parquet")
    got = {r.rec_id: r.text for r in apply_corrections(spark, str(tmp_path)).collect()}
    assert got == {k: re.sub(r"(?<!\w)[0-9]+(?!\w)", "#", t) for k, t in enumerate(texts)}
