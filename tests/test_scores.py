"""Scores over truths with variants and wildcards, against all readings of a small table."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tessitura.plans import alignment
from tessitura.plans.common import predictions
from tests.oracle import SF, connect
from tests.test_alignment import words

#: Truths as lists of blocks, blocks as lists of options.
TRUTHS = [
    [["a"], ["forty two", "42"], ["b"]], [["<*>"], ["a"], ["b"], ["c"], ["d"]], [["x"], ["<*>"], ["y z", ""], ["x"], ["q"], ["r"], ["s"]],
    [["a"], ["b"], ["c"], ["d"], ["e"], ["f"], ["g"], ["h"], ["i"], ["j"]], [["a", "b c"], ["a"], ["a c", "b", "d e f"]],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("scores"))
    text = lambda t: " ".join("{" + "|".join(b) + "}" if len(b) > 1 else b[0] for b in t)
    rows = [(i, "d", "test", i, "en", text(t)) for i, t in enumerate(TRUTHS)] + [(9, "d", "test", 9, "en", "a {b|c")]
    df = spark.createDataFrame(rows, "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string")
    df.write.parquet(f"{at}/recording.parquet")
    return at


def fewest(truth, pred):
    """Word errors of one reading: a wildcard takes any run of words."""
    if "<*>" not in truth:
        return words(truth, pred)
    k = truth.index("<*>")
    return min(words(truth[:k], pred[:i]) + fewest(truth[k + 1 :], pred[j:]) for i in range(len(pred) + 1) for j in range(i, len(pred) + 1))


def want(spark, folder):
    """{(rec_id, pipeline): (errors, the lengths of the readings with so few)}."""
    out = {}
    for r in predictions(spark, folder).filter("rec_id < 9").collect():
        readings = [" ".join(c).split() for c in itertools.product(*TRUTHS[r.rec_id])]
        errors = [fewest(t, list(r.h)) for t in readings]
        out[r.rec_id, r.pipeline] = min(errors), {sum(w != "<*>" for w in t) for t, e in zip(readings, errors) if e == min(errors)}
    return out


def test_scores_are_those_of_the_best_reading(spark, folder):
    expected = want(spark, folder)
    rows = {(r.rec_id, r.pipeline): r for r in alignment.scored(spark, folder).collect()}
    assert set(rows) == set(expected)
    for k, (errors, lengths) in expected.items():
        assert rows[k].n_errors == errors and rows[k].n_words in lengths
    assert {(r.rec_id, r.pipeline): r.n_errors for r in alignment.align_score(spark, folder).collect()} == {k: e for k, (e, _) in expected.items()}


def test_rates_are_sums_of_scores(spark, folder):
    rows = alignment.scored(spark, folder).collect()
    every = {p: [r for r in rows if r.pipeline == p] for p in ("drop7", "dup9", "swap5")}
    sums = lambda rs: (sum(r.n_errors for r in rs), sum(r.n_words for r in rs))
    for r in alignment.wer_by_pipeline(spark, folder).collect():
        e, n = sums(every[r.pipeline])
        assert (r.n_errors, r.n_words, r.wer) == (e, n, pytest.approx(e / n))
    assert {(r.dataset_name, r.pipeline): (r.n_errors, r.n_words) for r in alignment.wer_rollup(spark, folder).filter("level = 0").collect()} == {("d", p): sums(rs) for p, rs in every.items()}
    common = {r.rec_id for r in rows if r.rec_id % 3}
    for r in alignment.common_samples_wer(spark, folder).collect():
        e, n = sums([x for x in every[r.pipeline] if x.rec_id in common])
        assert (r.n, r.wer) == (len(common), pytest.approx(e / n))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_plain_truths_agree_with_the_sql(spark):
    """Where the truth has one reading the SQL says the same."""
    plain = predictions(spark, SF).filter(~F.col("text").rlike(r"[{}]|<\*>")).select("rec_id").distinct()
    got = {(r.rec_id, r.pipeline): r.n_errors for r in alignment.align_score(spark, SF).join(plain, "rec_id", "left_semi").collect()}
    keep = {r.rec_id for r in plain.collect()}
    assert got and got == {(a, b): n for a, b, n in connect().execute(alignment.ORACLE["align_score"]).fetchall() if a in keep}
