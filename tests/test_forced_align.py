import itertools

import numpy as np

from tessitura.functions.sequences import fill_times, forced_alignment
from tessitura.functions.multivariant import parse
from tessitura.plans.sequences import fill_timings, forced_align


def test_a_given_transcript_is_aligned_over_all_classes(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = {7: "one two", 5: "red red", 9: "far too many words for these frames"}
    x = {label: rng.normal(size=(7 if label < 2 else 3, 64)).astype(np.float32) for label in range(3)}
    spark.createDataFrame([(100 * k + i, k, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r, "d", "test", r, "en", t) for r, t in texts.items()]
    spark.createDataFrame(rows, "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string").write.parquet(f"{tmp_path}/recording.parquet")
    got = {}
    for r in forced_align(spark, str(tmp_path)).collect():
        got.setdefault(r.label, {})[r.token] = (r.sym, r.first, r.last)
    for label, rec in enumerate(sorted(texts)):
        tokens = [1 + (31 * len(w) + ord(w[0])) % 63 for w in texts[rec].split()]
        assert max(tokens) > 7
        if label == 2:
            assert got[label] == {k: (c, None, None) for k, c in enumerate(tokens)}
            continue
        logp = x[label].astype(float)
        logp = logp - np.log(np.exp(logp).sum(1, keepdims=True))
        best = None
        for path in itertools.product(sorted({0, *tokens}), repeat=7):  # every path that collapses to the tokens
            runs = [(c, len(list(g))) for c, g in itertools.groupby(path)]
            if [c for c, _ in runs if c] == tokens:
                best = max(best or (-np.inf,), (sum(logp[t, c] for t, c in enumerate(path)), runs))
        want, at = [], 0
        for c, n in best[1]:
            want += [(c, at, at + n)] if c else []
            at += n
        assert got[label] == dict(enumerate(want))


def test_variants_and_wildcards_get_times_from_the_frames(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = {7: "one {forty two|42} <*> end", 5: "too {many|words} for four frames", 9: "a {b|<*>}"}
    x = {label: rng.normal(size=(9 if label else 3, 64)).astype(np.float32) for label in range(3)}
    spark.createDataFrame([(100 * k + i, k, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r, "d", "test", r, "en", t) for r, t in texts.items()]
    spark.createDataFrame(rows, "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string").write.parquet(f"{tmp_path}/recording.parquet")
    got = {}
    for r in fill_timings(spark, str(tmp_path)).collect():
        got.setdefault(r.rec_id, []).append((r.uid, r.word, r.start_time, r.end_time, r.error))
    assert [e for *_, e in got[5]] == ["too few frames"] and [e for *_, e in got[9]] == ["a wildcard among variants"]
    logp = x[1].astype(float)
    words = ["one", "forty", "two", "end"]
    spans = forced_alignment(logp - np.log(np.exp(logp).sum(1, keepdims=True)), [1 + (31 * len(w) + ord(w[0])) % 63 for w in words], 0)
    timed = fill_times(parse(texts[7]), [(a / 25, b / 25) for _, a, b in spans], 9 / 25)
    assert sorted(got[7]) == sorted((w["uid"], w["value"], w["start_time"], w["end_time"], None) for b in timed for o in b["options"] for w in o)
    assert {w for _, w, *_ in got[7]} == {"one", "forty", "two", "42", "<*>", "end"}
