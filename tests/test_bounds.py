from tessitura.functions.alignment import align
from tessitura.functions.multivariant import parse
from tessitura.plans.aggregates import anything_time_fill, insertion_bounds
from tessitura.plans.common import predictions
from tests import test_partial

#: Nine words and more, so that a pipeline says one of them twice.
TEXT = test_partial.TEXT + " xa yb"
PIECES, TIMES = [*test_partial.PIECES, ("xa", 2.8, 3.0), ("yb", 3.1, 3.4)], [*test_partial.TIMES, (2.8, 3.0), (3.1, 3.4)]


def test_every_insertion_of_the_alignments_has_bounds(spark, tmp_path):
    folder = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("recording", [(1, "d", "test", 1, "en", TEXT)], "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string")
    put("transcript_token", [(k, 1, v, TEXT.index(v), TEXT.index(v) + len(v), s, e) for k, (v, s, e) in enumerate(PIECES)], "token_id long, rec_id long, value string, start_pos int, end_pos int, start_time double, end_time double")
    want = {}
    for r in predictions(spark, folder).collect():
        m = align(parse(TEXT), list(r.h))["matches"]
        for i, x in enumerate(m):
            if x["status"] == "insertion":
                ends = [TIMES[y["true_uid"]][1] for y in m[:i] if y["true_uid"] is not None]
                starts = [TIMES[y["true_uid"]][0] for y in m[i + 1 :] if y["true_uid"] is not None]
                want[r.pipeline, x["pred_uid"]] = (max(ends, default=0.0), min(starts, default=1000.0))
    assert want and {(r.pipeline, r.pred_uid): (r.left_end, r.right_start) for r in insertion_bounds(spark, folder).collect()} == want


def test_every_wildcard_has_its_neighbours_times(spark, tmp_path):
    rows = [
        (1, 1, "<*>", 0.1, 0.2), (2, 1, "a", 0.3, 0.5), (3, 1, "<*>", 0.5, 0.6), (7, 1, "b", 0.7, 0.9), (8, 1, "<*>", 1.0, 1.1), (8, 1, "<*>", 1.0, 1.1),
        (20, 2, "c", None, None), (21, 2, "<*>", None, None), (22, 2, "d", None, None), (30, 3, "<*>", None, None),
    ]
    spark.createDataFrame(rows, "token_id long, rec_id long, value string, start_time double, end_time double").write.parquet(f"{tmp_path}/transcript_token.parquet")
    got = sorted((r.token_id, r.start_time, r.end_time) for r in anything_time_fill(spark, str(tmp_path)).collect())
    assert got == [(1, 0.0, 0.3), (3, 0.5, 0.7), (8, 0.9, 1000.0), (21, None, None), (30, 0.0, 1000.0)]
