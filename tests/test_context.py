from tessitura.functions.sequences import merge_sentences
from tessitura.plans.sequences import context_history, sentence_merge


def test_a_hundred_words_of_context(spark, tmp_path):
    texts = [" ".join(f"w{k}x{i}" for i in range(1 + k % 2)) for k in range(120)]
    spark.createDataFrame([(k, 1, float(20 * k), t) for k, t in enumerate(texts)], "seg_id long, rec_id long, start_time double, text string").write.parquet(f"{tmp_path}/timed_text.parquet")
    got = {r.seg_id: r.history for r in context_history(spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(" ".join(texts[:k]).split()[-100:]) for k in range(120)} and len(got[119].split()) == 100


def test_long_sentences_are_split_before_merging(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    texts = {1: f"Short one. {long}. And another. End", 2: "a. b! c", 3: "x" * 300 + " y. z", 4: ""}
    rows = [(k, "d", "test", k, "en", t) for k, t in texts.items()]
    spark.createDataFrame(rows, "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string").write.parquet(f"{tmp_path}/recording.parquet")
    got = {r.rec_id: r for r in sentence_merge(spark, str(tmp_path)).collect()}
    split, line = [], ""
    for w in long.split():
        if len(line) + 1 + len(w) > 230:
            split, line = [*split, line], w
        else:
            line = f"{line} {w}".strip()
    assert got[1].parts == merge_sentences(["Short one", *split, line, "And another", "End"], 230, 60)
    assert all(len(p) <= 230 for p in got[1].parts) and len(got[1].parts) >= 3
    assert got[2].parts == ["a b c"] and got[3].parts == ["x" * 300, "y z"] and got[4].parts == []
    assert all(r.chars == len(" ".join(r.parts)) for r in got.values())
