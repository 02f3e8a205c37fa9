from tessitura.functions.alignment import char_distance as brute
from tessitura.plans.alignment import char_distance


def test_every_pair_in_characters(spark, tmp_path):
    values = ["отчёт", "отчет", "ＡＢ", "AB", None, "naïve", "naive", "t⁠he", "the", "𝒳y", "xy"]
    rows = [(k, 1, v) for k, v in enumerate(values)] + [(20, 2, "a"), (0, 1, values[0])]
    spark.createDataFrame(rows, "token_id long, rec_id long, value string").write.parquet(f"{tmp_path}/transcript_token.parquet")
    want = {k: brute(a, b) for k, (a, b) in enumerate(zip(values, values[1:])) if a is not None and b is not None}
    assert {r.token_id: r.d for r in char_distance(spark, str(tmp_path)).collect()} == want and len(want) == 8
