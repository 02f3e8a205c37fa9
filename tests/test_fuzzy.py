import numpy as np
from pyspark.sql import functions as F

from tessitura.operators import fuzzy
from tessitura.operators.corrector import correct_texts, domain_words, substitute, word_corrections
from tessitura.functions.alignment import char_distance
from tessitura.plans.joins import fuzzy_dict_match
from tessitura.plans.sequences import EDITS, fuzzy_correct

SAID = ["rod", "rеd", "nавy", "azúre", "grеen", "olive2", "plum", "tan", "лён", "ｔｈｅ", "bluue", "yelow", "it"]
NAMES = ["red old tan", "Navy azure green", "blue olive plum", "лен hot", "yellow"]


def test_all_words_meet_all_words(spark, tmp_path):
    spark.createDataFrame([(1, "d", "test", 1, "en", " ".join(SAID) + " <*> {plum|it}")], "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string").write.parquet(f"{tmp_path}/recording.parquet")
    spark.createDataFrame([(k, n) for k, n in enumerate(NAMES)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    said, names = {w.replace("ё", "е") for w in SAID}, {d for n in NAMES for d in n.lower().split()}
    near = {(w, d): n for w in said for d in names if (n := char_distance(w, d)) <= 3}
    assert {(r.w, r.d): r.dist for r in fuzzy_dict_match(spark, str(tmp_path)).collect()} == {k: n for k, n in near.items() if n <= 2}
    want = {}
    for w in said:
        found = sorted((n, d) for (v, d), n in near.items() if v == w and n <= EDITS[min(len(w), 9)])
        if found and found[0][0] > 0 and (len(found) == 1 or found[1][0] > found[0][0]):
            want[w] = found[0][::-1]
    assert {r.w: (r.correction, r.dist) for r in fuzzy_correct(spark, str(tmp_path)).collect()} == want
    assert want["rеd"] == ("red", 1) and want["azúre"] == ("azure", 1)


def test_search_in_a_grid_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(90)} | {7: None, 8: [0.0] * 4}
    df = spark.createDataFrame([(i, v, "x") for i, v in x.items()], "i bigint, v array<float>, hit string")
    vectors = {i: np.array(v) for i, v in x.items() if v is not None and np.any(v)}
    want = []
    for q in (q for q in vectors if q % 5 == 0):
        scored = sorted((-round(float(vectors[q] @ v / np.sqrt(vectors[q] @ vectors[q]) / np.sqrt(v @ v)), 6), i) for i, v in vectors.items() if i != q)
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(scored[:3])]
    for rows, block in ((100, 100), (20, 3)):
        plain = fuzzy.grid
        monkeypatch.setattr(fuzzy, "grid", lambda a, b, k, q: plain(a, b, k, q, rows, block))
        got = fuzzy.cosine_topk_blocks(df, "i", "v", F.col("i") % 5 == 0, 3)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query, r.hit, r.score + 0.0, r.place) for r in got.collect()) == sorted((q, i, s + 0.0, k) for q, i, s, k in want)
        monkeypatch.undo()
    assert fuzzy.cosine_topk_blocks(df.limit(0), "i", "v", F.col("i") % 5 == 0, 3).count() == 0


def test_corrections_with_lemmas_forms_and_capitals(spark):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    frequency = spark.createDataFrame([("table", 5.0), ("rare", 0.5)], "w string, zipf double")
    lemmas = spark.createDataFrame([("tokenzs", "tokenz"), ("gone", None)], "form string, value string")
    domain = words("token", "lattice", "lattise", "ёлка", "table")
    got = lambda **o: {r.w: r.correction for r in word_corrections(words("Tokenz", "tokenzs", "latticc", "tables", "ab", "елко", "TOKEN", "rare", "table"), domain, frequency, **o).collect()}
    # 'latticc' is as near to lattice as 'lattise' is far: one edit against two; 'tables' is itself unknown and next to table.
    assert got() == {"Tokenz": "Token", "latticc": "lattice", "tables": "table", "елко": "ёлка", "tokenzs": "token"}
    inflect = spark.createDataFrame([("token", "tokenzs", "tokens")], "lemma string, like string, value string")
    assert got(lemmas=lemmas, inflect=inflect) == {"tokenzs": "tokens"}
    assert sorted(r.w for r in domain_words(words("Ёлка", "Table", "runs"), frequency, 2.0, spark.createDataFrame([("runs", "run")], "form string, value string")).collect()) == ["run", "runs", "елка", "ёлка"]
    assert sorted(r.w for r in domain_words(words("runs", None), frequency, 2.0, spark.createDataFrame([("runs", "run")], "form string, value string"), "replace").collect()) == ["run"]
    texts = spark.createDataFrame([(1, "Tokenz, tokenz - latticc!"), (2, None), (3, ""), (1, "Tokenz, tokenz - latticc!")], "i bigint, t string")
    fixed = {r.i: r.t for r in correct_texts(texts, "i", "t", spark.createDataFrame([("Tokenz", "Token"), ("latticc", "lattice")], "w string, correction string")).collect()}
    assert fixed == {1: "Token, tokenz - lattice!", 2: None, 3: ""}


def test_phrases_are_put_in_once(spark):
    df = spark.createDataFrame([("two word lattice two",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(substitute(F.col("t"), {"lattice": "{a}", "word lattice": "{lattice two}", "two": "2"}).alias("x")).collect()]
    assert got == ["2 {lattice two} 2", None, ""]
