import itertools
import unicodedata

from tessitura.llm import lookalike
from tessitura.llm.lookalike import consistent, lookalike_classes, consistent_texts, lookalike_pairs, resolved_scripts, skeleton


def test_same_look():
    same = [
        ["Speech", "Ѕрeeсһ", "Ｓｐｅｅｃｈ", "Spe​ech", "S­peech", "ЅpееcҺ".replace("Ҝ", "").replace("Һ", "h")],
        ["café recording", "café recording", "café　recordinɡ", "саfé recοrding"],
        ["сегмент ёмкий", "ceгмeнт ёмкий", "сегмент ёмкий"],
        ["final", "ﬁnal"], ["IV", "Ⅳ", "ІV"], ["l", "ⅼ", "ӏ"], ["A", "Ꭺ", "ꓮ", "Ⲁ", "Α"], ["it's", "it’s", "itʼs"], ["well-made", "well‐made", "well‑made"], ["so...", "so…", "so‥."], ["Ǆ", "DŽ"],
    ]
    for group in same:
        assert len({skeleton(t) for t in group}) == 1, group
        assert len({consistent(t)[0] for t in group}) == 1, group
    assert consistent("Ѕрeeсһ")[0] == "Speech"
    assert consistent("ceгмeнт ёмкий")[0] == "сегмент ёмкий"
    assert consistent("Ѕрeeсһ")[1] == 1


def test_different_look():
    for a, b in itertools.combinations(["cafe", "café", "Cafe", "cafè", "ca fe", "cafe.", "ç", "c", "й", "и", "²", "2", "O", "0", "l", "1"], 2):
        assert skeleton(a) != skeleton(b) and consistent(a)[0] != consistent(b)[0]


def test_form_is_stable_and_whole_script_follows_the_text():
    for t in ["сор", "Дубль сор", "the сор", "", " ", "测试 тест", "ΑΒΓ", "a" * 50_000 + "е", "👩‍🔬 ok"]:
        f = consistent(t)[0]
        assert consistent(f)[0] == f and skeleton(f) == skeleton(t)
    assert consistent("Дубль cop")[0] == "Дубль сор"
    assert consistent("the сор")[0] == "the cop"
    assert resolved_scripts(skeleton("привет")) == {"Cyrillic"} and resolved_scripts("12") is None
    assert unicodedata.is_normalized("NFC", consistent("é")[0])


def test_pairs(spark):
    rows = [(1, "aа"), (2, "аa"), (3, "aa"), (3, "aa"), (4, "aa"), (5, "AA"), (6, None), (7, ""), (8, "​"), (9, " "), (10, " "), (None, "аа")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "i bigint, t string, __f string")
    got = {(r.id_a, r.id_b) for r in lookalike_pairs(df, [], "i", "t").collect()}
    assert got == {(a, b) for a, b in itertools.combinations([1, 2, 3, 4], 2)} - {(3, 4)}
    df = spark.createDataFrame([(r[0] or 0, 1 + (r[0] or 0) % 2, r[1]) for r in rows], "i bigint, rec_id bigint, t string")
    got = {tuple(r) for r in lookalike_pairs(df, ["rec_id"], "i", "t").collect()}
    assert got == {(2, 1, 3), (1, 0, 2), (1, 2, 4), (1, 0, 4)}
    assert lookalike_pairs(spark.createDataFrame([], "i bigint, t string"), [], "i", "t").count() == 0
    forms = {r.i: r.form for r in consistent_texts(spark.createDataFrame(rows, "i bigint, t string"), ["i"], "t").collect()}
    assert forms[6] is None and forms[7] == "" and forms[2] == "aa"


def test_classes_of_many_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "ROWS", 3)
    spell = ["cop", "сор", "cоp", "соp"]
    rows = [(i, 1 + i % 2, spell[i % 7 % 4], "x") for i in range(60)] + [(100, 1, "apart", "x"), (101, None, "сор", "x")]
    df = spark.createDataFrame(rows + rows[:9], "id bigint, of bigint, text string, class_id string")
    here = [r for r in rows if r[1] is not None]
    want = {(a[1], a[0], b[0]) for a in here for b in here if a[1] == b[1] and a[0] < b[0] and a[2] != b[2] and 100 not in (a[0], b[0])}
    assert sorted((r.of, r.id_a, r.id_b) for r in lookalike_pairs(df, ["of"], "id", "text").collect()) == sorted(want)
    links = {}
    for _, a, b in want:
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    got = lookalike_classes(df, ["of"], "id", "text").collect()
    assert {r.id: r.n_links for r in got} == links and {(r.of, r.class_id) for r in got} == {(1, 0), (2, 1)}
    assert len(got) == len(links) and lookalike_classes(df.limit(0), ["of"], "id", "text").count() == 0
