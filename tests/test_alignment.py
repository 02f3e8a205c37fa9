import itertools
import random

import pytest

from tessitura.functions.alignment import align, align_texts, aligned, capped_errors, char_distance, edit_errors, word_errors
from tessitura.functions.multivariant import MultivariantError, parse, render, resolve, starting_part


def pairs(r):
    return [(m["true"], m["pred"]) for m in r["matches"]]


def test_goldens():
    r = align_texts("a <*> b c {x|y|d} {qaz|} {a|b}", "a b x y a a")
    assert pairs(r) == [("a", "a"), ("<*>", None), ("b", "b"), ("c", "x"), ("y", "y"), ("a", "a"), (None, "a")]
    r = align_texts("{седьмого|7} - {восьмого|8} мая {|в} {Пуэрто-Рико} прошёл {шестнадцатый|16-й|16й|16} этап", "седьмого 8 мая прошел 16й этап")
    assert r["options"] == [0, 1, 0, 1, 2]
    r = align_texts("nothing", "no thing")
    assert pairs(r) == [(None, "no"), ("nothing", "thing")] and (r["n_word_errors"], r["n_correct"], r["n_char_errors"]) == (2, 0, 4)
    r = align_texts("{A | B B B}", "B")
    assert r["options"] == [0] and r["n_word_errors"] == 1 and r["true_len"] == 1


@pytest.mark.parametrize("truth,pred,errors", [
    ("<*>", "", 0), ("<*>", "a b c", 0), ("a <*> b", "a x y z b", 0), ("a <*>", "a b c", 0), ("<*> a", "q w a", 0), ("{<*>|z} b", "b", 0), ("{b|<*>}", "", 0),
    ("", "", 0), ("", "a b", 2), ("a b", "", 2), ("{o+}", "oo", 0), ("{Face<x>}", "face-x", 0), ("{C++|d}", "c++", 0),
])
def test_wildcards_and_edges(truth, pred, errors):
    assert align_texts(truth, pred)["n_word_errors"] == errors


def test_errors():
    for bad in ("{a|b", "a}b", "x{a|b}", "{a}{b}", "{}", "{a|{b}}"):
        with pytest.raises(MultivariantError):
            parse(bad)
        assert align_texts(bad, "a")["error"]


def words(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            d, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, d + (x != y))
    return row[-1]


def best_plain(t, p):
    """All alignments of two short token lists: least (words, chars, -correct)."""
    if not t or not p:
        rest = t or p
        return (len(rest), sum(map(len, rest)), 0)
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    same = t[0] == p[0]
    return min(
        add(best_plain(t[1:], p[1:]), (0, 0, -1) if same else (1, char_distance(t[0], p[0]), 0)),
        add(best_plain(t, p[1:]), (1, len(p[0]), 0)), add(best_plain(t[1:], p), (1, len(t[0]), 0)),
    )


def test_random_against_brute_force():
    rng = random.Random(0)
    vocab = ["a", "ab", "abc", "b", "cab"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            if rng.random() < 0.5:
                parts.append([[rng.choice(vocab)]])
            else:
                parts.append([[rng.choice(vocab) for _ in range(rng.randrange(0, 3))] for _ in range(rng.randrange(2, 4))])
        text = " ".join(p[0][0] if len(p) == 1 else "{" + "|".join(" ".join(o) for o in p) + "}" for p in parts)
        pred = [rng.choice(vocab) for _ in range(rng.randrange(0, 5))]
        r = align(parse(text), pred)
        want = min(best_plain([w for o in choice for w in o], pred) for choice in itertools.product(*parts))
        assert (r["n_word_errors"], r["n_char_errors"], -r["n_correct"]) == want
        single = [t["value"] for t in resolve(parse(text), r["options"])]
        assert [m["true"] for m in r["matches"] if m["true"] is not None] == single and [m["pred"] for m in r["matches"] if m["pred"] is not None] == pred
        assert sum(m["n_char_errors"] for m in r["matches"]) == r["n_char_errors"] and sum(m["status"] != "correct" for m in r["matches"]) == r["n_word_errors"]


def test_bits_against_table():
    rng = random.Random(6)
    for _ in range(500):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert edit_errors(a, b) == words(a, b)


def test_long_texts_do_not_recurse():
    r = align_texts("w " * 3000, "w " * 2990)
    assert r["n_word_errors"] == 10


def test_columns(spark):
    rows = [("a b c d", "a x c"), ("", "a"), ("a", ""), (None, "a"), ("q w e r t y", "w w e e r"), ("x", "x y z q w e")]
    df = spark.createDataFrame(rows, "t string, h string")
    from pyspark.sql import functions as F

    from tessitura.functions.tokenize import tokenize

    got = df.select("t", "h", aligned("t", "h").alias("a"), word_errors(tokenize(F.col("t")), tokenize(F.col("h"))).alias("w")).select("*", capped_errors(F.col("a.matches")).alias("c")).collect()
    for r in got:
        if r.t is not None:
            assert r.a.n_word_errors == r.w == words(r.t.split(), r.h.split())
    assert got[-1].c == 4 and got[-1].a.n_word_errors == 5


def test_render_and_cut():
    assert render(parse("a {b|c d} <*> {e}")) == "a {b|c d} <*> {e|}"
    timed = lambda text, times: _time(parse(text), times)

    def _time(blocks, times):
        it = iter(times)
        for b in blocks:
            for o in b["options"]:
                for t in o:
                    t["start_time"], t["end_time"] = next(it)
        return blocks

    assert render(starting_part(timed("A B", [(1, 2), (3, 4)]), 3.5)) == "a {b|}"
    cut = starting_part(timed("A {B1|B2 B3}", [(0, 1), (3, 4), (3, 3.5), (3.5, 4)]), 3.7)
    assert render(cut[:1]) == "a" and sorted(" ".join(t["value"] for t in o) for o in cut[1]["options"]) == sorted(["", "b1", "b2", "b2 b3"])
    assert starting_part(timed("A", [(5, 6)]), 5) == []
