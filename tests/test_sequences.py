import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions.multivariant import parse
from tessitura.functions.sequences import chunk_bounds, ctc_collapse, fill_times, forced_alignment, merge_sentences, pack_by_space, propagate_times, splice
from tessitura.operators.asof import asof, overlap_pairs
from tessitura.operators.fuzzy import edit_neighbours
from tessitura.operators.replay import rechunk
from tessitura.sources.registry import get_dataset, pcm16, read_prediction_tree, register_dataset


def test_ctc_collapse(spark):
    rows = [("____", ""), ("aaaaa", "a"), ("_дд_жо__оойй_", "джоой"), ("", "")]
    df = spark.createDataFrame(rows, "s string, want string").withColumn("a", F.filter(F.split("s", ""), lambda x: x != ""))
    for r in df.select("want", F.array_join(ctc_collapse(F.col("a"), F.lit("_")), "").alias("got")).collect():
        assert r.got == r.want


def test_chunks(spark):
    df = spark.createDataFrame([(41,), (30,), (10,), (50,), (31,)], "n bigint")
    got = {r.n: [tuple(x) for x in r.c] for r in df.select("n", chunk_bounds(F.col("n"), 30, 5).alias("c")).collect()}
    assert got[41] == [(0, 30), (5, 35), (10, 40), (11, 41)] and got[30] == [(0, 30)] and got[10] == [(0, 10)]
    assert got[50] == [(0, 30), (5, 35), (10, 40), (15, 45), (20, 50)] and got[31] == [(0, 30), (1, 31)]
    same = df.filter("n = 41").select(chunk_bounds(F.col("n"), 30, 5, same_shift=True).alias("c")).first().c
    assert [tuple(x) for x in same][-1] == (15, 41)


def brute_alignment(logp, tokens, blank):
    best = (-np.inf, None)
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        out = [k for k, _ in itertools.groupby(path)]
        if [k for k in out if k != blank] == tokens:
            best = max(best, (sum(logp[t, k] for t, k in enumerate(path)), path), key=lambda x: x[0])
    return best


def test_forced_alignment():
    rng = np.random.default_rng(1)
    for blank in (0, 2):
        for tokens in ([1], [1, 1], [1, 3], [3, 1, 3]):
            logp = np.log(rng.dirichlet(np.ones(4), 6))
            spans = forced_alignment(logp, tokens, blank)
            path = [blank] * 6
            for k, a, b in spans:
                path[a:b] = [tokens[k]] * (b - a)
            score, _ = brute_alignment(logp, tokens, blank)
            assert abs(sum(logp[t, k] for t, k in enumerate(path)) - score) < 1e-9 and [k for k, *_ in spans] == list(range(len(tokens)))
    with pytest.raises(ValueError):
        forced_alignment(logp[:2], [1, 1], 0)
    with pytest.raises(ValueError):
        forced_alignment(logp, [0], 0)


def test_times():
    assert propagate_times([("a", 0, 1), ("b", 1, 3)], ["a", "x", "y"]) == [(0, 1), (1, 2), (2, 3)]
    assert propagate_times([("a", 0, 1), ("b", 1, 3), ("c", 3, 4)], ["x", "c"]) == [(0, 3), (3, 4)]
    assert propagate_times([("a", 0, 1)], []) == []
    assert propagate_times([("100", 0, 1), ("000", 1, 2), ("$", 2, 3)], ["$", "100", "000"]) == [(0, 1), (0, 1), (1, 2)]
    for bad in (([], ["x"]), ([("a", 0, 1), ("b", 1, 2)], ["x", "y"]), ([("a", 0, 1), ("b", 1, 2)], ["a", "x", "b"]), ([("a", 0, 1)], ["a", "x"])):
        with pytest.raises(ValueError):
            propagate_times(*bad)
    filled = fill_times(parse("w {longest|a b|}"), [(0, 1), (1, 3)])
    assert [[(t["start_time"], t["end_time"]) for t in o] for o in filled[1]["options"]] == [[(1, 3)], [(1, 2), (2, 3)], []]
    times = lambda text, known, finish=None: [[[(t["start_time"], t["end_time"]) for t in o] for o in b["options"]] for b in fill_times(parse(text), known, finish)]
    # "p q" has no counterpart in the longest option; the option of one word in between has.
    assert times("{seventy five|75|p q}", [(0, 2), (2, 4)]) == [[[(0, 2), (2, 4)], [(0, 4)], [(0, 2), (2, 4)]]]
    assert times("<*> a <*> {b|} <*>", [(1, 2), (5, 6)], 9) == [[[(0.0, 1)]], [[(1, 2)]], [[(2, 5)]], [[(5, 6)], []], [[(6, 9)]]]
    for text, known in (("a {b|<*>}", [(0, 1), (1, 2)]), ("<*> <*> a", [(0, 1)]), ("a b", [(0, 1)]), ("{a b c|x y}", [(0, 1), (1, 2), (2, 3)])):
        with pytest.raises(ValueError):
            times(text, known)


def test_text(spark):
    assert merge_sentences(["aa", "b", "cc", "dddd"], 5) == ["aa b", "cc", "dddd"]
    assert merge_sentences(["aaaa", "bbbb"], 20, 3) == ["aaaa", "bbbb"]
    df = spark.createDataFrame([("aa bb  cc dddddddd e",), ("",), (None,)], "t string").select(pack_by_space(F.col("t"), 5).alias("p"))
    assert [r.p for r in df.collect()] == [["aa bb", "cc", "dddddddd", "e"], [], None]
    fix = F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit("xyz").alias("v")), F.struct(F.lit(2).alias("a"), F.lit(3).alias("b"), F.lit("").alias("v")))
    named = F.transform(fix, lambda c: F.struct(c["a"].alias("start_pos"), c["b"].alias("end_pos"), c["v"].alias("value")))
    assert spark.createDataFrame([("abcd",)], "t string").select(splice(F.col("t"), named).alias("r")).first().r == "xyzbd"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            d, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, d + (x != y))
    return row[-1]


def test_neighbours(spark):
    rng = random.Random(2)
    a = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(40)] + [None]
    b = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(40)] + [None]
    x, y = spark.createDataFrame([(w,) for w in set(a)], "w string"), spark.createDataFrame([(w,) for w in set(b)], "d string")
    got = {(r.w, r.d, r.dist) for r in edit_neighbours(x, y, "w", "d", 2).collect()}
    assert got == {(p, q, distance(p, q)) for p in set(a) for q in set(b) if p is not None and q is not None and distance(p, q) <= 2}


@pytest.mark.parametrize("slot", [5, 1000])
@pytest.mark.parametrize("strict,forward", [(True, False), (False, False), (True, True), (False, True)])
def test_asof(spark, slot, strict, forward):
    rng = random.Random(slot)
    probes = [(i, rng.choice([1, 2, None]), rng.choice([rng.randrange(60), None])) for i in range(60)]
    events = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(60), None]), i) for i in range(40)]
    p, e = spark.createDataFrame(probes, "i bigint, k bigint, t bigint"), spark.createDataFrame(events, "k bigint, u bigint, s bigint")
    got = {r.i: r.s for r in asof(p, e, ["k"], F.col("t"), F.col("u"), F.col("s"), ["s"], strict=strict, forward=forward, slot=slot).collect()}
    for i, k, t in probes:
        own = [(u, s) for kk, u, s in events if k is not None and kk == k and u is not None and t is not None and ((u > t or (u == t and not strict)) if forward else (u < t or (u == t and not strict)))]
        want = (min(own) if forward else max(own))[1] if own else None
        assert got[i] == want, (i, k, t)


def test_overlap(spark):
    rng = random.Random(4)
    a = [(rng.randrange(3), i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.randrange(90) for _ in range(50))]
    b = [(rng.randrange(3), i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.randrange(90) for _ in range(50))]
    got = sorted(tuple(r) for r in overlap_pairs(spark.createDataFrame(a, "k int, x int, s int, e int"), spark.createDataFrame(b, "k int, y int, rs int, re int"), ["k"], 10).select("x", "y", "overlap").collect())
    assert got == sorted((x, y, min(e, f) - max(s, r)) for k, x, s, e in a for m, y, r, f in b if k == m and s < f and r < e)


def test_rechunk(spark):
    rows = [(1, i, n) for i, n in enumerate([3, 0, 12, 5, 1, 0])] + [(2, 0, 10), (3, 0, 0)]
    got = [tuple(r) for r in rechunk(spark.createDataFrame(rows, "k int, seq bigint, n bigint"), ["k"], 5).orderBy("k", "piece").collect()]
    assert got == [(1, 0, 5, 2), (1, 1, 5, 2), (1, 2, 5, 2), (1, 3, 5, 3), (1, 4, 1, 5), (2, 0, 5, 0), (2, 1, 5, 0)]


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        get_dataset("nothing")
    with pytest.raises(ValueError):
        register_dataset("documents")(lambda s, d: None)
    for pipe, idx, body in (("p", 0, '{"type": "transcription", "output": "a b"}'), ("q", 3, '{"type": "timed_transcription", "segments": [{"text": "c", "start_time": 0, "end_time": 1}, {"text": "d"}]}')):
        d = tmp_path / pipe / "set" / str(idx)
        d.mkdir(parents=True)
        (d / "transcription.json").write_text(body)
    assert sorted(tuple(r) for r in read_prediction_tree(spark, str(tmp_path)).collect()) == [("p", "set", 0, "a b"), ("q", "set", 3, "c d")]
    df = spark.createDataFrame([([0.0, 1.0, -1.0, 0.5, float("nan"), None, 2.0],)], "a array<float>")
    assert df.select(pcm16(F.col("a")).alias("x")).first().x == [0, 32767, -32768, 16384, 0, 0, 32767]
