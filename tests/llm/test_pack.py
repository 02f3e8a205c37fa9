import itertools
import random

import numpy as np

from tessitura.llm.pack import best_fit_decreasing, certificate, lower_bound, pack, packed_documents


def fewest(sizes, capacity):
    """Fewest containers by search over all assignments."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_bracket_the_optimum():
    rng = random.Random(1)
    tight = 0
    for _ in range(300):
        cap = rng.choice([10, 17, 24, 100])
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        where, n = best_fit_decreasing(np.array(sizes), cap)
        assert max(np.bincount(where, weights=sizes)) <= cap and len(set(where)) == n
        values, counts = np.unique(sizes, return_counts=True)
        low, best = lower_bound(values, counts, cap), fewest(sizes, cap)
        assert low <= best <= n
        tight += low == best
    assert tight > 250
    assert lower_bound(np.array([]), np.array([]), 10) == 0
    assert lower_bound(np.array([6]), np.array([9]), 10) == 9  # none of two fit


def check(rows, sizes, capacity):
    by = {}
    for r in rows:
        by.setdefault((r["grp"], r["bin"]), []).append(r["size"])
    assert max(map(sum, by.values())) <= capacity
    for key, own in itertools.groupby(sorted(rows, key=lambda r: (r["key"], r["piece"])), key=lambda r: r["key"]):
        own = list(own)
        size = sizes[key] or 0
        assert sum(r["size"] for r in own) == size and [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == max(1, -(-size // capacity)) == own[0]["n_pieces"]
    assert {r["key"] for r in rows} == set(sizes)
    return len(by)


def test_pack(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, None, 5, rng.randrange(1, 60), rng.randrange(1, 100), 100, 230]) for i in range(3000)}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in sizes.items()], "key bigint, size int, grp string, bin int")
    total = sum(v or 0 for v in sizes.values())
    shared = check(pack(df, 100, group=200).collect(), sizes, 100)
    assert -(-total // 100) <= shared
    values, counts = np.unique([min(100, v - p) for v in sizes.values() if v for p in range(0, v, 100)], return_counts=True)
    assert shared <= lower_bound(values, counts, 100) * 1.02 + 1
    assert pack(spark.createDataFrame([], "key bigint, size int")).count() == 0


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    """Groups of thirty items need more than four rounds; each but the last leaves fewer containers."""
    from tessitura.llm import pack as module

    written, keep = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, purpose: written.append(keep(df, purpose)) or written[-1])
    rng = random.Random(4)
    sizes = {i: rng.randrange(26, 40) for i in range(6000)}
    got = check(pack(spark.createDataFrame(list(sizes.items()), "key bigint, size int"), 100, group=30).collect(), sizes, 100)
    assert len(written) - 1 > 4
    alone = written[0].select("grp", "bin").distinct().count()
    values, counts = np.unique(list(sizes.values()), return_counts=True)
    assert lower_bound(values, counts, 100) <= got < alone


def test_documents(spark):
    docs = [(1, "a b " * 3000), (2, None), (3, ""), (4, "word"), (4, "word"), (5, "x " * 1024)]
    got = packed_documents(spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, size string"))
    rows = got.collect()
    assert sorted({r.doc_id for r in rows if r.n_pieces > 1}) == [1]
    assert sorted(r.n_tokens for r in rows if r.doc_id == 4) == [1, 1]
    c = certificate(got).first()
    assert c.bound <= c.containers <= c.bound + 1
