import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators.windows import previous, running, trailing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.randrange(-20, 20)]), "x") for i in range(200)] + [(3, 500, 1, "x")]


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [7, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, rows, width, inclusive):
    df = spark.createDataFrame(rows, "k int, i int, v int, __slot string").drop("__slot")
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / width), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}, inclusive).collect()
    assert len(got) == len(rows)
    by = {r.i: r for r in got}
    for own in groups(rows).values():
        for j, r in enumerate(own):
            seen = [x[2] for x in own[: j + inclusive] if x[2] is not None]
            assert (by[r[1]].s, by[r[1]].m, by[r[1]].l) == ((sum(seen), max(seen), min(seen)) if seen else (None, None, None))


@pytest.mark.parametrize("width", [7, 1000])
def test_previous_and_mean(spark, rows, width):
    df = spark.createDataFrame(rows, "k int, i int, v int, z string")
    slot = F.floor(F.col("i") / width)
    lag = {r.i: (r.a, r.b) for r in previous(df, ["k"], ["i"], slot, {"a": "v", "b": "i"}).collect()}
    mean = {r.i: r.m for r in trailing(df, ["k"], ["i"], slot, 4, lambda w: F.avg("v").over(w), "m", block=width + 3).collect()}
    for own in groups(rows).values():
        for j, r in enumerate(own):
            assert lag[r[1]] == ((own[j - 1][2], own[j - 1][1]) if j else (None, None))
            seen = [x[2] for x in own[max(0, j - 3) : j + 1] if x[2] is not None]
            assert mean[r[1]] == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert running(df.limit(0), ["k"], ["i"], slot, {"s": ("sum", F.col("v"))}).count() == 0
