import random

import numpy as np
import pytest

from tessitura.operators.intervals import merge_flat, periods_and_gaps, speaker_periods


def brute(rows, closed=True):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s)
        done = []
        for s, e in iv:
            if done and (s <= done[-1][1] if closed else s < done[-1][1]):
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(key, "period", s, e) for s, e in done}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(done, done[1:])}
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("leaf,fan_in", [(7, 2), (50, 3), (600_000, 12)])
def test_random_against_brute_force(spark, closed, leaf, fan_in):
    rng = random.Random(leaf)
    rows = []
    for key in range(40):
        for _ in range(rng.randrange(1, 25)):
            s = rng.randrange(-40, 300)
            rows.append((key, s, s + rng.choice([-3, 0, 1, 2, 3, 5, 8, 90, 250])))
    rows += rows[:50] + [(None, 1, 2), (3, None, 5), (3, 4, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k int, a bigint, b bigint, kind string, __iv string")
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], "a", "b", closed=closed, leaf=leaf, fan_in=fan_in).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, closed)


def test_empty_and_dirty_times(spark):
    df = spark.createDataFrame([], "rec_id bigint, speaker_idx int, start_time double, end_time double")
    assert speaker_periods(df).count() == 0
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, 0, nan, 1.0), (1, 0, 0.0, inf), (1, 0, 2.0, 1.0), (1, 0, 1.0, 1.0000001), (1, None, 0.0, 9.0), (2, 0, 0.0001, 1.0000001), (2, 0, 1.0, 2.0)],
        "rec_id bigint, speaker_idx int, start_time double, end_time double",
    )
    assert [tuple(r) for r in speaker_periods(df).collect()] == [(2, 0, "period", 0, 2000)]


def test_merge_flat_is_associative():
    rng = np.random.default_rng(3)
    g, s = rng.integers(0, 5, 500), rng.integers(0, 3000, 500)
    e = s + rng.integers(1, 9, 500)
    whole = merge_flat(g, s, e)
    parts = [merge_flat(g[i::7], s[i::7], e[i::7]) for i in range(7)]
    again = merge_flat(*[np.concatenate(x) for x in zip(*parts)])
    assert all((a == b).all() for a, b in zip(whole, again))
