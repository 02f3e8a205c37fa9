"""Overlap joins against all pairs, with far and long intervals."""

import random

from tessitura.operators.asof import overlap_pairs

LEFT, RIGHT = "k bigint, a bigint, s bigint, e bigint", "k bigint, b bigint, rs bigint, re bigint"


def brute(left, right):
    return sorted((a, b, min(e, f) - max(s, r)) for k, a, s, e in left for q, b, r, f in right if k is not None and k == q and s <= e and r <= f and s < f and r < e)


def test_against_all_pairs_at_every_level(spark):
    rng = random.Random(3)
    for wide in (False, True):
        def some(n, start):
            rows = []
            for i in range(n):
                s = rng.randrange(-300, 3000)
                far = rng.choice([0, 1, 50, 3000, 10**6, 10**12, 8 * 10**15]) if wide else rng.randrange(0, 200)
                rows.append((rng.choice([1, 1, 1, 2, None]), start + i, s, rng.choice([s + far, s + far, s, s - 3])))
            return rows
        left, right = some(80, 0), some(80, 1000)
        got = overlap_pairs(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], 100)
        assert sorted((r.a, r.b, r.overlap) for r in got.collect()) == brute(left, right)


def test_one_far_end_does_not_multiply_rows(spark):
    left = [(1, 0, 0, 10**12)] + [(1, i, 30_000 * i, 30_000 * i + 5_000) for i in range(1, 200)]
    right = [(1, 0, 5, 10**12)] + [(1, i, 30_000 * i + 1_000, 30_000 * i + 2_000) for i in range(1, 200)]
    got = overlap_pairs(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], 30_000)
    assert sorted((r.a, r.b, r.overlap) for r in got.collect()) == brute(left, right)
    assert overlap_pairs(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), ["k"], 100).count() == 0
