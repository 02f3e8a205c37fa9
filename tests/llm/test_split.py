import random

import numpy as np
import pytest

from tessitura.llm.split import StrongestCut, audio_pieces, cut_points, split_recordings

REC = "rec_id bigint, audio struct<array:array<float>,sampling_rate:int>, pieces string"
TXT = "rec_id bigint, seg_id bigint, start_time double, end_time double, cov string"


def test_strongest_rightmost():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 33):
        v = rng.integers(0, 4, n)
        t = StrongestCut(v)
        for i in range(n):
            for j in range(i + 1, n + 1):
                assert t.query(i, j) == max(range(i, j), key=lambda k: (v[k], k))


def best_hard(length, positions, limit, overlap):
    """Fewest cuts away from a boundary, by dynamic programming over all positions."""
    if length <= limit:
        return 0
    cost = {0: 0}
    bounds = set(positions)
    for a in range(length):
        if a not in cost:
            continue
        start = a - overlap if a else 0
        for b in range(max(a, start + overlap) + 1, min(start + limit, length) + 1):
            cost[b] = min(cost.get(b, 1 << 30), cost[a] + (0 if b in bounds or b == length else 1))
    return cost[length]


def test_pieces_cover_overlap_and_use_boundaries():
    rng = random.Random(2)
    for _ in range(300):
        limit, overlap = rng.choice([(10, 2), (7, 3), (12, 0), (30, 2)])
        length = rng.randrange(1, 120)
        pos = sorted(rng.sample(range(1, length), min(length - 1, rng.randrange(0, 15)))) if length > 1 else []
        out = cut_points(length, np.array(pos, np.int64), np.array([rng.randrange(3) for _ in pos]), limit, overlap)
        assert out[0][0] == 0 and out[-1][1] == length and all(b - a <= limit for a, b, _ in out)
        assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(out, out[1:]))
        assert all((how == "natural") == (b in pos) for _, b, how in out[:-1])
        assert sum(how == "hard" for *_, how in out) == best_hard(length, pos, limit, overlap)
    with pytest.raises(ValueError):
        cut_points(5, np.array([]), np.array([]), 2, 2)


def brute_gap(n, rate, texts):
    whole = n / rate
    texts = {(s, e) for s, e in texts if e is not None and e == e}
    ends = {e for _, e in texts if 0 < e < whole and not any(s is not None and s < e < x for s, x in texts)}
    at = [0, *sorted(ends), whole]
    return max(b - a for a, b in zip(at, at[1:]))


def test_against_brute_force(spark):
    rng = random.Random(4)
    recs, texts, want = [], [], {}
    for rec in range(40):
        rate, secs = rng.choice([8, 10, 25]), rng.choice([20, 30, 31, 64, 130])
        n = rate * secs + rng.choice([0, 1])
        recs.append((rec, ([0.5] * n, rate), "x"))
        own = []
        for i in range(rng.randrange(0, 12)):
            s = rng.randrange(0, secs * 8) / 8
            e = rng.choice([None, float("nan"), s + rng.randrange(-8, 80) / 8, s + 4, s])
            own.append((rng.choice([s, s, s, None]), e))
        texts += [(rec, i, s, e, "y") for i, (s, e) in enumerate(own)] * rng.choice([1, 2])
        if n > 30 * rate:
            want[rec] = brute_gap(n, rate, own)
    recs += [recs[0], (90, None, "x"), (91, ([], 8), "x"), (92, ([1.0] * 999, 0), "x"), (93, ([1.0] * 999, None), "x"), (None, ([1.0] * 999, 8), "x"), (94, (None, 8), "x")]
    a, b = spark.createDataFrame(recs, REC), spark.createDataFrame([*texts, (None, 1, 0.0, 1.0, "y")], TXT)
    got = {r["rec_id"]: r for r in split_recordings(a, b).collect()}
    assert set(got) == set(want)
    for rec, r in got.items():
        assert abs(r["max_gap_us"] / 1e6 - want[rec]) < 1e-5
        assert all(p["end_sample"] - p["start_sample"] <= 30 * r["rate"] for p in r["pieces"])
    for r in audio_pieces(a, b).collect():
        assert len(r["audio"]["array"]) == r["end_sample"] - r["start_sample"]
    assert split_recordings(spark.createDataFrame([], REC), spark.createDataFrame([], TXT)).count() == 0
