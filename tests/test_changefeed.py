import datetime as dt
import random

from tessitura.operators.changefeed import ChangeTable, standing_after_batches, standing_chunks

SCHEMA = "rec_id bigint, seq bigint, uid string, op string, text string, is_finish boolean, put_ts timestamp, file string"


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def brute(rows):
    changes = {}
    for r in sorted(rows, key=lambda r: (r[6] is not None, r[6] or at(0))):
        if not r[5] and r[0] is not None and r[1] is not None:
            changes.setdefault((r[0], r[1]), r)
    state = {}
    for r in sorted(changes.values(), key=lambda r: (r[6] is not None, r[6] or at(0), r[1])):
        key = (r[0], r[2]) if r[2] is not None else (r[0], None, r[1])
        gone = (r[3] or "").strip().lower() in ("delete", "d", "del", "remove")
        state.pop(key, None)
        if not gone:
            state[key] = (r[0], r[1], r[2], r[4])
    return sorted(state.values(), key=str)


def feed(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        rec = rng.choice([7, 7, 7, 1, 2, None])
        rows.append((rec, rng.choice([seq, seq, seq, None]), rng.choice(["0", "1", "2", "3", None]), rng.choice(["insert", "U", " Update ", "DELETE ", "d", None]), rng.choice(["a", "", None, "b" * 50]), rng.choice([False, False, None, True]), at(rng.choice([seq, seq // 7, None])), "clash"))
    rows += rng.choices(rows, k=60)
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = feed(seed)
        got = sorted((tuple(r) for r in standing_chunks(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        assert got == brute(rows)


def test_batches_in_any_order_and_repeated(spark, tmp_path):
    rows = [r for r in feed(5) if not r[5] and r[0] is not None and r[1] is not None]
    by_change = {(r[0], r[1]): r for r in rows}
    rows = list(by_change.values())
    batches = [rows[i::4] for i in range(4)]
    table = ChangeTable(spark, str(tmp_path / "t"), ["rec_id", "uid"], ["rec_id", "seq"], ["put_ts", "seq"], ["text"])
    for b in (batches[2], batches[0], batches[3], batches[1]):
        table.append(spark.createDataFrame(b, SCHEMA))
    got = sorted(tuple(r) for r in table.current().select("rec_id", "seq").collect())
    assert got == sorted((a, b) for a, b, *_ in brute(rows))
    table.append(spark.createDataFrame(batches[1], SCHEMA))  # a repeated batch: the same files once more
    assert sorted(tuple(r) for r in table.current().select("rec_id", "seq").collect()) == got


def test_copies_in_several_batches(spark, tmp_path):
    """Copies of a change that differ in arrival, op and text, over random batches: the least sequence number, then content, holds."""
    rng = random.Random(8)
    for turn in range(3):
        rows = [r for r in feed(20 + turn, 120)]
        rows += [(r[0], r[1], rng.choice([r[2], "9"]), rng.choice(["d", r[3]]), rng.choice(["z", r[4]]), r[5], rng.choice([at(rng.randrange(200)), r[6], None]), r[7]) for r in rng.choices(rows, k=80)]
        rng.shuffle(rows)
        whole = sorted((tuple(r) for r in standing_chunks(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        batches = [spark.createDataFrame(rows[i::4], SCHEMA) for i in range(4)]
        got = sorted((tuple(r) for r in standing_after_batches([*batches, batches[1]], str(tmp_path / f"t{turn}")).collect()), key=str)
        assert got == whole


def test_a_late_copy_does_not_kill_its_successor(spark, tmp_path):
    one = lambda seq, text, n: spark.createDataFrame([(1, seq, "u", "insert", text, False, at(n), "")], SCHEMA)
    got = standing_after_batches([one(5, "old", 10), one(6, "new", 11), one(5, "old", 12)], str(tmp_path / "t")).collect()
    assert [r.text for r in got] == ["new"]


def test_empty(spark):
    assert standing_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
