import datetime as dt
import random

import pytest

from tessitura.operators.changefeed import ChangeTable, standing_chunks
from tessitura.streaming.live import CHUNK, live_changes, live_load, live_texts

START = dt.datetime(2025, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(3)
    rows = []
    for rec in range(5):
        for seq in range(60):
            rows.append((rec, seq, rng.choice([None, "a", "b", "c", str(seq)]), rng.choice(["insert", "update", "delete"]), f"w{rec}_{seq}", False, 1.0, at(seq), at(seq + rng.random())))
        rows.append((rec, 60, None, None, None, True, 1.0, at(60), at(61)))
        rows.append((rec, 61, "late", "insert", "late", False, 1.0, at(90), at(91)))
    return sorted(rows, key=lambda r: r[7])


@pytest.fixture()
def stream(spark, chunks, tmp_path):
    for i in range(0, len(chunks), 70):
        spark.createDataFrame(chunks[i : i + 70], CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_texts_equal_batch(spark, stream, chunks, tmp_path):
    rows = run(spark, live_texts(stream), "texts", tmp_path).collect()
    for rec in range(5):
        own = {}
        for r in chunks:
            if r[0] == rec and r[1] < 60:
                own[r[2] or f"#{r[1]}"] = r[4]
        done = [r for r in rows if r.rec_id == rec and r.finished and r.n_chunks]
        assert done[-1].text == " ".join(own.values()) and done[-1].n_chunks == len(own)
        assert max(r.late for r in rows if r.rec_id == rec) == 1


def test_load_windows(spark, stream, chunks, tmp_path):
    got = {r.start: r.n for r in run(spark, live_load(stream, "10 seconds"), "load", tmp_path, "complete").collect()}
    assert sum(got.values()) == len(chunks) and got[START] == 50


def test_changes_equal_batch(spark, stream, chunks, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), ["rec_id", "uid"], ["rec_id", "seq"], ["put_ts", "seq"], ["text"])
    live_changes(stream, table, str(tmp_path / "cp2")).awaitTermination(180)
    got = sorted((r.rec_id, r.seq) for r in table.current().collect())
    assert got == sorted((r.rec_id, r.seq) for r in standing_chunks(spark.createDataFrame(chunks, CHUNK)).collect())
