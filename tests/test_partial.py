"""Partial alignments of a small table against a plain loop over its ticks."""

import datetime

import pytest

from tessitura.functions.alignment import align
from tessitura.functions.multivariant import parse, starting_part
from tessitura.plans import streams

TEXT = "so {forty two|42} <*> new-born end"
#: (piece, start, end): 'new-born' is one timed piece of two words; the times are those of each word of the truth.
PIECES = [("so", 0.0, 0.3), ("forty", 0.3, 0.6), ("two", 0.6, 0.9), ("42", 0.3, 0.9), ("<*>", 1.0, 1.6), ("new-born", 1.6, 2.4), ("end", 2.5, 2.7)]
TIMES = [(0.0, 0.3), (0.3, 0.6), (0.6, 0.9), (0.3, 0.9), (1.0, 1.6), (1.6, 2.0), (2.0, 2.4), (2.5, 2.7)]
#: seq, chunk, text, seconds after the first put, seconds processed.
CHUNKS = [(1, "a", "so", 0.0, 0.9), (2, "b", "fort", 0.55, 0.5), (3, "b", "42", 0.8, 0.75), (4, "c", "er hm", 1.3, 2.3), (5, "d", "new born", 2.1, None), (6, "e", "end", 3.0, 2.75), (7, "f", "so so", 3.0, 2.8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("partial"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    put("recording", [(1, "d", "test", 1, "en", TEXT)], "rec_id long, dataset_name string, split_name string, sample_idx int, lang string, transcription string")
    tokens = [(k, 1, None if v == "end" else v, TEXT.index(v), TEXT.index(v) + len(v), s, e) for k, (v, s, e) in enumerate(PIECES)]
    put("transcript_token", tokens + tokens[:2], "token_id long, rec_id long, value string, start_pos int, end_pos int, start_time double, end_time double")
    t0 = datetime.datetime(2024, 1, 1)
    put("output_chunk", [(r, q, u, x, False, t0 + datetime.timedelta(seconds=s), d) for q, u, x, s, d in CHUNKS for r in (1, 2)], "rec_id long, seq long, uid string, text string, is_finish boolean, put_ts timestamp, seconds_processed double")
    return at


def said(time):
    blocks = parse(TEXT)
    for w in (w for b in blocks for o in b["options"] for w in o):
        w["start_time"], w["end_time"] = TIMES[w["uid"]]
    return starting_part(blocks, time)


def states():
    """[(seq, put, processed, known text)] after each chunk."""
    out, known, done = [], {}, 0.0
    for q, u, x, s, d in CHUNKS:
        known[u], done = x, done if d is None else d
        out.append((q, s, done, " ".join(known.values())))
    return out


def test_every_tick_has_the_last_state_before_it(spark, folder):
    want = {}
    for tick in range(1, 14):
        q, _, done, text = [s for s in states() if s[1] < tick * 0.25][-1]
        a = align(said(done), text.split())
        want[tick] = (q, done, a["n_word_errors"], a["true_len"], a["n_correct"])
    got = {r.tick: (r.seq, r.processed, r.n_word_errors, r.true_len, r.n_correct) for r in streams.partial_alignment(spark, folder).collect()}
    assert got == want
    assert want[4] == (3, 0.75, 0, 2, 2)  # so 42, under way
    news = [(r.rec_id, r.tick, r.n, r.text) for r in streams.known_news(spark, folder).collect()]
    assert sorted(news) == [(r, 1, 7, "so fort 42 er hm new born end so so") for r in (1, 2)]


def brute_positions():
    """The definition, match by match."""
    out = {}
    for q, _, done, text in states():
        m = align(said(done), text.split())["matches"]
        tail = next((k for k in range(len(m), -1, -1) if k == 0 or m[k - 1]["status"] != "deletion"), 0)
        for i, x in enumerate(m):
            if x["true_uid"] is not None:
                s, e = TIMES[x["true_uid"]]
            else:
                s = max([0.0, *(TIMES[y["true_uid"]][1] for y in m[:i] if y["true_uid"] is not None)])
                e = min([done, *(TIMES[y["true_uid"]][0] for y in m[i + 1 : tail] if y["true_uid"] is not None)])
            out[q, i] = ("not_yet" if i >= tail else x["status"], s, e, pytest.approx(done - (s + e) / 2))
    return out


def test_error_positions_of_all_states(spark, folder):
    want = brute_positions()
    assert {(r.seq, r.i): (r.status, r.start_time, r.end_time, r.time_delta) for r in streams.error_positions(spark, folder).collect()} == want
    assert {s for s, *_ in want.values()} >= {"correct", "insertion", "not_yet"}
    rows = streams.latency_histogram(spark, folder).collect()
    assert len(rows) == 31
    for r in rows:
        own = [s for s, a, b, d in want.values() if r.lo <= d.expected < r.hi]
        assert r.n == len(own)
        assert [r.correct, r.error, r.not_yet] == ([None] * 3 if not own else [pytest.approx(sum(k == w for k in ("correct" if s == "correct" else "not_yet" if s == "not_yet" else "error" for s in own)) / len(own)) for w in ("correct", "error", "not_yet")])
