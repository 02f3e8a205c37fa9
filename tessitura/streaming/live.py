"""Chunk streams as Structured Streaming: the joined text of each recording as it grows, load per window, live change tables.

Order within a recording is order of arrival (of batches, and within a batch of put_ts, then seq); FINISH completes it and frees
its state. What comes for a finished recording is counted as late and changes nothing. The batch functions give the same
results once FINISH has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.operators.changefeed import ChangeTable

CHUNK = "rec_id bigint, seq bigint, uid string, op string, text string, is_finish boolean, seconds_processed double, put_ts timestamp, get_ts timestamp"
TEXT = "rec_id bigint, n_chunks bigint, text string, finished boolean, late bigint"
STATE = "keys array<string>, firsts array<bigint>, texts array<string>, finished boolean, late bigint"


def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One recording's step: new chunks are put at their end, edits of a known uid in its place."""
    keys, firsts, texts, finished, late = state.get if state.exists else ([], [], [], False, 0)
    place = {k: i for i, k in enumerate(keys)}
    keys, firsts, texts = list(keys), list(firsts), list(texts)
    rows = pd.concat(list(batches)).sort_values(["put_ts", "seq"], kind="stable")
    for seq, uid, text, fin in zip(rows["seq"], rows["uid"], rows["text"], rows["is_finish"]):
        if finished:
            late += 1
        elif fin is not None and fin == fin and bool(fin):
            finished = True
        elif text is not None and text == text:
            k = f"#{seq}" if uid is None or uid != uid else uid
            if k in place:
                texts[place[k]] = text
            else:
                place[k] = len(keys)
                keys.append(k)
                firsts.append(int(seq))
                texts.append(text)
    out = pd.DataFrame({"rec_id": [key[0]], "n_chunks": [len(keys)], "text": [" ".join(texts)], "finished": [finished], "late": [late]})
    # A finished recording keeps the mark alone, to tell late chunks.
    state.update(([], [], [], True, late) if finished else (keys, firsts, texts, False, late))
    yield out


def live_texts(chunks: DataFrame) -> DataFrame:
    """The text of each recording after each batch that touches it; rows of a finished recording say only how much came late."""
    return chunks.select("rec_id", "seq", "uid", "text", "is_finish", "put_ts").groupBy("rec_id").applyInPandasWithState(grow, TEXT, STATE, "append", GroupStateTimeout.NoTimeout)


def live_load(chunks: DataFrame, window: str = "1 second", lateness: str = "1 minute") -> DataFrame:
    """Chunks, and the mean and longest delay, per window of put_ts; the watermark only frees state."""
    delay = (F.unix_micros("get_ts") - F.unix_micros("put_ts")) / 1e6
    timed = chunks.withWatermark("put_ts", lateness).groupBy(F.window("put_ts", window).alias("w"))
    return timed.agg(F.count("*").alias("n"), F.avg(delay).alias("mean"), F.max(delay).alias("most")).select("w.start", "n", "mean", "most")


def live_changes(chunks: DataFrame, table: ChangeTable, checkpoint: str) -> StreamingQuery:
    """Appends a stream of changes to a change table, batch by batch; a batch that is written again changes no reader's result."""
    step: Callable[[DataFrame, int], None] = lambda batch, _: table.append(batch)
    return chunks.filter("not coalesce(is_finish, false)").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
