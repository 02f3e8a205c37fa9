"""Splitting oversized items at natural boundaries, with a fixed overlap between consecutive pieces.

The boundaries of an item form a range-maximum index (a sparse table over their strengths): each piece asks for the
strongest boundary in the window of permissible ends, ties going to the right, and the next piece steps back by the overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.intervals import interval_nodes, merge_flat

#: Seconds: the limit of a piece and what it shares with the one before.
LIMIT_S, OVERLAP_S = 30, 2


class StrongestCut:
    """Sparse table over strengths: the index of the largest in any range, the rightmost of equals, in constant time."""

    def __init__(self, strength: np.ndarray):
        self.strength = np.asarray(strength)
        self.levels = [np.arange(len(self.strength))]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(self.strength):
            below = self.levels[-1]
            left, right = below[:-half], below[half:]
            self.levels.append(np.where(self.strength[right] >= self.strength[left], right, left))

    def query(self, lo: int, hi: int) -> int:
        """Index of the strongest in [lo, hi)."""
        k = (hi - lo).bit_length() - 1
        left, right = self.levels[k][lo], self.levels[k][hi - (1 << k)]
        return int(right if self.strength[right] >= self.strength[left] else left)


def cut_points(length: int, positions: np.ndarray, strength: np.ndarray, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int, str]]:
    """Pieces (start, end, how the end was cut) of [0, length): ordered, each at most limit long and starting overlap before the last end.

    positions are sorted, strictly between 0 and length. A boundary is used whenever one lies in reach: first among pieces of
    at least ``least`` (half the limit), else among any that go beyond the overlap. Passing over a boundary never costs one
    later, since whatever can be reached from a later cut can be reached from an earlier one in one more step. Without any
    boundary in reach the piece is cut at the limit ('hard'); the last piece ends with the item ('end').
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit of a piece must exceed the overlap")
    least = limit // 2 if least is None else least
    index = StrongestCut(strength) if len(positions) else None
    out, start = [], 0
    while length - start > limit:
        end, how = start + limit, "hard"
        if index is not None:
            hi = int(np.searchsorted(positions, start + limit, "right"))
            far = int(np.searchsorted(positions, start + max(least, overlap + 1), "left"))
            near = int(np.searchsorted(positions, start + overlap, "right"))
            lo = far if far < hi else near
            if lo < hi:
                end, how = int(positions[index.query(lo, hi)]), "natural"
        out.append((start, end, how))
        start = end - overlap
    out.append((start, length, "end"))
    return out


def boundaries(timed_text: DataFrame) -> DataFrame:
    """(rec_id, cov, points): what each recording's timed texts cover, as open intervals, and ends of texts that cover nothing; in microseconds.

    An end_time is a natural boundary if no other text is under way, that is if it lies inside none of the open intervals.
    Those of texts with a length are right ends of the union; only others need checking. Texts without end_time (null, NaN)
    do not count; a text without start_time is under way at no time.
    """
    us = lambda c: F.when(F.abs(F.col(c)) < 9e12, F.round(F.col(c) * 1_000_000).cast("bigint"))
    rows = timed_text.select(F.col("rec_id"), us("start_time").alias("s"), us("end_time").alias("e")).filter("rec_id is not null and e is not null")
    cover = interval_nodes(rows, ["rec_id"], "s", "e", closed=False, leaf=600_000_000)
    points = rows.filter("s is null or e <= s").select("rec_id", "e").distinct()
    none = F.lit(None).cast("bigint")
    both = cover.select("rec_id", "__iv", none.alias("p")).unionByName(points.select("rec_id", F.lit(None).cast(cover.schema["__iv"].dataType).alias("__iv"), F.col("e").alias("p")))
    return both.groupBy("rec_id").agg(F.flatten(F.collect_list("__iv")).alias("cov"), F.collect_list("p").alias("points"))


PIECES = T.StructType([
    T.StructField("max_gap_us", T.LongType()),
    T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("start_sample", T.LongType()), T.StructField("end_sample", T.LongType()), T.StructField("cut", T.StringType())]))),
])


def _pieces(n: int, rate: int, cov, points, limit_s: float, overlap_s: float) -> dict:
    s = np.array([x["s"] for x in cov] if cov is not None else [], np.int64)
    e = np.array([x["e"] for x in cov] if cov is not None else [], np.int64)
    _, s, e = merge_flat(np.zeros(len(s), np.int64), s, e, closed=False)
    free = np.unique(np.array(points if points is not None else [], np.int64))
    if len(free) and len(s):  # not inside an open interval
        k = np.searchsorted(s, free, "left") - 1
        free = free[(k < 0) | (e[np.maximum(k, 0)] <= free)]
    at = np.union1d(e, free)
    whole = round(n / rate * 1_000_000)
    at = at[(at > 0) & (at < whole)]
    # The longer nothing starts after it, the stronger a boundary.
    nxt = np.append(s, max(whole, int(s[-1]) if len(s) else 0))[np.searchsorted(s, at, "left")]
    pause = np.maximum(nxt - at, 0)
    sample = np.floor(at * rate / 1_000_000 + 0.5).astype(np.int64)
    keep = (sample > 0) & (sample < n)
    cuts = cut_points(n, sample[keep], pause[keep], int(limit_s * rate), int(overlap_s * rate))
    return {"max_gap_us": int(np.diff(np.concatenate([[0], at, [whole]])).max()), "pieces": [{"start_sample": a, "end_sample": b, "cut": c} for a, b, c in cuts]}


def split_recordings(recording: DataFrame, timed_text: DataFrame, limit_s: float = LIMIT_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """rec_id, n_samples, rate, max_gap_us, pieces of each recording whose audio is longer than limit_s.

    pieces: ordered (start_sample, end_sample, cut) that cover the whole audio, at most limit_s long, each starting overlap_s
    before the last one ends; cut is 'natural', 'hard' where no boundary was in reach, or 'end'. max_gap_us: the longest way
    between neighbouring boundaries (start and end of the audio included). Only sizes of the audio are read, never its
    values into Python; ``audio_pieces`` cuts the arrays.

    No row: null or empty audio, a rate that is null or not positive, a null rec_id, audio within the limit, empty tables.
    NaN samples count as samples. Repeated rows of a recording count once (the longest audio holds, should they differ).
    """
    @F.pandas_udf(PIECES)
    def split(n: pd.Series, rate: pd.Series, cov: pd.Series, points: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pieces(*x, limit_s, overlap_s) for x in zip(n, rate, cov, points)], columns=["max_gap_us", "pieces"])

    recs = recording.select("rec_id", F.size("audio.array").cast("bigint").alias("n_samples"), F.col("audio.sampling_rate").alias("rate"))
    recs = recs.filter(f"rec_id is not null and rate > 0 and n_samples > rate * {limit_s}")
    recs = recs.groupBy("rec_id").agg(F.max(F.struct("n_samples", "rate")).alias("r")).select("rec_id", "r.*")
    # Only texts of recordings that must be cut are gathered by recording.
    texts = timed_text.select("rec_id", "start_time", "end_time").join(recs.select("rec_id"), "rec_id", "left_semi")
    both = recs.join(boundaries(texts), "rec_id", "left")
    return both.select("rec_id", "n_samples", "rate", split.asNondeterministic()("n_samples", "rate", "cov", "points").alias("x")).select("rec_id", "n_samples", "rate", "x.*")


def audio_pieces(recording: DataFrame, timed_text: DataFrame, limit_s: float = LIMIT_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """One row for each piece with its samples, sliced in the JVM: rec_id, piece, start_sample, end_sample, cut, audio."""
    cuts = split_recordings(recording, timed_text, limit_s, overlap_s).select("rec_id", F.posexplode("pieces").alias("piece", "p"))
    audio = recording.select("rec_id", F.col("audio.array").alias("samples"), F.col("audio.sampling_rate").alias("rate")).filter(F.size("samples") > F.col("rate") * limit_s)
    audio = audio.dropDuplicates(["rec_id"])
    part: Column = F.slice("samples", F.col("p.start_sample") + 1, F.col("p.end_sample") - F.col("p.start_sample"))
    return cuts.join(audio, "rec_id").select("rec_id", "piece", "p.*", F.struct(part.alias("array"), F.col("rate").alias("sampling_rate")).alias("audio"))
