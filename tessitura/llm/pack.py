"""Filling containers of fixed capacity with items of varying size, with certified bounds.

Items are spread over groups of bounded size and each group is packed best-fit decreasing. Dual feasible functions give a lower
bound on each group's number of containers; a group that meets it is proven optimal and stays. The others release what does
not fill a container, exchange these items among each other, and are packed again, as long as that saves containers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.encode import encode_corpus
from tessitura.session import materialize

CAPACITY = 2_048
#: Items in a group (some MB in one task).
GROUP = 50_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers); sizes in decreasing order, none above the capacity.

    Open containers are kept by their free room; a bit mask of the rooms there are finds the tightest in one step.
    """
    out = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                mask ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        out[i] = b
        left = room - size
        if not by_room[left]:
            mask |= 1 << left
        by_room[left].append(b)
    return out, n


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers that items of these sizes need at least, by dual feasible functions over the histogram of sizes.

    Functions that map sizes so that no container's items exceed its capacity after the mapping: raising those above
    capacity - e to the capacity and dropping those below e, for every e up to half of it; and rounding to k + 1 steps. They
    are also applied one after the other.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    keep = sizes > 0
    sizes, counts = sizes[keep], counts[keep]
    if not len(sizes):
        return 0
    total = int((sizes * counts).sum())
    best = -(-total // capacity)
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, sizes, counts)
    number = np.concatenate([[0], np.cumsum(hist)])
    weight = np.concatenate([[0], np.cumsum(hist * np.arange(capacity + 1))])
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    raised = large * capacity + middle
    best = max(best, int(-(-raised.max() // capacity)))
    x = sizes.astype(object)
    for k in range(1, 24):
        steps = (k + 1) * x // capacity
        exact = (k + 1) * x % capacity == 0
        # In units of capacity / k, to stay with whole numbers.
        value = np.where(exact, k * x, steps * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
        # First raise and drop at a few thresholds, then round.
        for e0 in {capacity // (k + 2), capacity // (k + 1), capacity // 2}:
            y = np.where(x > capacity - e0, capacity, np.where(x < e0, 0, x))
            steps = (k + 1) * y // capacity
            value = np.where((k + 1) * y % capacity == 0, k * y, steps * capacity)
            best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


PACKED = "key bigint, piece int, n_pieces int, size int, grp bigint, bin bigint, free int, bins int, bound int"


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = pdf["size"].to_numpy()
    where, n = best_fit_decreasing(sizes, capacity)
    used = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
    values, counts = np.unique(sizes, return_counts=True)
    return pdf[["key", "piece", "n_pieces", "size", "grp"]].assign(
        bin=where, free=(capacity - used)[where].astype("int32"), bins=np.int32(n), bound=np.int32(lower_bound(values, counts, capacity))
    )


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """key, piece, n_pieces, size, grp, bin: the container (grp, bin) of each piece of each item. items: key (unique), size.

    An item larger than the capacity is split into full pieces and a rest; no other is. Items of size 0 take no room and lie in
    any container; a null size counts as 0. Equal sizes go in order of key and piece. No items, no rows.

    Groups above their bound exchange items until one of them at most is left or a round saves no container; each round but the last
    saves one at least, so this ends. What is left above the bound, ``certificate`` tells.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("int")
    n = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int")
    pieces = items.select("key", size.alias("whole"), n.alias("n_pieces")).select("key", "whole", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.select("key", "piece", "n_pieces", F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    total = pieces.count()
    groups = max(1, math.ceil(total / group))

    def fill(rows: DataFrame, number: int, base: int) -> DataFrame:
        rows = rows.withColumn("grp", base + F.pmod(F.xxhash64("key", "piece", F.lit(base)), F.lit(number)))
        return materialize(rows.groupBy("grp").applyInPandas(lambda p: _pack_group(p, capacity), PACKED), "packed")

    state = fill(pieces, groups, 0)
    done, base = None, groups
    while True:
        gap = F.col("bins") > F.col("bound")
        # Containers of uncertified groups that have room left are opened again; full ones stay.
        loose = state.filter(gap & (F.col("free") > 0))
        old = loose.groupBy("grp").agg(F.countDistinct("bin").alias("b"), F.count("*").alias("n")).agg(F.sum("b"), F.sum("n"), F.count("*")).first()
        if not old[0] or old[2] < 2:
            break
        number = max(1, math.ceil(old[1] / group))
        again = fill(loose.select("key", "piece", "n_pieces", "size"), number, base)
        new = again.groupBy("grp").agg(F.first("bins").alias("b")).agg(F.sum("b")).first()[0]
        base += number
        if new >= old[0]:
            break
        rest = state.filter(~(gap & (F.col("free") > 0)))
        done = rest if done is None else done.unionAll(rest)
        state = again
    out = state if done is None else done.unionAll(state)
    return out.select("key", "piece", "n_pieces", "size", "grp", "bin")


def document_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """key, doc_id, size: every document with its number of tokens, written once; key numbers the rows, so repeated ids stay apart."""
    sizes = encode_corpus(documents, "doc_id", "text", path).select("doc_id", F.size("ids").alias("size"))
    return materialize(sizes.withColumn("key", F.monotonically_increasing_id()), "sizes")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, n_pieces, first_token, n_tokens, container: every document in containers of ``capacity`` tokens."""
    sizes = document_sizes(documents, path)
    packed = pack(sizes, capacity)
    return packed.join(sizes.select("key", "doc_id"), "key").select(
        "doc_id", "piece", "n_pieces", (F.col("piece") * capacity).cast("bigint").alias("first_token"), F.col("size").alias("n_tokens"), F.concat_ws("-", "grp", "bin").alias("container")
    )


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, what all items together need at least, the gap between them, and the share of room left. The histogram has capacity + 1 rows at most."""
    hist = packed.groupBy("n_tokens").count()
    bins = packed.select("container").distinct().count()
    rows = hist.collect()
    bound = lower_bound(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), capacity)
    tokens = sum(r[0] * r[1] for r in rows)
    return packed.sparkSession.createDataFrame([(bins, bound, bins - bound, 1 - tokens / (bins * capacity) if bins else 0.0)], "containers bigint, bound bigint, gap bigint, unused double")
