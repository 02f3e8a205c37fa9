"""Union of time intervals per entity, and its complement, as a mergeable aggregate.

State: a list of sorted disjoint intervals. Leaves fold the intervals that start in one time slot of an entity; a
reduction tree merges neighbouring leaves into nodes of a fixed time span. Since a node's starts lie within its span of
integer time, its list has a bounded size, however many rows an entity has. Above the nodes no lists are gathered: only
each node's furthest end travels on (one row per node), as the carry with which every node emits its own periods and gaps
where it lies. So one entity with a third of all rows spreads over as many tasks as it has nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.session import materialize

LIST = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def merge_flat(group: np.ndarray, s: np.ndarray, e: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge many lists at once: arrays of (group, start, end) -> the same, sorted and disjoint per group.

    closed: intervals that only touch are joined too. Linear for lists that come in order, as the tree hands them on; others are sorted first.
    """
    if len(s) == 0:
        return group, s, e
    if not bool(np.all((group[1:] > group[:-1]) | ((group[1:] == group[:-1]) & (s[1:] >= s[:-1])))):
        order = np.lexsort((s, group))
        group, s, e = group[order], s[order], e[order]
    low, width = int(min(s.min(), e.min())), int(max(s.max(), e.max()) - min(s.min(), e.min())) + 2
    _, rank = np.unique(group, return_inverse=True)
    if width * (int(rank[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(e - low + rank * width) - rank * width + low
    else:
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(e, np.flatnonzero(np.diff(rank)) + 1)])
    new = np.ones(len(s), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (s[1:] > reach[:-1] if closed else s[1:] >= reach[:-1])
    at = np.flatnonzero(new)
    return group[at], s[at], np.maximum.reduceat(e, at)


def _merge_batch(lists: pa.Array, closed: bool) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    flat = lists.flatten()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    group = np.repeat(np.arange(n), lengths)
    s = flat.field("s").to_numpy(zero_copy_only=False)
    e = flat.field("e").to_numpy(zero_copy_only=False)
    group, s, e = merge_flat(group, s, e, closed)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(group, minlength=n), out=offsets[1:])
    values = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["s", "e"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@F.arrow_udf(LIST)
def _merge_closed(lists: pa.Array) -> pa.Array:
    return _merge_batch(lists, True)


@F.arrow_udf(LIST)
def _merge_open(lists: pa.Array) -> pa.Array:
    return _merge_batch(lists, False)


def merged(lists: Column, closed: bool = True) -> Column:
    """The aggregate's merge step over a column of interval lists (need not be sorted)."""
    return (_merge_closed if closed else _merge_open)(lists)


def interval_nodes(df: DataFrame, keys: Sequence[str], start: str, end: str, *, closed: bool = True, leaf: int = 600_000, fan_in: int = 12) -> DataFrame:
    """(keys..., __node, __iv): sorted disjoint intervals of each entity and node of leaf * fan_in units of time.

    start and end are integer columns. Rows with a null key or time, or that do not end after their start, do not count.
    Equal starts are folded before the first shuffle (only the furthest end matters), which also removes repeated rows.
    """
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e"))
    by = [f"__k{i}" for i in range(len(keys))]
    rows = rows.dropna().filter("__e > __s")
    rows = rows.groupBy(*by, "__s").agg(F.max("__e").alias("__e"))
    slot = F.floor(F.col("__s") / F.lit(leaf)).cast("bigint")
    leaves = rows.groupBy(*by, slot.alias("__leaf")).agg(F.array_sort(F.collect_list(F.struct(F.col("__s").alias("s"), F.col("__e").alias("e")))).alias("__iv"))
    leaves = leaves.select(*by, "__leaf", F.floor(F.col("__leaf") / F.lit(fan_in)).cast("bigint").alias("__node"), merged(F.col("__iv"), closed).alias("__iv"))
    # Lists of neighbouring leaves one after the other are in order of their starts: the merge is linear.
    nodes = leaves.groupBy(*by, "__node").agg(F.array_sort(F.collect_list(F.struct("__leaf", "__iv"))).alias("__l"))
    nodes = nodes.select(*by, "__node", F.flatten(F.transform("__l", lambda x: x["__iv"])).alias("__iv"))
    return nodes.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "__node", merged(F.col("__iv"), closed).alias("__iv"))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, *, closed: bool = True, leaf: int = 600_000, fan_in: int = 12) -> DataFrame:
    """(keys..., kind, start_ms, end_ms): kind 'period' for each longest covered stretch, 'gap' for each stretch between two.

    Nulls: a row with a null key, start or end does not count; neither does one that is empty or runs backwards. Repeated,
    nested and touching intervals fall together (closed=False: touching ones stay apart). An empty table gives no rows.
    Extra columns, of any name, are ignored.
    """
    # Four branches read the nodes below: written once, they are neither merged nor shuffled again, nor lost with an executor.
    nodes = materialize(interval_nodes(df, keys, start, end, closed=closed, leaf=leaf, fan_in=fan_in), "interval-nodes")
    by = [F.col(k) for k in keys]
    order = W.partitionBy(*by).orderBy("__node")
    reach = nodes.select(*keys, "__node", F.element_at("__iv", -1)["e"].alias("__reach"))
    carry = reach.select(*keys, "__node", F.max("__reach").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__carry"))
    at = nodes.join(carry, [*keys, "__node"])
    fresh = (lambda x: x["s"] > F.col("__carry")) if closed else (lambda x: x["s"] >= F.col("__carry"))
    at = at.select(
        *keys, "__node", "__carry", F.element_at("__iv", -1)["e"].alias("__reach"),
        F.when(F.col("__carry").isNull(), F.col("__iv")).otherwise(F.filter("__iv", fresh)).alias("__new"),
        F.when(F.col("__carry").isNotNull(), F.greatest("__carry", F.array_max(F.transform(F.filter("__iv", lambda x: ~fresh(x)), lambda x: x["e"])))).alias("__before"),
    )
    n = F.size("__new")
    # Stretches that end before the node's last new one: their ends are final here.
    inner = F.transform(F.slice("__new", 1, F.greatest(n - 1, F.lit(0))), lambda x: F.struct(F.lit("period").alias("kind"), x["s"].alias("a"), x["e"].alias("b")))
    gaps = F.transform(
        F.slice("__new", 1, n),
        lambda x, i: F.struct(F.lit("gap").alias("kind"), F.when(i == 0, F.col("__before")).otherwise(F.get("__new", i - 1)["e"]).alias("a"), x["s"].alias("b")),
    )
    local = at.select(*keys, F.explode(F.concat(inner, gaps)).alias("__r")).filter("__r.a is not null")
    # The last new stretch of a node may reach into later nodes: it ends where the next new one finds the carry.
    edge = at.select(*keys, "__node", "__before", "__reach", F.when(n > 0, F.get("__new", n - 1)["s"]).alias("a"))
    later = order.rowsBetween(1, W.unboundedFollowing)
    edge = edge.select(
        *keys, "a",
        F.coalesce(F.first(F.when(F.col("a").isNotNull(), F.col("__before")), ignorenulls=True).over(later), F.max("__reach").over(W.partitionBy(*by))).alias("b"),
    ).filter("a is not null")
    return local.select(*keys, F.col("__r.kind").alias("kind"), F.col("__r.a").alias("start_ms"), F.col("__r.b").alias("end_ms")).unionAll(
        edge.select(*keys, F.lit("period").alias("kind"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    )


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite."""
    return F.when(F.abs(seconds) < 9e12, F.round(seconds * 1000).cast("bigint"))


def speaker_periods(segments: DataFrame) -> DataFrame:
    """Continuous periods and gaps of each speaker of each recording from DiarizationSegments (times in seconds)."""
    rows = segments.select("rec_id", "speaker_idx", to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e"))
    return periods_and_gaps(rows, ["rec_id", "speaker_idx"], "s", "e")
