"""Window functions over long sequences, spread over slots of (key, order).

A window partitioned by key alone puts a whole key into one task. Here each slot of a key's order is swept on its own, and what
earlier slots leave behind comes as one row per slot. Slots must rise with the order; keys may be null (nulls are one key).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_BOTH = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}


def _carried(rows: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the carry columns of their slot; null keys meet null keys."""
    names = {k: f"__c{i}" for i, k in enumerate([*by, "__slot"])}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(carry.withColumnsRenamed(names), on, "left").drop(*names.values())


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], slot: Column, folds: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """df with, for each name -> (sum | max | min, column), the running fold in ascending order, the row itself included or not.

    Rows of equal order count one after the other, so order must be unique within a key for a repeatable result.
    """
    rows = df.withColumn("__slot", F.coalesce(slot, F.lit(-(2**60))).cast("bigint"))
    for n, (_, c) in folds.items():
        rows = rows.withColumn(f"__v_{n}", c)
    tops = rows.groupBy(*by, "__slot").agg(*[_FOLD[k](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in folds.items()])
    before = W.partitionBy(*by).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*by, "__slot", *[_FOLD[k](f"__t_{n}").over(before).alias(f"__k_{n}") for n, (k, _) in folds.items()])
    here = W.partitionBy(*by, "__slot").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    rows = rows.select("*", *[_FOLD[k](f"__v_{n}").over(here).alias(f"__h_{n}") for n, (k, _) in folds.items()])
    out = _carried(rows, carry, by)
    return out.select(*df.columns, *[_BOTH[k](F.col(f"__k_{n}"), F.col(f"__h_{n}")).alias(n) for n, (k, _) in folds.items()])


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], slot: Column, columns: dict[str, str]) -> DataFrame:
    """df with, for each new name -> column, the value in the row before (null in a key's first row)."""
    rows = df.withColumn("__slot", F.coalesce(slot, F.lit(-(2**60))).cast("bigint")).withColumn("__v", F.struct(*[F.col(c).alias(n) for n, c in columns.items()]))
    tops = rows.groupBy(*by, "__slot").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carry = tops.select(*by, "__slot", F.lag("__last").over(W.partitionBy(*by).orderBy("__slot")).alias("__carry"))
    here = W.partitionBy(*by, "__slot").orderBy(*order)
    rows = rows.select("*", F.lag("__v").over(here).alias("__lag"))
    out = _carried(rows, carry, by).withColumn("__p", F.coalesce("__lag", "__carry"))
    return out.select(*df.columns, *[F.col(f"__p.{n}").alias(n) for n in columns])


def trailing(df: DataFrame, by: Sequence[str], order: Sequence[str], slot: Column, rows: int, fold: Callable[[WindowSpec], Column], name: str, own: bool = True, block: int = 10_000) -> DataFrame:
    """df with a fold over the last ``rows`` rows, the row itself among them (own) or not: blocks of numbered rows, each with the end of the block before."""
    numbered = running(df, by, order, slot, {"__n": ("sum", F.lit(1))}).withColumn("__b", F.floor((F.col("__n") - 1) / block))
    late = F.pmod(F.col("__n") - 1, F.lit(block)) >= block - rows
    copies = F.when(late, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))
    spread = numbered.select("*", F.explode(copies).alias("__own"))
    w = W.partitionBy(*by, "__own").orderBy("__n").rowsBetween(*((-(rows - 1), 0) if own else (-rows, -1)))
    return spread.withColumn(name, fold(w)).filter("__own = __b").select(*df.columns, name)
