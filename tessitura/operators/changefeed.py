"""Rebuilding a table's current state from a change feed, with equality-delete files and sequence numbers.

A feed is appended, never rewritten. Each append writes two sets of files that carry the changes' sequence numbers:
``inserts`` (every change that leaves a row) and ``deletes`` (the key of every change that ends what the key held before:
a withdrawal, and also an insert or update, since it replaces the row). A delete removes rows of its key with a smaller
sequence number only, so the files may be appended late, repeatedly and in any order. A reader reduces the deletes to the
latest one per key and anti-joins the inserts against it. Where batches may hold copies of one change, it first finds which
copy holds, and reads only that one's insert and delete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.session import shared_folder

#: How a withdrawal may be spelled, after trimming and in lower case. Any other op, null included, writes a row.
DELETE_OPS = ("delete", "d", "del", "remove")


def is_delete(op: Column) -> Column:
    return F.coalesce(F.lower(F.trim(op)).isin(*DELETE_OPS), F.lit(False))


class ChangeTable:
    """A change table in one folder: identity columns name one change, key columns the row it is about.

    Sequence numbers are any sortable columns (here time, then number), compared as one struct. A change whose key has a
    null is about a row of its own: an insert of it is never replaced, a delete of it removes nothing. Copies of one change
    (same identity) count once; should they differ, the one with the smallest sequence number, then content, holds.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], identity: Sequence[str], sequence: Sequence[str], values: Sequence[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.identity, self.sequence, self.values = list(key), list(identity), list(sequence), list(values)
        self.schema = None
        self.columns = list(dict.fromkeys([*key, *identity, *sequence, *values]))

    def append(self, feed: DataFrame, op: str = "op") -> None:
        """Append a batch of changes: one pass over the feed, files of inserts and of delete keys side by side."""
        rows = feed.select(*self.columns, is_delete(F.col(op)).alias("__gone"))
        rest = [c for c in [*rows.columns] if c not in self.identity]
        first = [*[c for c in self.sequence if c in rest], *[c for c in rest if c not in self.sequence]]
        # Copies of a change fall together in the partial aggregate, before the shuffle.
        once = rows.groupBy(*self.identity).agg(F.min(F.struct(*first)).alias("__r")).select(*self.identity, "__r.*")
        once = once.select(*self.columns, "__gone", F.explode(F.when(F.col("__gone"), F.array(F.lit("deletes"))).otherwise(F.array(F.lit("inserts"), F.lit("deletes")))).alias("file"))
        keyed = F.lit(True)
        for k in self.key:
            keyed = keyed & F.col(k).isNotNull()
        once = once.filter((F.col("file") == "inserts") | keyed)
        # A replacement's delete needs no values; a withdrawal has no other row that could tell them.
        own = (F.col("file") == "inserts") | F.col("__gone")
        bare = [F.when(own, F.col(c)).alias(c) if c in self.values and c not in [*self.key, *self.sequence] else F.col(c) for c in self.columns]
        once = once.select(*bare, "__gone", "file")
        self.schema = once.schema
        once.write.mode("append").partitionBy("file").parquet(self.path)

    def _files(self, kind: str) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(self.path).filter(F.col("file") == kind).drop("file")

    def _first(self) -> DataFrame:
        """One row for each change: of its copies in all batches, the one with the smallest sequence number, then content."""
        told = self._files("inserts").unionByName(self._files("deletes").filter("__gone"))
        rest = [c for c in told.columns if c not in self.identity]
        order = [*[c for c in self.sequence if c in rest], *[c for c in rest if c not in self.sequence]]
        return told.groupBy(*self.identity).agg(F.min(F.struct(*order)).alias("__r")).select(*self.identity, "__r.*")

    def current(self, appended_once: bool = False) -> DataFrame:
        """The rows that stand: inserts without a later delete of their key. An empty table gives no rows.

        Copies of one change may lie in several batches; only the one that holds counts, with its delete, unless the caller knows that each
        change was appended once. A row whose key has a null meets no delete and goes past the join, so nulls are no hot key.
        """
        deletes, rows = self._files("deletes"), self._files("inserts")
        if not appended_once:
            first = self._first()
            told = list(dict.fromkeys([*self.identity, *self.key, *self.sequence]))
            holds = first.select(*[F.col(c).alias(f"__i_{c}") for c in told])
            on = F.lit(True)
            for c in told:
                on = F.col(c).eqNullSafe(F.col(f"__i_{c}")) & on
            deletes, rows = deletes.join(holds, on, "left_semi"), first.filter("not __gone")
        rows = rows.drop("__gone")
        order = F.struct(*self.sequence)
        latest = deletes.groupBy(*self.key).agg(F.max(order).alias("__deleted"))
        latest = latest.select(*[F.col(k).alias(f"__d_{k}") for k in self.key], "__deleted")
        on, keyed = order < F.col("__deleted"), F.lit(True)
        for k in self.key:
            on, keyed = (F.col(k) == F.col(f"__d_{k}")) & on, keyed & F.col(k).isNotNull()
        return rows.filter(keyed).join(latest, on, "left_anti").unionByName(rows.filter(~keyed))


def replay(feed: DataFrame, key: Sequence[str], identity: Sequence[str], sequence: Sequence[str], values: Sequence[str], op: str = "op", path: str | None = None) -> DataFrame:
    """Current state of one whole feed, through a change table in the shared folder (or at path, appended to)."""
    spark = feed.sparkSession
    files = ChangeTable(spark, path or shared_folder(spark, "changes"), key, identity, sequence, values)
    files.append(feed, op)
    return files.current(appended_once=path is None)


def _changes(output_chunk: DataFrame) -> DataFrame:
    return output_chunk.filter(~F.coalesce(F.col("is_finish"), F.lit(False))).filter("rec_id is not null and seq is not null")


_CHUNKS = (["rec_id", "uid"], ["rec_id", "seq"], ["put_ts", "seq"], ["text"])


def standing_after_batches(batches: Sequence[DataFrame], path: str | None = None) -> DataFrame:
    """As ``standing_chunks``, from a feed that arrives in several batches, in any order, copies of one change in some of them."""
    spark = batches[0].sparkSession
    files = ChangeTable(spark, path or shared_folder(spark, "changes"), *_CHUNKS)
    for b in batches:
        files.append(_changes(b))
    return files.current().select("rec_id", "seq", "uid", "text")


def standing_chunks(output_chunk: DataFrame) -> DataFrame:
    """rec_id, seq, uid, text of every TranscriptionChunk that stands at the end of its recording's feed.

    FINISH rows are no changes (a null is_finish is none either way: it counts as a change). Rows without rec_id or seq
    cannot be named and do not count; a null put_ts sorts before all times.
    """
    return replay(_changes(output_chunk), *_CHUNKS).select("rec_id", "seq", "uid", "text")
