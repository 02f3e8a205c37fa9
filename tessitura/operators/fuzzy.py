"""Similarity joins of words and of vectors, without making all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and queries of a search that meet in one cell (some 50 MB of vectors of 64).
ROWS, BLOCK = 100_000, 4_096


def _deletions(word: Column, most: int) -> Column:
    """The word and everything that up to ``most`` deletions of letters leave of it."""
    out = F.array(word)
    for _ in range(most):
        one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda w: F.length(w) > 0), one))))
    return out


def edit_neighbours(words: DataFrame, dictionary: DataFrame, word: str, entry: str, most: int) -> DataFrame:
    """word, entry, dist for all pairs at most ``most`` edits apart.

    Two words that close share what some ``most`` deletions leave of each, so an equality join on these finds every pair;
    the distance itself is checked once for each. Nulls match nothing.
    """
    a = words.filter(F.col(word).isNotNull()).select(F.col(word), F.explode(_deletions(F.col(word), most)).alias("__d"))
    b = dictionary.filter(F.col(entry).isNotNull()).select(F.col(entry), F.explode(_deletions(F.col(entry), most)).alias("__d"))
    near = a.join(b, "__d").select(word, entry).distinct()
    return near.withColumn("dist", F.levenshtein(word, entry)).filter(F.col("dist") <= most)


def grid(rows: DataFrame, queries: DataFrame, key: str, query: str, rows_each: int = ROWS, queries_each: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column __cell, so that each row meets each query in just one cell: an equality join of bounded cells.

    Rows are cut into ranges and queries into blocks of bounded size by hash; a range goes to as many cells as there are blocks, and a
    block to as many as there are ranges. Nothing is broadcast, and the numbers of both grow with the data.
    """
    ranges, blocks = max(1, -(-rows.count() // rows_each)), max(1, -(-queries.count() // queries_each))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    a = rows.withColumn("__r", F.pmod(F.xxhash64(key), F.lit(ranges))).select("*", every(blocks).alias("__q"))
    b = queries.withColumn("__q", F.pmod(F.xxhash64(query), F.lit(blocks))).select("*", every(ranges).alias("__r"))
    cell = (F.col("__r") * blocks + F.col("__q")).alias("__cell")
    return a.select("*", cell).drop("__r", "__q"), b.select("*", cell).drop("__r", "__q")


def _best_cosines(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("hit", kind="stable")
            ids, x = rows["hit"].to_numpy(), np.stack(rows["v"].to_numpy())
            own, q = queries["query"].to_numpy(), np.stack(queries["q"].to_numpy())
            length = np.sqrt((x * x).sum(1))
            for at in range(0, len(q), 64):  # so many rows of scores at a time
                y, me = q[at : at + 64], own[at : at + 64]
                score = np.round((y @ x.T) / np.outer(np.sqrt((y * y).sum(1)), length), 6)
                score[me[:, None] == ids[None, :]] = -2.0
                few = min(k, score.shape[1])
                least = np.partition(score, score.shape[1] - few, 1)[:, score.shape[1] - few]
                for i, low in enumerate(least):
                    near = np.flatnonzero(score[i] >= low)
                    near = near[np.argsort(-score[i, near], kind="stable")][:few]  # equals in order of their ids
                    out += [(me[i], ids[j], score[i, j]) for j in near if score[i, j] >= -1.5]
        return pd.DataFrame(out, columns=["query", "hit", "score"])

    return run


def cosine_topk_blocks(df: DataFrame, ident: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """query, hit, score, place: the k rows most like each query by cosine, itself excluded; ties go to the smaller id.

    Queries are a stated set; blocks of them meet ranges of rows in a grid, each cell as one product of matrices that keeps its best k of
    each query, so that only k rows for each query and range are shuffled again. Rows without a vector, or of length 0, match nothing.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = df.select(F.col(ident).alias("hit"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("__asks")).filter("v is not null and hit is not null").filter(norm > 0)
    queries = rows.filter("__asks").select(F.col("hit").alias("query"), F.col("v").alias("q"))
    a, b = grid(rows.drop("__asks"), queries, "hit", "query")
    best = a.groupBy("__cell").cogroup(b.groupBy("__cell")).applyInPandas(_best_cosines(k), f"query {_type(rows, 'hit')}, hit {_type(rows, 'hit')}, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "hit"))
    return best.withColumn("place", place.cast("bigint")).filter(F.col("place") <= k)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
