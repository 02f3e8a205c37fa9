"""Encoding a corpus with a byte-level BPE tokenizer, exactly, however long a text is.

Short texts are encoded as they are. A long text is cut into leaves that are rows of their own, so that its encoding spreads
over the cluster: where a space follows a character that is none, the tokenizer's own splitting starts afresh, and leaves
simply follow one another. Text without such a place for long (one unsplit word) is halved anywhere; the halves' ids are joined
as a tree, by encoding a window around each join again, wider and wider, until both ends of the window agree with its
neighbours. They agree when the tokens on both sides of each end form a pair that is its own encoding: a sequence of tokens of
which all neighbours do is the encoding of its text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.session import at_least_parallel

#: Characters: a text longer than this is cut, into leaves of at most this.
LONG, LEAF = 16_384, 8_192
#: Bytes: a single unsplit word longer than this is halved.
WORD = 2_048
#: Fixed value: how byte-level BPE of this vocabulary splits text into words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
JOINT = regex.compile(r"(?<=\S)[ \n]")
IDS = T.ArrayType(T.IntegerType())


def default_tokenizer() -> str:
    """Path of byte_bpe_50k.tiktoken among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Encoder:
    """A vocabulary file of ranks: lines of a token in base64 and its id, the id being the rank of its merge."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})

    def text(self, text: str) -> list[int]:
        """Ids of a text; what reads like a special token is ordinary text."""
        return self.bpe.encode_ordinary(text)

    def piece(self, word: bytes) -> list[int]:
        """Ids of one word, or a part of one, as bytes that are not split before merging."""
        return self.bpe._core_bpe.encode_single_piece(word)

    def spelled(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)

    def pair(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their own text."""
        return self.piece(self.spelled([a, b])) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one word from those of its two halves."""
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.piece(self.spelled(left[a:] + right[:b]))
            if (a == 0 or self.pair(left[a - 1], window[0])) and (b == len(right) or self.pair(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins the ids of consecutive parts of one word, neighbours first, so that each id takes part in log(parts) joins."""
        parts = [p for p in parts if p]
        while len(parts) > 1:
            joined = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0] if parts else []


def glued(e: Encoder, parts: list[tuple[int, list[int]]]) -> list[int]:
    """Ids of a text from those of its leaves, in order."""
    ids, word = [], []
    for part, own in parts:
        if part != 2 and word:
            ids += e.tree(word)
            word = []
        if part:
            word.append(own)
        else:
            ids += own
    return ids + e.tree(word)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def leaves(text: str, leaf: int = LEAF, word: int = WORD) -> list[tuple[int, bytes]]:
    """Cuts a text, as UTF-8: (0, text) for leaves on their own, (1, part) for the first part of a halved word, (2, part) for its others."""
    out, pos = [], 0
    while len(text) - pos > leaf:
        cut = max(text.rfind(" ", pos + 1, pos + leaf), text.rfind("\n", pos + 1, pos + leaf))
        while cut > pos and text[cut - 1].isspace():
            cut = max(text.rfind(" ", pos + 1, cut), text.rfind("\n", pos + 1, cut))
        if cut > pos:
            out.append((0, text[pos:cut].encode()))
            pos = cut
            continue
        m = JOINT.search(text, pos + leaf - 1)
        end = m.start() if m else len(text)
        out += _unsplit(text[pos:end], leaf, word)
        pos = end
    if pos < len(text):
        out.append((0, text[pos:].encode()))
    return out


def _unsplit(text: str, leaf: int, word: int) -> list[tuple[int, bytes]]:
    """Leaves of text that offers no place to cut: between its words, as the tokenizer splits it, and within long ones."""
    out, group = [], []

    def flush() -> None:
        # Blanks at the end of a leaf would be split otherwise than before what follows: they stand as words of their own.
        n = len(group)
        while n and text[group[n - 1][1] - 1].isspace():
            n -= 1
        if n:
            out.append((0, text[group[0][0] : group[n - 1][1]].encode()))
        out.extend((1, text[a:b].encode()) for a, b in group[n:])
        group.clear()

    for m in PATTERN.finditer(text):
        a, b = m.span()
        if b - a <= word:
            if group and b - group[0][0] > leaf:
                flush()
            group.append((a, b))
            continue
        flush()
        own = text[a:b].encode()
        n = 1
        while len(own) > n * word:  # halves of halves
            n *= 2
        step = -(-len(own) // n)
        out += [(2 if i else 1, own[i : i + step]) for i in range(0, len(own), step)]
    flush()
    return out


def _ids_array(rows: Iterable[list[int]]) -> pa.Array:
    """One list column; each row's ids become four bytes each before the next row is made."""
    packed = [np.array(r, np.int32) for r in rows]
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *packed])))


def encode_corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, long: int = LONG, leaf: int = LEAF, word: int = WORD) -> DataFrame:
    """(ident, ids): the token ids of every row's text, without special tokens; strings that read like one are ordinary text.

    A null and an empty text give an empty list, a blank text its ordinary ids. Every row gives one row, repeated ones too.
    path names the tokenizer's file, which every executor must be able to read.
    """
    path = path or default_tokenizer()

    @F.arrow_udf(IDS)
    def encode(t: pa.Array) -> pa.Array:
        e = encoder(path)
        return _ids_array(e.text(x) if x else [] for x in (s.as_py() for s in t))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("b", T.BinaryType())])))
    def cut(t: pd.Series) -> pd.Series:
        return pd.Series([[{"part": a, "b": b} for a, b in leaves(x, leaf, word)] for x in t])

    @F.arrow_udf(IDS)
    def encode_leaf(part: pa.Array, b: pa.Array) -> pa.Array:
        e = encoder(path)
        return _ids_array(e.piece(x) if p else e.text(x.decode()) for p, x in zip(part.to_pylist(), (s.as_py() for s in b)))

    @F.arrow_udf(IDS)
    def concatenate(rows: pa.Array) -> pa.Array:
        e = encoder(path)
        return _ids_array(glued(e, [(x["part"], x["ids"]) for x in row.as_py()]) for row in rows)

    rows = df.select(F.col(ident).alias("i"), F.col(text).alias("t"))
    short = at_least_parallel(rows).filter(F.coalesce(F.length("t"), F.lit(0)) <= long).select("i", encode("t").alias("ids"))
    # While its leaves are apart a long text is known by its row's id and its hash; equal rows are encoded once and counted.
    big = rows.filter(F.length("t") > long).groupBy("i", F.sha2("t", 256).alias("h")).agg(F.first("t").alias("t"), F.count("*").alias("n"))
    parts = big.select("i", "h", "n", F.posexplode(cut("t")).alias("pos", "x")).select("i", "h", "n", "pos", "x.*")
    parts = parts.repartition("i", "h", "pos").select("i", "h", "n", "pos", "part", encode_leaf("part", "b").alias("ids"))
    whole = parts.groupBy("i", "h").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "part", "ids"))).alias("leaves"))
    whole = whole.select("i", "n", concatenate("leaves").alias("ids")).select("i", "ids", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return short.unionAll(whole.select("i", "ids")).select(F.col("i").alias(ident), "ids")
