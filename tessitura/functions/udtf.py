"""Table functions for SQL: chunks of an audio's length, and the tokens of a multivariant truth."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from tessitura.functions.multivariant import MultivariantError, parse

_CHUNK = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
_TOKEN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("block", "option", "uid", "start_pos", "end_pos")] + [T.StructField("value", T.StringType()), T.StructField("is_any", T.BooleanType())])


class ChunkAudio:
    """chunk_audio(length_ms, segment_ms, shift_ms): pieces that cover the audio; none for null lengths."""

    def eval(self, length_ms: int, segment_ms: int, shift_ms: int):
        if length_ms is None:
            return
        starts = list(range(0, length_ms - segment_ms, shift_ms)) + [max(length_ms - segment_ms, 0)]
        for i, s in enumerate(starts):
            yield i, s, min(s + segment_ms, length_ms)


class TruthTokens:
    """truth_tokens(text): every token of every option of a truth; none for null texts and truths that cannot be read."""

    def eval(self, text: str):
        try:
            blocks = parse(text) if text is not None else []
        except MultivariantError:
            return
        for b, block in enumerate(blocks):
            for o, option in enumerate(block["options"]):
                for t in option:
                    yield b, o, t["uid"], t["start_pos"], t["end_pos"], t["value"], t["is_any"]


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("chunk_audio", udtf(ChunkAudio, returnType=_CHUNK))
    spark.udtf.register("truth_tokens", udtf(TruthTokens, returnType=_TOKEN))
