"""Named datasets, and readers and writers of predictions, subtitles and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.session import parallelism, table

_DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_dataset(name: str):
    """Decorator: a function (session, folder) -> DataFrame under a name that must be new."""

    def add(f):
        if name in _DATASETS:
            raise ValueError(f"dataset {name!r} is registered already")
        _DATASETS[name] = f
        return f

    return add


def get_dataset(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in _DATASETS:
        raise ValueError(f"no dataset {name!r}; there are {sorted(_DATASETS)}")
    return _DATASETS[name]


@register_dataset("recordings")
def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truths: one row for each recording that has one (repeated rows fall together)."""
    df = table(spark, folder, "recording").filter("transcription is not null and rec_id is not null")
    df = df.select("rec_id", "dataset_name", "split_name", "sample_idx", "lang", F.col("transcription").alias("text")).distinct()
    # Texts are small and aligning them is not: as many tasks as the session has partitions, whatever the bytes.
    return df.repartition(parallelism(spark), "rec_id")


@register_dataset("documents")
def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


PREDICTION_PATH = r"([^/]+)/([^/]+)/([^/]+)/transcription\.json$"
PREDICTION = "type string, output string, segments array<struct<start_time:double,end_time:double,text:string>>"


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions as JSON lines by pipeline and dataset; readers of some pipelines skip the others' folders."""
    df.write.mode(mode).partitionBy("pipeline", "dataset_name").json(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_prediction_tree(spark: SparkSession, root: str) -> DataFrame:
    """A tree pipeline/dataset/idx/transcription.json, names from the paths; timed outputs are joined to their text."""
    df = spark.read.schema(PREDICTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "transcription.json").json(root)
    path = F.col("_metadata.file_path")
    text = F.when(F.col("type") == "timed_transcription", F.array_join(F.transform("segments", lambda s: s["text"]), " ")).otherwise(F.col("output"))
    names = {k: F.regexp_extract(path, PREDICTION_PATH, i) for i, k in enumerate(("pipeline", "dataset_name", "idx"), 1)}
    return df.select(names["pipeline"].alias("pipeline"), names["dataset_name"].alias("dataset_name"), names["idx"].cast("int").alias("sample_idx"), text.alias("text"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def srt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))


def pcm16(samples: Column) -> Column:
    """Samples of -1 to 1 as 16-bit integers; what is beyond is clamped, NaN and null become 0."""
    one = lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(F.greatest(F.least((x * 32768).cast("int"), F.lit(32767)), F.lit(-32768)))
    return F.transform(samples, one)
