"""Files as streams: micro-batches with a fixed schema, sinks, and sessions.

A run with ``availableNow`` over a folder gives the same rows as reading the folder at once; a checkpoint folder makes it
restartable with each file processed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation
from quillon.operators.frame import need, quoted
from quillon.sources.csvfile import spans_lines

Schema = str | T.StructType


def stream_csv(spark: SparkSession, folder: str, schema: Schema, *, delimiter: str = ",", header: bool = True, files_per_batch: int | None = None, multiline: bool = True) -> DataFrame:
    """``multiline=False`` lets large files be split, where quotes hold no line breaks; a stream cannot look ahead for them."""
    reader = spark.readStream.schema(schema).options(sep=delimiter, header=str(header).lower(), quote='"', escape='"', multiLine=str(multiline).lower())
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(folder)


def stream_ndjson(spark: SparkSession, folder: str, schema: Schema, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)


def scan_csv(spark: SparkSession, path: str, schema: Schema, *, delimiter: str = ",", header: bool = True, multiline: bool | None = None) -> DataFrame:
    """A lazy scan to chain operators on; files are split unless quotes hold line breaks, which a pass finds out if not told."""
    many = spans_lines(spark, path) if multiline is None else multiline
    return spark.read.schema(schema).options(sep=delimiter, header=str(header).lower(), quote='"', escape='"', multiLine=str(many).lower()).csv(path)


def scan_ndjson(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Processes everything there is now, batch by batch, and stops."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sink_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Appends everything there is now to files, each input once."""
    if kind not in ("parquet", "csv", "json"):
        raise InvalidOperation(f"no streaming sink {kind!r}")
    writer = stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    (writer.option("header", "true") if kind == "csv" else writer).trigger(availableNow=True).start().awaitTermination()


def sessions(df: DataFrame, user: str, at: str, tie: Sequence[str], gap_minutes: int = 30, name: str = "session") -> DataFrame:
    """Numbers each user's sessions from 1: a new one begins after a pause of more than ``gap_minutes``."""
    need(df, user, at, *tie)
    w = Window.partitionBy(quoted(user)).orderBy(quoted(at), *[quoted(t) for t in tie])
    pause = F.timestamp_diff("MICROSECOND", F.lag(quoted(at)).over(w), quoted(at))
    begins = F.when(pause.isNull() | (pause > gap_minutes * 60_000_000), 1).otherwise(0)
    return df.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")


def session_windows(df: DataFrame, user: str, at: str, gap_minutes: int = 30, *aggs: Column, watermark: str | None = None) -> DataFrame:
    """Sessions as windows with aggregates; also for streams, where ``watermark`` bounds the state kept for late rows."""
    need(df, user, at)
    if df.isStreaming and watermark is None:
        raise InvalidOperation("a stream needs a watermark")
    timed = df.withWatermark(at, watermark) if watermark else df
    return timed.groupBy(quoted(user), F.session_window(quoted(at), f"{gap_minutes} minutes").alias("window")).agg(*(aggs or [F.count(F.lit(1)).alias("events")]))
