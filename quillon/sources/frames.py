"""Frames from local values and generators, and the JSON, Parquet, Arrow, SQL-text and registry sources and sinks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation, SourceError
from quillon.operators.frame import Order, free_name, order_columns, quoted
from quillon.sources.csvfile import csv_value, read_csv, write_csv
from quillon.types import infer_columns, infer_rows, is_numeric

# Local values and generators.


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Dictionaries: the union of their keys, missing values null, the first non-null value deciding a column's type."""
    schema, data = infer_rows(rows)
    return spark.createDataFrame(data, schema) if schema.fields else empty(spark)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[object]]) -> DataFrame:
    schema, data = infer_columns(columns)
    return spark.createDataFrame(data, schema) if schema.fields else empty(spark)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def range_frame(spark: SparkSession, name: str, start: float, end: float, step: float = 1) -> DataFrame:
    """start, start + step, ... below ``end``, as doubles."""
    if step <= 0 or start >= end:
        raise InvalidOperation("a range needs a positive step and start < end")
    n = math.ceil((end - start) / step)
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))


def linspace(spark: SparkSession, name: str, start: float, end: float, count: int) -> DataFrame:
    """``count`` evenly spaced numbers, both ends included."""
    if count < 2:
        raise InvalidOperation("linspace needs at least two points")
    return spark.range(count).select((F.lit(float(start)) + F.col("id") * F.lit((end - start) / (count - 1))).alias(name))


# JSON.


def read_json(spark: SparkSession, path: str | None = None, *, text: str | None = None, at: str | None = None) -> DataFrame:
    """A document holding an array of objects, at the top or at a dotted path ``at``."""
    if text is not None:
        value = json.loads(text)
        for key in at.split(".") if at else ():
            if not isinstance(value, dict) or key not in value:
                raise SourceError(f"nothing at {at!r}")
            value = value[key]
        if not isinstance(value, list) or any(not isinstance(x, dict) for x in value):
            raise SourceError("expected an array of objects")
        return from_rows(spark, value)
    if path is None:
        raise SourceError("pass a path or text")
    lines = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    if not at and len(lines) == 2 and all(_is_object(x) for x in lines):
        return read_ndjson(spark, path)  # an object per line under the extension of a document
    df = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if not at:
        return df
    try:
        kind = df.select(F.col(at)).schema.fields[0].dataType
    except Exception as error:
        raise SourceError(f"nothing at {at!r}") from error
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise SourceError(f"no array of objects at {at!r}")
    return df.select(F.inline(F.col(at)))


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object per non-blank line; a malformed line raises when it is read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _iso(df: DataFrame) -> DataFrame:
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: csv_value(quoted(c), T.TimestampNTZType()) for c in times}) if times else df


def to_json_text(df: DataFrame, pretty: bool = False) -> str:
    """A driver-sized frame as a JSON array, nulls kept, times in ISO form."""
    shaped = _iso(df)
    rows = shaped.select(F.to_json(F.struct(*[quoted(c) for c in shaped.columns]), {"ignoreNullFields": "false"})).toLocalIterator()
    return json.dumps([json.loads(r[0]) for r in rows], indent=2 if pretty else None, ensure_ascii=False)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of documents, one per partition, each an array of objects with nulls kept and times in ISO form; one without
    rows gives an empty file."""
    import pyarrow as pa
    import pyarrow.compute as pc

    shaped = _iso(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows:
                lines = pc.binary_join_element_wise(pa.array([""] + [","] * (batch.num_rows - 1) if not begun else [","] * batch.num_rows), batch.column(0), "")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([] if begun else ["["], pa.string()), lines.cast(pa.string())])], names=["value"])
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(["]"] if begun else ["[]"])], names=["value"])

    rows = shaped.select(F.to_json(F.struct(*[quoted(c) for c in shaped.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(run, "value string").write.mode(mode).option("pathExtension", "json").text(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _iso(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


# Parquet and Arrow.


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[quoted(c) for c in columns]) if columns else df


def write_parquet(df: DataFrame, path: str, *, compression: str = "snappy", row_group_bytes: int | None = None, mode: str = "overwrite") -> None:
    if compression not in ("snappy", "gzip", "zstd", "none"):
        raise InvalidOperation(f"unknown compression {compression!r}")
    writer = df.write.mode(mode).option("compression", compression)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


def from_arrow(spark: SparkSession, table: object) -> DataFrame:
    """A ``pyarrow.Table``; dictionary columns come as their values."""
    import pyarrow as pa

    plain = [pa.field(f.name, f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in table.schema]
    return spark.createDataFrame(table.cast(pa.schema(plain)))


def from_arrow_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    import pyarrow as pa

    return from_arrow(spark, pa.ipc.open_stream(data).read_all())


def to_arrow(df: DataFrame) -> object:
    return df.toArrow()


def to_arrow_ipc(df: DataFrame) -> bytes:
    import pyarrow as pa

    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


# SQL text.


def sql_literal(value: Column, kind: T.DataType) -> Column:
    text = csv_value(value, kind)
    if isinstance(kind, T.BooleanType):
        shown = F.when(value, "TRUE").otherwise("FALSE")
    elif is_numeric(kind):
        wide = value.cast("double")
        shown = F.when(~F.isnan(wide) & (F.abs(wide) != float("inf")), text)
    else:
        shown = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(F.when(value.isNotNull(), shown), F.lit("NULL"))


def sql_inserts(df: DataFrame, table: str, batch_size: int = 1000, *, order_by: Order) -> DataFrame:
    """INSERT statements of up to ``batch_size`` rows each: (batch, value). Batches are built where the rows are."""
    if batch_size < 1:
        raise InvalidOperation("a batch holds at least one row")
    from quillon.operators.frame import with_position

    def name(x: str) -> str:
        return '"' + x.replace('"', '""') + '"'

    at = free_name(df, "__pos")
    values = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(quoted(f.name), f.dataType) for f in df.schema.fields]), F.lit(")"))
    rows = with_position(df, order_by, at).select(F.floor(F.col(at) / batch_size).alias("batch"), F.col(at).alias("at"), values.alias("v"))
    lists = rows.groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vs"))
    head = f"INSERT INTO {name(table)} ({', '.join(name(c) for c in df.columns)}) VALUES\n"
    return lists.select("batch", F.concat(F.lit(head), F.concat_ws(",\n", "vs"), F.lit(";")).alias("value"))


def to_sql_text(df: DataFrame, table: str, batch_size: int = 1000, *, order_by: Order) -> str:
    return "\n".join(r[0] for r in sql_inserts(df, table, batch_size, order_by=order_by).orderBy("batch").select("value").toLocalIterator())


# Files by extension, and the registry.

Reader = Callable[[SparkSession, str], DataFrame]
Writer = Callable[[DataFrame, str], None]
_readers: dict[str, Reader] = {}
_writers: dict[str, Writer] = {}


def _extension(path: str) -> str:
    return PurePosixPath(path).suffix.lstrip(".").lower()


def register_reader(extension: str, reader: Reader) -> None:
    _readers[extension.lstrip(".").lower()] = reader


def register_writer(extension: str, writer: Writer) -> None:
    _writers[extension.lstrip(".").lower()] = writer


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """By extension: registered readers first, then csv, tsv, json, ndjson/jsonl, parquet, arrow, xlsx."""
    kind = _extension(path)
    if kind in _readers:
        return _readers[kind](spark, path)
    if kind in ("csv", "tsv", "txt"):
        return read_csv(spark, path, delimiter="\t" if kind == "tsv" else None)
    if kind == "json":
        return read_json(spark, path)
    if kind in ("ndjson", "jsonl"):
        return read_ndjson(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "xlsx":
        from quillon.sources.excel import read_excel

        return read_excel(spark, path)
    if kind == "arrow":
        with open(path, "rb") as f:
            return from_arrow_ipc(spark, f.read())
    raise SourceError(f"no reader for {path!r}")


def to_file(df: DataFrame, path: str) -> None:
    """By extension: registered writers first, then csv, tsv, json, ndjson/jsonl, parquet (folders), xlsx."""
    kind = _extension(path)
    if kind in _writers:
        _writers[kind](df, path)
    elif kind in ("csv", "tsv"):
        write_csv(df, path, delimiter="\t" if kind == "tsv" else ",")
    elif kind == "json":
        write_json(df, path)
    elif kind in ("ndjson", "jsonl"):
        write_ndjson(df, path)
    elif kind == "parquet":
        write_parquet(df, path)
    elif kind == "xlsx":
        from quillon.sources.excel import write_excel

        write_excel(df, path)
    else:
        raise SourceError(f"no writer for {path!r}")


sink = to_file

# Reports.


def info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, nulls) in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{i}").alias("non_null"), (F.col("__n") - F.col(f"c{i}")).alias("nulls")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def memory_usage(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size in bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def to_string(df: DataFrame, head: int = 10, tail: int = 0, *, order_by: Order | None = None, width: int = 40) -> str:
    """A boxed table of the first rows, with the number of rows left out and, given an order, the last ones."""
    if tail and order_by is None:
        raise InvalidOperation("the last rows depend on the order of rows: pass order_by")
    n = df.count()
    ordered = df.orderBy(*order_columns(order_by, "showing")) if order_by is not None else df
    rows = [tuple(r) for r in ordered.limit(head if n > head + tail else n).collect()]
    last = [tuple(r) for r in ordered.offset(n - tail).limit(tail).collect()] if tail and n > head + tail else []

    def cell(x: object) -> str:
        text = "null" if x is None else str(x)
        return text if len(text) <= width else text[: width - 1] + "…"

    body = [[cell(x) for x in r] for r in rows]
    gap = [["…"] * len(df.columns)] if n > len(rows) + len(last) else []
    body += gap + [[cell(x) for x in r] for r in last]
    widths = [max([len(c), *(len(r[i]) for r in body)]) for i, c in enumerate(df.columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def line(cells: Sequence[str]) -> str:
        return "|" + "|".join(f" {x.ljust(w)} " for x, w in zip(cells, widths)) + "|"

    shown = f"{n} rows x {len(df.columns)} columns" + (f", {n - len(rows) - len(last)} rows not shown" if gap else "")
    return "\n".join([rule, line(df.columns), rule, *map(line, body), rule, shown])


def show(df: DataFrame, head: int = 10, tail: int = 0, *, order_by: Order | None = None) -> None:
    print(to_string(df, head, tail, order_by=order_by))


def chunks(df: DataFrame, size: int = 10_000) -> Iterator[list[dict]]:
    """Rows in lists of ``size``, fetched one partition at a time."""
    held: list[dict] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def numbered(df: DataFrame, order_by: Order, name: str = "row") -> DataFrame:
    """A 1-based row number within one task; for frames of driver size."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order_columns(order_by, "numbering"))).cast("bigint"))
