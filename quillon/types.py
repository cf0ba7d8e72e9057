"""Dtype names, schema inference from local rows, number texts and the cast matrix."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ShapeMismatch, TypeMismatch

#: Dtype names users write -> Spark types.
DTYPES: dict[str, T.DataType] = {
    "f64": T.DoubleType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "utf8": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.TimestampNTZType(),
    "datetime": T.TimestampNTZType(),
}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype(name: str | T.DataType) -> T.DataType:
    """The Spark type of a dtype name; Spark types and DDL strings pass."""
    if isinstance(name, T.DataType):
        return name
    if name in DTYPES:
        return DTYPES[name]
    try:
        return T._parse_datatype_string(name)
    except Exception as error:
        raise TypeMismatch(f"unknown dtype {name!r}") from error


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def infer_value(value: object) -> T.DataType:
    """The type of one Python value: ints are long, floats double, sequences arrays, mappings structs."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, dt.datetime):
        return T.TimestampNTZType() if value.tzinfo is None else T.TimestampType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, bytes):
        return T.BinaryType()
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), infer_column([v])) for k, v in value.items()])
    if isinstance(value, Sequence):
        return T.ArrayType(infer_column(value))
    raise TypeMismatch(f"no dtype for a {type(value).__name__}")


def infer_column(values: Iterable[object]) -> T.DataType:
    """The first non-null value decides; a column of nulls is double."""
    for value in values:
        if value is not None:
            return infer_value(value)
    return T.DoubleType()


def conform(value: object, kind: T.DataType) -> object:
    """A value as its column's type; a value of another kind becomes null (an int in a double column widens)."""
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, T.LongType):
        if isinstance(value, float):
            return int(value) if math.isfinite(value) else None
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, T.StructType):
        return {f.name: conform(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, Mapping) else None
    if isinstance(kind, T.ArrayType):
        return [conform(v, kind.elementType) for v in value] if isinstance(value, Sequence) and not isinstance(value, str) else None
    return value if isinstance(infer_value(value), type(kind)) else None


def infer_rows(rows: Sequence[Mapping[str, object]]) -> tuple[T.StructType, list[tuple]]:
    """Schema (union of keys in first-seen order, all nullable) and rows conformed to it."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: infer_column(r.get(n) for r in rows) for n in names}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return schema, [tuple(conform(r.get(n), kinds[n]) for n in names) for r in rows]


def infer_columns(columns: Mapping[str, Sequence[object]]) -> tuple[T.StructType, list[tuple]]:
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ShapeMismatch(f"columns differ in length: { {k: len(v) for k, v in columns.items()} }")
    kinds = {n: infer_column(v) for n, v in columns.items()}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    rows = list(zip(*([conform(x, kinds[n]) for x in v] for n, v in columns.items())))
    return schema, rows


def num_to_text(value: Column, kind: T.DataType) -> Column:
    """Numbers as text without a trailing ``.0`` or an exponent for integral values below 1e21; other types as cast."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(whole, F.when(whole, value).cast("bigint").cast("string"))
        .when(F.abs(value) < 1e21, F.regexp_replace(F.when(F.abs(value) < 1e21, value).cast("decimal(38,16)").cast("string"), r"\.?0+$", ""))
        .otherwise(value.cast("string"))
    )


def cast_column(value: Column, source: T.DataType, target: str | T.DataType) -> Column:
    """The cast matrix: failures give null, never an error.

    To number: text is trimmed and read, empty text is 0, booleans are 1 and 0, times are epoch milliseconds; to a whole number
    fractions are cut off. To text: numbers without ``.0``, times in ISO form. To boolean: numbers are true unless 0 or NaN, text
    unless empty. To date: text in ISO form, numbers as epoch milliseconds.
    """
    kind = dtype(target)
    if type(source) is type(kind):
        return value.cast(kind)
    if is_numeric(kind):
        if isinstance(source, T.StringType):
            text = F.trim(value)
            number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
        elif isinstance(source, TEMPORAL):
            number = F.unix_millis(value.cast("timestamp")).cast("double")
        elif isinstance(source, T.BooleanType) or is_numeric(source):
            number = value.cast("double") if not isinstance(source, T.LongType) or not isinstance(kind, T.IntegerType) else value
        else:
            raise TypeMismatch(f"cannot cast {source.simpleString()} to {kind.simpleString()}")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return number.cast(kind)
        return F.when(~F.isnan(number.cast("double")), number).try_cast(kind)
    if isinstance(kind, T.StringType):
        if isinstance(source, TEMPORAL):
            return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if isinstance(source, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(value)
        return num_to_text(value, source)
    if isinstance(kind, T.BooleanType):
        if isinstance(source, T.StringType):
            return F.length(value) > 0
        if is_numeric(source):
            number = value.cast("double")
            return F.when(value.isNotNull(), (number != 0) & ~F.isnan(number))
        return value.isNotNull() | F.lit(None).cast("boolean")
    if isinstance(kind, TEMPORAL):
        if isinstance(source, T.StringType):
            return F.regexp_replace(F.trim(value), "Z$", "").try_cast(kind)
        if is_numeric(source):
            number = value.cast("double")
            return F.timestamp_millis(F.when(~F.isnan(number), number).try_cast("bigint")).cast(kind)
        if isinstance(source, TEMPORAL):
            return value.cast(kind)
    raise TypeMismatch(f"cannot cast {source.simpleString()} to {kind.simpleString()}")
