"""Projection, filtering, sorting, limits and set operations as plain functions ``DataFrame -> DataFrame``.

Rows have no position; an operator that needs one takes ``order_by`` and raises without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ColumnNotFound, InvalidOperation, ShapeMismatch, TypeMismatch
from quillon.session import Workspace
from quillon.types import cast_column

Order = str | Column | Sequence[str | Column]
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def need(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ColumnNotFound(name, df.columns)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    while base in df.columns:
        base += "_"
    return base


def order_columns(order_by: Order | None, what: str = "this operator") -> list[Column]:
    """Order expressions, names ascending with nulls last; raises where an order is required but missing."""
    if order_by is None or (isinstance(order_by, (list, tuple)) and not order_by):
        raise InvalidOperation(f"{what} depends on the order of rows: pass order_by")
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [quoted(x).asc_nulls_last() if isinstance(x, str) else x for x in items]


# Projection.


def select(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.select(*[quoted(n) for n in names])


def drop(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.drop(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    need(df, *names)
    return df.withColumnsRenamed(dict(names))


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds or replaces columns, all computed from the original frame."""
    return df.withColumns(dict(columns))


def assign(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order) -> DataFrame:
    """Puts the columns of two frames side by side by position, the right ones winning on a name clash."""
    key = free_name(left, free_name(right, "__pos"))
    a, b = with_position(left, left_order, key), with_position(right, right_order, key)
    if a.count() != b.count():
        raise ShapeMismatch("frames differ in length")
    kept = [quoted(c) for c in left.columns if c not in right.columns]
    both = a.select(key, *kept).join(b, key)
    return both.select(*[quoted(c) for c in dict.fromkeys([*left.columns, *right.columns])])


def relocate(df: DataFrame, names: Sequence[str], *, before: str | None = None, after: str | None = None) -> DataFrame:
    if (before is None) == (after is None):
        raise InvalidOperation("pass exactly one of before and after")
    anchor = before or after
    need(df, *names, anchor)
    if anchor in names:
        raise InvalidOperation("the anchor is among the moved columns")
    rest = [c for c in df.columns if c not in names]
    at = rest.index(anchor) + (after is not None)
    return df.select(*[quoted(c) for c in [*rest[:at], *names, *rest[at:]]])


def cast(df: DataFrame, dtypes: Mapping[str, str | T.DataType]) -> DataFrame:
    need(df, *dtypes)
    return df.withColumns({c: cast_column(quoted(c), df.schema[c].dataType, k) for c, k in dtypes.items()})


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns plus named expressions."""
    return df.select("*", *(c.alias(n) for n, c in columns.items()))


def row(df: DataFrame, i: int, order_by: Order) -> dict[str, object] | None:
    """The row at position ``i`` as a dictionary, None beyond the end."""
    found = df.orderBy(*order_columns(order_by, "row")).offset(i).limit(1).collect()
    return found[0].asDict(recursive=True) if found else None


# Filters.


def where(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    need(df, column)
    if op not in OPERATORS:
        raise InvalidOperation(f"unknown operator {op!r}")
    return df.where(OPERATORS[op](quoted(column), value))


def drop_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    need(df, *(columns or []))
    return df.dropna("any", subset=list(columns) if columns else None)


def row_filter(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Keeps the rows for which a Python function of the row is true; the slow path, in Arrow batches."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(predicate(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def row_map(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """Maps rows with a Python function to rows of ``schema``; the slow path, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(r) for r in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, kind)


def row_column(df: DataFrame, name: str, fn: Callable[[dict], object], kind: str) -> DataFrame:
    """Adds a column computed by a Python function of the row."""
    from pyspark.sql.types import StructField, StructType

    fields = [f for f in df.schema.fields if f.name != name] + [StructField(name, T._parse_datatype_string(kind))]
    out = row_map(df, lambda r: r | {name: fn(r)}, StructType(fields))
    return out.select(*[quoted(c) for c in dict.fromkeys([*df.columns, name])])


def series_apply(df: DataFrame, name: str, fn: Callable[..., object], columns: Sequence[str], kind: str) -> DataFrame:
    """Adds a column computed by a Python function of whole columns: it gets a pandas Series per column for a batch of rows and
    returns one of the same length."""
    need(df, *columns)

    @F.pandas_udf(kind)
    def run(*batch: pd.Series) -> pd.Series:
        return pd.Series(fn(*batch))

    return df.withColumn(name, run(*[quoted(c) for c in columns]))


def with_values(df: DataFrame, name: str, values: Sequence[object], order_by: Order, kind: str | None = None) -> DataFrame:
    """Adds or replaces a column by local values, one per row in ``order_by``; as many values as rows, or ShapeMismatch.

    The values come from the driver, so they are of driver size; the frame is joined to them by position.
    """
    from quillon.types import infer_column

    key = free_name(df, "__pos")
    placed = with_position(df, order_by, key)
    if placed.count() != len(values):
        raise ShapeMismatch(f"{len(values)} values for {placed.count()} rows")
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("__value", T._parse_datatype_string(kind) if kind else infer_column(values))])
    given = df.sparkSession.createDataFrame(list(enumerate(values)), schema)
    out = placed.join(given, key).drop(key)
    return out.select(*[F.col("__value").alias(c) if c == name else quoted(c) for c in dict.fromkeys([*df.columns, name])])


# Order, limits, samples.


def sort_by(df: DataFrame, columns: str | Sequence[str], order: str | Sequence[str] = "asc") -> DataFrame:
    """Nulls last in both directions; a shorter list of orders leaves the rest ascending."""
    names = [columns] if isinstance(columns, str) else list(columns)
    need(df, *names)
    orders = [order] * len(names) if isinstance(order, str) else [*order, *["asc"] * len(names)]
    return df.orderBy(*[quoted(c).desc_nulls_last() if o == "desc" else quoted(c).asc_nulls_last() for c, o in zip(names, orders)])


def top_k(df: DataFrame, k: int, columns: str | Sequence[str], order: str | Sequence[str] = "desc") -> DataFrame:
    """The first rows of an order without sorting everything."""
    return sort_by(df, columns, order).limit(k)


def head(df: DataFrame, n: int = 5, *, order_by: Order) -> DataFrame:
    return df.orderBy(*order_columns(order_by, "head")).limit(n)


def tail(df: DataFrame, n: int = 5, *, order_by: str | Sequence[str]) -> DataFrame:
    """The last ``n`` rows of an ascending order."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    need(df, *names)
    return df.orderBy(*[quoted(c).desc_nulls_first() for c in names]).limit(n)


def slice_rows(df: DataFrame, start: int, end: int | None = None, *, order_by: Order) -> DataFrame:
    """Rows [start, end) of an order; a start below 0 counts as 0, an end at or below the start gives no rows."""
    first = max(start, 0)
    ordered = df.orderBy(*order_columns(order_by, "slice")).offset(first)
    return ordered if end is None else ordered.limit(max(end - first, 0))


def sample(df: DataFrame, n: float, seed: int = 0) -> DataFrame:
    """``n`` >= 1: exactly so many rows (or all); 0 < n < 1: that share, at least one row. Without replacement."""
    if n <= 0 or (n > 1 and n != int(n)):
        raise InvalidOperation("sample size must be a positive whole number or a share below 1")
    count = int(n) if n >= 1 else max(1, int(df.count() * n))
    return df.orderBy(F.rand(seed)).limit(count)


def unique(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first", *, order_by: Order | None = None) -> DataFrame:
    """Distinct rows, or whole rows with distinct ``columns``: the first or last in ``order_by``."""
    if columns is None:
        return df.dropDuplicates()
    need(df, *columns)
    order = order_columns(order_by, "unique over some columns")
    if keep == "last":
        order = [_reversed(o) for o in order_columns(order_by)] if not _plain(order_by) else [quoted(c).desc_nulls_first() for c in _plain(order_by)]
    place = free_name(df, "__place")
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*columns).orderBy(*order)))
    return ranked.where(F.col(place) == 1).drop(place)


def _plain(order_by: Order) -> list[str]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return items if all(isinstance(x, str) for x in items) else []


def _reversed(_: Column) -> Column:
    raise InvalidOperation("keep='last' takes column names in order_by")


def ranged(df: DataFrame, order_by: Order, part: str, inner: str) -> DataFrame:
    """``df`` in range partitions of a total order, with the partition's number and the 0-based place in it.

    One shuffle; the rows are written once with both numbers, since the bounds of a range partitioning are sampled anew, and
    partitions are coalesced differently, whenever it is planned again.
    """
    order = order_columns(order_by, "a position")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({part: F.spark_partition_id(), inner: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return Workspace(df.sparkSession, "ranged").write(rows, "rows")


def with_position(df: DataFrame, order_by: Order, name: str = "__pos") -> DataFrame:
    """Adds the 0-based position in a total order without moving all rows into one task.

    Rows are range-partitioned, sorted and written with their place in the partition (:func:`ranged`); the partitions' counts,
    one number each, give the offsets that turn places into global positions.
    """
    inner, part, before = free_name(df, "__in_part"), free_name(df, "__part"), free_name(df, "__offset")
    rows = ranged(df, order_by, part, inner)
    counts = rows.groupBy(part).count()
    offsets = counts.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(before))  # a row per partition
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(inner) + F.col(before)).drop(inner, part, before)


# Set operations: null equals null, rows are distinct, schemas match by name and type.


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    if set(left.columns) != set(right.columns):
        raise ShapeMismatch(f"columns differ: {left.columns} and {right.columns}")
    _same_types(left, right)
    return right.select(*[quoted(c) for c in left.columns])


def _same_types(left: DataFrame, right: DataFrame) -> None:
    for name in left.columns:
        if name in right.columns and left.schema[name].dataType != right.schema[name].dataType:
            a, b = left.schema[name].dataType, right.schema[name].dataType
            raise TypeMismatch(f"column {name!r} is {a.simpleString()} and {b.simpleString()}")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(_aligned(left, right)).distinct()


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(_aligned(left, right))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(_aligned(left, right))


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by name; a missing column is null."""
    if not frames:
        raise InvalidOperation("concat needs at least one frame")
    out = frames[0]
    for other in frames[1:]:
        _same_types(out, other)
        out = out.unionByName(other, allowMissingColumns=True)
    return out
