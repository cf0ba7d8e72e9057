"""Reshaping (pivot, melt, explode, unroll, spread, transpose) and filling of nulls."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation, TypeMismatch
from quillon.operators import aggregates
from quillon.operators.frame import Order, free_name, need, order_columns, quoted, ranged
from quillon.types import num_to_text

#: A pivot or spread makes a column per value; more than so many is refused rather than planned.
MAX_COLUMNS = 5000


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def pivot(
    df: DataFrame,
    index: str | Sequence[str],
    columns: str,
    values: str,
    agg: str = "first",
    *,
    headers: Sequence[str] | None = None,
    order: str | Column | None = None,
) -> DataFrame:
    """A row per ``index``, a column per value of ``columns`` (its text, 'null' for null), cells aggregated from ``values``.

    sum (0 if all values are null), mean, count (rows, null values too), first and last (null values too, by ``order``). Cells
    without rows are null. ``headers`` gives the columns and saves the pass that finds them.
    """
    names = _names(index)
    need(df, *names, columns, values)
    header = F.coalesce(num_to_text(quoted(columns), df.schema[columns].dataType), F.lit("null"))
    if headers is None:
        found = df.select(header.alias("h")).distinct().orderBy("h").limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise InvalidOperation(f"pivot would make more than {MAX_COLUMNS} columns")
        headers = [r[0] for r in found]
    v = quoted(values)
    if agg in ("first", "last"):
        if order is None:
            raise InvalidOperation(f"pivot with {agg!r} depends on the order of rows: pass order")
        by = quoted(order) if isinstance(order, str) else order
        # The value sits in a struct so that a null value can be the first one.
        pick = (F.min_by if agg == "first" else F.max_by)(F.struct(v.alias("v")), by)["v"]
    else:
        made = {"sum": aggregates.total(v), "mean": F.avg(v), "count": F.count(F.lit(1))}
        if agg not in made:
            raise InvalidOperation(f"unknown pivot aggregate {agg!r}")
        pick = made[agg]
    h = free_name(df, "__header")
    return df.withColumn(h, header).groupBy(*[quoted(n) for n in names]).pivot(h, list(headers)).agg(pick)


def melt(df: DataFrame, id_vars: str | Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """A row per id row and value column; columns of different types become text."""
    ids = _names(id_vars)
    chosen = [c for c in df.columns if c not in ids] if value_vars is None else list(value_vars)
    need(df, *ids, *chosen)
    if not chosen:
        raise InvalidOperation("melt needs at least one value column")
    kinds = {df.schema[c].dataType for c in chosen}
    if len(kinds) > 1:
        df = df.withColumns({c: num_to_text(quoted(c), df.schema[c].dataType) for c in chosen})
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in chosen], var_name, value_name)


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row per element: null gives one null row, an empty array none; a column that is no array stays as it is."""
    need(df, column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return df
    kept = df.where(quoted(column).isNull() | (F.size(quoted(column)) > 0))
    name = free_name(df, "__element")
    out = kept.select("*", F.explode_outer(quoted(column)).alias(name))
    return out.select(*[F.col(name).alias(c) if c == column else quoted(c) for c in df.columns])


def unroll(df: DataFrame, columns: str | Sequence[str], index: str | None = None) -> DataFrame:
    """Zips parallel arrays into rows, the shorter ones padded with null; ``index`` names the 0-based place."""
    names = _names(columns)
    need(df, *names)
    for c in names:
        if not isinstance(df.schema[c].dataType, T.ArrayType):
            raise TypeMismatch(f"column {c!r} is no array")
    arrays = [F.coalesce(quoted(c), F.array().cast(df.schema[c].dataType)).alias(f"a{i}") for i, c in enumerate(names)]
    at, item = free_name(df, "__at"), free_name(df, "__item")
    out = df.select("*", F.posexplode(F.arrays_zip(*arrays)).alias(at, item))
    fields = {c: F.col(item)[f"a{i}"] for i, c in enumerate(names)}
    added = [F.col(at).cast("bigint").alias(index)] if index else []
    return out.select(*[fields[c].alias(c) if c in fields else quoted(c) for c in df.columns if c != index], *added)


def spread(df: DataFrame, column: str, *, limit: int | None = None, name: Callable[[str | int], str] | None = None, drop: bool = True) -> DataFrame:
    """An array becomes ``column_0``..., a struct or map ``column_key``...; ``limit`` bounds the number of columns."""
    need(df, column)
    kind = df.schema[column].dataType
    called = name or (lambda key: f"{column}_{key}")
    c = quoted(column)
    if isinstance(kind, T.StructType):
        parts = [(n, c[n]) for n in kind.fieldNames()]
    elif isinstance(kind, T.ArrayType):
        n = limit if limit is not None else df.agg(F.coalesce(F.max(F.size(c)), F.lit(0))).first()[0]
        if n > MAX_COLUMNS:
            raise InvalidOperation(f"spread would make {n} columns; pass limit")
        parts = [(i, F.get(c, F.lit(i))) for i in range(max(n, 0))]
    elif isinstance(kind, T.MapType):
        keys = df.select(F.explode(F.map_keys(c)).alias("k")).distinct().orderBy("k").limit(MAX_COLUMNS + 1).collect()
        if len(keys) > MAX_COLUMNS:
            raise InvalidOperation(f"spread would make more than {MAX_COLUMNS} columns")
        parts = [(r[0], F.try_element_at(c, F.lit(r[0]))) for r in keys]
    else:
        raise TypeMismatch(f"column {column!r} is neither array, struct nor map")
    parts = parts[:limit] if limit is not None else parts
    kept = [quoted(x) for x in df.columns if not (drop and x == column)]
    return df.select(*kept, *[value.alias(called(key)) for key, value in parts])


def transpose(df: DataFrame, header: str | None = None, *, order_by: Order | None = None, limit: int = 1000) -> DataFrame:
    """Columns become rows: ``column``, then one column per row, named by ``header`` or by place in ``order_by``.

    The result is as wide as the frame is long, so more than ``limit`` rows are refused.
    """
    if header is None:
        order = order_columns(order_by, "transpose without a header")
        if df.limit(limit + 1).count() > limit:
            raise InvalidOperation(f"more than {limit} rows to transpose")
        label = free_name(df, "__label")
        df = df.withColumn(label, (F.row_number().over(Window.orderBy(*order)) - 1).cast("string"))  # at most `limit` rows
    else:
        need(df, header)
        if df.limit(limit + 1).count() > limit:
            raise InvalidOperation(f"more than {limit} rows to transpose")
        label = header
        df = df.withColumn(label, num_to_text(quoted(label), df.schema[label].dataType))
    values = [c for c in df.columns if c != label]
    if len({df.schema[c].dataType for c in values}) > 1:
        df = df.withColumns({c: num_to_text(quoted(c), df.schema[c].dataType) for c in values})
    return df.transpose(quoted(label)).withColumnRenamed("key", "column")


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    need(df, *values)
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def fill_forward(df: DataFrame, *, order_by: Order, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls take the last value before them; leading nulls stay."""
    return _fill(df, order_by, keys, columns, forward=True)


def fill_backward(df: DataFrame, *, order_by: Order, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls take the next value after them; trailing nulls stay."""
    return _fill(df, order_by, keys, columns, forward=False)


def _fill(df: DataFrame, order_by: Order, keys: Sequence[str], columns: Sequence[str] | None, forward: bool) -> DataFrame:
    chosen = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    need(df, *chosen, *keys)
    if not keys:
        return _fill_whole(df, order_by, chosen, forward)
    return df.withColumns(_carried(chosen, Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order_columns(order_by, "filling")), forward))


def _carried(columns: Sequence[str], w: WindowSpec, forward: bool) -> dict[str, Column]:
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return {c: F.last(quoted(c), True).over(before) if forward else F.first(quoted(c), True).over(after) for c in columns}


def _fill_whole(df: DataFrame, order_by: Order, columns: Sequence[str], forward: bool) -> DataFrame:
    """Filling without keys: each range partition fills itself and takes what is left from its neighbours' edge values, a row
    per partition."""
    part, inner = free_name(df, "__part"), free_name(df, "__inner")
    rows = ranged(df, order_by, part, inner)
    held = [(F.max_by if forward else F.min_by)(quoted(c), F.when(quoted(c).isNotNull(), F.col(inner))).alias(f"e{i}") for i, c in enumerate(columns)]
    w = Window.orderBy(part)
    reach = w.rowsBetween(Window.unboundedPreceding, -1) if forward else w.rowsBetween(1, Window.unboundedFollowing)
    edges = [(F.last if forward else F.first)(f"e{i}", True).over(reach).alias(free_name(df, f"__edge{i}")) for i in range(len(columns))]
    edge = rows.groupBy(part).agg(*held).select(part, *edges)
    filled = rows.withColumns(_carried(columns, Window.partitionBy(part).orderBy(inner), forward)).join(F.broadcast(edge), part)
    return filled.withColumns({c: F.coalesce(quoted(c), F.col(free_name(df, f"__edge{i}"))) for i, c in enumerate(columns)}).select(*[quoted(c) for c in df.columns])


def impute(df: DataFrame, values: Mapping[str, object], expand: Sequence[str] = (), *, order_by: Order | None = None) -> DataFrame:
    """Fills nulls with a constant or an aggregate Column of the frame; ``expand`` first adds the missing key combinations.

    The combinations of the keys' distinct values (null included) are the wanted result, so their cross product is what is
    asked for and not a by-product; of rows with equal keys the last by ``order_by`` is kept.
    """
    need(df, *values, *expand)
    out = df
    if expand:
        w = Window.partitionBy(*[quoted(k) for k in expand]).orderBy(*[_backward(o) for o in _names_of(order_by)])
        place = free_name(df, "__place")
        last = df.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
        grid = None
        for i, k in enumerate(expand):
            domain = df.select(quoted(k).alias(f"__k{i}")).distinct()
            grid = domain if grid is None else grid.crossJoin(domain)
        condition = F.lit(True)
        for i, k in enumerate(expand):
            condition = condition & F.col(f"__k{i}").eqNullSafe(quoted(k))
        keyed = grid.join(last, condition, "left")
        out = keyed.select(*[F.col(f"__k{expand.index(c)}").alias(c) if c in expand else quoted(c) for c in df.columns])
    fills = {c: v for c, v in values.items() if isinstance(v, Column)}
    if fills:
        scalars = df.agg(*[v.alias(f"__v{i}") for i, v in enumerate(fills.values())])
        out = out.crossJoin(F.broadcast(scalars))  # one row
    named = {c: (F.col(f"__v{list(fills).index(c)}") if c in fills else F.lit(values[c])) for c in values}
    return out.select(*[F.coalesce(quoted(c), named[c].cast(df.schema[c].dataType)).alias(c) if c in named else quoted(c) for c in df.columns])


def _names_of(order_by: Order | None) -> list[str]:
    if order_by is None:
        raise InvalidOperation("expand depends on the order of rows with equal keys: pass order_by")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _backward(name: str) -> Column:
    return quoted(name).desc_nulls_first()
