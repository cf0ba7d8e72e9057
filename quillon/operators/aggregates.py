"""Aggregates as Column builders, and group operations over frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation, TypeMismatch
from quillon.operators.frame import need, quoted
from quillon.types import is_numeric

Expr = Column | str


def _col(x: Expr) -> Column:
    return quoted(x) if isinstance(x, str) else x


def total(x: Expr) -> Column:
    """Sum; 0 if there is no value."""
    return F.coalesce(F.sum(_col(x)), F.lit(0))


def mean(x: Expr) -> Column:
    return F.avg(_col(x))


def count(x: Expr) -> Column:
    """Non-null values."""
    return F.count(_col(x))


def count_distinct(x: Expr) -> Column:
    return F.count_distinct(_col(x))


def least(x: Expr) -> Column:
    return F.min(_col(x))


def most(x: Expr) -> Column:
    return F.max(_col(x))


def std(x: Expr) -> Column:
    """Sample standard deviation; null below two values."""
    return F.stddev_samp(_col(x).cast("double"))


def median(x: Expr) -> Column:
    """Exact, the midpoint of the two middle values."""
    return F.median(_col(x))


def first(x: Expr, order: Expr) -> Column:
    """The first non-null value by ``order``, which has to be total."""
    return F.min_by(_col(x), F.when(_col(x).isNotNull(), _col(order)))


def last(x: Expr, order: Expr) -> Column:
    """The last non-null value by ``order``."""
    return F.max_by(_col(x), F.when(_col(x).isNotNull(), _col(order)))


def collect(x: Expr, order: Expr) -> Column:
    """Non-null values in order as an array."""
    pairs = F.collect_list(F.when(_col(x).isNotNull(), F.struct(_col(order).alias("o"), _col(x).alias("v"))))
    return F.transform(F.sort_array(pairs), lambda p: p["v"])


def mode(x: Expr) -> Column:
    """The most frequent non-null value, the smallest among equals."""
    return F.mode(_col(x), deterministic=True)


def corr(x: Expr, y: Expr) -> Column:
    """Pearson over pairs where both are present; null below two pairs or for a constant side."""
    a, b = _col(x).cast("double"), _col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


NAMED: dict[str, Callable[..., Column]] = {"sum": total, "mean": mean, "count": count, "min": least, "max": most, "std": std}


def group_agg(df: DataFrame, keys: str | Sequence[str], spec: Mapping[str, Column | str], order: Expr | None = None) -> DataFrame:
    """Groups by ``keys`` (null is a key) and aggregates; a text names the aggregate of the column called like the output.

    'first' and 'last' need ``order``. Without keys there is one row, on an empty frame too.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    need(df, *names)
    out = []
    for name, item in spec.items():
        if isinstance(item, str):
            need(df, name)
            if item in ("first", "last"):
                if order is None:
                    raise InvalidOperation(f"{item!r} depends on the order of rows: pass order")
                item = (first if item == "first" else last)(name, order)
            elif item in NAMED:
                item = NAMED[item](name)
            else:
                raise InvalidOperation(f"unknown aggregate {item!r}")
        out.append(item.alias(name))
    return df.groupBy(*[quoted(n) for n in names]).agg(*out) if names else df.agg(*out)


def group_count(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    names = [keys] if isinstance(keys, str) else list(keys)
    need(df, *names)
    return df.groupBy(*[quoted(n) for n in names]).count()


def group_first(df: DataFrame, keys: Sequence[str], order: Expr) -> DataFrame:
    """Per group every other column's first non-null value, each on its own."""
    return group_agg(df, keys, {c: first(c, order) for c in df.columns if c not in keys})


def group_last(df: DataFrame, keys: Sequence[str], order: Expr) -> DataFrame:
    return group_agg(df, keys, {c: last(c, order) for c in df.columns if c not in keys})


def group_apply(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """A Python function of each whole group; the caller answers for groups that fit a task's memory."""
    need(df, *keys)
    return df.groupBy(*[quoted(k) for k in keys]).applyInPandas(fn, schema)


def n_groups(df: DataFrame, keys: Sequence[str]) -> int:
    need(df, *keys)
    return df.select(*[quoted(k) for k in keys]).distinct().count()


def groups(df: DataFrame, keys: Sequence[str], limit: int = 1000) -> dict[tuple, DataFrame]:
    """Sub-frames by key, lazily; more than ``limit`` groups are refused, since each is a driver-side object."""
    need(df, *keys)
    found = df.select(*[quoted(k) for k in keys]).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise InvalidOperation(f"more than {limit} groups; use group_agg or group_apply")
    out = {}
    for r in found:
        condition = F.lit(True)
        for k in keys:
            condition = condition & quoted(k).eqNullSafe(F.lit(r[k]))
        out[tuple(r)] = df.where(condition)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), null included, most frequent first, equals by value."""
    need(df, column)
    counts = df.groupBy(quoted(column).alias("value")).count()
    return counts.orderBy(F.desc("count"), F.col("value").asc_nulls_last())


def n_unique(column: Expr) -> Column:
    """Distinct values, null counting as one."""
    c = _col(column)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def describe(df: DataFrame) -> DataFrame:
    """Numeric columns only: one row per statistic (count, mean, std, min, max)."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not numeric:
        raise TypeMismatch("no numeric column")
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[fn(quoted(c).cast("double")).cast("double").alias(f"{s}_{i}") for s, fn in stats.items() for i, c in enumerate(numeric)])
    rows = [F.struct(F.lit(s).alias("statistic"), *[F.col(f"{s}_{i}").alias(c) for i, c in enumerate(numeric)]) for s in stats]
    return one.select(F.inline(F.array(*rows)))
