"""A verb layer for users who come from data-verb libraries: selectors and short names over the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation
from quillon.operators import aggregates, frame, joins, reshape


@dataclass(frozen=True)
class Desc:
    name: str


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Without:
    parts: tuple


@dataclass(frozen=True)
class Span:
    first: str
    last: str


Selector = str | Everything | Without | Span


def all_columns() -> Everything:
    return Everything()


def without(*parts: Selector) -> Without:
    return Without(parts)


def span(first: str, last: str) -> Span:
    """The columns from one to the other, in either direction."""
    return Span(first, last)


def desc(name: str) -> Desc:
    return Desc(name)


def resolve(df: DataFrame, *parts: Selector) -> list[str]:
    """The selected column names, each once, in order of mention."""
    out: list[str] = []
    for part in parts:
        if isinstance(part, Everything):
            names = df.columns
        elif isinstance(part, Without):
            gone = set(resolve(df, *part.parts))
            names = [c for c in df.columns if c not in gone]
        elif isinstance(part, Span):
            frame.need(df, part.first, part.last)
            a, b = df.columns.index(part.first), df.columns.index(part.last)
            names = df.columns[min(a, b) : max(a, b) + 1]
        else:
            frame.need(df, part)
            names = [part]
        out += [n for n in names if n not in out]
    return out


def select(df: DataFrame, *parts: Selector) -> DataFrame:
    return frame.select(df, *resolve(df, *parts))


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    return frame.derive(df, columns)


def filter(df: DataFrame, condition: Column) -> DataFrame:  # noqa: A001
    return df.where(condition)


def orderby(df: DataFrame, *keys: str | Desc) -> DataFrame:
    names = [k.name if isinstance(k, Desc) else k for k in keys]
    return frame.sort_by(df, names, ["desc" if isinstance(k, Desc) else "asc" for k in keys])


def groupby(df: DataFrame, *keys: str) -> tuple[DataFrame, list[str]]:
    frame.need(df, *keys)
    return df, list(keys)


def fold(df: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("key", "value")) -> DataFrame:
    return reshape.melt(df, [c for c in df.columns if c not in columns], list(columns), *names)


def join(left: DataFrame, right: DataFrame, on: joins.On, how: str = "inner", suffix: str = "_right") -> DataFrame:
    return joins.join(left, right, on, how, suffix=suffix)


class op:
    """Null-skipping aggregates by column name."""

    sum = staticmethod(aggregates.total)
    mean = staticmethod(aggregates.mean)
    count = staticmethod(aggregates.count)
    min = staticmethod(aggregates.least)
    max = staticmethod(aggregates.most)
    distinct = staticmethod(aggregates.count_distinct)
    first = staticmethod(aggregates.first)
    last = staticmethod(aggregates.last)
    corr = staticmethod(aggregates.corr)


@dataclass(frozen=True)
class Reduce:
    """A Python reduction of whole columns of a group, for :func:`rollup`; the slow path."""

    fn: Callable[..., object]
    columns: tuple[str, ...]
    kind: str = "double"


def rollup(grouped: DataFrame | tuple[DataFrame, Sequence[str]], **spec: Column | Reduce) -> DataFrame:
    """One row per group (or one in all): built-in aggregates, and Python reductions as grouped pandas functions."""
    df, keys = grouped if isinstance(grouped, tuple) else (grouped, [])
    built = {n: x for n, x in spec.items() if isinstance(x, Column)}
    made = {n: _grouped(x)(*[frame.quoted(c) for c in x.columns]) for n, x in spec.items() if isinstance(x, Reduce)}
    for name in set(spec) - set(built) - set(made):
        raise InvalidOperation(f"{name!r} is no aggregate")
    parts = [df.groupBy(*[frame.quoted(k) for k in keys]).agg(*[x.alias(n) for n, x in p.items()]) for p in (built, made) if p]
    if len(parts) == 1:
        return parts[0]
    # Python reductions cannot share a pass with built-in aggregates: two passes, joined by group.
    right = parts[1].withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & frame.quoted(k).eqNullSafe(frame.quoted(f"__{k}"))
    return parts[0].join(right, condition).select(*[frame.quoted(c) for c in [*keys, *spec]])


def _grouped(item: Reduce) -> Callable[..., Column]:
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    fn = item.fn
    warnings.filterwarnings("ignore", "In Python 3.6", UserWarning)
    if len(item.columns) == 1:

        def one(x: pd.Series) -> object:
            return fn(x)

        return pandas_udf(one, item.kind, PandasUDFType.GROUPED_AGG)
    if len(item.columns) == 2:

        def two(x: pd.Series, y: pd.Series) -> object:
            return fn(x, y)

        return pandas_udf(two, item.kind, PandasUDFType.GROUPED_AGG)
    raise InvalidOperation("a reduction takes one or two columns")


def impute(df: DataFrame, values: Mapping[str, object], expand: Sequence[str] = (), order_by: frame.Order | None = None) -> DataFrame:
    return reshape.impute(df, values, expand, order_by=order_by)


unroll = reshape.unroll
spread = reshape.spread
lookup = joins.lookup
concat = frame.concat
union = frame.union
intersect = frame.intersection
except_ = frame.difference
dedupe = frame.unique
relocate = frame.relocate
rename = frame.rename
sample = frame.sample
slice_rows = frame.slice_rows


def ungroup(grouped: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    return grouped[0]


def count(grouped: DataFrame | tuple[DataFrame, Sequence[str]]) -> DataFrame:
    df, keys = grouped if isinstance(grouped, tuple) else (grouped, [])
    return aggregates.group_count(df, keys) if keys else df.agg(F.count(F.lit(1)).alias("count"))
