"""Window functions as Column builders over a :class:`Over` (partition keys and order).

Every sequential function needs a total order; without partition keys a window would move all rows into one task, so large frames
should use :func:`quillon.operators.frame.with_position` or :func:`running_total` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation
from quillon.operators.frame import Order, free_name, need, order_columns, quoted, ranged


def ordered(name: str, direction: str = "asc") -> Column:
    """A window order: nulls last ascending, first descending."""
    return quoted(name).desc_nulls_first() if direction == "desc" else quoted(name).asc_nulls_last()


@dataclass(frozen=True)
class Over:
    keys: tuple[str, ...] = ()
    order: tuple[str | Column, ...] = ()

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*[quoted(k) for k in self.keys]).orderBy(*order_columns(list(self.order), "a window function"))

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*[quoted(k) for k in self.keys])

    def running(self, w: int | None = None) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding if w is None else -(w - 1), Window.currentRow)


def over(*keys: str, order: Order = ()) -> Over:
    items = (order,) if isinstance(order, (str, Column)) else tuple(order)
    return Over(keys, items)


def _ranking(w: Over, source: str, direction: str) -> WindowSpec:
    return w.whole.orderBy(ordered(source, direction))


def rank(w: Over, source: str, direction: str = "asc") -> Column:
    return F.rank().over(_ranking(w, source, direction)).cast("bigint")


def dense_rank(w: Over, source: str, direction: str = "asc") -> Column:
    return F.dense_rank().over(_ranking(w, source, direction)).cast("bigint")


def percent_rank(w: Over, source: str, direction: str = "asc") -> Column:
    """(rank - 1) / (n - 1); 0 for a single row."""
    return F.percent_rank().over(_ranking(w, source, direction))


def row_number(w: Over, source: str | None = None, direction: str = "asc") -> Column:
    """From 1, by the source value and then the window's order."""
    first = [ordered(source, direction)] if source else []
    rest = order_columns(list(w.order), "rowNumber") if w.order or not first else []
    return F.row_number().over(w.whole.orderBy(*first, *rest)).cast("bigint")


def position(w: Over) -> Column:
    """From 0, in the window's order."""
    return row_number(w) - 1


def ntile(w: Over, n: int, source: str | None = None, direction: str = "asc") -> Column:
    """floor((row number - 1) * n / rows) + 1: the larger tiles need not come first."""
    if n < 1:
        raise InvalidOperation("ntile needs at least one tile")
    place = row_number(w, source, direction) - 1
    return (F.floor(place * n / F.count(F.lit(1)).over(w.whole)) + 1).cast("bigint")


def cum_sum(w: Over, x: str) -> Column:
    """Null counts as 0; never null."""
    return F.coalesce(F.sum(quoted(x)).over(w.running()), F.lit(0))


def cum_sum_keep_null(w: Over, x: str) -> Column:
    """As :func:`cum_sum`, but null where the value is."""
    return F.when(quoted(x).isNotNull(), cum_sum(w, x))


def cum_max(w: Over, x: str) -> Column:
    return F.max(quoted(x)).over(w.running())


def cum_min(w: Over, x: str) -> Column:
    return F.min(quoted(x)).over(w.running())


def cum_prod(w: Over, x: str) -> Column:
    return F.coalesce(F.product(quoted(x).cast("double")).over(w.running()), F.lit(1.0))


def cum_count(w: Over, x: str) -> Column:
    return F.count(quoted(x)).over(w.running())


def shift(w: Over, x: str, n: int = 1) -> Column:
    """The value n rows before (after, for a negative n)."""
    return F.lag(quoted(x), n).over(w.rows) if n >= 0 else F.lead(quoted(x), -n).over(w.rows)


def diff(w: Over, x: str, n: int = 1) -> Column:
    return quoted(x) - shift(w, x, n)


def pct_change(w: Over, x: str, n: int = 1) -> Column:
    """(x - previous) / previous; null for a previous 0 or null."""
    before = shift(w, x, n).cast("double")
    return F.try_divide(quoted(x).cast("double") - before, before)


def _full(w: Over, size: int, value: Column) -> Column:
    if size < 1:
        raise InvalidOperation("a rolling window has at least one row")
    return F.when(F.row_number().over(w.rows) >= size, value)


def rolling_mean(w: Over, x: str, size: int) -> Column:
    """Null before the window is full; nulls are skipped."""
    return _full(w, size, F.avg(quoted(x)).over(w.running(size)))


def rolling_sum(w: Over, x: str, size: int) -> Column:
    return _full(w, size, F.coalesce(F.sum(quoted(x)).over(w.running(size)), F.lit(0)))


def rolling_std(w: Over, x: str, size: int) -> Column:
    """Sample standard deviation; null below two values."""
    return _full(w, size, F.stddev_samp(quoted(x).cast("double")).over(w.running(size)))


def rolling_min(w: Over, x: str, size: int) -> Column:
    return _full(w, size, F.min(quoted(x)).over(w.running(size)))


def rolling_max(w: Over, x: str, size: int) -> Column:
    return _full(w, size, F.max(quoted(x)).over(w.running(size)))


def ewm(df: DataFrame, x: str, alpha: float, *, keys: Sequence[str], order_by: str | Sequence[str], name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean e = alpha * x + (1 - alpha) * e per group in order; a null carries e on.

    The recursion is no frame aggregate, so each group is computed whole in one task (pandas' vectorised recursion).
    """
    if not 0 < alpha <= 1:
        raise InvalidOperation("alpha lies in (0, 1]")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    need(df, x, *keys, *order)
    name = free_name(df, name)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        values = pd.to_numeric(pdf[x], errors="coerce").astype(float)
        return pdf.assign(**{name: values.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()})

    schema = df.withColumn(name, F.lit(None).cast("double")).schema
    return df.groupBy(*[quoted(k) for k in keys]).applyInPandas(run, schema)


def running_total(df: DataFrame, x: str, order_by: Order, name: str = "running_total") -> DataFrame:
    """A cumulative sum over the whole frame without a one-task window; a name in use gets an underscore.

    Rows are range-partitioned by the order and written once; each partition sums its own rows, and the partitions' totals, a row
    each, give the offsets.
    """
    need(df, x)
    part, inner, before, name = free_name(df, "__part"), free_name(df, "__inner"), free_name(df, "__offset"), free_name(df, name)
    rows = ranged(df, order_by, part, inner)
    within = rows.withColumn(name, F.coalesce(F.sum(quoted(x)).over(Window.partitionBy(part).orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    totals = rows.groupBy(part).agg(F.coalesce(F.sum(quoted(x)), F.lit(0)).alias("t"))
    offsets = totals.select(part, (F.sum("t").over(Window.orderBy(part)) - F.col("t")).alias(before))
    return within.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(before)).drop(part, inner, before)
