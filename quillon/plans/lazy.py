"""The lazy surface. Spark frames are lazy already, so these are naming conventions and an explain text, no plan tree of our own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from quillon.operators import aggregates, frame


def explain_text(df: DataFrame) -> str:
    """The logical plan as written and as optimized, and the physical plan."""
    execution = df._jdf.queryExecution()
    parts = {"ORIGINAL": execution.logical().toString(), "OPTIMIZED": execution.optimizedPlan().toString(), "PHYSICAL": execution.executedPlan().toString()}
    return "\n".join(f"== {name} ==\n{text}" for name, text in parts.items())


def sort(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    return frame.sort_by(df, by, "desc" if descending else "asc")


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    """Aggregates given as (aggregate, column) pairs, named ``<aggregate>_<column>``."""
    pairs = list(aggs.items()) if isinstance(aggs, Mapping) else list(aggs)
    spec: dict[str, Column] = {}
    for kind, column in pairs:
        frame.need(df, column)
        spec[f"{kind}_{column}"] = aggregates.NAMED[kind](column)
    return aggregates.group_agg(df, list(keys), spec)


def distinct(df: DataFrame, columns: Sequence[str] | None = None, *, order_by: frame.Order | None = None) -> DataFrame:
    return frame.unique(df, columns, order_by=order_by)
