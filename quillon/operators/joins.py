"""Equi-joins with one output layout: keys under their left names, left columns, right columns with a suffix on a clash.

The physical join (broadcast, shuffled hash, sort-merge, skew splitting) is left to the optimizer and adaptive execution, which
know the sizes of both sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation, ShapeMismatch, TypeMismatch
from quillon.operators.frame import Order, need, order_columns, quoted
from quillon.types import is_numeric

On = str | Sequence[str] | Mapping[str, str | Sequence[str]]
HOWS = ("inner", "left", "right", "outer", "cross", "semi", "anti")


def _keys(on: On) -> tuple[list[str], list[str]]:
    def names(x: str | Sequence[str]) -> list[str]:
        return [x] if isinstance(x, str) else list(x)

    if isinstance(on, Mapping):
        left, right = names(on["left"]), names(on["right"])
    else:
        left = right = names(on)
    if len(left) != len(right):
        raise ShapeMismatch("both sides need as many keys")
    if not left:
        raise InvalidOperation("a join needs at least one key")
    return left, right


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    return type(a) is type(b) or (is_numeric(a) and is_numeric(b))


def join(left: DataFrame, right: DataFrame, on: On = (), how: str = "inner", *, suffix: str = "_right") -> DataFrame:
    """Null keys match nothing; number keys match only numbers, texts only texts.

    inner, left, right, outer, cross, semi, anti. In right and outer joins an unmatched right row brings its own key. An anti
    join keeps left rows with null keys.
    """
    if how not in HOWS:
        raise InvalidOperation(f"unknown join {how!r}")
    if how == "cross":
        named = [quoted(c).alias(c + suffix if c in left.columns else c) for c in right.columns]
        return left.crossJoin(right.select(*named))
    lk, rk = _keys(on)
    need(left, *lk)
    need(right, *rk)
    for a, b in zip(lk, rk):
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if not _comparable(x, y):
            raise TypeMismatch(f"key {a!r} is {x.simpleString()}, key {b!r} is {y.simpleString()}")
    inner_names = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[quoted(c).alias(n) for c, n in inner_names.items()])
    condition = F.lit(True)
    for i, (a, b) in enumerate(zip(lk, rk)):
        same = quoted(a) == F.col(inner_names[b])
        condition = same if i == 0 else condition & same
    if how in ("semi", "anti"):
        return left.join(r, condition, f"left_{how}")
    joined = left.join(r, condition, {"outer": "full"}.get(how, how))
    both = how in ("right", "outer")
    keys = [(F.coalesce(quoted(a), F.col(inner_names[b])) if both else quoted(a)).alias(a) for a, b in zip(lk, rk)]
    others = [quoted(c) for c in left.columns if c not in lk]
    added = [F.col(inner_names[c]).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in rk]
    return joined.select(*keys, *others, *added)


def lookup(left: DataFrame, right: DataFrame, on: On, values: Sequence[str] | None = None, *, order_by: Order) -> DataFrame:
    """A left join with the first right row per key (by ``order_by``); a clashing column is overwritten in place."""
    lk, rk = _keys(on)
    values = [c for c in right.columns if c not in rk] if values is None else list(values)
    need(right, *rk, *values)
    place = "__place"
    ranked = right.withColumn(place, F.row_number().over(Window.partitionBy(*[quoted(k) for k in rk]).orderBy(*order_columns(order_by, "lookup"))))
    firsts = ranked.where(F.col(place) == 1).select(*[quoted(k) for k in rk], *[quoted(v) for v in values if v not in rk])
    joined = join(left, firsts, {"left": lk, "right": rk}, "left", suffix="__new")
    out = []
    for c in left.columns:
        out.append(quoted(c + "__new").alias(c) if c in values and c not in lk and c not in rk else quoted(c))
    return joined.select(*out, *[quoted(v) for v in values if v not in left.columns and v not in rk])
