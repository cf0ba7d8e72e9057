"""Flattening deeply nested records into related flat tables that keep parent-child links.

Method: each record is parsed whole and walked into path-value-ordinal triples, the triples are grouped by their repeated ancestor
(the list they belong to), and each group is pivoted into one table whose key is the record id and the ordinals of the lists on
the way. A layout names the lists and their leaf fields, because the texts drift: a list may be written as an array, as an
object with the places as keys, as one object alone, as JSON text inside JSON, or directly in place of the object that should
hold it.

Only the parse runs in Python (one record at a time, Arrow batches out); grouping and pivoting are hash aggregates with map-side
combining, where the triples of a row, adjacent as they are parsed, become one row before the shuffle. Records delivered twice
fold in the same aggregate.

Defined results for edge cases: null, empty or malformed text, or text nested too deep for the parser, anywhere in it, gives the
record's own row without values and no children; null places in a list count as positions but give no row; an empty list, ``{}``
or blank text in place of a list has no rows; values that are no number where one is declared become null; extra fields are
ignored; among differing copies of one record the largest value of each field is kept; an empty table gives empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "array<struct<path:string,ordinals:array<int>,name:string,value:string>>"


@dataclass(frozen=True)
class ListLayout:
    """A repeated group: ``name`` of its table, ``at`` the keys that lead to it from its parent, leaf ``fields`` (name -> Spark
    type), and the lists inside it."""

    name: str
    at: tuple[str, ...]
    fields: dict[str, str]
    lists: tuple["ListLayout", ...] = ()


@dataclass(frozen=True)
class RecordLayout:
    """The record itself: ``fields`` (output name -> (path of keys, Spark type)) and its lists."""

    fields: dict[str, tuple[tuple[str, ...], str]]
    lists: tuple[ListLayout, ...] = ()
    name: str = "records"
    positions: dict[str, str] = field(default_factory=dict)


def _decoded(value: object) -> object:
    """JSON text inside JSON, to any depth, as its content."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _is_indexed(value: object) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.isascii() and k.isdigit() for k in value)


def _places(value: object) -> list[object]:
    """The places of a list in whatever shape it is written."""
    value = _decoded(value)
    if isinstance(value, list):
        return [_decoded(x) for x in value]
    if _is_indexed(value):
        return [_decoded(value[k]) for k in sorted(value, key=int)]
    return [value] if isinstance(value, dict) and value else []


def _reach(node: dict, layout: ListLayout) -> list[object]:
    """The list's places; an object on the way may be left out, with the list itself, or one of its objects, in its place."""
    value: object = node
    for i, key in enumerate(layout.at):
        value = _decoded(value)
        if not isinstance(value, dict):
            return _places(value)
        if key not in value:
            direct = i and (_is_indexed(value) or any(name in value for name in layout.fields))
            return _places(value) if direct else []
        value = value[key]
    return _places(value)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else repr(value)


def _walk(node: dict, layout: ListLayout, ordinals: tuple[int, ...], path: str) -> Iterator[tuple]:
    path = f"{path}.{layout.name}" if path else layout.name
    for i, place in enumerate(_reach(node, layout)):
        if not isinstance(place, dict):
            continue
        at = (*ordinals, i)
        yield (path, at, "", None)
        for name in layout.fields:
            if place.get(name) is not None:
                yield (path, at, name, _text(place[name]))
        for inner in layout.lists:
            yield from _walk(place, inner, at, path)


def triples_of(text: str | None, layout: RecordLayout) -> Iterator[tuple]:
    """The path-value-ordinal triples (path, ordinals, field, value) of one record; the empty field marks that a row exists."""
    yield ("", (), "", None)
    try:
        record = _decoded(json.loads(text)) if text else None
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return
    for name, (keys, _) in layout.fields.items():
        value: object = record
        for key in keys:
            value = _decoded(value)
            value = value.get(key) if isinstance(value, dict) else None
        if value is not None:
            yield ("", (), name, _text(value))
    for inner in layout.lists:
        yield from _walk(record, inner, (), "")


def triples(df: DataFrame, layout: RecordLayout, key: str, body: str) -> DataFrame:
    """(record_id, path, ordinals, name, value) for every record of ``df``; rows without a key are left out."""
    import pyarrow as pa

    out_rows = 50_000
    types = [("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("name", pa.string()), ("value", pa.string())]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("record_id"), F.col(body).cast("string").alias("body"))
    id_type = rows.schema["record_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            where: list[int] = []
            held: list[tuple] = []

            def flush() -> pa.RecordBatch:
                columns = [ids.take(pa.array(where, pa.int64()))]
                columns += [pa.array([h[i] for h in held], kind) for i, (_, kind) in enumerate(types)]
                done = pa.RecordBatch.from_arrays(columns, names=["record_id", *(n for n, _ in types)])
                where.clear()
                held.clear()
                return done

            for i in range(batch.num_rows):
                for triple in triples_of(texts[i].as_py(), layout):
                    where.append(i)
                    held.append(triple)
                    if len(held) >= out_rows:
                        yield flush()
            if held:
                yield flush()

    return rows.mapInArrow(run, f"record_id {id_type.simpleString()}, path string, ordinals array<int>, name string, value string")


def from_structs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Records held in struct columns, as (key, body) with the body as JSON text."""
    return df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body"))


def _all_lists(lists: tuple[ListLayout, ...], path: str = "", depth: int = 0) -> Iterator[tuple[str, int, ListLayout]]:
    for x in lists:
        own = f"{path}.{x.name}" if path else x.name
        yield own, depth + 1, x
        yield from _all_lists(x.lists, own, depth + 1)


def tables(found: DataFrame, layout: RecordLayout, key: str = "record_id") -> dict[str, DataFrame]:
    """The flat tables by name: the record's with its fields, and one per list with the positions of the lists on the way.

    A child's link to its parent is the key and the parent's positions, which are the leading ones of its own.
    """

    def pivot(path: str, positions: list[str], fields: dict[str, str]) -> DataFrame:
        rows = found.where(F.col("path") == path)
        aggs = [F.max(F.when(F.col("name") == n, F.col("value"))).try_cast(t).alias(n) for n, t in fields.items()]
        aggs = aggs or [F.count(F.lit(1)).alias("__n")]
        grouped = rows.groupBy("record_id", "ordinals").agg(*aggs)
        at = [F.get(F.col("ordinals"), F.lit(i)).alias(p) for i, p in enumerate(positions)]
        return grouped.select(F.col("record_id").alias(key), *at, *fields)

    out = {layout.name: pivot("", [], {n: t for n, (_, t) in layout.fields.items()})}
    for path, depth, x in _all_lists(layout.lists):
        names = path.split(".")
        positions = [f"{layout.positions.get(n, n)}_pos" for n in names[:depth]]
        out[x.name] = pivot(path, positions, x.fields)
    return out


def row_positions(found: DataFrame) -> DataFrame:
    """Every row of every table once: (record_id, path, ordinals)."""
    return found.where(F.col("name") == "").groupBy("record_id", "path", "ordinals").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
