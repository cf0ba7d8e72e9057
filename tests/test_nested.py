from __future__ import annotations

import json

from quillon.operators import nested
from quillon.plans.catalogue import PAGE


def rows(spark, bodies: list[tuple]) -> set[tuple]:
    df = spark.createDataFrame(bodies, "nested_id long, body string, path string, value int")
    found = nested.row_positions(nested.triples(df, PAGE, "nested_id", "body")).collect()
    return {(r["record_id"], *[*r["ordinals"], -1, -1, -1][:3]) for r in found}


ITEM = {"id": 1, "choices": [{"sku": "a", "tiers": [{"min_qty": 1}, None, {"price": 2}]}]}


def test_all_shapes_of_a_list_give_the_same_rows(spark):
    want = {(-1, -1, -1), (0, -1, -1), (0, 0, -1), (0, 0, 0), (0, 0, 2)}
    indexed = {"id": "1", "choices": {"0": {"sku": "a", "tiers": {"0": {"min_qty": 1}, "1": None, "2": {"price": "2"}}}}}
    single = {"id": 1, "choices": {"sku": "a", "tiers": [{"min_qty": 1}, None, {"price": 2}]}}
    shapes = [
        {"results": {"items": [ITEM]}},
        {"results": {"items": {"0": indexed}}},
        {"results": {"items": single}},
        {"results": [ITEM]},
        {"results": {"items": json.dumps([ITEM])}},
        {"meta": None, "extra": {"items": 8}, "results": {"items": [single]}},
    ]
    bodies = [(i, json.dumps(x), "p", 1) for i, x in enumerate(shapes)] + [(99, json.dumps(json.dumps(shapes[0])), "p", 1)]
    got = rows(spark, bodies)
    for i in [*range(len(shapes)), 99]:
        assert {r[1:] for r in got if r[0] == i} == want, i


def test_empty_null_and_malformed_records_keep_their_own_row(spark):
    bodies = [None, "", "{", "null", "[]", '{"results": {}}', '{"results": {"items": ""}}', '{"results": {"items": {}}}', '{"results": null}', "[" * 100_000]
    got = rows(spark, [(i, b, "p", 1) for i, b in enumerate(bodies)] + [(None, "{}", "p", 1)])
    assert got == {(i, -1, -1, -1) for i in range(len(bodies))}


def test_tables_keep_values_links_and_fold_copies(spark):
    body = {"meta": {"page": "7"}, "results": {"items": [None, {"id": "12", "product": "x", "price": "abc", "choices": [{}, {"sku": "s", "surcharge": 1.5}]}]}}
    drifted = {"results": {"items": {"0": None, "1": {"price": "abc", "product": "x", "id": 12, "choices": {"0": {}, "1": {"sku": "s", "surcharge": 1.5}}}}}, "meta": {"page": 7}}
    df = spark.createDataFrame([(5, json.dumps(body)), (5, json.dumps(drifted))], "nested_id long, body string")
    out = nested.tables(nested.triples(df, PAGE, "nested_id", "body"), PAGE, "nested_id")
    assert [r.asDict() for r in out["records"].collect()] == [{"nested_id": 5, "page": 7}]
    assert [r.asDict() for r in out["items"].collect()] == [{"nested_id": 5, "item_pos": 1, "id": 12.0, "product": "x", "price": None}]
    got = {(r["item_pos"], r["choice_pos"], r["sku"], r["surcharge"]) for r in out["choices"].collect()}
    assert got == {(1, 0, None, None), (1, 1, "s", 1.5)}
    assert out["tiers"].count() == 0


def test_struct_records_and_long_records(spark):
    schema = "nested_id long, meta struct<page:int>, results struct<items:array<struct<id:double,product:string>>>"
    many = [(1, (3,), ([(float(i), "p") if i % 2 else None for i in range(30_000)],)), (2, None, None)]
    df = nested.from_structs(spark.createDataFrame(many, schema), "nested_id", "meta", "results")
    out = nested.tables(nested.triples(df, PAGE, "nested_id", "body"), PAGE, "nested_id")
    assert out["items"].count() == 15_000
    assert {(r["nested_id"], r["page"]) for r in out["records"].collect()} == {(1, 3), (2, None)}
    assert nested.triples(df.limit(0), PAGE, "nested_id", "body").count() == 0
