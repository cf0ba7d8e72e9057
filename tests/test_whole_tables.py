"""Queries that have to use every row of their tables, against brute force over the smallest tables."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = entry.ENTRY_DIR


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [tuple(r) for r in entry.queries()[name](spark, DIR).collect()]


def table(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def by_user() -> dict[int, list[dict]]:
    rows: dict[int, list[dict]] = {}
    for r in table("events").sort_values("event_id").to_dict("records"):
        rows.setdefault(r["user_id"], []).append(r)
    return rows


def test_cum_prod_of_all_events(run):
    want = {}
    for events in by_user().values():
        p = 1.0
        for r in events:
            p *= 1 + (r["event_id"] % 3) / 10.0
            want[r["event_id"]] = p
    got = dict(run("cum_prod"))
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6) for i in want)


def test_cum_prod_beyond_the_first_ids(spark, tmp_path):
    """The smallest table has no id above 2,000."""
    spark.createDataFrame([(i, 1) for i in (1, 2001, 90_001)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in entry.queries()["cum_prod"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1.1), (2001, 1.1), (90_001, 1.21)}


def test_ewm_of_all_events(run):
    want = {}
    for events in by_user().values():
        e = None
        for r in events:
            e = r["value"] if e is None else 0.3 * r["value"] + 0.7 * e
            want[r["event_id"]] = e
    got = dict(run("ewm"))
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_agg_list_of_all_events(run):
    want = {(user, len(events), ",".join(r["event_type"] for r in events)) for user, events in by_user().items()}
    got = run("agg_list")
    assert len(got) == len(want) and set(got) == want


def test_impute_expand_of_all_lineitems(run):
    cells: dict[tuple, float] = {}
    for r in table("lineitem").to_dict("records"):
        key = (r["l_returnflag"], None if (r["l_returnflag"], r["l_linenumber"]) == ("A", 7) else r["l_linenumber"])
        if (r["l_returnflag"], r["l_linenumber"]) != ("R", 1):
            cells[key] = max(cells.get(key, 0.0), r["l_quantity"])
    want = {(flag, number): cells.get((flag, number), 0.0) for flag in "ANR" for number in (None, *range(1, 8))}
    got = run("impute_expand")
    assert len(got) == 24 and {(flag, number): q for flag, number, q in got} == want


def test_sort_returns_every_order(run):
    status = {r["o_orderkey"]: None if r["o_orderstatus"] == "F" else r["o_orderstatus"] for r in table("orders").to_dict("records")}
    keys = sorted(status)
    want = [(k, s) for s in ("P", "O", None) for k in keys if status[k] == s]
    assert len(want) == len(status) and run("sort_nulls_last") == want


def test_orderby_returns_every_nation(run):
    rows = table("nation").to_dict("records")
    assert run("orderby_compat") == sorted(((r["n_name"], r["n_regionkey"]) for r in rows), key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "semi", "anti"])
def test_joins_of_all_orders_and_customers(run, how):
    orders = [(r["o_orderkey"], None if r["o_custkey"] == 12 else r["o_custkey"]) for r in table("orders").to_dict("records")]
    names = {r["c_custkey"] + 10: r["c_name"] for r in table("customer").to_dict("records")}
    used = {k for _, k in orders}
    matched = [(k, o, names[k]) for o, k in orders if k in names]
    lone_orders = [(k, o, None) for o, k in orders if k not in names]
    lone_customers = [(k, None, n) for k, n in names.items() if k not in used]
    assert matched and lone_orders and lone_customers and None in used
    want = {
        "inner": matched, "left": matched + lone_orders, "right": matched + lone_customers, "outer": matched + lone_orders + lone_customers,
        "semi": [(o, k) for k, o, _ in matched], "anti": [(o, k) for k, o, _ in lone_orders],
    }[how]
    assert Counter(run(f"join_{how}")) == Counter(want)


def test_pivot_count_of_all_line_numbers(spark):
    cells = Counter((r["l_returnflag"], r["l_linenumber"]) for r in table("lineitem").to_dict("records"))
    out = entry.queries()["pivot_count"](spark, DIR)
    assert out.columns == ["l_returnflag", *"1234567"]
    assert sorted(map(tuple, out.collect())) == [(flag, *(cells[flag, n] for n in range(1, 8))) for flag in "ANR"]
