"""Trailing totals against a plain loop, over versions, corrections, gaps and odd amounts."""

from __future__ import annotations

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillon.operators.trailing import Trailing, report, trailing_state, trailing_totals

SPEC = Trailing(("region",), "date", "amount", spans=(3, 5), row_id="sale_id", arrived="loaded_at", version="month")
SCHEMA = "sale_id long, region string, date date, amount double, loaded_at timestamp_ntz, day string, version string"


def _brute(rows: list[tuple], spans: tuple[int, ...] = (3, 5)) -> dict:
    seen: dict = {}
    for sale, region, date, amount, *_ in rows:
        if region is not None and date is not None and amount is not None and not math.isnan(amount):
            seen[sale] = (region, date, amount)
    out = {}
    for region in {v[0] for v in seen.values()}:
        own = [v for v in seen.values() if v[0] == region]
        first, last = min(v[1] for v in own), max(v[1] for v in own)
        for i in range((last - first).days + 1):
            day = first + dt.timedelta(days=i)
            row = []
            for s in spans:
                amounts = [a for _, d, a in own if day - dt.timedelta(days=s) < d <= day]
                row += [round(sum(amounts), 6), len(amounts)]
            out[region, day] = tuple(row)
    return out


def _got(df) -> dict:
    return {(r["region"], r["date"]): (round(r["total_3"], 6), r["count_3"], round(r["total_5"], 6), r["count_5"]) for r in df.collect()}


def test_versions_and_corrections_agree_with_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 2, 30, 31, 44, 75, 76, 90]) + rng.randrange(3))
        loaded = dt.datetime.combine(day, dt.time(1)) + dt.timedelta(days=rng.choice([0, 1, 40, 100]))
        row = (i, rng.choice(["a", "b", "c", None]), day, rng.choice([None, float("nan"), 0.0, -2.5, 0.1, 0.2, 19.99]), loaded, "x", "y")
        rows.append(row)
        if i % 7 == 0:
            rows.append((*row[:4], loaded + dt.timedelta(days=35), "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    out = trailing_totals(df, SPEC)
    assert _got(out) == _brute(rows)
    assert out.select("version").distinct().count() > 2


def test_late_sale_before_the_first_day_fills_the_gap(spark):
    d = dt.date
    rows = [(1, "a", d(2024, 3, 10), 5.0, dt.datetime(2024, 3, 10), "", ""), (2, "a", d(2024, 1, 2), 7.0, dt.datetime(2024, 4, 1), "", ""), (3, "a", d(2024, 5, 1), 1.0, dt.datetime(2024, 5, 2), "", "")]
    assert _got(trailing_totals(spark.createDataFrame(rows, SCHEMA), SPEC)) == _brute(rows)


def test_exact_sums_and_infinite_amounts(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "a", d, 0.1, None, "", ""), (2, "a", d, 0.2, None, "", ""), (3, "a", d, -0.3, None, "", ""), (4, "b", d, float("inf"), None, "", ""), (5, "b", d + dt.timedelta(days=9), 1.0, None, "", ""), (None, "a", d, 1.0, None, "", ""), (None, "a", d, 1.0, None, "", "")]
    out = {(r["region"], r["date"]): r for r in trailing_totals(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert out["a", d]["total_3"] == 2.0 and out["a", d]["count_3"] == 5
    assert out["b", d]["total_3"] == float("inf")
    assert out["b", d + dt.timedelta(days=9)]["total_3"] == 1.0
    assert out["b", d + dt.timedelta(days=7)]["avg_3"] is None


def test_empty_input(spark):
    out = trailing_totals(spark.createDataFrame([], SCHEMA), SPEC)
    assert out.count() == 0 and "total_3" in out.columns


def test_many_copies_of_one_sale_count_once(spark):
    rows = [(1, "a", dt.date(2024, 1, 1), 2.0, dt.datetime(2024, 1, 1), "", "")]
    df = spark.createDataFrame(rows, SCHEMA).crossJoin(spark.range(500)).drop("id").withColumn("extra", F.lit(1))
    assert trailing_totals(df, SPEC).first()["total_3"] == 2.0


def test_a_kept_state_goes_on_and_writes_touched_days_only(spark, tmp_path):
    rng, spec, path = random.Random(3), replace(SPEC, version="day"), f"file://{tmp_path}/state"
    rows, all_rows = [], []
    first = dt.date(2024, 1, 1)
    for i in range(120):
        day = first + dt.timedelta(days=rng.randrange(60))
        rows.append((i, rng.choice("ab"), day, float(rng.randrange(9)), dt.datetime(2024, 3, 1), "", ""))
    sizes = []
    late = (500, "a", first, 5.0, dt.datetime(2024, 3, 2), "", "")
    fresh = (501, "b", first + dt.timedelta(days=61), 2.0, dt.datetime(2024, 3, 3), "", "")
    for batch in (rows, [late, fresh, rows[0]], [late, (502, "c", first, 1.0, dt.datetime(2024, 3, 4), "", "")]):
        all_rows += batch
        state = trailing_state(spark.createDataFrame(batch, SCHEMA), spec, path)
        assert _got(report(state, spec)) == _brute(all_rows)
        sizes.append(sorted(p.name for p in tmp_path.glob("state/days/v=*/__day=*")))
    written = {v.name: len(list(v.glob("__day=*"))) for v in (tmp_path / "state" / "days").iterdir()}
    assert written["v=1"] >= 58  # the first batch, with all days
    assert written["v=2"] == 5 and written["v=3"] <= 6 and written["v=4"] == 1  # a correction, a new day and its gap, a new entity


def test_small_and_huge_amounts(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "a", d, 1e-9, None, "", ""), (2, "a", d, 0.3, None, "", ""), (3, "a", d + dt.timedelta(days=8), 1.0, None, "", "")]
    out = {r["date"]: r for r in trailing_totals(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert out[d]["total_3"] == pytest.approx(0.300000001, rel=1e-15) and out[d + dt.timedelta(days=4)]["total_3"] == 0.0
    with pytest.raises(Exception, match="1e20"):
        trailing_totals(spark.createDataFrame([(1, "a", d, 3e20, None, "", "")], SCHEMA), SPEC).collect()
