from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest

from quillon.errors import InvalidOperation
from quillon.llm import percentiles as M
from quillon.llm.percentiles import merge, percentiles, summaries

SCHEMA = "b string, d string, samples array<double>, gid int, n int"


def nearest(values: list[float], p: float) -> float:
    values = sorted(values)
    return values[max(1, math.ceil(Decimal(str(p)) * len(values))) - 1]


def data(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        b = "hot" if i % 3 == 0 else rng.choice(["x", "y", None])
        length = rng.choice([0, 1, 5, 30, 1500 if i % 40 == 0 else 2])
        values = [rng.choice([None, float("nan"), float("inf"), float("-inf"), -0.0, 7.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(length)]
        rows.append((b, rng.choice(["d1", "d2", None]), None if i % 29 == 0 else values, 1, 1))
    return rows


def groups(rows: list[tuple], by: tuple[int, ...]) -> dict:
    out: dict = {}
    for r in rows:
        for v in r[2] or []:
            if v is not None and not math.isnan(v):
                out.setdefault(tuple(r[i] for i in by), []).append(v)
    return out


def test_exact_for_every_group_of_every_grouping(spark):
    rows, ps = data(), [0.0, 0.5, 0.95]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = percentiles(df, [["b"], ["b", "d"]], "samples", ps).collect()
    want = {(0, b, None, p): (len(v), nearest(v, p)) for (b,), v in groups(rows, (0,)).items() for p in ps}
    want |= {(1, b, d, p): (len(v), nearest(v, p)) for (b, d), v in groups(rows, (0, 1)).items() for p in ps}
    assert {(r["grouping"], r["b"], r["d"], r["p"]): (r["n"], r["value"]) for r in found} == want


def test_all_equal_values_and_empty_input(spark):
    df = spark.createDataFrame([("a", "d", [4.0] * 500, 1, 1)] * 8, SCHEMA)
    assert [(r["n"], r["value"]) for r in percentiles(df, [["b"]], "samples", [0.5]).collect()] == [(4000, 4.0)]
    assert percentiles(df.limit(0), [["b"]], "samples", [0.5]).count() == 0
    with pytest.raises(InvalidOperation):
        percentiles(df, [["b"]], "samples", [1.5])


def test_merged_summaries_keep_the_rank_error(spark):
    rng = random.Random(9)
    rows = [("a", f"d{i % 6}", [rng.expovariate(1 + i % 6) for _ in range(20)], 1, 1) for i in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    points = 20
    days = summaries(df, ["b", "d"], "samples", points)
    assert days.groupBy("d").sum("weight").first()[1] == 80
    values = sorted(v for r in rows for v in r[2])
    for r in merge(days, ["b"], [0.5, 0.95]).collect():
        assert r["n"] == len(values)
        rank = sum(v <= r["value"] for v in values)
        assert abs(rank - r["p"] * len(values)) <= len(values) / points + 1


def test_ends_where_both_infinities_meet(spark):
    up, down = float("inf"), float("-inf")
    rows = [("a", "d", [down, up], 1, 1), ("a", "d", [up, down], 1, 1), ("b", "d", [down, 0.0, up], 1, 1), ("c", "d", [up] * 3, 1, 1)]
    found = percentiles(spark.createDataFrame(rows, SCHEMA), [["b"]], "samples", [0.0, 0.5, 0.75, 1.0]).collect()
    want = {b: sorted(v for r in rows if r[0] == b for v in r[2]) for b in "abc"}
    assert {(r["b"], r["p"]): r["value"] for r in found} == {(b, p): nearest(v, p) for b, v in want.items() for p in (0.0, 0.5, 0.75, 1.0)}


def test_blocks_of_targets_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TARGETS", 7)
    rng = random.Random(5)
    rows = [(f"g{i % 11}", None, [rng.gauss(0, 1) for _ in range(20_000 if i == 0 else 40)], 1, 1) for i in range(33)]
    found = percentiles(spark.createDataFrame(rows, SCHEMA).repartition(4), [["b"]], "samples", [0.5, 0.95]).collect()
    want = {b: v for (b,), v in groups(rows, (0,)).items()}
    assert {(r["b"], r["p"]): (r["n"], r["value"]) for r in found} == {(b, p): (len(v), nearest(v, p)) for b, v in want.items() for p in (0.5, 0.95)}


def test_counts_folded_within_a_task_are_the_counts(monkeypatch):
    monkeypatch.setattr(M, "FOLD_ROWS", 3)
    rng = np.random.default_rng(1)
    held, n_all, eq_all = M._Held(), np.zeros((4, M.PIVOTS + 1), int), np.zeros((4, M.PIVOTS), int)
    for _ in range(20):
        key = rng.integers(0, 4, 6)
        n, eq = rng.integers(0, 9, (6, M.PIVOTS + 1)), rng.integers(0, 3, (6, M.PIVOTS))
        proposals = np.where(n[:, :, None] > 0, rng.normal(size=(6, M.PIVOTS + 1, M.PIVOTS)), np.nan)
        held.add(key, n, eq, proposals)
        np.add.at(n_all, key, n)
        np.add.at(eq_all, key, eq)
    key, n, eq, proposals = held.fold()
    assert len(key) == 4 and (n == n_all).all() and (eq == eq_all).all()
    assert (np.isnan(proposals).all(axis=2) == (n == 0)).all()


def test_a_partition_without_values_in_play_gives_no_rows(spark):
    rows = [("a", None, [float(1000 * part + i) for i in range(100)], 1, 1) for part in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(4, "samples")
    found = percentiles(df, [["b"]], "samples", [0.1, 0.2]).collect()
    assert {r["p"]: (r["n"], r["value"]) for r in found} == {0.1: (400, 39.0), 0.2: (400, 79.0)}
