from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation
from quillon.llm import topn
from quillon.llm.topn import top_n

SCHEMA = "id long, g string, h string, score double, at int, rank int, tags array<string>"


def brute(rows: list[tuple], n: int) -> set[tuple]:
    best: dict = {}
    for i, g, h, s, *_ in rows:
        if s is not None and not math.isnan(s):
            best.setdefault((g, h), set()).add((-s, i is None, i or 0))
    return {(*k, p + 1, None if none else i) for k, v in best.items() for p, (_, none, i) in enumerate(sorted(v)[:n])}


def test_agrees_with_a_loop_on_ties_nulls_and_copies(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        row = (i, g, rng.choice(["x", None]), rng.choice([None, float("nan"), -1.0, 0.0, 5.0, float(rng.randrange(40))]), 1, 9, ["t"])
        rows += [row] * rng.choice([1, 1, 3])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = top_n(df, ["g", "h"], "score", "id", 3)
    assert out.columns == [*df.columns, "rank_"]
    got = [(r["g"], r["h"], r["rank_"], r["id"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3)


def test_copies_that_differ_keep_the_least_and_order_can_be_turned(spark):
    rows = [(1, "a", "x", 5.0, 3, 0, None), (1, "a", "x", 5.0, 2, 0, None), (None, "a", "x", 5.0, 1, 0, None), (2, "a", "x", 1.0, 1, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["id"], r["at"]) for r in top_n(df, ["g"], "score", "id", 2).orderBy("rank_").collect()] == [(1, 2), (None, 1)]
    assert top_n(df, ["g"], "score", "id", 1, ascending=True).first()["id"] == 2
    assert top_n(df.limit(0), ["g"], "score", "id", 1).count() == 0
    with pytest.raises(InvalidOperation):
        top_n(df, ["g"], "score", "id", 0)


def test_ranks_before_the_shuffle(spark, monkeypatch):
    """The written plan ranks on both sides of each of its two exchanges."""
    plans = []
    monkeypatch.setattr(topn.Workspace, "write", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    df = spark.range(10).select("id", F.lit("g").alias("g"), F.col("id").cast("double").alias("score"))
    assert top_n(df, ["g"], "score", "id", 2).count() == 2
    assert plans[0].count("WindowGroupLimit") == 4


def test_an_item_of_several_scores_takes_one_place(spark):
    rows = [(1, "a", "x", 9.0, 1, 0, None), (1, "a", "x", 8.0, 2, 0, None), (2, "a", "x", 7.0, 1, 0, None), (3, "a", "x", 6.0, 1, 0, None), (4, "b", None, 1.0, 1, 0, None), (1, None, "x", 2.0, 1, 0, None), (1, None, "x", 3.0, 1, 0, None)]
    df = spark.createDataFrame(rows * 2, SCHEMA).repartition(5)
    got = {(r["g"], r["rank_"], r["id"], r["score"]) for r in top_n(df, ["g", "h"], "score", "id", 2).collect()}
    assert got == {("a", 1, 1, 9.0), ("a", 2, 2, 7.0), ("b", 1, 4, 1.0), (None, 1, 1, 3.0)}
    low = {(r["g"], r["rank_"], r["id"], r["score"]) for r in top_n(df, ["g", "h"], "score", "id", 3, ascending=True).collect()}
    assert low == {("a", 1, 3, 6.0), ("a", 2, 2, 7.0), ("a", 3, 1, 8.0), ("b", 1, 4, 1.0), (None, 1, 1, 2.0)}
