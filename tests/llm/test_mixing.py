from __future__ import annotations

import random

import pytest

from quillon.llm import mixing as M
from quillon.llm.mixing import mix_sources, shares

DOCS = "doc long, source string, size int, quality double, mix string, copies int"
TARGETS = "mix string, source string, weight double, max_repeats int, size_factor double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        source = "big" if i % 3 == 0 else rng.choice(["mid", "mid", "mid", "small" if i % 50 == 0 else "mid", None])
        rows.append((i, source, rng.choice([1, 10, 50, 400, None, 0]), rng.choice([None, -1.0, 1.0, 5.0]), "clash", 1))
    rows += rows[:40]
    return spark.createDataFrame(rows, DOCS)


def test_budgets_epochs_and_caps(spark, docs):
    targets = spark.createDataFrame([("m", "big", 5.0, 1, 0.4), ("m", "small", 3.0, 4, 0.4), ("m", "mid", 2.0, 2, 0.4), ("m", "none", 1.0, 3, 0.4), ("n", "mid", 1.0, 2, 1.5), ("z", "mid", None, 2, 1.0), (None, "mid", 1.0, 1, 1.0)], TARGETS)
    mixed = mix_sources(docs, targets, "doc", "source", "size", "quality", seed=1)
    report = {(r["mix"], r["source"]): r for r in shares(mixed, docs, targets, "source", "size", "doc").collect()}
    assert set(report) == {("m", s) for s in ("big", "small", "mid", "none")} | {("n", "mid"), ("z", "mid")}
    seen = {(r["mix"], r["doc"]): r["copies"] for r in mixed.collect()}
    assert len(seen) == mixed.count() and min(seen.values()) >= 1
    held = {r["source"]: r["s"] for r in docs.dropDuplicates(["doc"]).where("size > 0").groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()}
    total = sum(held.values())
    for (mix, source), r in report.items():
        cap = {"big": 1, "small": 4, "mid": 2, "none": 3}[source]
        assert r["most_copies"] <= cap
        limit = held.get(source, 0) * cap
        budget = r["target_size"]
        if budget >= limit:
            assert r["reached_size"] == limit
        else:
            assert abs(r["reached_size"] - budget) <= 25, (mix, source)
    assert report["n", "mid"]["target_size"] == pytest.approx(1.5 * total, abs=0.01)
    assert report["z", "mid"]["reached_size"] == 0
    # Complete epochs first: copies of a source's documents differ by at most one.
    for mix in ("m", "n"):
        copies = [v for (m, d), v in seen.items() if m == mix and d in {r["doc"] for r in docs.where("source = 'mid'").select("doc").collect()}]
        assert max(copies) - min(copies) <= 1


def test_better_documents_are_drawn_more_often(spark, docs):
    targets = spark.createDataFrame([("m", "big", 1.0, 1, 0.08)], TARGETS)
    mixed = mix_sources(docs, targets, "doc", "source", "size", "quality", seed=3).join(docs.dropDuplicates(["doc"]).select("doc", "quality"), "doc")
    drawn = {r["quality"]: r["count"] for r in mixed.groupBy("quality").count().collect()}
    assert drawn[5.0] > 2 * drawn[1.0] > 0


def test_seeded_and_split_over_buckets_alike(spark, docs):
    targets = spark.createDataFrame([("m", "big", 1.0, 2, 0.1), ("m", "mid", 1.0, 2, 0.1)], TARGETS)
    a = mix_sources(docs, targets, "doc", "source", "size", "quality", seed=5)
    b = mix_sources(docs.repartition(9), targets, "doc", "source", "size", "quality", seed=5, buckets=16)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert mix_sources(docs.limit(0), targets, "doc", "source", "size").count() == 0
    assert mix_sources(docs, targets.limit(0), "doc", "source", "size").count() == 0


def test_a_source_of_extreme_qualities_is_cut_until_little_is_sorted(spark, monkeypatch):
    """The documents drawn are those of a sort of all keys, also where nearly all keys fall into one of the first ranges."""
    rng = random.Random(11)
    rows = [(i, rng.choice("abc"), rng.choice([1, 3, 20]), rng.choice([0.01, 1000.0]) if i % 9 else 0.01) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc long, source string, size int, quality double")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.5), ("m", "b", 1.0, 1, 0.5), ("m", "c", 9.0, 1, 0.5)], TARGETS)
    sorted_rows = []
    passed = M._passed

    def watched(drawn, plan, i, state, buckets):
        kept = state.keep

        def keep(df):
            out = kept(df)
            if "lo" in out.columns:
                sorted_rows.append(max(r["n"] or 0 for r in out.collect()))
            return out

        state.keep = keep
        return passed(drawn, plan, i, state, buckets)

    whole = sorted(map(tuple, mix_sources(df, targets, "doc", "source", "size", "quality", seed=2).collect()))
    monkeypatch.setattr(M, "BORDER_ROWS", 40)
    monkeypatch.setattr(M, "HELD_TARGETS", 0)  # the state as written tables
    monkeypatch.setattr(M, "_passed", watched)
    cut = sorted(map(tuple, mix_sources(df, targets, "doc", "source", "size", "quality", seed=2, buckets=32).collect()))
    assert cut == whole and max(sorted_rows) > 40 and sorted_rows[-1] <= 40
    assert {r[1] for r in cut} == {"a", "b", "c"}
