"""Null rules, ties and layouts of the operators on tiny frames."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillon.errors import ColumnNotFound, InvalidOperation, ShapeMismatch, TypeMismatch
from quillon.functions import scalar as S
from quillon.operators import aggregates as A
from quillon.operators import frame as P
from quillon.operators import joins as J
from quillon.operators import reshape as R
from quillon.operators import windows as W
from quillon.plans import lazy, verbs
from quillon.plans.sql import query
from quillon.errors import ParseError
from quillon.types import cast_column, num_to_text

c = F.col


def values(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 10, 5.0), (2, "Bob", 20, None), (3, "Cid", 30, 7.0), (4, "Dee", None, 7.0), (5, "Eve", 10, float("nan"))], "id int, name string, dept int, pay double")


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame([(10, "Ops"), (20, "Dev"), (40, "Law"), (10, "Ops2"), (None, "None")], "dept int, name string")


def test_division_and_modulo_never_raise(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (7.0, -2.0), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in df.select(S.fdiv(c("a"), c("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == -3.5 and math.isnan(got[5])
    rest = [r[0] for r in df.select(S.fmod(c("a"), c("b"))).collect()]
    assert math.isnan(rest[0]) and rest[3] is None and rest[4] == 1.0


def test_rounding_texts_and_slices(spark):
    df = spark.createDataFrame([(-2.5, "   ab ", "abcdef")], "x double, t string, s string")
    row = df.select(S.round_half_up(c("x")), S.trim(c("t")), S.text_slice(c("s"), -3, -1), S.text_slice(c("s"), 2), S.pad_start(c("s"), 3, "*"), S.pad_end(c("s"), 8, "*"), S.split(F.lit("a.b..c"), "."), S.extract(c("s"), "(c.)"), S.extract(c("s"), "(z)"), S.replace_all(F.lit("a.a"), ".", "-")).first()
    assert list(row) == [-2.0, "ab", "de", "cdef", "abcdef", "abcdef**", ["a", "b", "", "c"], "cd", None, "a-a"]
    with pytest.raises(TypeMismatch):
        S.extract(c("s"), "abc")


def test_date_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 14, 5, 6), dt.datetime(2024, 3, 30, 2, 5, 6))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(S.date_part(c("a"), "day_of_week"), S.date_part(c("a"), "week_number"), S.truncate(c("a"), "quarter"), S.diff_between(c("a"), c("b")), S.until(c("a"), c("b")), S.format_date(c("a"), "DD.MM.YYYY (HH:mm)")).first()
    assert list(row) == [0, 13, dt.datetime(2024, 1, 1), 1.5, -1.5, "31.03.2024 (14:05)"]


def test_casts_give_null_on_failure(spark):
    df = spark.createDataFrame([("12.7", 3.9, True), ("", float("nan"), None), ("x", None, False)], "t string, d double, b boolean")
    kind = {f.name: f.dataType for f in df.schema.fields}
    out = df.select(cast_column(c("t"), kind["t"], "f64"), cast_column(c("t"), kind["t"], "i32"), cast_column(c("d"), kind["d"], "i32"), cast_column(c("b"), kind["b"], "f64"), cast_column(c("t"), kind["t"], "bool"), cast_column(c("d"), kind["d"], "bool"))
    assert [tuple(r) for r in out.collect()] == [(12.7, 12, 3, 1.0, True, True), (0.0, 0, None, None, False, False), (None, None, None, 0.0, True, None)]
    numbers = spark.createDataFrame([(1.0,), (-0.5,), (1e20,), (None,)], "x double")
    assert [r[0] for r in numbers.select(num_to_text(c("x"), numbers.schema["x"].dataType)).collect()] == ["1", "-0.5", "100000000000000000000", None]


def test_join_layouts_and_null_keys(people, depts):
    inner = J.join(people, depts, "dept")
    assert inner.columns == ["dept", "id", "name", "pay", "name_right"]
    assert sorted(values(inner, "id", "name_right")) == [(1, "Ops"), (1, "Ops2"), (2, "Dev"), (5, "Ops"), (5, "Ops2")]
    assert sorted(r[0] for r in values(J.join(people, depts, "dept", "anti"), "id")) == [3, 4]
    assert sorted(r[0] for r in values(J.join(people, depts, "dept", "semi"), "id")) == [1, 2, 5]
    assert J.join(people, depts, "dept", "outer").count() == 5 + 2 + 2
    assert {r[0] for r in values(J.join(people, depts, "dept", "right"), "dept")} == {10, 20, 40, None}
    assert J.join(people, depts, how="cross").columns == ["id", "name", "dept", "pay", "dept_right", "name_right"]
    with pytest.raises(TypeMismatch):
        J.join(people, depts, {"left": "dept", "right": "name"})
    with pytest.raises(ColumnNotFound):
        J.join(people, depts, "nothing")
    with pytest.raises(ShapeMismatch):
        J.join(people, depts, {"left": ["dept"], "right": ["dept", "name"]})


def test_lookup_keeps_the_first_match_and_overwrites(people, depts):
    out = J.lookup(people, depts, "dept", order_by="name")
    assert out.columns == ["id", "name", "dept", "pay"]
    assert sorted(values(out, "id", "name"), key=lambda r: r[0]) == [(1, "Ops"), (2, "Dev"), (3, None), (4, None), (5, "Ops")]


def test_group_rules(spark):
    df = spark.createDataFrame([("East", 100.0, 1), ("East", None, 2), ("East", 200.0, 3), (None, None, 4), (None, 300.0, 5), ("West", None, 6)], "region string, amount double, i int")
    out = A.group_agg(df, "region", {"total": A.total("amount"), "mean": A.mean("amount"), "n": A.count("amount"), "first": A.first("amount", "i"), "last": A.last("amount", "i"), "all": A.collect("amount", "i"), "std": A.std("amount")})
    got = {r["region"]: tuple(r)[1:] for r in out.collect()}
    assert got["East"][:6] == (300.0, 150.0, 2, 100.0, 200.0, [100.0, 200.0])
    assert got[None] == (300.0, 300.0, 1, 300.0, 300.0, [300.0], None)
    assert got["West"] == (0.0, None, 0, None, None, [], None)
    assert A.group_agg(df.limit(0), [], {"n": F.count(F.lit(1))}).first()["n"] == 0
    with pytest.raises(InvalidOperation):
        A.group_agg(df, "region", {"amount": "first"})
    assert A.n_groups(df, ["region"]) == 3 and set(A.groups(df, ["region"])) == {("East",), (None,), ("West",)}


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (None, 1.0, 5.0)], "x double, y double, k double")
    row = df.agg(A.corr("x", "y"), A.corr("x", "k")).first()
    assert row[0] == pytest.approx(1.0) and row[1] is None


def test_window_rules(spark):
    df = spark.createDataFrame([(1, 100.0), (2, None), (3, 200.0), (4, 100.0)], "i int, x double")
    w = W.over(order="i")
    out = df.select("i", W.rank(w, "x").alias("r"), W.rank(w, "x", "desc").alias("rd"), W.cum_sum(w, "x").alias("cs"), W.cum_sum_keep_null(w, "x").alias("cn"), W.rolling_mean(w, "x", 2).alias("rm"), W.shift(w, "x").alias("s"), W.pct_change(w, "x").alias("p"), W.cum_prod(w, "x").alias("cp"))
    rows = {r["i"]: tuple(r)[1:] for r in out.collect()}
    assert rows[1] == (1, 3, 100.0, 100.0, None, None, None, 100.0)
    assert rows[2] == (4, 1, 100.0, None, 100.0, 100.0, None, 100.0)
    assert rows[3] == (3, 2, 300.0, 300.0, 200.0, None, None, 20000.0)
    ten = spark.range(10)
    assert [r[0] for r in ten.select(W.ntile(W.over(order="id"), 4)).collect()] == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4]
    with pytest.raises(InvalidOperation):
        W.cum_sum(W.over(), "x")


def test_ewm_carries_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, 20.0), ("b", 1, 3.0)], "k string, i int, x double")
    out = {(r["k"], r["i"]): r["ewm"] for r in W.ewm(df, "x", 0.5, keys=["k"], order_by="i").collect()}
    assert out == {("a", 1): None, ("a", 2): 10.0, ("a", 3): 10.0, ("a", 4): 15.0, ("b", 1): 3.0}


def test_positions_and_running_totals_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("one"))
    at = P.with_position(df, "k", "pos")
    assert at.where("k <> pos").count() == 0
    total = W.running_total(df, "one", "k", "sum")
    assert total.where("sum <> k + 1").count() == 0


def test_positions_of_millions_of_wide_rows(spark):
    """Adaptive execution may coalesce the two sides of a plan differently: no row may be lost, no position given twice."""
    n = 4_000_000
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 512).alias("k"), F.sha2((F.col("id") + 1).cast("string"), 512).alias("wide"), F.lit(1).alias("one"))
    placed = P.with_position(df, "k", "pos").agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(placed) == (n, n, 0, n - 1)
    total = W.running_total(df, "one", "k", "run").agg(F.count("*"), F.count_distinct("run"), F.min("run"), F.max("run")).first()
    assert tuple(total) == (n, n, 1, n)


def test_filling_a_whole_frame_in_many_partitions(spark):
    rows = [(i, None if i % 7 or i < 20 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int, __part int").repartition(6)
    seen = None
    want = {}
    for i, v, _ in rows:
        seen = seen if v is None else v
        want[i] = seen
    out = R.fill_forward(df, order_by="id", columns=["v"])
    assert out.columns == df.columns and {r["id"]: r["v"] for r in out.collect()} == want
    back, seen = {}, None
    for i, v, _ in reversed(rows):
        seen = seen if v is None else v
        back[i] = seen
    assert {r["id"]: r["v"] for r in R.fill_backward(df, order_by="id", columns=["v"]).collect()} == back


def test_explode_unroll_spread(spark):
    df = spark.createDataFrame([(1, ["a", None], [1]), (2, None, None), (3, [], [5, 6])], "i int, t array<string>, n array<int>")
    assert set(values(R.explode(df, "t"), "i", "t")) == {(1, None), (1, "a"), (2, None)}
    got = values(R.unroll(df, ["t", "n"], index="at"), "i", "t", "n", "at")
    assert set(got) == {(1, "a", 1, 0), (1, None, None, 1), (3, None, 5, 0), (3, None, 6, 1)}
    assert R.spread(df, "n").columns == ["i", "t", "n_0", "n_1"]
    assert R.explode(df, "i").count() == 3


def test_pivot_first_keeps_nulls_and_melt_inverts(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "x", 5.0, 2), ("a", None, 1.0, 3), ("b", "y", 2.0, 4)], "k string, h string, v double, i int")
    out = R.pivot(df, "k", "h", "v", "first", order="i")
    assert out.columns == ["k", "null", "x", "y"]
    assert sorted(values(out, "k", "null", "x", "y")) == [("a", 1.0, None, None), ("b", None, None, 2.0)]
    assert [r["x"] for r in R.pivot(df, "k", "h", "v", "count").orderBy("k").collect()] == [2, None]
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "id int, a double, b double")
    back = R.pivot(R.melt(wide, "id"), "id", "variable", "value", "first", order="variable")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_filling_and_imputing(spark):
    df = spark.createDataFrame([("N", "Q1", 10.0), ("N", "Q2", None), ("S", "Q1", 30.0)], "region string, quarter string, value double")
    out = R.impute(df, {"value": 0.0}, ["region", "quarter"], order_by="value")
    assert sorted(map(tuple, out.collect())) == [("N", "Q1", 10.0), ("N", "Q2", 0.0), ("S", "Q1", 30.0), ("S", "Q2", 0.0)]
    assert sorted(r["value"] for r in R.impute(df, {"value": F.avg("value")}).collect()) == [10.0, 20.0, 30.0]
    seq = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "i int, x int")
    assert [r["x"] for r in R.fill_forward(seq, order_by="i", columns=["x"]).orderBy("i").collect()] == [None, 5, 5, 7]
    assert [r["x"] for r in R.fill_backward(seq, order_by="i", columns=["x"]).orderBy("i").collect()] == [5, 5, 7, 7]


def test_sets_sorting_and_errors(spark, people):
    a = spark.createDataFrame([(1, "x"), (None, "x"), (1, "x")], "k int, t string")
    b = spark.createDataFrame([("x", None), ("y", 2)], "t string, k int")
    assert P.union(a, b).count() == 3 and P.intersection(a, b).collect()[0]["k"] is None and P.difference(a, b).count() == 1
    assert P.concat(a, b.select("k")).count() == 5
    with pytest.raises(TypeMismatch):
        P.concat(a, spark.createDataFrame([("1",)], "k string"))
    assert [r["dept"] for r in P.sort_by(people, ["dept", "id"], "desc").collect()] == [30, 20, 10, 10, None]
    assert [r["id"] for r in P.unique(people, ["dept"], "last", order_by="id").orderBy("id").collect()] == [2, 3, 4, 5]
    assert P.row(people, 1, "id")["name"] == "Bob" and P.sample(people, 2, seed=1).count() == 2 and P.sample(people, 0.1).count() == 1
    for bad in (lambda: P.drop(people, "zz"), lambda: P.rename(people, {"zz": "a"}), lambda: P.select(people, "zz")):
        with pytest.raises(ColumnNotFound):
            bad()
    other = spark.createDataFrame([("z", i) for i in range(5)], "name string, n int")
    both = P.assign(people, other, "id", "n")
    assert both.columns == ["id", "name", "dept", "pay", "n"] and {r["name"] for r in both.collect()} == {"z"}


def test_union_is_a_set_union_and_semi_anti_partition(spark, people, depts):
    assert J.join(people, depts, "dept", "semi").count() + J.join(people, depts, "dept", "anti").count() == people.count()


def test_sql_front_door(people):
    out = query(people, "select dept, COUNT(*), SUM(pay) AS s from this where name <> 'O''x' group by dept having count(*) > 1 order by dept limit 5")
    assert out.columns == ["dept", "count", "s"] and out.first()["count"] == 2
    assert [r["dept"] for r in query(people, "SELECT dept FROM this ORDER BY dept DESC").collect()] == [30, 20, 10, 10, None]
    assert query(people, "SELECT AVG(pay) FROM this WHERE pay < 6").columns == ["avg_pay"]
    for bad in ("", "UPDATE x", "SELECT a", "SELECT id FROM other", "SELECT id FROM this JOIN this", "SELECT FROM this WHERE"):
        with pytest.raises(ParseError):
            query(people, bad)
    with pytest.raises(ColumnNotFound):
        query(people, "SELECT nothing FROM this")


def test_verbs_and_lazy(spark, people):
    assert verbs.resolve(people, verbs.span("dept", "id"), verbs.without("pay")) == ["id", "name", "dept"]
    out = verbs.rollup(verbs.groupby(people, "dept"), n=verbs.op.count("pay"), spread=verbs.Reduce(lambda x: float(x.max() - x.min()), ("pay",)))
    assert {r["dept"]: r["n"] for r in out.collect()} == {10: 2, 20: 0, 30: 1, None: 1}
    assert "OPTIMIZED" in lazy.explain_text(people.where("id > 1"))
    assert lazy.group_agg(people, ["dept"], [("min", "pay"), ("max", "pay")]).columns == ["dept", "min_pay", "max_pay"]


def test_describe_counts_and_info(people):
    d = {r["statistic"]: r for r in A.describe(people.select("id", "name")).collect()}
    assert d["count"]["id"] == 5.0 and d["mean"]["id"] == 3.0
    assert people.agg(A.n_unique("dept")).first()[0] == 4
    assert A.value_counts(people, "dept").first()["value"] == 10
