"""One query per operator over the test tables, each beside its SQL.

Keys of the tables used where a total order is needed: ``orders.o_orderkey`` and ``events.event_id`` are unique. Nulls are made
with ``nullif``, since the tables have none. Float aggregates are rounded on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import aggregates as A
from quillon.operators import frame as P
from quillon.operators import joins as J
from quillon.operators import reshape as R
from quillon.operators import windows as W
from quillon.plans import lazy, sql, verbs
from quillon.session import Workspace
from quillon.sources import csvfile, frames
from quillon.streaming import files
from quillon.types import cast_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def case(text: str | None, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a query on tables, given to it as frames, with its SQL (None where SQL has no equivalent)."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

        QUERIES[fn.__name__] = query
        if text is not None:
            SQL[fn.__name__] = text
        return fn

    return register


c = F.col


# Filters and projections.


@case("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_extendedprice * (1 - l_discount)), 6) AS mean_revenue, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag", "lineitem")
def pricing_summary(li: DataFrame) -> DataFrame:
    revenue = c("l_extendedprice") * (1 - c("l_discount"))
    rows = li.where(c("l_quantity") > 10).withColumn("rev", revenue)
    out = A.group_agg(rows, "l_returnflag", {"revenue": F.round(A.total("rev"), 2), "mean_revenue": F.round(A.mean("rev"), 6), "n": F.count(F.lit(1))})
    return P.sort_by(out, "revenue", "desc")


@case("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.02 AND NOT (l_returnflag = 'N')", "lineitem")
def filter_expr(li: DataFrame) -> DataFrame:
    return P.select(li.where((c("l_quantity") >= 49) & (c("l_discount") < 0.02) & ~(c("l_returnflag") == "N")), "l_orderkey", "l_partkey", "l_quantity")


@case("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'", "orders")
def where_ops(o: DataFrame) -> DataFrame:
    return P.select(P.where(P.where(o, "o_totalprice", ">", 300000), "o_orderstatus", "!=", "F"), "o_orderkey", "o_totalprice")


@case("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 50000", "orders")
def filter_in_between(o: DataFrame) -> DataFrame:
    return o.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH") & c("o_totalprice").between(1000, 50000)).select("o_orderkey", "o_orderpriority")


@case(
    """SELECT event_id, (v > 10 AND t = 'click') AS both_kleene, (v > 10 OR t = 'click') AS either, CASE WHEN v IS NULL OR t IS NULL THEN NULL ELSE v > 10 AND t = 'click' END AS both_strict, v IS NULL AS no_value
    FROM (SELECT event_id, nullif(value, 0) AS v, nullif(event_type, 'view') AS t FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value, event_type FROM events)) WHERE v IS NULL OR v > 5""",
    "events",
)
def filter_null_logic(e: DataFrame) -> DataFrame:
    e = e.withColumn("v", F.when(c("event_id") % 7 != 0, F.nullif(c("value"), F.lit(0.0)))).withColumn("t", F.nullif(c("event_type"), F.lit("view")))
    big, click = c("v") > 10, c("t") == "click"
    e = e.where(c("v").isNull() | (c("v") > 5))
    return e.select("event_id", (big & click).alias("both_kleene"), (big | click).alias("either"), S.strict_and(big, click).alias("both_strict"), c("v").isNull().alias("no_value"))


@case("SELECT o_orderpriority AS priority, o_orderkey, o_custkey, o_totalprice AS price FROM orders", "orders")
def select_rename_drop_relocate(o: DataFrame) -> DataFrame:
    o = P.rename(P.drop(o, "o_orderdate", "o_orderstatus"), {"o_totalprice": "price", "o_orderpriority": "priority"})
    return P.relocate(o, ["priority"], before="o_orderkey")


@case("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_totalprice + 1 AS plus, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", "orders")
def with_columns_derive(o: DataFrame) -> DataFrame:
    band = F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low")
    o = P.select(o, "o_orderkey", "o_totalprice")
    return P.derive(o, {"o_totalprice": c("o_totalprice") * 2, "plus": c("o_totalprice") + 1, "band": band})


@case(
    """SELECT p_partkey, p_size::DOUBLE AS size_f, p_retailprice::INTEGER_TRUNC AS price_i, p_size::VARCHAR AS size_t, try_cast(substr(p_brand, 7) AS DOUBLE) AS brand_f, p_size <> 0 AS size_b, length(p_name) > 0 AS name_b FROM part""".replace(
        "p_retailprice::INTEGER_TRUNC", "trunc(p_retailprice)::INTEGER"
    ),
    "part",
)
def cast_matrix(p: DataFrame) -> DataFrame:
    kind = {f.name: f.dataType for f in p.schema.fields}
    brand = F.substring("p_brand", 7, 20)
    return p.select(
        "p_partkey",
        cast_column(c("p_size"), kind["p_size"], "f64").alias("size_f"),
        cast_column(c("p_retailprice"), kind["p_retailprice"], "i32").alias("price_i"),
        cast_column(c("p_size"), kind["p_size"], "utf8").alias("size_t"),
        F.when(brand != "", cast_column(brand, kind["p_brand"], "f64")).alias("brand_f"),
        cast_column(c("p_size"), kind["p_size"], "bool").alias("size_b"),
        cast_column(c("p_name"), kind["p_name"], "bool").alias("name_b"),
    )


@case(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN d = 0 THEN CASE WHEN q = 0 THEN 'NaN'::DOUBLE ELSE sign(q) * 'inf'::DOUBLE END ELSE q / d END AS ratio,
    CASE WHEN d = 0 THEN 'NaN'::DOUBLE ELSE q % d END AS rest, q - d AS less, q * d AS times, q + d AS plus, pow(q, 2.0::DOUBLE) AS squared
    FROM (SELECT *, l_quantity - 25 AS q, (l_linenumber % 3)::DOUBLE AS d FROM lineitem)""",
    "lineitem",
)
def arith_div_mod_zero(li: DataFrame) -> DataFrame:
    q, d = c("l_quantity") - 25, (c("l_linenumber") % 3).cast("double")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", S.fdiv(q, d).alias("ratio"), S.fmod(q, d).alias("rest"), S.sub(q, d).alias("less"), S.mul(q, d).alias("times"), S.add(q, d).alias("plus"), S.power(q, 2.0).alias("squared"))


@case("SELECT c_custkey, floor(c_acctbal + 0.5)::DOUBLE AS whole, floor(c_acctbal * 10 + 0.5) / 10 AS tenth, abs(c_acctbal) AS positive FROM customer", "customer")
def round_half_up(cu: DataFrame) -> DataFrame:
    return cu.select("c_custkey", S.round_half_up(c("c_acctbal")).alias("whole"), S.round_half_up(c("c_acctbal"), 1).alias("tenth"), F.abs("c_acctbal").alias("positive"))


# Text and dates.


@case(
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || '  ') AS bare, substr(p_name, 3, 5) AS cut, right(p_name, 3) AS last3, length(p_name) AS n FROM part""",
    "part",
)
def str_case_trim_slice(p: DataFrame) -> DataFrame:
    name = c("p_name")
    return p.select(
        "p_partkey", F.upper(name).alias("up"), F.lower("p_brand").alias("low"), S.trim(F.concat(F.lit("  "), name, F.lit("  "))).alias("bare"),
        S.text_slice(name, 2, 7).alias("cut"), S.text_slice(name, -3).alias("last3"), F.length(name).cast("bigint").alias("n"),
    )


@case(
    "SELECT p_partkey, contains(p_type, 'S') AS has_s, starts_with(p_brand, 'Brand') AS brand, ends_with(p_brand, '3') AS three, replace(p_name, 'a', '@') AS swapped FROM part",
    "part",
)
def str_contains_replace(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", c("p_type").contains("S").alias("has_s"), c("p_brand").startswith("Brand").alias("brand"), c("p_brand").endswith("3").alias("three"), S.replace_all(c("p_name"), "a", "@").alias("swapped"))


@case(
    """SELECT c_custkey, CASE WHEN length(k) < 8 THEN lpad(k, 8, '0') ELSE k END AS padded, CASE WHEN length(k) < 8 THEN rpad(k, 8, '.') ELSE k END AS dotted, len(string_split(c_name, '#')) AS parts,
    string_split(c_name, '#')[1] AS first_part, CASE WHEN regexp_matches(c_name, '([0-9]+)') THEN regexp_extract(c_name, '([0-9]+)', 1) END AS number FROM (SELECT *, c_custkey::VARCHAR AS k FROM customer)""",
    "customer",
)
def str_pad_split_extract(cu: DataFrame) -> DataFrame:
    k, parts = c("c_custkey").cast("string"), S.split(c("c_name"), "#")
    return cu.select(
        "c_custkey", S.pad_start(k, 8, "0").alias("padded"), S.pad_end(k, 8, ".").alias("dotted"), F.size(parts).cast("bigint").alias("parts"), F.get(parts, F.lit(0)).alias("first_part"),
        S.extract(c("c_name"), "([0-9]+)").alias("number"),
    )


@case("SELECT n_nationkey, CASE WHEN nullif(n_regionkey, 1) IS NULL THEN NULL ELSE n_name || '-' || n_regionkey::VARCHAR END AS label FROM nation", "nation")
def str_concat_null(n: DataFrame) -> DataFrame:
    key = F.nullif(c("n_regionkey"), F.lit(1)).cast("string")
    return n.select("n_nationkey", F.concat("n_name", F.lit("-"), key).alias("label"))


@case(
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, quarter(o_orderdate) AS q,
    dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS week, epoch_ms(o_orderdate) AS millis FROM orders""",
    "orders",
)
def date_parts(o: DataFrame) -> DataFrame:
    names = {"y": "year", "m": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "q": "quarter", "dow": "day_of_week", "doy": "day_of_year", "week": "week_number"}
    return o.select("o_orderkey", *[S.date_part(c("o_orderdate"), part).alias(n) for n, part in names.items()], S.epoch_millis(c("o_orderdate")).alias("millis"))


@case("SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events", "events")
def date_truncate(e: DataFrame) -> DataFrame:
    return e.select("event_id", S.truncate(c("ts"), "month").alias("month"), S.truncate(c("ts"), "hour").alias("hour"))


@case(
    """SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 86400000000.0::DOUBLE AS days, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 3600000000.0::DOUBLE AS hours,
    (epoch_us(TIMESTAMP '2024-01-01') - epoch_us(ts))::DOUBLE / 86400000000.0::DOUBLE / 30 AS months FROM events""",
    "events",
)
def date_diff(e: DataFrame) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return e.select("event_id", S.diff_between(c("ts"), start, "days").alias("days"), S.diff_between(c("ts"), start, "hours").alias("hours"), S.until(c("ts"), start, "month").alias("months"))


@case("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS shown FROM orders", "orders")
def date_format(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", S.format_date(c("o_orderdate"), "YYYY/MM/DD HH:mm:ss").alias("shown"))


# Aggregates.


@case(
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
    round(stddev_samp(l_extendedprice), 4) AS spread FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
def agg_basic(li: DataFrame) -> DataFrame:
    return A.group_agg(li, "l_returnflag", {
        "total": F.round(A.total("l_quantity"), 2), "mean": F.round(A.mean("l_quantity"), 6), "n": A.count("l_quantity"), "suppliers": A.count_distinct("l_suppkey"),
        "low": A.least("l_extendedprice"), "high": A.most("l_extendedprice"), "spread": F.round(A.std("l_extendedprice"), 4),
    })


@case("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL", "lineitem")
def agg_multi_key(li: DataFrame) -> DataFrame:
    return A.group_count(li, ["l_returnflag", "l_linestatus"])


@case("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders", "orders")
def agg_global(o: DataFrame) -> DataFrame:
    return A.group_agg(o, [], {"total": F.round(A.total("o_totalprice"), 2), "n": F.count(F.lit(1))})


@case("SELECT k, coalesce(round(sum(v), 2), 0) AS total FROM (SELECT nullif(event_type, 'view') AS k, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events) GROUP BY k", "events")
def agg_sum_allnull_zero(e: DataFrame) -> DataFrame:
    e = e.select(F.nullif(c("event_type"), F.lit("view")).alias("k"), F.when(c("event_type") != "click", c("value")).alias("v"))
    return A.group_agg(e, "k", {"total": F.round(A.total("v"), 2)})


@case(
    """SELECT user_id, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS first_v, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS last_v
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY user_id""",
    "events",
)
def agg_first_last(e: DataFrame) -> DataFrame:
    e = e.withColumn("v", F.when(c("event_id") % 3 != 0, c("value")))
    return A.group_agg(e, "user_id", {"first_v": A.first("v", "event_id"), "last_v": A.last("v", "event_id")})


@case("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id", "events")
def agg_list(e: DataFrame) -> DataFrame:
    return A.group_agg(e, "user_id", {"n": F.count(F.lit(1)), "types": F.array_join(A.collect("event_type", "event_id"), ",")})


@case("SELECT user_id, event_type AS usual FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1", "events")
def agg_mode(e: DataFrame) -> DataFrame:
    return A.group_agg(e, "user_id", {"usual": A.mode("event_type")})


@case(
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(NULL AS DOUBLE) AS constant FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
def agg_corr(li: DataFrame) -> DataFrame:
    return A.group_agg(li, "l_returnflag", {"r": F.round(A.corr("l_quantity", "l_extendedprice"), 6), "constant": A.corr("l_quantity", F.lit(1.0) * 1)})


@case("SELECT o_orderpriority, median(o_totalprice) AS middle FROM orders GROUP BY o_orderpriority", "orders")
def agg_median(o: DataFrame) -> DataFrame:
    return A.group_agg(o, "o_orderpriority", {"middle": A.median("o_totalprice")})


@case("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id", "events")
def group_first(e: DataFrame) -> DataFrame:
    return A.group_first(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").drop("event_id")


@case("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id", "events")
def group_last(e: DataFrame) -> DataFrame:
    return A.group_last(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").drop("event_id")


@case("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand", "part")
def value_counts(p: DataFrame) -> DataFrame:
    return A.value_counts(p, "p_brand")


@case("SELECT count(DISTINCT v) + max((v IS NULL)::INT) AS n FROM (SELECT nullif(p_size, 7) AS v FROM part)", "part")
def n_unique(p: DataFrame) -> DataFrame:
    return p.agg(A.n_unique(F.nullif(c("p_size"), F.lit(7))).alias("n"))


@case(
    """WITH s AS (SELECT count(p_size) AS n, avg(p_size) AS m, stddev_samp(p_size) AS d, min(p_size) AS lo, max(p_size) AS hi, count(p_retailprice) AS n2, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS d2, min(p_retailprice) AS lo2, max(p_retailprice) AS hi2 FROM part)
    SELECT 'count' AS statistic, n::DOUBLE AS p_size, n2::DOUBLE AS p_retailprice FROM s UNION ALL SELECT 'mean', round(m, 4), round(m2, 4) FROM s UNION ALL SELECT 'std', round(d, 4), round(d2, 4) FROM s
    UNION ALL SELECT 'min', lo::DOUBLE, lo2 FROM s UNION ALL SELECT 'max', hi::DOUBLE, hi2 FROM s""",
    "part",
)
def describe(p: DataFrame) -> DataFrame:
    d = A.describe(p.select("p_size", "p_retailprice", "p_name"))
    return d.select("statistic", F.round("p_size", 4).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


# Joins.

_C = "(SELECT c_custkey + 10 AS c_custkey, c_name FROM customer)"
_O = "(SELECT o_orderkey, nullif(o_custkey, 12) AS o_custkey FROM orders)"


def _customers(cu: DataFrame) -> DataFrame:
    """All customers, their keys shifted so that both sides have unmatched rows."""
    return cu.select((c("c_custkey") + 10).alias("c_custkey"), "c_name")


def _orders(o: DataFrame) -> DataFrame:
    """All orders, some with a null key."""
    return o.select("o_orderkey", F.nullif(c("o_custkey"), F.lit(12)).alias("o_custkey"))


_ON = {"left": "o_custkey", "right": "c_custkey"}


@case(f"SELECT o_custkey, o_orderkey, c_name FROM {_O} JOIN {_C} ON o_custkey = c_custkey", "orders", "customer")
def join_inner(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON)


@case(f"SELECT o_custkey, o_orderkey, c_name FROM {_O} LEFT JOIN {_C} ON o_custkey = c_custkey", "orders", "customer")
def join_left(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON, "left")


@case(f"SELECT c_custkey AS o_custkey, o_orderkey, c_name FROM {_O} RIGHT JOIN {_C} ON o_custkey = c_custkey", "orders", "customer")
def join_right(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON, "right")


@case(f"SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM {_O} FULL JOIN {_C} ON o_custkey = c_custkey", "orders", "customer")
def join_outer(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON, "outer")


@case("SELECT n.n_name, r.r_name, n.n_regionkey, r.r_regionkey FROM nation n CROSS JOIN region r", "nation", "region")
def join_cross(n: DataFrame, r: DataFrame) -> DataFrame:
    return J.join(n.select("n_name", "n_regionkey"), r, how="cross")


@case(f"SELECT o_orderkey, o_custkey FROM {_O} WHERE o_custkey IN (SELECT c_custkey FROM {_C})", "orders", "customer")
def join_semi(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON, "semi")


@case(f"SELECT o_orderkey, o_custkey FROM {_O} o WHERE NOT EXISTS (SELECT 1 FROM {_C} WHERE c_custkey = o.o_custkey)", "orders", "customer")
def join_anti(o: DataFrame, cu: DataFrame) -> DataFrame:
    return J.join(_orders(o), _customers(cu), _ON, "anti")


@case("SELECT a.n_regionkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation")
def join_suffix(n: DataFrame) -> DataFrame:
    return J.join(n.select("n_regionkey", "n_name"), n.select("n_regionkey", "n_name"), "n_regionkey")


@case(
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON o_custkey = c_custkey""",
    "customer", "orders",
)
def lookup_first(cu: DataFrame, o: DataFrame) -> DataFrame:
    return J.lookup(cu.select("c_custkey", "c_name"), o, {"left": "c_custkey", "right": "o_custkey"}, ["o_orderkey", "o_totalprice"], order_by="o_orderkey")


# Sets, sorting, limits.


@case("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_distinct(cu: DataFrame, s: DataFrame) -> DataFrame:
    return P.union(cu.select(c("c_nationkey").alias("k")), s.select(c("s_nationkey").alias("k")))


@case("SELECT nullif(c_nationkey, 3) AS k FROM customer INTERSECT SELECT nullif(s_nationkey, 3) FROM supplier", "customer", "supplier")
def intersection(cu: DataFrame, s: DataFrame) -> DataFrame:
    return P.intersection(cu.select(F.nullif("c_nationkey", F.lit(3)).alias("k")), s.select(F.nullif("s_nationkey", F.lit(3)).alias("k")))


@case("SELECT nullif(n_nationkey, 4) AS k FROM nation EXCEPT SELECT CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END FROM supplier", "nation", "supplier")
def difference(n: DataFrame, s: DataFrame) -> DataFrame:
    return P.difference(n.select(F.nullif(c("n_nationkey"), F.lit(4)).alias("k")), s.select(F.when(c("s_nationkey") % 3 > 0, c("s_nationkey")).alias("k")))


@case("SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region", "nation", "region")
def concat_missing_cols(n: DataFrame, r: DataFrame) -> DataFrame:
    return P.concat(n.select(c("n_nationkey").alias("k"), c("n_name").alias("name")), r.select(c("r_regionkey").alias("k"), c("r_name").alias("name"), F.lit("region").alias("extra")))


@case("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey", "orders")
def sort_nulls_last(o: DataFrame) -> DataFrame:
    o = o.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return P.sort_by(o, ["status", "o_orderkey"], ["desc"])


@case("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25", "orders")
def top_k(o: DataFrame) -> DataFrame:
    return P.top_k(P.select(o, "o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"])


@case("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7", "orders")
def head(o: DataFrame) -> DataFrame:
    return P.head(P.select(o, "o_orderkey", "o_custkey"), 7, order_by="o_orderkey")


@case("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "orders")
def tail(o: DataFrame) -> DataFrame:
    return P.tail(P.select(o, "o_orderkey", "o_custkey"), 7, order_by="o_orderkey")


@case("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 10", "orders")
def slice_rows(o: DataFrame) -> DataFrame:
    return P.slice_rows(P.select(o, "o_orderkey", "o_custkey"), 10, 25, order_by="o_orderkey")


@case("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", "orders")
def unique_first(o: DataFrame) -> DataFrame:
    return P.unique(P.select(o, "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], order_by="o_orderkey")


@case("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1", "orders")
def unique_last(o: DataFrame) -> DataFrame:
    return P.unique(P.select(o, "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "last", order_by="o_orderkey")


@case("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem")
def unique_rows(li: DataFrame) -> DataFrame:
    return P.unique(P.select(li, "l_returnflag", "l_linestatus"))


@case("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders", "orders")
def global_position(o: DataFrame) -> DataFrame:
    return P.with_position(P.select(o, "o_orderkey"), "o_orderkey", "pos")


@case("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n_row, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders", "orders")
def global_running_total(o: DataFrame) -> DataFrame:
    o = P.with_position(P.select(o, "o_orderkey", "o_totalprice"), "o_orderkey", "pos")
    out = W.running_total(o, "o_totalprice", "o_orderkey", "running")
    return out.select("o_orderkey", (c("pos") + 1).alias("n_row"), F.round("running", 2).alias("running"))


# Windows.


@case(
    """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_orderpriority ORDER BY d NULLS LAST, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY d DESC NULLS FIRST) AS r_desc
    FROM (SELECT *, nullif(month(o_orderdate), 3) AS d FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY d NULLS LAST)""",
    "orders",
)
def rank_family(o: DataFrame) -> DataFrame:
    o = o.withColumn("d", F.nullif(F.month("o_orderdate"), F.lit(3)))
    w = W.over("o_orderpriority", order="o_orderkey")
    return o.select("o_orderkey", W.rank(w, "d").alias("r"), W.dense_rank(w, "d").alias("dr"), W.row_number(w, "d").alias("rn"), W.rank(w, "d", "desc").alias("r_desc"))


@case("SELECT p_partkey, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS pr FROM part", "part")
def percent_rank(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", W.percent_rank(W.over("p_brand"), "p_size").alias("pr"))


@case("SELECT p_partkey, (floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1) * 4::DOUBLE / count(*) OVER (PARTITION BY p_brand)) + 1)::BIGINT AS tile FROM part", "part")
def ntile_floor(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", W.ntile(W.over("p_brand", order="p_partkey"), 4, "p_size").alias("tile"))


_EV = "(SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value * 100) / 100 END AS v FROM events)"
_BY_USER = W.over("user_id", order=("ts", "event_id"))


def _events(e: DataFrame) -> DataFrame:
    return e.withColumn("v", F.when(c("event_id") % 5 != 0, F.floor(c("value") * 100).cast("double") / 100))


@case(
    f"""SELECT event_id, round(coalesce(sum(v) OVER w, 0), 4) AS cs, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 4) END AS cs_null, max(v) OVER w AS cmax, min(v) OVER w AS cmin, count(v) OVER w AS cc
    FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "events",
)
def cum_family(e: DataFrame) -> DataFrame:
    w = _BY_USER
    return _events(e).select("event_id", F.round(W.cum_sum(w, "v"), 4).alias("cs"), F.round(W.cum_sum_keep_null(w, "v"), 4).alias("cs_null"), W.cum_max(w, "v").alias("cmax"), W.cum_min(w, "v").alias("cmin"), W.cum_count(w, "v").alias("cc"))


@case("SELECT event_id, round(coalesce(product(1 + (event_id % 3) / 10.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 1), 6) AS p FROM events", "events")
def cum_prod(e: DataFrame) -> DataFrame:
    e = e.withColumn("x", 1 + (c("event_id") % 3) / 10.0)
    return e.select("event_id", F.round(W.cum_prod(W.over("user_id", order="event_id"), "x"), 6).alias("p"))


@case(
    f"""SELECT event_id, lag(v, 2) OVER w AS back2, lead(v) OVER w AS next1, lag(event_type) OVER w AS type_before, round(v - lag(v) OVER w, 6) AS d1, CASE WHEN lag(v) OVER w <> 0 THEN round((v - lag(v) OVER w) / lag(v) OVER w, 6) END AS pct
    FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "events",
)
def shift_diff_pct(e: DataFrame) -> DataFrame:
    w = _BY_USER
    return _events(e).select("event_id", W.shift(w, "v", 2).alias("back2"), W.shift(w, "v", -1).alias("next1"), W.shift(w, "event_type").alias("type_before"), F.round(W.diff(w, "v"), 6).alias("d1"), F.round(W.pct_change(w, "v"), 6).alias("pct"))


@case(
    f"""SELECT event_id, CASE WHEN n >= 4 THEN round(avg(v) OVER f, 5) END AS rmean, CASE WHEN n >= 4 THEN round(coalesce(sum(v) OVER f, 0), 4) END AS rsum, CASE WHEN n >= 4 THEN round(stddev_samp(v) OVER f, 4) END AS rstd,
    CASE WHEN n >= 4 THEN min(v) OVER f END AS rmin, CASE WHEN n >= 4 THEN max(v) OVER f END AS rmax
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_EV}) WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING)""",
    "events",
)
def rolling_family(e: DataFrame) -> DataFrame:
    w = _BY_USER
    return _events(e).select(
        "event_id", F.round(W.rolling_mean(w, "v", 4), 5).alias("rmean"), F.round(W.rolling_sum(w, "v", 4), 4).alias("rsum"), F.round(W.rolling_std(w, "v", 4), 4).alias("rstd"),
        W.rolling_min(w, "v", 4).alias("rmin"), W.rolling_max(w, "v", 4).alias("rmax"),
    )


@case(
    """WITH RECURSIVE s AS (SELECT event_id, user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT event_id, user_id, n, v AS e FROM s WHERE n = 1 UNION ALL SELECT s.event_id, s.user_id, s.n, 0.3::DOUBLE * s.v + 0.7::DOUBLE * r.e FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
    SELECT event_id, round(e, 6) AS e FROM r""",
    "events",
)
def ewm(e: DataFrame) -> DataFrame:
    return W.ewm(e.select("event_id", "user_id", "value"), "value", 0.3, keys=["user_id"], order_by="event_id").select("event_id", F.round("ewm", 6).alias("e"))


# Reshaping and filling.


@case(
    """SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) END AS "F",
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) END AS "O",
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) END AS "P" FROM orders GROUP BY o_orderpriority""",
    "orders",
)
def pivot_sum(o: DataFrame) -> DataFrame:
    out = R.pivot(o, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", headers=["F", "O", "P"])
    return out.select("o_orderpriority", *[F.round(x, 2).alias(x) for x in "FOP"])


@case(
    """SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linenumber = 1), 0) AS "1", nullif(count(*) FILTER (WHERE l_linenumber = 2), 0) AS "2", nullif(count(*) FILTER (WHERE l_linenumber = 3), 0) AS "3",
    nullif(count(*) FILTER (WHERE l_linenumber = 4), 0) AS "4", nullif(count(*) FILTER (WHERE l_linenumber = 5), 0) AS "5", nullif(count(*) FILTER (WHERE l_linenumber = 6), 0) AS "6", nullif(count(*) FILTER (WHERE l_linenumber = 7), 0) AS "7"
    FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
def pivot_count(li: DataFrame) -> DataFrame:
    return R.pivot(li, "l_returnflag", "l_linenumber", "l_quantity", "count")


@case("SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'double_price', p_retailprice * 2 FROM part", "part")
def melt(p: DataFrame) -> DataFrame:
    return R.melt(p.select("p_partkey", "p_retailprice", (c("p_retailprice") * 2).alias("double_price")), "p_partkey")


@case("SELECT s_suppkey, s_name, 's_nationkey' AS key, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, s_name, 's_acctbal', s_acctbal FROM supplier", "supplier")
def fold(s: DataFrame) -> DataFrame:
    return verbs.fold(s.withColumn("s_nationkey", c("s_nationkey").cast("double")), ["s_nationkey", "s_acctbal"])


@case(
    """SELECT event_id, unnest(string_split(replace(replace(props, '{', ''), '}', ''), ':')) AS part FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0 AND event_id % 8 <> 0""",
    "events",
)
def explode(e: DataFrame) -> DataFrame:
    parts = S.split(S.replace_all(S.replace_all(c("props"), "{", ""), "}", ""), ":")
    made = F.when(c("event_id") % 4 != 0, parts).when(c("event_id") % 8 == 0, F.array().cast("array<string>"))
    return R.explode(e.select("event_id", made.alias("part")), "part")


@case(
    """SELECT user_id, event_id, i - 1 AS idx, list_extract([value, value * 2], i) AS a, list_extract([event_type], i) AS b FROM events, (SELECT unnest([1, 2]) AS i) WHERE event_id % 3 = 0""".replace("i - 1 AS idx", "(i - 1)::BIGINT AS idx"),
    "events",
)
def unroll_index(e: DataFrame) -> DataFrame:
    a = F.when(c("event_id") % 3 == 0, F.array(c("value"), c("value") * 2))
    b = F.when(c("event_id") % 3 == 0, F.array("event_type"))
    return R.unroll(e.select("user_id", "event_id", a.alias("a"), b.alias("b")), ["a", "b"], index="idx")


@case("SELECT vec_id, label, embedding[1] AS embedding_0, embedding[2] AS embedding_1, embedding[3] AS embedding_2 FROM embeddings", "embeddings")
def spread_array(v: DataFrame) -> DataFrame:
    return R.spread(v, "embedding", limit=3)


@case(
    """SELECT 'r_regionkey' AS "column", max(r_regionkey) FILTER (WHERE r_name = 'AFRICA') AS "AFRICA", max(r_regionkey) FILTER (WHERE r_name = 'AMERICA') AS "AMERICA", max(r_regionkey) FILTER (WHERE r_name = 'ASIA') AS "ASIA",
    max(r_regionkey) FILTER (WHERE r_name = 'EUROPE') AS "EUROPE", max(r_regionkey) FILTER (WHERE r_name = 'MIDDLE EAST') AS "MIDDLE EAST" FROM region""",
    "region",
)
def transpose_small(r: DataFrame) -> DataFrame:
    return R.transpose(r, "r_name")


@case("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, -1) AS v FROM events", "events")
def fill_value(e: DataFrame) -> DataFrame:
    return R.fill_null(e.select("event_id", F.when(c("event_id") % 5 != 0, c("value")).alias("v")), {"v": -1.0})


@case(f"SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_EV}", "events")
def fill_forward(e: DataFrame) -> DataFrame:
    return R.fill_forward(_events(e).select("event_id", "user_id", "v"), order_by="event_id", keys=["user_id"], columns=["v"])


@case(f"SELECT event_id, user_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_EV}", "events")
def fill_backward(e: DataFrame) -> DataFrame:
    return R.fill_backward(_events(e).select("event_id", "user_id", "v"), order_by="event_id", keys=["user_id"], columns=["v"])


@case(
    """WITH rows AS (
        SELECT l_returnflag, CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN NULL ELSE l_linenumber END AS l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_quantity END AS q FROM lineitem
    ),
    last AS (SELECT l_returnflag, l_linenumber, CASE WHEN bool_or(q IS NULL) THEN NULL ELSE max(q) END AS q FROM rows GROUP BY ALL),
    grid AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM last) CROSS JOIN (SELECT DISTINCT l_linenumber FROM last))
    SELECT g.l_returnflag, g.l_linenumber, coalesce(q, 0) AS q FROM grid g LEFT JOIN last l ON l.l_returnflag IS NOT DISTINCT FROM g.l_returnflag AND l.l_linenumber IS NOT DISTINCT FROM g.l_linenumber""",
    "lineitem",
)
def impute_expand(li: DataFrame) -> DataFrame:
    # Gaps by value: no row is left out, but one combination of keys has moved to a null key and the quantities of another are null.
    flag, number = c("l_returnflag"), c("l_linenumber")
    moved = F.when(~((flag == "A") & (number == 7)), number).alias("l_linenumber")
    rows = li.select(flag, moved, F.when(~((flag == "R") & (number == 1)), c("l_quantity")).alias("q"))
    return R.impute(rows, {"q": 0.0}, ["l_returnflag", "l_linenumber"], order_by="q")


@case(f"SELECT event_id, v FROM {_EV} WHERE v IS NOT NULL", "events")
def drop_null(e: DataFrame) -> DataFrame:
    return P.drop_null(_events(e).select("event_id", "v"), ["v"])


# SQL, verbs, lazy surface, functions of rows and groups.


@case("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, count(*) AS count FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 1000 OR o_custkey = 1) GROUP BY o_orderpriority HAVING count(*) > 10", "orders")
def sql_where_group_having(o: DataFrame) -> DataFrame:
    out = sql.query(o, "SELECT o_orderpriority, SUM(o_totalprice) AS s, COUNT(*) FROM this WHERE o_orderstatus = 'O' AND (o_totalprice > 1000 OR o_custkey = 1) GROUP BY o_orderpriority HAVING COUNT(*) > 10 ORDER BY s DESC LIMIT 100")
    return out.withColumn("s", F.round("s", 2))


@case("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%H' AND o_orderstatus NOT IN ('F', 'P') AND o_custkey IS NOT NULL", "orders")
def sql_like_in_null(o: DataFrame) -> DataFrame:
    return sql.query(o, "SELECT o_orderkey, o_orderpriority FROM this WHERE o_orderpriority LIKE '%H' AND o_orderstatus NOT IN ('F', 'P') AND o_custkey IS NOT NULL")


@case("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, max(l_tax) AS high, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag", "lineitem")
def rollup_compat(li: DataFrame) -> DataFrame:
    out = verbs.rollup(verbs.groupby(li, "l_returnflag"), total=verbs.op.sum("l_quantity"), high=verbs.op.max("l_tax"), lines=verbs.op.distinct("l_linenumber"))
    return out.withColumn("total", F.round("total", 2))


@case("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name", "nation")
def orderby_compat(n: DataFrame) -> DataFrame:
    return verbs.orderby(verbs.select(n, verbs.without("n_nationkey")), verbs.desc("n_regionkey"), "n_name")


@case("SELECT user_id, round(max(value) - min(value), 6) AS span FROM events GROUP BY user_id", "events")
def group_apply(e: DataFrame) -> DataFrame:
    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "span": [round(pdf["value"].max() - pdf["value"].min(), 6)]})

    return A.group_apply(e.select("user_id", "value"), ["user_id"], span, "user_id bigint, span double")


@case("SELECT event_id, upper(event_type) AS shout FROM events WHERE length(event_type) > 4", "events")
def row_udf(e: DataFrame) -> DataFrame:
    few = P.row_filter(e.select("event_id", "event_type"), lambda r: len(r["event_type"]) > 4)
    return P.row_column(few, "shout", lambda r: r["event_type"].upper(), "string").drop("event_type")


@case("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_o_totalprice, count(o_custkey) AS count_o_custkey FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", "orders")
def lazy_group(o: DataFrame) -> DataFrame:
    out = lazy.group_agg(o.where(c("o_totalprice") > 1000), ["o_orderstatus"], [("mean", "o_totalprice"), ("count", "o_custkey")])
    return out.withColumn("mean_o_totalprice", F.round("mean_o_totalprice", 4))


@case(None, "orders")
def sample_n(o: DataFrame) -> DataFrame:
    return P.sample(o, 100, seed=3)


def range_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.range_frame(spark, "x", 0, 10, 3).withColumn("kind", F.lit("range"))
    return a.unionByName(frames.linspace(spark, "x", 0, 1, 5).withColumn("kind", F.lit("linspace")))


QUERIES["range_linspace"] = range_linspace
SQL["range_linspace"] = "SELECT (i * 3)::DOUBLE AS x, 'range' AS kind FROM range(4) t(i) UNION ALL SELECT i / 4.0::DOUBLE, 'linspace' FROM range(5) t(i)"


@case("SELECT column_name AS \"column\", 5::BIGINT AS non_null, 0::BIGINT AS nulls FROM (VALUES ('r_regionkey'), ('r_name')) t(column_name)", "region")
def info(r: DataFrame) -> DataFrame:
    return frames.info(r).drop("dtype")


# Files: written to the shared folder and read again.


@case("SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def csv_roundtrip(n: DataFrame) -> DataFrame:
    path = Workspace(n.sparkSession, "csv").path
    csvfile.write_csv(n, path, delimiter=";")
    return csvfile.read_csv(n.sparkSession, path)


@case("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", "nation")
def json_roundtrip(n: DataFrame) -> DataFrame:
    path = Workspace(n.sparkSession, "json").path
    frames.write_ndjson(n, path)
    return frames.read_ndjson(n.sparkSession, path)


@case("SELECT n_name, n_regionkey FROM nation", "nation")
def parquet_roundtrip(n: DataFrame) -> DataFrame:
    path = Workspace(n.sparkSession, "parquet").path
    frames.write_parquet(n, path, compression="zstd")
    return frames.read_parquet(n.sparkSession, path, ["n_name", "n_regionkey"])


@case("SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def arrow_roundtrip(n: DataFrame) -> DataFrame:
    return frames.from_arrow_ipc(n.sparkSession, frames.to_arrow_ipc(n))


@case(
    """SELECT (r_regionkey // 2)::BIGINT AS batch, 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES' || chr(10) || string_agg('(' || r_regionkey || ', ''' || r_name || ''')', ',' || chr(10) ORDER BY r_regionkey) || ';' AS value FROM region GROUP BY 1""",
    "region",
)
def sql_insert_text(r: DataFrame) -> DataFrame:
    return frames.sql_inserts(r, "region", 2, order_by="r_regionkey")


# Sessions and streams.


@case(
    """SELECT event_id, user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session
    FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "events",
)
def sessionize(e: DataFrame) -> DataFrame:
    return files.sessions(e.select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"]).drop("ts")


@case("SELECT event_id, user_id, event_type, value FROM events WHERE value > 50", "events")
def stream_chunks(e: DataFrame) -> DataFrame:
    spark, path = e.sparkSession, Workspace(e.sparkSession, "stream").path
    e.select("event_id", "user_id", "event_type", "value").write.option("header", "true").csv(f"{path}/in")
    stream = files.stream_csv(spark, f"{path}/in", "event_id bigint, user_id bigint, event_type string, value double")
    files.sink_files(stream.where("value > 50"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, value double").parquet(f"{path}/out")


def names_in_sql(text: str) -> set[str]:
    """The tables a statement reads; for tests."""
    return set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text))
