"""The core's queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import malformed, nested, trailing

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REGION_DAYS = trailing.Trailing(("region",), "date", "amount", spans=(7, 30), row_id="sale_id", arrived="loaded_at")
QUOTED = malformed.RecordSchema((("name", "string"), ("description", "string"), ("value", "int")), ",")
EUROPEAN = malformed.RecordSchema((("name", "string"), ("price", "int"), ("quantity", "int"), ("active", "boolean")), ";")
TIERS = nested.ListLayout("tiers", ("tiers",), {"min_qty": "int", "price": "double"})
CHOICES = nested.ListLayout("choices", ("choices",), {"sku": "string", "surcharge": "double"}, (TIERS,))
ITEMS = nested.ListLayout("items", ("results", "items"), {"id": "double", "product": "string", "price": "double"}, (CHOICES,))
PAGE = nested.RecordLayout({"page": (("meta", "page"), "int")}, (ITEMS,), positions={"items": "item", "choices": "choice", "tiers": "tier"})


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sales").select("sale_id", "region", "date", "amount", "loaded_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = trailing.trailing_state(_sales(spark, sf_dir), REGION_DAYS)
    totals = state.select(F.col("__e0").alias("region"), F.date_format("__day", "yyyy-MM-dd").alias("sale_day"), "t7_amt", "t30_amt")
    # Exact decimals: 0.55 = 11 / 20.
    return totals.where("t7_amt > 0 AND t7_amt * 20 > t30_amt * 11").select("region", "sale_day")


def p3_trailing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trailing.trailing_totals(_sales(spark, sf_dir), REGION_DAYS)
    return out.select("region", F.col("date").alias("day"), "count_7", "count_30", "total_7", "avg_7", "total_30", "avg_30")


def _classified(spark: SparkSession, sf_dir: str, name: str, schema: malformed.RecordSchema) -> DataFrame:
    return malformed.classify(table(spark, sf_dir, name), schema)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        malformed.failed_rows(_classified(spark, sf_dir, name, schema)).select(F.lit(name).alias("src"), "line_id", "reason")
        for name, schema in (("quoted", QUOTED), ("european", EUROPEAN))
    ]
    return parts[0].unionByName(parts[1])


def p4_quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.valid_rows(_classified(spark, sf_dir, "quoted", QUOTED), QUOTED)


def p4_european_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.valid_rows(_classified(spark, sf_dir, "european", EUROPEAN), EUROPEAN)


def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records of both tables with the first broken field."""
    parts = [
        malformed.failed_rows(_classified(spark, sf_dir, name, schema)).select(F.lit(name).alias("src"), "line_id", "reason", "broken_field", "raw_line")
        for name, schema in (("quoted", QUOTED), ("european", EUROPEAN))
    ]
    return parts[0].unionByName(parts[1])


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = nested.from_structs(table(spark, sf_dir, "nested_pages"), "nested_id", "meta", "results")
    bodies = table(spark, sf_dir, "nested_bodies").select("nested_id", "body")
    return nested.triples(pages.unionByName(bodies), PAGE, "nested_id", "body")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.row_positions(_nested(spark, sf_dir))
    at = [F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).alias(n) for i, n in enumerate(("item_pos", "choice_pos", "tier_pos"))]
    return rows.select(F.col("record_id").alias("nested_id"), *at)


def _nested_table(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.tables(_nested(spark, sf_dir), PAGE, "nested_id")[name]

    return query


def queries() -> dict[str, Query]:
    named = [p3_found, p3_trailing_totals, p4_found, p4_quoted_rows, p4_european_rows, p4_rejects, p5_found]
    return {f.__name__: f for f in named} | {f"p5_{n}": _nested_table(n) for n in ("records", "items", "choices", "tiers")}


_DAYS = """
    arrived AS (
        SELECT * FROM sales WHERE region IS NOT NULL AND date IS NOT NULL AND amount IS NOT NULL AND NOT isnan(amount)
        QUALIFY row_number() OVER (PARTITION BY sale_id) = 1
    ),
    daily AS (SELECT region, date, sum(amount::DECIMAL(38,8)) AS s, count(*) AS n FROM arrived GROUP BY region, date),
    calendar AS (
        SELECT region, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY region
    ),
    filled AS (SELECT c.region, c.day, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM calendar c LEFT JOIN daily d ON d.region = c.region AND d.date = c.day),
    totals AS (
        SELECT region, day, sum(s) OVER w7 AS t7, sum(n) OVER w7 AS n7, sum(s) OVER w30 AS t30, sum(n) OVER w30 AS n30 FROM filled
        WINDOW w7 AS (PARTITION BY region ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY region ORDER BY day ROWS 29 PRECEDING)
    )
"""

_TOKENS = "'', 'null', 'NULL', 'NA', 'N/A', 'NaN', 'nan', 'None', 'none'"


def _parsed_sql(src: str, sep: str, n: int) -> str:
    """CTEs that classify the records of a table by plain patterns and typed casts."""
    field = f"(?:\"(?:[^\"]|\"\")*\"|[^\"{sep}]*)"
    row = f"^{field}(?:{sep}{field}){{{n - 1}}}$"
    groups = f"^({field})" + f"{sep}({field})" * (n - 1) + "$"
    unquoted = [
        f"CASE WHEN starts_with(regexp_extract(line, '{groups}', {i}), '\"') THEN replace(regexp_extract(line, '{groups}', {i})[2:-2], '\"\"', '\"') ELSE regexp_extract(line, '{groups}', {i}) END AS f{i}"
        for i in range(1, n + 1)
    ]
    return f"""
    {src}_lines AS (SELECT * EXCLUDE (raw_line), raw_line, regexp_replace(raw_line, '\\r?\\n$', '') AS line FROM {src}),
    {src}_fields AS (
        SELECT *, regexp_matches(line, '^{field}(?:{sep}{field})*$') AS well_quoted, regexp_matches(line, '{row}') AS right_columns, {', '.join(unquoted)}
        FROM {src}_lines WHERE regexp_matches(line, '[^\\s]')
    )"""


def _bad_int(f: str) -> str:
    digits = f"trim({f}, ' ')"
    return f"({f} NOT IN ({_TOKENS}) AND (NOT regexp_matches({digits}, '^[+-]?[0-9]+$') OR try_cast({digits} AS INTEGER) IS NULL))"


def _bad_bool(f: str) -> str:
    return f"({f} NOT IN ({_TOKENS}) AND lower({f}) NOT IN ('true', 'false'))"


def _reason(bad: str) -> str:
    return f"CASE WHEN NOT well_quoted THEN 'quoting' WHEN NOT right_columns THEN 'columns' WHEN {bad} THEN 'value' END"


_QUOTED_BAD = _bad_int("f3")
_EUROPEAN_BAD = " OR ".join((_bad_int("f2"), _bad_int("f3"), _bad_bool("f4")))


def _loaded(f: str, kind: str, name: str) -> str:
    value = f"CASE WHEN {f} NOT IN ({_TOKENS}) THEN {f} END"
    return f"{value} AS {name}" if kind == "string" else f"try_cast(trim({value}, ' ') AS {kind}) AS {name}"


def oracle_sql() -> dict[str, str]:
    quoted, european = _parsed_sql("quoted", ",", 3), _parsed_sql("european", ";", 4)
    return {
        "p3_found": f"WITH {_DAYS} SELECT region, strftime(day, '%Y-%m-%d') AS sale_day FROM totals WHERE t7 > 0 AND t7 * 20 > t30 * 11",
        "p3_trailing_totals": f"""WITH {_DAYS} SELECT region, day, n7::BIGINT AS count_7, n30::BIGINT AS count_30, t7::DOUBLE AS total_7,
            CASE WHEN n7 > 0 THEN t7::DOUBLE / n7 END AS avg_7, t30::DOUBLE AS total_30, CASE WHEN n30 > 0 THEN t30::DOUBLE / n30 END AS avg_30 FROM totals""",
        "p4_found": f"""WITH {quoted}, {european} SELECT * FROM (
            SELECT 'quoted' AS src, line_id, {_reason(_QUOTED_BAD)} AS reason FROM quoted_fields
            UNION ALL SELECT 'european' AS src, line_id, {_reason(_EUROPEAN_BAD)} AS reason FROM european_fields) WHERE reason IS NOT NULL""",
        "p4_quoted_rows": f"""WITH {quoted} SELECT line_id, file_name, received_at, {_loaded('f1', 'string', 'name')}, {_loaded('f2', 'string', 'description')}, {_loaded('f3', 'INTEGER', 'value')}
            FROM quoted_fields WHERE {_reason(_QUOTED_BAD)} IS NULL""",
        "p4_european_rows": f"""WITH {european} SELECT line_id, file_name, received_at, {_loaded('f1', 'string', 'name')}, {_loaded('f2', 'INTEGER', 'price')}, {_loaded('f3', 'INTEGER', 'quantity')},
            {_loaded('f4', 'BOOLEAN', 'active')} FROM european_fields WHERE {_reason(_EUROPEAN_BAD)} IS NULL""",
    }
