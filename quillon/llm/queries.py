"""The package's queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.mixing import budgets, mix_sources, shares
from quillon.llm.packing import containers, pack_items
from quillon.llm.percentiles import merge, percentiles, summaries
from quillon.llm.residue import mark_residue, without_residue
from quillon.llm.topn import top_n

SEED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "sales").select("sale_id", "region", "product", "amount")
    return top_n(sales, ["region", "product"], "amount", "sale_id", 3).select("sale_id")


def p1_top_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_n(_table(spark, sf_dir, "sales"), ["region", "product"], "amount", "sale_id", 3)
    return found.select("region", "product", F.col("rank").cast("bigint").alias("place"), "sale_id", "date", "amount", "quantity", "loaded_at")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _table(spark, sf_dir, "compare_reshape")
    runs = runs.select("run_id", "benchmark", F.date_format("started_at", "yyyy-MM-dd").alias("run_day"), F.col("framekit.samplesMs").alias("samples"))
    return runs.dropDuplicates(["run_id"])


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(_runs(spark, sf_dir), [["benchmark"], ["benchmark", "run_day"]], "samples", [0.5, 0.95])
    return found.groupBy("benchmark", "run_day").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(_runs(spark, sf_dir), [["benchmark"], ["benchmark", "run_day"]], "samples", [0.5, 0.95])
    whole = found.where("grouping = 0 AND p = 0.5").select("benchmark", F.col("value").alias("middle"))
    days = found.where("grouping = 1").join(whole, "benchmark")
    far = F.when(F.col("p") == 0.5, F.col("value") > 1.5 * F.col("middle")).otherwise(F.col("value") > 3 * F.col("middle"))
    return days.where(far).select("benchmark", "run_day", F.when(F.col("p") == 0.5, "p50").otherwise("p95").alias("stat"))


def p2_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of calendar weeks combined from the days' summaries; rank error at most 2 % of a week's samples."""
    days = summaries(_runs(spark, sf_dir), ["benchmark", "run_day"], "samples", points=50)
    weeks = days.withColumn("week", F.date_format(F.date_trunc("week", F.col("run_day").cast("date")), "yyyy-MM-dd"))
    return merge(weeks, ["benchmark", "week"], [0.5, 0.95])


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in tokens: one per byte of UTF-8 and an end token; texts without bytes have none."""
    length = F.octet_length("text")
    return _table(spark, sf_dir, "documents").withColumn("size", F.when(length > 0, length + 1))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(_sized(spark, sf_dir).select("doc_id", "size"), _table(spark, sf_dir, "capacities"), "doc_id", "size")


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(p6_pack(spark, sf_dir))


def _quality(df: DataFrame) -> DataFrame:
    """A document's weight in sampling grows with its votes; an accepted answer counts for more."""
    votes = F.log1p(F.greatest(F.coalesce("votes", F.lit(0)), F.lit(0)))
    return df.withColumn("quality", 1 + votes + F.when(F.col("accepted"), 1.0).otherwise(0.0))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _quality(_sized(spark, sf_dir)).select("doc_id", "source", "size", "quality")
    return mix_sources(docs, _table(spark, sf_dir, "mix_targets"), "doc_id", "source", "size", "quality", seed=SEED)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_mixed(spark, sf_dir), _sized(spark, sf_dir), _table(spark, sf_dir, "mix_targets"), "source", "size", "doc_id")


def p7_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source of a mix is to give, and how often all of its documents are used for it."""
    docs = _sized(spark, sf_dir).where("size > 0").select("source", F.col("size").cast("long").alias("size"))
    plan = budgets(docs, _table(spark, sf_dir, "mix_targets"))
    return plan.select("mix", "source", F.round("target_share", 6).alias("target_share"), F.round("budget", 2).alias("target_size"), "held", "docs", "epochs", F.round("rest", 2).alias("rest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_residue(docs).where("residue IS NOT NULL").select("doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    return without_residue(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_top_sales, p2_found, p2_percentiles, p2_weeks, p6_pack, p6_unused, p7_mix, p7_shares, p7_budgets, p8_found, p8_kept]
    return {f.__name__: f for f in named}


_TOP = """
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY region, product ORDER BY amount DESC, sale_id) AS place
        FROM (SELECT * FROM sales WHERE amount IS NOT NULL AND NOT isnan(amount)
              QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY loaded_at) = 1)
    ) WHERE place <= 3
"""

_PERCENTILES = """
    samples AS (
        SELECT benchmark, run_day, x FROM (
            SELECT benchmark, strftime(started_at, '%Y-%m-%d') AS run_day, unnest(framekit.samplesMs) AS x
            FROM (SELECT * FROM compare_reshape QUALIFY row_number() OVER (PARTITION BY run_id) = 1)
        ) WHERE x IS NOT NULL AND NOT isnan(x)
    ),
    both_levels AS (SELECT benchmark, NULL AS run_day, x FROM samples UNION ALL SELECT * FROM samples),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY benchmark, run_day ORDER BY x) AS r, count(*) OVER (PARTITION BY benchmark, run_day) AS n
        FROM both_levels
    ),
    stats AS (
        SELECT benchmark, run_day, max(n)::BIGINT AS n, max(x) FILTER (WHERE r = ceil(0.5 * n)) AS p50, max(x) FILTER (WHERE r = ceil(0.95 * n)) AS p95
        FROM ranked GROUP BY benchmark, run_day
    )
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT sale_id FROM ({_TOP})",
        "p1_top_sales": f"SELECT region, product, place, sale_id, date, amount, quantity, loaded_at FROM ({_TOP})",
        "p2_percentiles": f"WITH {_PERCENTILES} SELECT * FROM stats",
        "p7_budgets": """WITH sized AS (SELECT source, octet_length(encode(text)) + 1 AS size FROM documents WHERE length(text) > 0),
            held AS (SELECT source, sum(size)::BIGINT AS held, count(*) AS docs FROM sized GROUP BY source),
            wanted AS (
                SELECT mix, source, sum(greatest(weight, 0)) AS w, max(greatest(max_repeats, 0)) AS cap, max(greatest(size_factor, 0)) AS f
                FROM mix_targets WHERE mix IS NOT NULL AND source IS NOT NULL GROUP BY mix, source
            ),
            planned AS (
                SELECT mix, source, cap, w / sum(w) OVER (PARTITION BY mix) AS share, w / sum(w) OVER (PARTITION BY mix) * f * grand AS budget, coalesce(held, 0) AS held, coalesce(docs, 0) AS docs,
                    CASE WHEN held > 0 THEN least(floor(budget / held), cap)::BIGINT ELSE 0 END AS epochs
                FROM wanted LEFT JOIN held USING (source) CROSS JOIN (SELECT sum(size) AS grand FROM sized)
            )
            SELECT mix, source, round(share, 6) AS target_share, round(budget, 2) AS target_size, held, docs, epochs, round(CASE WHEN epochs < cap THEN budget - epochs * held ELSE 0 END, 2) AS rest FROM planned""",
        "p2_weeks": f"""WITH {_PERCENTILES},
            points AS (
                SELECT r.benchmark, date_trunc('week', r.run_day::DATE) AS week, r.x, ceil(i * r.n / 50)::BIGINT - ceil((i - 1) * r.n / 50)::BIGINT AS weight
                FROM ranked r, generate_series(1, 50) t(i) WHERE r.run_day IS NOT NULL AND r.r = ceil(i * r.n / 50)
            ),
            summed AS (
                SELECT benchmark, week, x, sum(weight) OVER (PARTITION BY benchmark, week ORDER BY x) AS cum, sum(weight) OVER (PARTITION BY benchmark, week) AS n FROM points WHERE weight > 0
            )
            SELECT benchmark, strftime(week, '%Y-%m-%d') AS week, p AS p, max(n)::BIGINT AS n, min(x) AS value
            FROM summed, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) s(p) WHERE cum >= ceil(p::DECIMAL(9, 4) * n) GROUP BY benchmark, week, p""",
        "p2_found": f"""WITH {_PERCENTILES},
            days AS (SELECT d.benchmark, d.run_day, d.p50, d.p95, w.p50 AS middle FROM stats d JOIN stats w ON d.benchmark = w.benchmark AND w.run_day IS NULL WHERE d.run_day IS NOT NULL)
            SELECT benchmark, run_day, 'p50' AS stat FROM days WHERE p50 > 1.5 * middle
            UNION ALL SELECT benchmark, run_day, 'p95' AS stat FROM days WHERE p95 > 3 * middle""",
    }
