"""Rolling totals over trailing periods, kept as a versioned daily state.

The state has one row per entity and day of the entity's span (first to last active day, gaps included):

    entity..., day, a_<m> (the day's own measures), t<span>_<m> (measures of the span ending with the day), version

with the measures ``amt`` (exact decimal sum), ``rem`` (what the amounts have beyond eight decimals), ``n`` (count), ``pinf`` and
``ninf`` (infinite amounts, counted apart so that they can leave a window again).

A :class:`Store` keeps the state in a folder, partitioned by version and day, and can be opened again to go on. ``advance`` takes
one version's arrivals: they touch the days whose windows hold them, and the days a longer span adds. Touched days of an entity
that follow each other form an island; in it a total is yesterday's total plus the day's arrivals minus the expiring day's amounts,
as one running sum from the last untouched day. Only the partitions of touched days are written, only those and the ones within
the longest span before them are read, and the manifest says for each day which version holds it. So a day's arrivals cost the
same however long the history is, and a correction recomputes exactly the dates whose windows hold it.

Arrivals are reduced to one row per version, entity and day before any state is touched, so the state's size depends on
entities x days and never on the number of raw rows; a hot entity has no more state rows than any other.

Defined results for edge cases: rows whose date, entity or amount is null or NaN do not count (a null entity has no span);
repeated ids count once, with the earliest arrival, also when they come in a later call; infinite amounts make the totals of the
windows that hold them infinite, or NaN if both signs meet; amounts are summed exactly to eight decimals, what is smaller as
doubles; a finite amount beyond +-1e20 raises, since its sums could not be undone exactly; an empty input gives an empty state with
the same columns; columns other than the named ones, whatever their names, are ignored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import Workspace

Days = dict[dt.date, int]

AMOUNT_TYPE = "decimal(38,8)"
AMOUNT_LIMIT = 1e20
MEASURES = ("amt", "rem", "n", "pinf", "ninf")
_DAY = "__day"
_VERSION = "__version"


@dataclass(frozen=True)
class Trailing:
    """What to total: ``entity`` columns, the ``day`` column, the ``amount``, the trailing ``spans`` in days.

    ``row_id`` names the identifier of a row that may be delivered more than once, ``arrived`` the arrival time that
    assigns rows to versions of the length ``version`` (a ``date_trunc`` unit).
    """

    entity: tuple[str, ...]
    day: str
    amount: str
    spans: tuple[int, ...] = (7, 30)
    row_id: str | None = None
    arrived: str | None = None
    version: str = "quarter"


def _entities(spec: Trailing) -> list[str]:
    return [f"__e{i}" for i in range(len(spec.entity))]


def _state_columns(spec: Trailing) -> list[str]:
    return [*(f"a_{m}" for m in MEASURES), *(f"t{s}_{m}" for s in spec.spans for m in MEASURES)]


def arrivals(df: DataFrame, spec: Trailing) -> DataFrame:
    """One row per version, entity and day: the raw rows reduced to their measures.

    Rows are first made distinct by ``row_id`` (map-side combining folds copies before the only shuffle of raw rows), then
    summed.
    """
    amount = F.col(spec.amount).cast("double")
    rows = df.select(
        *(F.col(c).alias(e) for c, e in zip(spec.entity, _entities(spec))),
        F.col(spec.day).cast("date").alias(_DAY),
        amount.alias("__amount"),
        *([F.col(spec.row_id).alias("__id")] if spec.row_id else []),
        (F.col(spec.arrived).cast("timestamp") if spec.arrived else F.lit(None).cast("timestamp")).alias("__at"),
    ).where(F.col("__amount").isNotNull() & ~F.isnan("__amount") & F.col(_DAY).isNotNull())
    for e in _entities(spec):
        rows = rows.where(F.col(e).isNotNull())
    if spec.row_id:
        keys = [*_entities(spec), _DAY, "__amount"]
        alone = F.when(F.col("__id").isNull(), F.monotonically_increasing_id())  # rows without an id are distinct
        rows = rows.withColumn("__alone", alone).groupBy("__id", "__alone").agg(F.min(F.struct("__at", *keys)).alias("r")).select("r.*")
    amount, endless = F.col("__amount"), F.abs(F.col("__amount")) == float("inf")
    huge = ~endless & (F.abs(amount) > F.lit(AMOUNT_LIMIT))
    whole = F.when(huge, F.raise_error(F.concat(F.lit("amount beyond 1e20: "), amount.cast("string"))).cast(AMOUNT_TYPE)).when(~endless, amount.try_cast(AMOUNT_TYPE))
    return (
        rows.withColumn("__whole", whole)
        .withColumn(_VERSION, F.coalesce(F.date_trunc(spec.version, "__at").cast("date"), F.lit("1970-01-01").cast("date")))
        .groupBy(_VERSION, *_entities(spec), _DAY)
        .agg(
            F.coalesce(F.sum("__whole"), F.lit(0)).cast(AMOUNT_TYPE).alias("a_amt"),
            F.coalesce(F.sum(F.when(~endless, amount - F.col("__whole").cast("double"))), F.lit(0.0)).alias("a_rem"),
            F.count(F.lit(1)).alias("a_n"),
            F.count(F.when(endless & (amount > 0), 1)).alias("a_pinf"),
            F.count(F.when(endless & (amount < 0), 1)).alias("a_ninf"),
        )
    )


def _islands(new: DataFrame, spans: DataFrame, spec: Trailing) -> DataFrame:
    """(entity..., start, stop): the runs of days that arrivals touch, apart from each other by at least one day."""
    ent, longest = _entities(spec), max(spec.spans)
    keys = ", ".join(ent)
    known = spans.selectExpr(*ent, "first_day AS old_first", "last_day AS old_last")
    days = new.groupBy(*ent, _DAY).agg(F.lit(1).alias("one")).join(known, ent, "left")
    days = days.selectExpr(
        *ent, _DAY, "old_first", "old_last", f"least(old_first, min({_DAY}) OVER (PARTITION BY {keys})) AS first", f"greatest(old_last, max({_DAY}) OVER (PARTITION BY {keys})) AS last"
    )
    leaves = f"least(date_add({_DAY}, {longest - 1}), last)"
    touched = days.selectExpr(
        *ent,
        f"CASE WHEN old_last IS NULL THEN first WHEN {_DAY} > old_last THEN date_add(old_last, 1) ELSE {_DAY} END AS a",
        f"CASE WHEN old_last IS NULL THEN last WHEN {_DAY} < old_first THEN greatest(date_add(old_first, -1), {leaves}) ELSE {leaves} END AS b",
    )
    before = f"max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    begun = touched.selectExpr(*ent, "a", "b", f"CASE WHEN a <= date_add({before}, 1) THEN 0 ELSE 1 END AS begins")
    numbered = begun.selectExpr(*ent, "a", "b", f"sum(begins) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island")
    return numbered.groupBy(*ent, "island").agg(F.min("a").alias("start"), F.max("b").alias("stop")).drop("island")


def _renewed(old: DataFrame, new: DataFrame, islands: DataFrame, spec: Trailing) -> DataFrame:
    """The rows of all island days. ``old`` holds the days of the islands and those within the longest span before them.

    Every day emits what it adds to and takes from the days of an island: its own amounts, the negative of them where they
    expire, and the totals of the day before the island. Rows are days per entity, not sales.
    """
    ent, longest = _entities(spec), max(spec.spans)
    own = [f"a_{m}" for m in MEASURES]
    totals = [f"t{s}_{m}" for s in spec.spans for m in MEASURES]
    near = islands.withColumns({"from_day": F.date_add("start", -longest)})
    held = old.join(near, ent).where(f"{_DAY} BETWEEN from_day AND stop")
    came = new.join(near, ent).where(f"{_DAY} BETWEEN start AND stop")
    # kind 0: the calendar, 1: own amounts, 2: yesterday's totals, otherwise the span after which the amounts expire.
    moves = [f"IF({_DAY} >= start, array(struct({_DAY} AS d, 1 AS kind)), array())"]
    moves += [f"IF(date_add({_DAY}, {s}) BETWEEN start AND stop, array(struct(date_add({_DAY}, {s}) AS d, {s + 2} AS kind)), array())" for s in spec.spans]
    yesterday = f"IF(date_add({_DAY}, 1) = start, array(struct(start AS d, 2 AS kind)), array())"
    nothing = [f"{_zero_sql(c.rsplit('_', 1)[1])} AS {c}" for c in totals]
    rows = held.selectExpr(*ent, "start", *own, *totals, f"inline(concat({', '.join([*moves, yesterday])}))")
    rows = rows.unionByName(came.selectExpr(*ent, "start", *own, *nothing, f"inline(concat({', '.join(moves)}))"))
    calendar = islands.selectExpr(*ent, "start", *(f"{_zero_sql(m)} AS a_{m}" for m in MEASURES), *nothing, "inline(transform(sequence(start, stop), x -> struct(x AS d, 0 AS kind)))")
    sums = [f"coalesce(sum(a_{m}) FILTER (WHERE kind = 1), {_zero_sql(m)}) AS a_{m}" for m in MEASURES]
    for s in spec.spans:
        change = f"CASE kind WHEN 1 THEN a_{{m}} WHEN 2 THEN t{s}_{{m}} WHEN {s + 2} THEN -a_{{m}} END"
        sums += [f"coalesce(sum({change.format(m=m)}), {_zero_sql(m)}) AS c{s}_{m}" for m in MEASURES]
    running = f"OVER (PARTITION BY {', '.join(ent)}, start ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    days = rows.unionByName(calendar).groupBy(*ent, "start", "d").agg(*(F.expr(x) for x in sums))
    return days.selectExpr(
        *ent,
        f"d AS {_DAY}",
        *(f"CAST(a_{m} AS {_type(m)}) AS a_{m}" for m in MEASURES),
        *(f"CAST(sum(c{s}_{m}) {running} AS {_type(m)}) AS t{s}_{m}" for s in spec.spans for m in MEASURES),
    )


class Store:
    """A state in a folder: ``days`` (partitioned by version number and day), ``spans`` (first and last day of each entity),
    ``ids`` (the identifiers that have counted) and ``manifest`` (which version number holds a day), each by version number.

    A version counts once its manifest is written, so a run that broke off leaves the version before it.
    """

    def __init__(self, spark: SparkSession, path: str, spec: Trailing, types: dict[str, str]) -> None:
        """``types``: the Spark types of the entity columns and, under the key '', of the identifier."""
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        ent = [f"{e} {types[c]}" for e, c in zip(_entities(spec), spec.entity)]
        columns = [f"{c} {_type(c.rsplit('_', 1)[1])}" for c in _state_columns(spec)]
        self.schema = ", ".join([*ent, *columns, f"{_VERSION} date", "v int", f"{_DAY} date"])
        self.span_schema = ", ".join([*ent, "first_day date", "last_day date", "v int"])
        self.id_schema = f"__id {types.get('', 'bigint')}, v int, {_DAY} date"
        self.days: Days = {}
        self.number = 0
        try:
            manifest = spark.read.schema(f"{_DAY} date, held int, v int").parquet(f"{self.path}/manifest")
            newest = manifest.agg(F.max("v")).first()[0]
        except AnalysisException:  # a new store
            newest = None
        if newest is not None:
            self.number = newest
            self.days = {r[0]: r[1] for r in manifest.where(F.col("v") == newest).select(_DAY, "held").collect()}  # a row per day

    def _partitions(self, days: Iterable[dt.date]) -> Column:
        """The partitions that hold some days, as a condition that the scan prunes by."""
        by_version: dict[int, list[dt.date]] = {}
        for day in days:
            if day in self.days:
                by_version.setdefault(self.days[day], []).append(day)
        return reduce(lambda x, y: x | y, [(F.col("v") == v) & F.col(_DAY).isin(held) for v, held in by_version.items()], F.lit(False))

    def rows(self, days: Iterable[dt.date] | None = None) -> DataFrame:
        """The state, or that of some days."""
        if not self.days:
            return self.spark.createDataFrame([], self.schema).drop("v")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/days").where(self._partitions(self.days if days is None else days)).drop("v")

    def spans(self) -> DataFrame:
        if not self.number:
            return self.spark.createDataFrame([], self.span_schema).drop("v")
        return self.spark.read.schema(self.span_schema).parquet(f"{self.path}/spans").where(F.col("v") == self.number).drop("v")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The raw rows whose identifier has not counted yet; those without one are kept. A copy keeps its date, so that only the
        identifiers of the dates that come are read."""
        spec = self.spec
        if spec.row_id is None or not self.number:
            return rows
        days = [r[0] for r in rows.select(F.col(spec.day).cast("date").alias("d")).distinct().collect()]  # a row per day
        seen = self.spark.read.schema(self.id_schema).parquet(f"{self.path}/ids").where((F.col("v") <= self.number) & F.col(_DAY).isin([d for d in days if d])).select("__id")
        return rows.join(seen, F.col(spec.row_id) == F.col("__id"), "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Takes raw rows in, those of all versions found in them, one version after the other."""
        rows = self.unseen(rows)
        work = Workspace(self.spark, "arrivals")
        new = work.write(arrivals(rows, self.spec), "arrivals")
        ids = None
        if self.spec.row_id:
            day = F.col(self.spec.day).cast("date").alias(_DAY)
            ids = rows.where(F.col(self.spec.row_id).isNotNull() & day.isNotNull()).select(F.col(self.spec.row_id).alias("__id"), day)
        self.advance_all(new, ids)
        work.drop()

    def advance_all(self, new: DataFrame, ids: DataFrame | None = None) -> None:
        """As :meth:`advance` for every version in rows of :func:`arrivals`; ``ids`` are written with the last one."""
        versions = sorted(r[0] for r in new.select(_VERSION).distinct().collect())  # load periods, at most a row per day
        for version in versions:
            self.advance(new.where(F.col(_VERSION) == F.lit(version)), version, ids if version == versions[-1] else None)

    def advance(self, new: DataFrame, version: dt.date, ids: DataFrame | None = None) -> None:
        """The next version after one version's rows of :func:`arrivals`."""
        ent, longest, number = _entities(self.spec), max(self.spec.spans), self.number + 1
        spans = self.spans()
        work = Workspace(self.spark, "islands")
        islands = work.write(_islands(new, spans, self.spec), "islands")
        found = islands.select(F.explode(F.sequence(F.date_add("start", -longest), "stop")).alias("d"), (F.col("d") >= F.col("start")).alias("touched"))
        near = {r[0]: r[1] for r in found.groupBy("d").agg(F.max("touched")).collect()}  # a row per day
        touched = [d for d, is_touched in near.items() if is_touched]
        old = self.rows(near)
        renewed = _renewed(old.drop(_VERSION), new.drop(_VERSION), islands, self.spec).withColumn(_VERSION, F.lit(version))
        there = islands.withColumnsRenamed({e: f"{e}_of" for e in ent})
        inside = reduce(lambda x, y: x & y, [F.col(e) == F.col(f"{e}_of") for e in ent]) & F.col(_DAY).between(F.col("start"), F.col("stop"))
        carried = old.where(F.col(_DAY).isin(touched)).join(there, inside, "left_anti") if self.days else None
        out = renewed.unionByName(carried) if carried is not None else renewed
        out.hint("rebalance", _DAY).write.mode("overwrite").partitionBy(_DAY).parquet(f"{self.path}/days/v={number}")
        grown = spans.unionByName(new.selectExpr(*ent, f"{_DAY} AS first_day", f"{_DAY} AS last_day")).groupBy(*ent).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
        grown.write.mode("overwrite").parquet(f"{self.path}/spans/v={number}")
        if ids is not None:
            ids.write.mode("overwrite").partitionBy(_DAY).parquet(f"{self.path}/ids/v={number}")
        days = self.days | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(days.items()), f"{_DAY} date, held int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        self.days, self.number = days, number
        work.drop()


def _type(measure: str) -> str:
    return {"amt": AMOUNT_TYPE, "rem": "double"}.get(measure, "bigint")


def _zero_sql(measure: str) -> str:
    return f"CAST(0 AS {_type(measure)})"


def open_store(df: DataFrame, spec: Trailing, path: str | None = None) -> Store:
    """The store in a folder, or a new one in the session's shared folder, for rows like ``df``'s."""
    types = {c: df.schema[c].dataType.simpleString() for c in spec.entity} | ({"": df.schema[spec.row_id].dataType.simpleString()} if spec.row_id else {})
    return Store(df.sparkSession, path or Workspace(df.sparkSession, "trailing").path, spec, types)


def trailing_state(df: DataFrame, spec: Trailing, path: str | None = None) -> DataFrame:
    """The state after all versions found in ``df``, advanced one version at a time in order of arrival.

    With a ``path`` the state is kept there, and the rows are added to what an earlier call has left.
    """
    store = open_store(df, spec, path)
    if path:
        store.add(df)
    else:
        store.advance_all(Workspace(df.sparkSession, "arrivals").write(arrivals(df, spec), "arrivals"))
    return store.rows()


def total_of(prefix: str) -> Column:
    """A window's total as a double, with infinite amounts put back."""
    up, down = F.col(f"{prefix}_pinf") > 0, F.col(f"{prefix}_ninf") > 0
    return (
        F.when(up & down, F.lit(float("nan")))
        .when(up, F.lit(float("inf")))
        .when(down, F.lit(float("-inf")))
        .otherwise(F.col(f"{prefix}_amt").cast("double") + F.when(F.col(f"{prefix}_n") > 0, F.col(f"{prefix}_rem")).otherwise(0.0))
    )


def trailing_totals(df: DataFrame, spec: Trailing) -> DataFrame:
    """Per entity and day of its span: the day's total and, per span, total, count and average of the amounts.

    The average of a window without amounts is null. See the module's docstring for null, repeated and infinite amounts.
    """
    return report(trailing_state(df, spec), spec)


def report(state: DataFrame, spec: Trailing) -> DataFrame:
    """A state as plain columns: entity..., day, day_total, total_<span>, count_<span>, avg_<span>, version."""
    out = [F.col(e).alias(c) for e, c in zip(_entities(spec), spec.entity)]
    out += [F.col(_DAY).alias(spec.day), total_of("a").alias("day_total")]
    for s in spec.spans:
        n = F.col(f"t{s}_n")
        out += [total_of(f"t{s}").alias(f"total_{s}"), n.alias(f"count_{s}"), F.when(n > 0, total_of(f"t{s}") / F.when(n > 0, n)).alias(f"avg_{s}")]
    return state.select(*out, F.col(_VERSION).alias("version"))
