"""Mixing sources to target weights with capped repetition, by Efraimidis-Spirakis sampling.

Each mix wants the total size ``size_factor`` x (size of all documents), shared among its sources by their weights. A source whose
share is larger than itself comes in complete epochs first (every document so many times), up to ``max_repeats``; the fraction
that remains is sampled without replacement: every document draws the key -ln(u) / quality, the smallest keys are taken until
their sizes reach what is left of the budget. The prefix ends before the budget is exceeded; ``PASSES - 1`` more prefixes of the
documents that still fit follow, then one document, whose size is nearest to the gap, if that brings the source nearer to its
budget.

A prefix is found like a quantile, not by sorting: keys are cut into ``buckets`` equal ranges, bucket sizes are summed with map-side
combining, and their running sum (a row per mix, source and bucket) tells which bucket holds the end of the budget. That bucket is
cut again, until it holds at most ``BORDER_ROWS`` documents; only those are sorted. So no source, however large and however its
qualities are spread, is sorted in one task, and what a pass leaves behind is one place in the order (key, document) per mix and
source. From the table of drawn keys and these places the result is one projection.

The state has one row per mix and source. Up to ``HELD_TARGETS`` such rows, which are counted first, are held by the driver and
broadcast; beyond, they are written tables and the joins are left to the engine's sizes.

A source that cannot reach its budget even at ``max_repeats`` gives all it has; other sources keep their budgets, and the report
shows the shares reached. Draws depend on the id, the mix and the seed only, so a run can be repeated on any cluster.

Defined results for edge cases: documents of null or non-positive size are not used; a null source belongs to no target; sources
without documents appear in the report with zero; null or negative weights, repeats and factors count as zero; null or
non-positive quality counts as the least quality allowed (``MIN_QUALITY``); a repeated id counts once; targets given twice for
one mix and source are added, with the larger cap; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import Workspace

MIN_QUALITY = 0.01
BUCKETS = 4096
PASSES = 2
#: Documents of a mix and source that are sorted in one task.
BORDER_ROWS = 10_000
#: Rows of state, one per mix and source, that are held by the driver and broadcast.
HELD_TARGETS = 10_000
GROUP = ["mix", "source"]


class _State:
    """Keeps tables with a row per mix and source: small ones as local rows to broadcast, others written."""

    def __init__(self, work: Workspace, targets: int) -> None:
        self.work, self.small, self.tables = work, targets <= HELD_TARGETS, 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        if self.small:
            return F.broadcast(df.sparkSession.createDataFrame(df.toArrow()))
        return self.work.write(df, f"state-{self.tables}")


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) drawn from the parts' text: 52 bits of their digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: share wanted, budget, and what the source holds. ``docs``: source, size; ``targets`` is small."""
    held = docs.groupBy("source").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("docs"))
    # The size of all documents, sources of no target included: held has a row per source.
    held = held.withColumn("grand", F.sum("held").over(Window.partitionBy(F.lit(0))))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0)
    wanted = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull()).groupBy("mix", "source").agg(
        F.sum(positive("weight")).alias("weight"), F.max(positive("max_repeats")).cast("long").alias("max_repeats"), F.max(positive("size_factor")).alias("size_factor")
    )
    mix = Window.partitionBy("mix")
    wanted = wanted.withColumn("target_share", F.when(F.sum("weight").over(mix) > 0, F.col("weight") / F.sum("weight").over(mix)).otherwise(0.0))
    both = wanted.join(held, "source", "left").withColumn("grand", F.coalesce(F.max("grand").over(Window.partitionBy(F.lit(0))), F.lit(0)))
    both = both.withColumns({"held": F.coalesce("held", F.lit(0)), "docs": F.coalesce("docs", F.lit(0)), "budget": F.col("target_share") * F.col("size_factor") * F.col("grand")})
    epochs = F.when(F.col("held") > 0, F.least(F.floor(F.expr("try_divide(budget, held)")), F.col("max_repeats"))).otherwise(0).cast("long")
    both = both.withColumn("epochs", epochs)
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("held")).otherwise(0.0)
    return both.withColumn("rest", rest).drop("grand", "weight", "size_factor")


def mix_sources(df: DataFrame, targets: DataFrame, doc_id: str, source: str, size: str, quality: str | None = None, *, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(mix, source, doc id, size, copies): the documents of every mix and how often each is used."""
    quality_value = F.coalesce(F.greatest(F.col(quality).cast("double"), F.lit(MIN_QUALITY)), F.lit(MIN_QUALITY)) if quality else F.lit(1.0)
    docs = df.where((F.col(size) > 0) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), quality_value.alias("quality"))
    work = Workspace(df.sparkSession, "mixing")
    # Small rows, one per document; the texts are read once.
    docs = work.write(docs.groupBy("doc").agg(F.max(F.struct("source", "size", "quality")).alias("d")).select("doc", "d.*"), "documents")
    plan = budgets(docs, targets).where("budget > 0 AND max_repeats > 0").select(*GROUP, "epochs", F.col("rest").cast("double").alias("r0"))
    state = _State(work, targets.count())
    plan = state.keep(plan)
    key = -F.log(uniform(F.col("doc").cast("string"), "mix", seed=seed)) / F.col("quality")
    drawn = docs.join(plan.drop("epochs", "r0"), "source").select(*GROUP, "doc", "size", key.alias("key"))
    for i in range(PASSES):
        plan = state.keep(_passed(drawn, plan, i, state, buckets))
    # One more document, of the size nearest to what is left, if that brings the source nearer to its budget.
    rest = F.col(f"r{PASSES}")
    off = F.abs(F.col("size") - rest)
    open_ones = drawn.join(plan, GROUP).where(~_taken(PASSES) & (off < rest))
    fill = open_ones.groupBy(*GROUP).agg(F.min_by("doc", F.struct(off, "key", "doc")).alias("fill"))
    plan = state.keep(plan.join(fill, GROUP, "left"))
    extra = (_taken(PASSES) | F.coalesce(F.col("doc") == F.col("fill"), F.lit(False))).cast("long")
    used = drawn.join(plan, GROUP).withColumn("copies", (F.col("epochs") + extra).cast("int"))
    return used.select(*GROUP, F.col("doc").alias(doc_id), "size", "copies").where("copies > 0")


def _taken(passes: int) -> Column:
    """Whether the first so many passes took a document: it fitted, and its place is not behind the pass's end (k, d)."""
    out = F.lit(False)
    for i in range(passes):
        before = (F.col("key") < F.col(f"k{i}")) | ((F.col("key") == F.col(f"k{i}")) & F.coalesce(F.col("doc") <= F.col(f"d{i}"), F.lit(False)))
        out = out | ((F.col("size") <= F.col(f"r{i}")) & before)
    return out


def _passed(drawn: DataFrame, plan: DataFrame, i: int, state: _State, buckets: int) -> DataFrame:
    """``plan`` with the end (k, d) of pass ``i``: of the longest prefix, by key, of the documents that fit what is left; and with
    what is left then."""
    left = F.col(f"r{i}")
    fitting = drawn.join(plan, GROUP).where(~_taken(i) & (F.col("size") <= left))
    # Keys as places between 0 and 1, which need no bounds to be known for the first cut.
    fitting = fitting.select(*GROUP, "doc", "size", "key", left.alias("left"), (F.col("key") / (1 + F.col("key"))).alias("x"))
    totals, rows = None, fitting.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0), "before": F.lit(0).cast("bigint")})
    while True:
        bucket = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        sums = rows.groupBy(*GROUP, F.coalesce(bucket, F.lit(0)).alias("bucket")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("before").alias("before"), F.first("left").alias("left"))
        running = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("cum", F.col("before") + F.sum("s").over(running))
        border = F.struct("lo", "hi", (F.col("cum") - F.col("s")).alias("before"), "n")
        found = sums.groupBy(*GROUP).agg(F.min_by(border, F.when(F.col("cum") > F.col("left"), F.col("bucket"))).alias("b"), F.max("cum").alias("all"))
        edges = state.keep(found.select(*GROUP, "b.*", "all"))
        totals = edges.select(*GROUP, "all") if totals is None else totals
        rows = fitting.join(edges, GROUP).where("x BETWEEN lo AND hi")  # none where all that fits is taken
        # A range of one key cannot be cut; keys are drawn from 2**52 places, so it is no larger than the copies of a place.
        if edges.where((F.col("n") > BORDER_ROWS) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
    order = Window.partitionBy(*GROUP).orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("cum") <= F.col("left")
    ends = rows.withColumn("cum", F.col("before") + F.sum("size").over(order)).groupBy(*GROUP).agg(
        F.max(F.when(inside, F.struct("key", "doc"))).alias("end"), F.min("key").alias("first"), F.coalesce(F.max(F.when(inside, F.col("cum"))), F.first("before")).alias("sum")
    )
    known = plan.join(totals, GROUP, "left").join(ends, GROUP, "left")
    over = F.col("first").isNotNull()  # else all that fits is taken
    cut = F.when(over, F.coalesce(F.col("end.key"), F.col("first"))).otherwise(F.lit(float("inf")))
    taken = F.when(over, F.col("sum")).otherwise(F.coalesce("all", F.lit(0)))
    return known.select(*plan.columns, cut.alias(f"k{i}"), F.col("end.doc").alias(f"d{i}"), (F.col(f"r{i}") - taken).alias(f"r{i + 1}"))


def shares(mixed: DataFrame, df: DataFrame, targets: DataFrame, source: str, size: str, doc_id: str) -> DataFrame:
    """Per mix and source: target and reached share and size, documents used, the most copies of one, and the cap."""
    docs = df.where((F.col(size) > 0) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.max(F.struct(F.col(source).alias("source"), F.col(size).cast("long").alias("size"))).alias("d")).select("d.*")
    plan = budgets(docs, targets)
    got = mixed.groupBy("mix", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most"))
    both = plan.join(got, ["mix", "source"], "left")
    reached = F.coalesce("size", F.lit(0))
    total = F.sum(reached).over(Window.partitionBy("mix"))
    return both.select(
        "mix",
        "source",
        F.round("target_share", 6).alias("target_share"),
        F.round(F.when(total > 0, reached / total).otherwise(0.0), 6).alias("reached_share"),
        F.round("budget", 2).alias("target_size"),
        reached.alias("reached_size"),
        F.coalesce("used", F.lit(0)).alias("documents"),
        F.coalesce(F.col("most"), F.lit(0)).cast("int").alias("most_copies"),
        F.col("max_repeats").cast("int").alias("max_repeats"),
    )
