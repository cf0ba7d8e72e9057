"""Percentiles per group over very many values by distributed multi-select.

Values are held as sorted chunks, one per group and input batch. In every round each partition looks the targets (a group and a
percentile) of its chunks up, counts less, equal and greater for their pivots by binary search, and proposes, for every range
between pivots, the local median and the medians of the halves beside it. The counts tell which range holds the wanted rank, the
weighted medians of that range's proposals become the next pivots, and the other ranges are discarded: at first by bounds, and
physically whenever less than a tenth of the stored values is still in play. All targets of all groups advance together until
each is found, so a result is exact. A pivot is always one of the values in play, so every round rules out at least one of them.

A round moves one small row per target and partition and never the values; a group of any size stays spread over all partitions
that hold it. The targets' state (bounds and pivots) lies with the driver, which hands it to the partitions, for one block of at
most ``BLOCK_TARGETS`` targets at a time: with more targets the chunks are rewritten by block of groups once, and the blocks are
worked off one after the other, each over its own chunks. The counts of a round are merged in tasks, one row per target, before
they go to the driver. What a lost executor held is computed again from the written chunks.

``summaries`` finds evenly spaced percentiles per group (say per day); they are weighted points that ``merge`` combines into
longer spans with a rank error of at most the share ``1 / points``.

A percentile p of n values is the value of rank ceil(p * n), the lower median for p = 0.5.

Defined results for edge cases: null and NaN samples are no samples; infinite ones are ordinary values; null keys form groups of
their own; groups without samples do not come out; repeated rows count as often as they occur (make them distinct before);
null, empty and very long lists are allowed (long ones are cut into slices); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation
from quillon.session import Workspace

#: Values in one slice of a list: bounds the bytes of an Arrow batch whatever the length of the lists.
SLICE = 8192
#: Targets whose state (about 100 bytes each, 200 with a round's counts) is with the driver at a time.
BLOCK_TARGETS = 50_000
#: Rewrite the chunks when the values still in play are fewer than this share of the stored ones.
TRIM_BELOW = 0.1
#: Pivots of a target in a round: the median and the medians of the halves.
PIVOTS = 3
#: Rows a task's counts are held in before they are folded to one per target.
FOLD_ROWS = 100_000
_GOT = "n array<bigint>, eq array<bigint>, props array<double>"


def _chunked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(gid, keys..., vals): per Arrow batch and group one sorted list of its samples."""
    schema = ", ".join(["gid string", *(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "vals array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            coded = batch.column(0).dictionary_encode()
            codes = np.asarray(coded.indices)
            values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            parents = np.asarray(pa.compute.list_parent_indices(lists))
            real = ~np.isnan(values)
            values, owner = values[real], codes[parents[real]]
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            present, starts = np.unique(owner, return_index=True)
            _, first_row = np.unique(codes, return_index=True)
            take = pa.array(first_row[present])
            offsets = pa.array(np.append(starts, len(values)).astype(np.int32))
            columns = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(values))], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def _search(values: np.ndarray, start: np.ndarray, stop: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Per entry the place of ``x`` in the sorted stretch ``values[start:stop]``, before or after its equals."""
    lo, hi = start.copy(), stop.copy()
    for _ in range(int((stop - start).max(initial=0)).bit_length()):
        middle = (lo + hi) >> 1
        v = values[np.minimum(middle, len(values) - 1)]
        up = (lo < hi) & ((v <= x) if right else (v < x))
        lo, hi = np.where(up, middle + 1, lo), np.where(~up & (lo < hi), middle, hi)
    return lo


@dataclass
class _Targets:
    """The targets of some groups, ordered by group, as arrays: rank ``k`` among the values in play, bounds and pivots (NaN: none)."""

    gids: pa.Array
    group: np.ndarray
    tid: np.ndarray
    k: np.ndarray
    playing: np.ndarray
    pivots: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.group)

    def only(self, chosen: np.ndarray) -> _Targets:
        groups, group = np.unique(self.group[chosen], return_inverse=True)
        rest = (x[chosen] for x in (self.tid, self.k, self.playing, self.pivots, self.lo, self.hi))
        return _Targets(self.gids.take(pa.array(groups)), group, *rest)

    def advanced(self, n: np.ndarray, eq: np.ndarray, proposals: np.ndarray) -> tuple[_Targets, np.ndarray]:
        """A round further, by all partitions' counts: narrowed to the range of the rank; and the values found (NaN: not yet)."""
        every = np.zeros((len(self), 2 * PIVOTS + 1), np.int64)
        every[:, 0::2], every[:, 1::2] = n, eq
        cum, line = np.cumsum(every, axis=1), np.arange(len(self))
        place = (cum < self.k[:, None]).sum(axis=1)  # an even place is a range, an odd one a pivot
        found = np.where(place % 2 == 1, self.pivots[line, np.minimum(place // 2, PIVOTS - 1)], np.nan)
        region = place // 2
        edge = np.full((len(self), 1), np.nan)
        bounds = np.concatenate([edge, self.pivots, edge], axis=1)
        lo, hi = bounds[line, region], bounds[line, region + 1]
        before = np.where(place > 0, cum[line, np.maximum(place - 1, 0)], 0)
        new = _Targets(self.gids, self.group, self.tid, self.k - before, every[line, place], _distinct(proposals[line, region]), np.where(np.isnan(lo), self.lo, lo), np.where(np.isnan(hi), self.hi, hi))
        return new, found


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Ascending rows without repeats; what is left out becomes NaN at the end."""
    out = np.full(rows.shape, np.nan)
    keep = ~np.isnan(rows)
    keep[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    line, at = np.nonzero(keep)
    out[line, np.cumsum(keep, axis=1)[line, at] - 1] = rows[line, at]
    return out


class _Pairs:
    """An Arrow batch of (gid, vals) as pairs of a chunk and a target, with the stretch of values in play."""

    def __init__(self, batch: pa.RecordBatch, targets: _Targets) -> None:
        lists = batch.column(1)
        self.values = np.asarray(lists.flatten())
        lengths = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
        self.ends = np.cumsum(lengths)
        coded = batch.column(0).dictionary_encode()
        known = np.asarray(pa.compute.fill_null(pa.compute.index_in(coded.dictionary, targets.gids), -1))
        group = known[np.asarray(coded.indices)]
        starts = np.searchsorted(targets.group, np.arange(len(targets.gids) + 1))
        per_row = np.where(group >= 0, starts[group + 1] - starts[group], 0)
        self.row = np.repeat(np.arange(batch.num_rows), per_row)
        self.target = np.arange(len(self.row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + starts[group[self.row]]
        self.pivots = targets.pivots[self.target]
        low, high = targets.lo[self.target], targets.hi[self.target]
        start, stop = (self.ends - lengths)[self.row], self.ends[self.row]
        self.start = np.where(np.isnan(low), start, _search(self.values, start, stop, low, True))
        self.stop = np.where(np.isnan(high), stop, _search(self.values, start, stop, high, False))

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in each range between pivots, equal to each pivot, and the proposals of each range (NaN where there are none)."""
        size, regions = len(self.row), PIVOTS + 1
        start, stop = np.repeat(self.start, PIVOTS), np.repeat(self.stop, PIVOTS)
        x = self.pivots.reshape(-1)
        none = np.isnan(x)
        left = np.where(none, stop, _search(self.values, start, stop, x, False)).reshape(size, PIVOTS)
        right = np.where(none, stop, _search(self.values, start, stop, x, True)).reshape(size, PIVOTS)
        begins = np.concatenate([self.start[:, None], right], axis=1)
        n = np.concatenate([left, self.stop[:, None]], axis=1) - begins
        at = begins[:, :, None] + (n[:, :, None] * np.arange(1, PIVOTS + 1)) // regions
        some = np.broadcast_to((n > 0)[:, :, None], at.shape)
        proposals = np.full(at.shape, np.nan)
        proposals[some] = self.values[at[some]]
        return n, right - left, proposals


def _quantiles(key: np.ndarray, m: np.ndarray, w: np.ndarray, n_keys: int) -> np.ndarray:
    """Per key the weighted median of its proposals and those of the halves; always proposals themselves, NaN for none."""
    out = np.full((n_keys, PIVOTS), np.nan)
    some = (w > 0) & ~np.isnan(m)
    key, m, w = key[some], m[some], w[some]
    order = np.lexsort((m, key))
    key, m, cum = key[order], m[order], np.cumsum(w[order])
    total = np.bincount(key, w[order], n_keys)
    before = np.cumsum(total) - total
    held = np.flatnonzero(total > 0)
    last = np.searchsorted(key, held, side="right") - 1
    for j in range(PIVOTS):
        found = np.searchsorted(cum, before[held] + total[held] * (j + 1) / (PIVOTS + 1))
        out[held, j] = m[np.minimum(found, last)]
    return out


def _folded(key: np.ndarray, n: np.ndarray, eq: np.ndarray, proposals: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per key: summed counts and weighted medians of the proposals."""
    present, at = np.unique(key, return_inverse=True)
    if len(present) == len(key):
        order = np.argsort(at)
        return present, n[order], eq[order], proposals[order]
    regions, size = PIVOTS + 1, len(present)

    def sums(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, x[:, i], size) for i in range(x.shape[1])], axis=1).astype(np.int64)

    where = np.repeat(at[:, None] * regions + np.arange(regions), PIVOTS)
    merged = _quantiles(where, proposals.reshape(-1), np.repeat(n, PIVOTS), size * regions)
    return present, sums(n), sums(eq), merged.reshape(size, regions, PIVOTS)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


class _Held:
    """Counts of one task, folded to one entry per target whenever they have become many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.folded = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(_folded(*part))
        self.rows += len(self.parts[-1][0])
        if self.rows > 2 * self.folded + FOLD_ROWS:
            self.fold()

    def fold(self) -> tuple[np.ndarray, ...]:
        self.parts = [_folded(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.rows = self.folded = len(self.parts[0][0])
        return self.parts[0]


def _as_counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, eq, proposals = (np.asarray(batch.column(batch.schema.get_field_index(c)).flatten()) for c in ("n", "eq", "props"))
    return n.reshape(-1, PIVOTS + 1), eq.reshape(-1, PIVOTS), proposals.reshape(-1, PIVOTS + 1, PIVOTS)


def _as_lists(n: np.ndarray, eq: np.ndarray, proposals: np.ndarray) -> list[pa.Array]:
    return [_lists(n), _lists(eq), _lists(proposals.reshape(len(n), (PIVOTS + 1) * PIVOTS))]


def _counts(targets: _Targets) -> Callable:
    """One partition's counts and proposals: a row per target that has values in play here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            pairs = _Pairs(batch, targets)
            if len(pairs.row):
                held.add(pairs.target, *pairs.counted())
        if held.parts:
            target, n, eq, proposals = held.fold()
            some = n.sum(axis=1) + eq.sum(axis=1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(target[some]), *_as_lists(n[some], eq[some], proposals[some])], names=["target", "n", "eq", "props"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per target of the rows of all partitions."""
    held = _Held()
    for batch in batches:
        held.add(np.asarray(batch.column(0)), *_as_counts(batch))
    if held.parts:
        target, *counts = held.fold()
        yield pa.RecordBatch.from_arrays([pa.array(target), *_as_lists(*counts)], names=["target", "n", "eq", "props"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, n, eq, props) of one partition before there are pivots: a row per group."""
    held, codes = _Held(), {}
    for batch in batches:
        every = _Targets(pa.array([], pa.string()), *(np.empty(0, np.int64) for _ in range(4)), np.empty((0, PIVOTS)), *(np.empty(0) for _ in range(2)))
        pairs = _Pairs(batch, every)
        pairs.row, pairs.pivots = np.arange(batch.num_rows), np.full((batch.num_rows, PIVOTS), np.nan)
        pairs.start, pairs.stop = np.append(0, pairs.ends)[:-1], pairs.ends
        coded = batch.column(0).dictionary_encode()
        code = np.array([codes.setdefault(g, len(codes)) for g in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
        held.add(code, *pairs.counted())
    if held.parts:
        code, *counts = held.fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()).take(pa.array(code)), *_as_lists(*counts)], names=["gid", "n", "eq", "props"])


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, n, pivots) of the groups in this partition, by the counts of all."""
    held, codes = _Held(), {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        code = np.array([codes.setdefault(g, len(codes)) for g in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
        held.add(code, *_as_counts(batch))
    if held.parts:
        code, n, _, proposals = held.fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()).take(pa.array(code)), pa.array(n[:, 0]), _lists(_distinct(proposals[:, 0, :]))], names=["gid", "n", "pivots"])


def _trimmed(targets: _Targets) -> Callable:
    """The chunks without the values that are ruled out for all targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Pairs(batch, targets)
            open_stretches = np.bincount(b.start, minlength=len(b.values) + 1) - np.bincount(b.stop, minlength=len(b.values) + 1)
            keep = np.cumsum(open_stretches)[:-1] > 0
            kept = np.append(0, np.cumsum(keep))
            offsets = pa.array(kept[np.append(0, b.ends)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(b.values[keep]))], names=["gid", "vals"])

    return run


def percentiles(df: DataFrame, groupings: Sequence[Sequence[str]], samples: str, ps: Sequence[float]) -> DataFrame:
    """Exact percentiles ``ps`` of the numbers in list column ``samples`` for every group of every grouping.

    Returns the union of all key columns (null where a grouping lacks one), ``grouping`` (index), ``n``, ``p``, ``value``.
    """
    if not ps or any(not 0 <= p <= 1 for p in ps):
        raise InvalidOperation("percentiles lie between 0 and 1")
    spark = df.sparkSession
    work = Workspace(spark, "multiselect")
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / SLICE).cast("int")), lambda i: F.slice(F.col(samples), i * SLICE + 1, F.lit(SLICE)))
    rows = df.where(F.size(F.col(samples)) > 0).select(*keys, F.explode(slices).alias("__vals"))
    levels = [
        F.struct(F.lit(i).alias("grouping"), *(F.when(F.lit(k in g), F.col(f"`{k}`")).alias(k) for k in keys)) for i, g in enumerate(groupings)
    ]
    rows = rows.select(F.explode(F.array(*levels)).alias("__g"), "__vals")
    rows = rows.select(F.to_json("__g").alias("gid"), "__g.*", F.col("__vals").cast("array<double>").alias("vals"))
    first = work.write(_chunked(rows, ["grouping", *keys]), "chunks")
    chunks = first.select("gid", "vals")
    seen = Observation()
    counted = chunks.mapInArrow(_sizes, f"gid string, {_GOT}").repartition("gid")
    groups = work.write(counted.mapInArrow(_begun, "gid string, n bigint, pivots array<double>").observe(seen, F.count(F.lit(1)).alias("groups")), "groups")
    blocks = -(-seen.get["groups"] * len(ps) // BLOCK_TARGETS)
    block = F.pmod(F.xxhash64("gid"), F.lit(max(blocks, 1)))
    if blocks > 1:
        chunks.withColumn("block", block).write.partitionBy("block").parquet(f"{work.path}/blocks")
        chunks = spark.read.schema("gid string, vals array<double>, block int").parquet(f"{work.path}/blocks")
        groups = work.write(groups.withColumn("block", block).repartition("block"), "groups-by-block")
    ranks = [Decimal(str(p)).as_integer_ratio() for p in ps]
    for i in range(blocks):
        own, its = (chunks.where(F.col("block") == i).drop("block"), groups.where(F.col("block") == i).drop("block")) if blocks > 1 else (chunks, groups)
        found = _selected(work, own, its.toArrow(), ranks, f"block{i}")
        spark.createDataFrame(found).coalesce(1).write.mode("append").parquet(f"{work.path}/found")
    schema = "gid string, tid bigint, n bigint, value double"
    results = spark.read.schema(schema).parquet(f"{work.path}/found") if blocks else spark.createDataFrame([], schema)
    known = first.groupBy("gid").agg(*(F.first(k).alias(k) for k in ["grouping", *keys]))
    p_of = F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("tid").cast("int") + 1)
    return results.join(known, "gid").select(*keys, "grouping", "n", p_of.alias("p"), "value")


def _selected(work: Workspace, chunks: DataFrame, groups: pa.Table, ranks: list[tuple[int, int]], label: str) -> pa.Table:
    """The rounds of one block: (gid, tid, n, value) of its targets. ``ranks`` are the percentiles as fractions."""
    n = np.asarray(groups["n"])
    group, tid = np.repeat(np.arange(len(n)), len(ranks)), np.tile(np.arange(len(ranks)), len(n))
    k = np.array([max(1, -(-above * int(total) // below)) for total in n for above, below in ranks], np.int64)
    pivots = np.asarray(groups["pivots"].combine_chunks().flatten()).reshape(-1, PIVOTS)[group]
    none = np.full(len(k), np.nan)
    targets, value, where = _Targets(groups["gid"].combine_chunks(), group, tid, k, n[group], pivots, none, none), none.copy(), np.arange(len(k))
    stored, turn = int(n.sum()), 0
    while len(targets):
        turn += 1
        if targets.playing.sum() < TRIM_BELOW * stored:
            chunks = work.write(chunks.mapInArrow(_trimmed(targets), "gid string, vals array<double>").where("size(vals) > 0"), f"{label}-chunks-{turn}")
            stored = int(targets.playing.sum())
        counted = chunks.mapInArrow(_counts(targets), f"target bigint, {_GOT}").repartition("target").mapInArrow(_merged, f"target bigint, {_GOT}")
        got = counted.toArrow().combine_chunks().sort_by("target").to_batches()  # a row per target of the block
        targets, found = targets.advanced(*_as_counts(got[0]))
        done = ~np.isnan(found)
        value[where[done]] = found[done]
        targets, where = targets.only(~done), where[~done]
    return pa.table({"gid": groups["gid"].combine_chunks().take(pa.array(group)), "tid": tid, "n": n[group], "value": value})


def summaries(df: DataFrame, keys: Sequence[str], samples: str, points: int = 50) -> DataFrame:
    """Per group the values at ranks ceil(i * n / points) with the number of ranks each stands for: keys, n, value, weight.

    Any set of summaries can be combined by :func:`merge`; the rank error is at most 1 / points of the combined number.
    """
    found = percentiles(df, [list(keys)], samples, [float(round(Decimal(i) / points, 10)) for i in range(1, points + 1)])
    rank = "CAST(ceil(n * round(p * {0}) / {0}) AS bigint)".format(points)
    before = "CAST(ceil(n * (round(p * {0}) - 1) / {0}) AS bigint)".format(points)
    return found.select(*keys, "n", "value", F.expr(f"{rank} - {before}").alias("weight")).where("weight > 0")


def merge(summary: DataFrame, span: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """Percentiles of longer spans (groups of ``span``) from summaries: span..., n, p, value.

    A span has at most ``points`` rows per summary in it, however many values were summarised.
    """
    from pyspark.sql import Window

    over = Window.partitionBy(*span)
    cum = summary.withColumn("n", F.sum("weight").over(over)).withColumn("cum", F.sum("weight").over(over.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = ", ".join(f"CAST({Decimal(str(p))} AS DECIMAL(20,10))" for p in ps)
    each = cum.withColumn("p", F.explode(F.expr(f"array({wanted})"))).where(F.expr("cum >= greatest(1, ceil(p * n))"))
    return each.groupBy(*span, "p").agg(F.max("n").alias("n"), F.min("value").alias("value")).select(*span, "n", F.col("p").cast("double").alias("p"), "value")
