"""Filling fixed-capacity containers with items of varying length by cost-balanced packing.

Every item is given the cost a * length + b * length**2 (linear layers plus attention). Items are assigned in descending length
to the container of lowest cost so far that still has room; a container is opened when none has. An item longer than the
capacity is split: its full pieces fill containers of their own, its remainder is packed like an item. No other item is split.

Lowest cost alone fills all containers alike and leaves a small gap in each that no item fits (1.4 % of the space at capacity 2048
on the test documents). Items up to ``tight`` x capacity therefore go to the fullest container that takes them, the lowest cost
deciding among equals. Of the values of ``tight`` in ``TIGHT`` a shard uses the first, that is the best balanced, that needs the
fewest containers.

Only (id, length) pairs are shuffled, never texts. They are hashed into shards of about ``shard_items`` items, whose number
follows the counted input, and every shard is packed by itself; a hot source or author cannot make a shard large. A shard wastes
less than its last container, about ``capacity / (shard_items * mean length)`` of the space, whatever the size of the input.

The containers of a shard are opened up to the fewest that could hold its items, so that the balancing has choice but cannot
spread the items over more containers than needed.

Defined results for edge cases: items of null or non-positive length have no size and are not packed; capacities that are null or
not positive are ignored; equal lengths go by id; a repeated id is packed once, with its largest length; an empty table or no
capacity gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a shard, on average.
SHARD_ITEMS = 4096
#: Capacities up to which their table is broadcast.
BROADCAST_ROWS = 100_000
#: Shares of the capacity up to which items are placed tightly, the best balanced first.
TIGHT = (0.0, 0.25, 0.5)
OUT = "capacity_id int, capacity int, container long, {id} {kind}, piece int, piece_start long, piece_size long"


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None, tight: float = 0.0) -> tuple[np.ndarray, int]:
    """Container numbers of items in descending size, none above ``capacity``, and the number of containers.

    ``quadratic`` defaults to 1 / capacity, at which the attention of one full-length item costs as much as its linear part.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    costs = linear * sizes + quadratic * sizes.astype(float) ** 2
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, load, used = np.full(n + len(sizes), capacity, np.int64), np.zeros(n + len(sizes)), n
    out = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = np.flatnonzero(room[:used] >= size)
        if len(fits) and size <= tight * capacity:
            left = room[fits]
            fits = fits[left == left.min()]
        if len(fits):
            at = fits[np.argmin(load[fits])]
        else:
            at, used = used, used + 1
        out[i] = at
        room[at] -= size
        load[at] += costs[i]
    kept, out = np.unique(out, return_inverse=True)
    return out, len(kept)


def best_pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """:func:`pack` with the first value of ``TIGHT`` that needs the fewest containers."""
    fewest = -(-int(sizes.sum()) // capacity)
    best = pack(sizes, capacity, tight=TIGHT[0])
    for tight in TIGHT[1:]:
        if best[1] <= fewest:
            break
        best = min(best, pack(sizes, capacity, tight=tight), key=lambda x: x[1])
    return best


def pack_items(df: DataFrame, capacities: DataFrame, item_id: str, size: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per item and piece for each capacity: capacity_id, capacity, container, item id, piece, piece_start, piece_size.

    ``capacities`` is a small fixed table (capacity_id int, capacity int); containers are numbered per capacity, not densely.
    """
    items = df.where((F.col(size) > 0) & F.col(item_id).isNotNull()).groupBy(item_id).agg(F.max(F.col(size).cast("long")).alias("__size"))
    caps = capacities.where(F.col("capacity") > 0).select(F.col("capacity_id").cast("int").alias("__cap_id"), F.col("capacity").cast("int").alias("__cap"))
    shards = max(1, -(-df.where(F.col(size) > 0).count() // shard_items))
    kind = items.schema[item_id].dataType.simpleString()
    work = items.withColumn("__shard", F.pmod(F.xxhash64(item_id), F.lit(shards)).cast("int"))
    # As many rows as items x capacities. Two ints per capacity are broadcast, if the counted table is small; else Spark plans the product.
    schema = OUT.format(id=f"`{item_id}`", kind=kind)
    known = caps.count()
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    work = work.select(F.col(item_id).alias("__id"), "__size", "__shard").crossJoin(F.broadcast(caps) if known <= BROADCAST_ROWS else caps)
    names = ["capacity_id", "capacity", "container", item_id, "piece", "piece_start", "piece_size"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(key[2]), int(key[0])
        full = (pdf["__size"] // capacity).to_numpy()
        rest = (pdf["__size"] % capacity).to_numpy()
        ids = pdf["__id"].to_numpy()
        whole = np.repeat(np.arange(len(pdf)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        some = np.flatnonzero(rest)
        some = some[np.lexsort((ids[some], -rest[some]))]
        at, opened = best_pack(rest[some], capacity) if len(some) else (np.empty(0, np.int64), 0)
        row, piece = np.concatenate([some, whole]), np.concatenate([full[some], piece])
        container = np.concatenate([at, opened + np.arange(len(whole))]) + (shard << 32)
        lengths = np.concatenate([rest[some], np.full(len(whole), capacity)])
        columns = [key[1], capacity, container, ids[row], piece, piece * capacity, lengths]
        return pd.DataFrame({n: pd.Series(c, index=range(len(row))) for n, c in zip(names, columns)})

    return work.groupBy("__shard", "__cap_id", "__cap").applyInPandas(run, schema)


def containers(packed: DataFrame) -> DataFrame:
    """Per capacity: items' total size, containers used, the fewest possible, and the share of unused space."""
    per = packed.groupBy("capacity_id", "capacity", "container").agg(F.sum("piece_size").alias("s"))
    out = per.groupBy("capacity_id", "capacity").agg(F.sum("s").alias("total_size"), F.count(F.lit(1)).alias("containers"))
    return out.select(
        "*",
        F.ceil(F.col("total_size") / F.col("capacity")).alias("fewest_possible"),
        F.round(1 - F.col("total_size") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"),
    )
