from __future__ import annotations

import random

import numpy as np

from quillon.llm.packing import best_pack, containers, pack, pack_items


def first_fit(sizes: list[int], capacity: int) -> int:
    """Containers of first-fit decreasing over all items at once, with items beyond the capacity split."""
    rooms: list[int] = []
    for size in sorted((s % capacity for s in sizes if s % capacity), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(capacity - size)
        else:
            rooms[at] -= size
    return len(rooms) + sum(s // capacity for s in sizes)


def test_every_item_whole_and_no_container_over_its_capacity(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([1, 7, 60, 99, 100, 101, 250, 1000, rng.randrange(1, 120)]) for i in range(2000)}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(5, sizes[5], "copy"), (3000, None, ""), (3001, 0, ""), (None, 5, "")]
    df = spark.createDataFrame(rows, "doc long, size int, piece string")
    caps = spark.createDataFrame([(1, 100), (2, 256), (3, None), (4, 0)], "capacity_id int, capacity int")
    out = pack_items(df, caps, "doc", "size", shard_items=700).toPandas()
    for capacity_id, capacity in ((1, 100), (2, 256)):
        own = out[out.capacity_id == capacity_id]
        assert own.groupby("container").piece_size.sum().max() <= capacity
        pieces = own.sort_values(["doc", "piece"]).groupby("doc")
        assert set(own.doc) == set(sizes)
        for doc, p in pieces:
            assert p.piece_size.sum() == sizes[doc] and list(p.piece) == list(range(len(p)))
            assert list(p.piece_start) == [i * capacity for i in range(len(p))]
            assert len(p) == -(-sizes[doc] // capacity)
    report = {r["capacity_id"]: r for r in containers(pack_items(df, caps, "doc", "size")).collect()}
    assert report[2]["fewest_possible"] <= report[2]["containers"] <= first_fit(list(sizes.values()), 256) + 1


def test_small_cases_against_all_assignments():
    def fewest(sizes: list[int], capacity: int) -> int:
        best = len(sizes)

        def go(i: int, rooms: list[int]) -> None:
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= sizes[i]:
                    go(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, capacity - sizes[i]])

        go(0, [])
        return best

    rng = random.Random(4)
    for _ in range(60):
        sizes = np.sort(np.array([rng.randrange(1, 60) for _ in range(9)]))[::-1]
        assert best_pack(sizes, 60)[1] <= fewest(list(sizes), 60) + 1


def test_lowest_cost_first_and_ties_alike():
    at, n = pack(np.array([50, 50, 30, 20, 10]), 100)
    assert n == 2 and at[0] != at[1] and at[2] == 0 and at[3] == 1
    assert list(pack(np.array([50, 50, 30, 20, 10]), 100)[0]) == list(at)


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, size int")
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity int")
    assert pack_items(df, caps, "doc", "size").count() == 0
    assert pack_items(df, caps.limit(0), "doc", "size").count() == 0


def test_no_capacity_is_dropped(spark):
    df = spark.createDataFrame([(1, 5), (2, 3)], "doc long, size int")
    caps = spark.range(1, 1201).selectExpr("cast(id as int) capacity_id", "cast(id as int) capacity")
    out = pack_items(df, caps, "doc", "size").toPandas()
    assert set(out.capacity_id) == set(range(1, 1201))
    assert all(g.piece_size.sum() == 8 for _, g in out.groupby("capacity_id"))
