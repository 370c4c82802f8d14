"""Problem 8: filling containers of fixed capacity from a length histogram."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.session import materialize


def plan_patterns(histogram: dict[int, int], capacity: int, rule: str = "shortest") -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns ``(count, [(length, times), ...])`` for a histogram of lengths.

    Lengths are placed longest first, a whole pattern count at a time, so the
    work follows the number of distinct lengths and not the number of items.
    ``rule`` chooses the open packs that are extended: 'shortest' takes the
    shortest pack first, the one with the most room, and gives each of its
    containers one item before the next shortest is looked at; 'longest' takes
    the pack with the least room that still fits and fills it.  Only when no
    open pack fits, new packs are opened.
    """
    if rule not in ("shortest", "longest"):
        raise ValueError("rule must be 'shortest' or 'longest'")
    open_by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []  # sorted rooms with open patterns
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(count: int, slots: list[tuple[int, int]], room: int) -> None:
        if room == 0:
            done.append((count, slots))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((count, slots))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError("a length must lie in 1..capacity")
        while left:
            at = len(rooms) - 1 if rule == "shortest" else bisect_left(rooms, length)
            if not 0 <= at < len(rooms) or rooms[at] < length:  # nothing fits: as many new packs as full ones take
                times = min(capacity // length, left)
                count = left // times
                put(count, [(length, times)], capacity - length * times)
                left -= count * times
                continue
            room = rooms[at]
            count, slots = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            times = 1 if rule == "shortest" else min(room // length, left)
            used = min(count, left // times)
            if used < count:
                put(count - used, slots, room)
            if slots[-1][0] == length:
                slots = [*slots[:-1], (length, slots[-1][1] + times)]
            else:
                slots = [*slots, (length, times)]
            put(used, slots, room - length * times)
            left -= used * times
    for groups in open_by_room.values():
        done += groups
    return done


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """Arrays (length, first rank, container base, offset), sorted by length and rank.

    The items of one length are numbered 0, 1, ...; a slot of a pattern used
    ``count`` times takes the next ``count`` of them, one for each container.
    """
    taken: dict[int, int] = {}
    rows = []
    base = 0
    for count, slots in patterns:
        offset = 0
        for length, times in slots:
            for _ in range(times):
                rank = taken.get(length, 0)
                rows.append((length, rank, base, offset))
                taken[length] = rank + count
                offset += length
        base += count
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4


def pack(items: DataFrame, *, key: str, size: str, capacity: int, rule: str = "shortest", bucket_rows: int = 100_000) -> DataFrame:
    """``key, piece, start, n, container, position`` for every item.

    An item above ``capacity`` is cut into full pieces and a rest, numbered by
    ``piece`` and ``start``; no other item is cut.  Null, zero and negative
    sizes are left out; a null key is an item like any other; repeated rows
    are items of their own.  ``container`` counts from 0 without gaps,
    ``position`` is the place inside it.

    Packs are chosen shortest first, or by ``rule`` (see ``plan_patterns``).
    The histogram has at most ``capacity`` rows and goes to the driver; the
    patterns come back as slot arrays whose size depends on the distinct
    lengths.  Ranks inside a length are counted in buckets, so a length that
    holds a third of all rows is ranked by many tasks.
    """
    kind = items.schema[key].dataType.simpleString()
    sized = items.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("s")).where("s > 0")
    full = F.expr(f"s div {capacity}")
    pieces = sized.select("k", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(s - 1) div {capacity}"))).alias("piece")).select(
        "k", "piece", F.when(F.col("piece") < full, capacity).otherwise(F.col("s") % capacity).cast("bigint").alias("n")
    )
    counted = materialize(pieces, "pack-pieces")
    total = counted.count()
    buckets = max(1, -(-total // bucket_rows))
    bucket = F.pmod(F.xxhash64("k", "piece"), F.lit(buckets))
    by_bucket = counted.withColumn("b", bucket)
    counts = by_bucket.groupBy("n", "b").count()
    histogram = {r["n"]: r["c"] for r in counts.groupBy("n").agg(F.sum("count").alias("c")).collect()}
    slot_arrays = _slots(plan_patterns(histogram, capacity, rule))
    before = Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("n", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("n", "b").orderBy("k", "piece")
    ranked = by_bucket.withColumn("r", F.row_number().over(inside) - 1).join(firsts.hint("shuffle_merge"), ["n", "b"]).select("k", "piece", "n", (F.col("r") + F.col("first")).alias("rank"))
    shared = items.sparkSession.sparkContext.broadcast(slot_arrays)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, base, offset = shared.value
        lo = {int(x): int(i) for i, x in zip(*np.unique(length, return_index=True)[::-1])}
        hi = {int(x): lo[int(x)] + int(c) for x, c in zip(*np.unique(length, return_counts=True))}
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            container, position = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n):
                rows = np.flatnonzero(n == x)
                a, b = lo[int(x)], hi[int(x)]
                slot = a + np.searchsorted(first[a:b], rank[rows], side="right") - 1
                container[rows] = base[slot] + rank[rows] - first[slot]
                position[rows] = offset[slot]
            start = batch.column(1).to_numpy() * capacity
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start), batch.column(2), pa.array(container), pa.array(position)], names=["k", "piece", "start", "n", "container", "position"])

    placed = ranked.mapInArrow(place, f"k {kind}, piece bigint, start bigint, n bigint, container bigint, position bigint")
    return placed.withColumnRenamed("k", key)
