"""Problem 2: the most frequent items of a stream in bounded memory.

A majority-vote sketch.  Each of ``depth`` rows hashes an item to one of
``width`` cells; a cell keeps the total weight that fell into it, one
candidate item and the candidate's vote surplus.  Two cells merge by adding
totals and cancelling votes: equal candidates add their surpluses, else the
stronger one stays with the difference.  For the candidate x of a cell,
``surplus <= f(x) <= (total + surplus) / 2``; any other item y has
``f(y) <= (total - surplus) / 2``.  These bounds survive every merge, so the
order in which tasks and batches come together doesn't matter for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import parts_for

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    a = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)
    a = (a ^ (a >> np.uint64(30))) * _M1
    a = (a ^ (a >> np.uint64(27))) * _M2
    return ((a ^ (a >> np.uint64(31))) % np.uint64(width)).astype(np.int64) + row * width


class VoteSketch:
    """``depth * width`` cells: ``total``, ``surplus``, hash and text of the candidate."""

    def __init__(self, cells: int):
        self.total = np.zeros(cells, np.int64)
        self.surplus = np.zeros(cells, np.int64)
        self.hash = np.zeros(cells, np.int64)
        self.item = np.full(cells, None, object)

    def merge(self, cell: np.ndarray, total: np.ndarray, surplus: np.ndarray, h: np.ndarray, item: np.ndarray) -> None:
        """Merge other cells into these; each index of ``cell`` at most once."""
        mine, held = self.surplus[cell], self.hash[cell]
        same = (held == h) & (self.total[cell] > 0)
        change = ~same & (surplus > mine)
        self.total[cell] += total
        self.surplus[cell] = np.where(same, mine + surplus, np.abs(mine - surplus))
        at = cell[change]
        self.hash[at] = h[change]
        self.item[at] = item[change]

    def add(self, h: np.ndarray, item: np.ndarray, weight: np.ndarray, depth: int, width: int) -> None:
        """Add one batch of items of positive weight.

        Inside a batch weights are summed for each item; the votes of a cell
        then cancel as far as they can, so the surplus is that of a strict
        majority or zero.
        """
        order = np.argsort(h, kind="stable")
        h, weight = h[order], weight[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        item, h, weight = item[order[first]], h[first], np.add.reduceat(weight, first)
        for row in range(depth):
            cell = _cells(h, row, width)
            order = np.lexsort((weight, cell))
            c, w = cell[order], weight[order]
            start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            last = np.r_[start[1:], len(c)] - 1
            total = np.add.reduceat(w, start)
            top = order[last]
            self.merge(c[start], total, np.maximum(0, 2 * w[last] - total), h[top], item[top])


_CELL = "slice bigint, turn bigint, cell bigint, total bigint, surplus bigint, h bigint, item string"


def heavy_items(rows: DataFrame, *, item: str, weight: str | None, share: float, depth: int = 4, width: int = 8192, tasks_per_core: int = 2, bytes_each: int = 256 << 20, fan_in: int = 64) -> DataFrame:
    """``item, weight_lower, weight_upper, total_weight`` of every item that may
    hold at least ``share`` of the total weight.

    No item with that share is missed.  Null items and weights that are null
    or not positive are left out; repeated rows add up; an empty table gives
    no row.  ``depth * width`` cells are all that is held of the distinct
    items, in each task and on the driver, whatever the input; the expected
    excess of ``weight_upper`` is below half of total / width.

    Batches are pre-aggregated before they meet the sketch and the sketch is
    what is shuffled, so a hot item costs no more than any other.  A task reads
    about ``bytes_each`` of the source; sketches are merged ``fan_in`` at a
    time, so no merge gathers those of all tasks.
    """
    kind = rows.schema[item].dataType.simpleString()
    if kind != "string":
        raise TypeError("items must be strings")
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    fed = rows.select(F.xxhash64(item).alias("h"), F.col(item).alias("i"), w.alias("w")).where(F.col("i").isNotNull() & (F.col("w") > 0))
    cells, slice_ = depth * width, max(1, width // 8)

    spark = rows.sparkSession
    tasks = parts_for(rows, bytes_each, max(1, tasks_per_core * spark.sparkContext.defaultParallelism))
    turns = [-(-tasks // fan_in)]  # groups of sketches at each level of the merge
    while turns[-1] > 1:
        turns.append(-(-turns[-1] // fan_in))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = VoteSketch(cells)
        for batch in batches:
            if batch.num_rows:
                s.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), depth, width)
        cell = np.flatnonzero(s.total)
        turn = TaskContext.get().partitionId() % turns[0]
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell // slice_), pa.array(np.full(len(cell), turn)), pa.array(cell), pa.array(s.total[cell]), pa.array(s.surplus[cell]), pa.array(s.hash[cell]), pa.array(s.item[cell], pa.string())], names=["slice", "turn", "cell", "total", "surplus", "h", "item"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, base, level = VoteSketch(slice_), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            base, level = int(cell[0]) // slice_ * slice_, batch.column("turn")[0].as_py()
            others = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("total", "surplus", "h", "item")]
            order = np.argsort(cell, kind="stable")
            turn = np.arange(len(cell)) - np.searchsorted(cell[order], cell[order])
            for t in range(int(turn.max()) + 1):  # one merge for each task's copy of a cell
                at = order[turn == t]
                s.merge(cell[at] - base, others[0][at], others[1][at], others[2][at], others[3][at])
        cell = np.flatnonzero(s.total)
        same = np.ones(len(cell), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(same * (base // slice_)), pa.array(same * level), pa.array(cell + base), pa.array(s.total[cell]), pa.array(s.surplus[cell]), pa.array(s.hash[cell]), pa.array(s.item[cell], pa.string())], names=["slice", "turn", "cell", "total", "surplus", "h", "item"])

    united = fed.coalesce(tasks).mapInArrow(sketch, _CELL)
    for n in turns:
        united = united.withColumn("turn", F.pmod("turn", F.lit(n))).groupBy("slice", "turn").applyInArrow(unite, _CELL)
    got = united.toArrow()  # at most depth * width rows
    total, surplus, h = (np.zeros(cells, np.int64) for _ in range(3))
    name = np.full(cells, None, object)
    at = got["cell"].to_numpy()
    for target, column in ((total, "total"), (surplus, "surplus"), (h, "h"), (name, "item")):
        target[at] = got[column].to_numpy()
    whole = int(total[:width].sum())
    known = {int(x): i for x, i, v in zip(h, name, total) if v}
    keys = np.array(list(known), np.int64)
    lower, upper = np.zeros(len(keys), np.int64), np.full(len(keys), whole, np.int64)
    for row in range(depth):
        if not len(keys):
            break
        cell = _cells(keys, row, width)
        mine = h[cell] == keys
        upper = np.minimum(upper, np.where(mine, total[cell] + surplus[cell], total[cell] - surplus[cell]) // 2)
        lower = np.maximum(lower, np.where(mine, surplus[cell], 0))
    keep = upper >= share * whole
    out = pa.table({"item": pa.array([known[int(k)] for k in keys[keep]], pa.string()), "weight_lower": lower[keep], "weight_upper": upper[keep], "total_weight": np.full(int(keep.sum()), whole, np.int64)})
    return spark.createDataFrame(out)
