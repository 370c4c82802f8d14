"""Problem 4: has this key been seen before, without keeping all earlier keys.

Keys are spread over shards by hash; in each shard they arrive in order.  The
keys of the current batch are held exactly.  When the batch is full it is
sealed: its keys become an immutable fingerprint filter, built by peeling, of
about 1.25 fingerprints a key, and the keys themselves are forgotten.  A new
key is probed against all sealed generations and, if none knows it, against
the current batch.  Batches grow with what is sealed, so the number of
generations grows with the logarithm of the keys.

A key that was seen is always found.  A new key is wrongly called seen with
the compounded chance of the generations it is probed against; the expected
number of wrong answers is therefore told by the new keys, not by the answers
"seen", most of which are right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import parts_for

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * _M1
    a = (a ^ (a >> np.uint64(27))) * _M2
    return a ^ (a >> np.uint64(31))


class PeeledFilter:
    """Immutable filter over 64-bit hashes: no false negatives, false positives 2**-bits.

    Each key owns three slots, one in each third of the table; the stored
    fingerprints are chosen so that the three slots of a key xor to its own
    fingerprint.  The order of assignment comes from peeling: keys that are
    alone in some slot are removed again and again, here a whole layer at a
    time, and assigned in reverse.
    """

    def __init__(self, hashes: np.ndarray, bits: int = 32):
        if bits not in (8, 16, 32):
            raise ValueError("bits must be 8, 16 or 32")
        self.bits = bits
        self.kind = {8: np.uint8, 16: np.uint16, 32: np.uint32}[bits]
        keys = np.unique(hashes.astype(np.uint64))
        self.third = int(1.25 * len(keys) / 3) + 16
        for seed in range(1000):
            self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            layers = self._peel(keys)
            if layers is not None:
                break
            if seed % 20 == 19:
                self.third += self.third // 8 + 1
        else:
            raise RuntimeError("peeling failed")
        self.table = np.zeros(3 * self.third, self.kind)
        slots, prints = self._slots(keys)
        for rows, owned in reversed(layers):
            s = slots[:, rows]
            self.table[owned] = 0
            self.table[owned] = prints[rows] ^ self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(hashes + self.seed)
        g = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
        third, low = np.uint64(self.third), np.uint64(0xFFFFFFFF)
        slots = np.stack([((h & low) * third) >> np.uint64(32), (((h >> np.uint64(32)) * third) >> np.uint64(32)) + third, (((g & low) * third) >> np.uint64(32)) + third + third])
        return slots.astype(np.int64), (g >> np.uint64(32)).astype(self.kind)

    def _peel(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        slots, _ = self._slots(keys)
        index = np.arange(len(keys), dtype=np.int64)
        flat = slots.ravel()
        count = np.bincount(flat, minlength=3 * self.third)
        which = np.zeros(3 * self.third, np.int64)
        np.bitwise_xor.at(which, flat, np.tile(index, 3))
        layers, left = [], len(keys)
        single = np.flatnonzero(count == 1)
        while left:
            if not len(single):
                return None
            rows, first = np.unique(which[single], return_index=True)
            layers.append((rows, single[first]))
            touched = slots[:, rows].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(which, touched, np.tile(rows, 3))
            left -= len(rows)
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        return layers

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(hashes.astype(np.uint64))
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints


class Generations:
    """Sealed filters and the exact current batch of one shard."""

    def __init__(self, batch_keys: int, bits: int):
        self.least, self.bits = batch_keys, bits
        self.filters: list[PeeledFilter] = []
        self.sealed = 0
        self.current: dict[bytes, int] = {}

    def error(self) -> float:
        """Chance that a key never seen is called seen: compounded over the generations."""
        return 1.0 - (1.0 - 2.0**-self.bits) ** len(self.filters)

    def _full(self) -> int:
        return max(self.least, self.sealed // 4)

    def room(self) -> int:
        """Keys that may come before the current batch is full, at least a quarter of a batch."""
        return max(self._full() - len(self.current), self._full() // 4, 1)

    def test_and_add(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """For keys in order of arrival: NEW, BATCH (in the exact batch) or FILTER (in a sealed one).  Then all are seen."""
        how = np.full(len(keys), NEW, np.int8)
        for f in reversed(self.filters):  # the largest generations come last
            rest = np.flatnonzero(how == NEW)
            if not len(rest):
                break
            how[rest[f.contains(hashes[rest])]] = FILTER
        current = self.current
        for i in np.flatnonzero(how == NEW).tolist():
            k = keys[i]
            if k in current:
                how[i] = BATCH
            else:
                current[k] = int(hashes[i])
        if len(current) >= self._full():
            self.filters.append(PeeledFilter(np.fromiter(current.values(), np.uint64, len(current)), self.bits))
            self.sealed += len(current)
            self.current = {}
        return how


NEW, SLICE, BATCH, FILTER = range(4)
HOW = ("new", "slice", "batch", "filter")


class HotKeys:
    """The most frequent keys of a stream in ``size`` counters; every key held has occurred."""

    def __init__(self, size: int):
        self.size = size
        self.count: dict[bytes, int] = {}

    def seen(self, key: bytes) -> bool:
        """Is the key held?  It is counted; if all counters are taken by others they all lose one."""
        count = self.count
        if key in count:
            count[key] += 1
            return True
        if len(count) < self.size:
            count[key] = 1
        else:
            self.count = {k: n - 1 for k, n in count.items() if n > 1}
        return False


def seen_before(rows: DataFrame, *, order: str, key: str, bits: int = 32, batch_keys: int = 512, hot_keys: int = 64, bytes_each: int = 12 << 20) -> DataFrame:
    """``order, seen, how, chance`` for every distinct ``order`` whose key is not null.

    ``seen`` says whether the (binary) key occurs under a smaller ``order``.
    Rows with a null order or key are left out; repeated rows of one order
    count once and are not earlier than themselves.  A key that was seen is
    always found.  ``how`` tells where: 'slice' and 'batch' are exact, 'filter'
    may be wrong, 'new' keys are surely new.  ``chance`` is the compounded
    chance, at the time of the test, that a new key would have been called seen
    (0 where the answer did not come from the filters).

    First pass: slices in order, each with counters for ``hot_keys`` frequent
    keys, or twice as many as there are shards; a repetition of a key held
    there is exactly "seen" and leaves its key behind.  A key that holds a
    third of all rows thus loads its shard with no more than a usual shard
    holds.  All other rows go on.  Second pass: shards by key, streamed
    in order against the generations; a shard holds its filters and one batch.
    """
    kind = rows.schema[order].dataType.simpleString()
    fed = rows.select(F.col(order).alias("o"), F.col(key).alias("k")).where(F.col("o").isNotNull() & F.col("k").isNotNull())
    parts = parts_for(rows, bytes_each)
    counters = max(hot_keys, 2 * parts)

    def first_in_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = HotKeys(counters)
        last = None
        for batch in batches:
            orders, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            fresh = np.ones(len(orders), bool)
            if len(orders):
                fresh[0], fresh[1:] = last is None or orders[0] != last, orders[1:] != orders[:-1]
                last = orders[-1]
            at = pa.array(np.flatnonzero(fresh))
            keys = keys.take(at)
            known = np.fromiter(map(hot.seen, keys.to_pylist()), bool, len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pc.if_else(pa.array(known), None, keys)], names=["o", "k"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Generations(batch_keys, bits)
        names = pa.array(HOW)
        for batch in batches:
            keys = batch.column(1)
            how = np.full(batch.num_rows, SLICE, np.int8)
            chance = np.zeros(batch.num_rows)
            at = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
            held, hashes = keys.drop_null().to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)[at].astype(np.int64).view(np.uint64)
            start = 0
            while start < len(at):  # no further than the batch may grow before it is sealed
                s = slice(start, start + state.room())
                chance[at[s]] = state.error()
                how[at[s]] = state.test_and_add(held[s], hashes[s])
                start = s.stop
            chance[(how == SLICE) | (how == BATCH)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(how != NEW), names.take(pa.array(how)), pa.array(chance)], names=["o", "seen", "how", "chance"])

    slices = fed.repartitionByRange(parts, "o").sortWithinPartitions("o").mapInArrow(first_in_slice, f"o {kind}, k binary")
    shards = slices.repartition(parts, F.coalesce("k", F.col("o").cast("string").cast("binary"))).sortWithinPartitions("o")
    tested = shards.select("o", "k", F.xxhash64("k").alias("h")).mapInArrow(probe, f"o {kind}, seen boolean, how string, chance double")
    return tested.withColumnRenamed("o", order)


def error_rate(tested: DataFrame) -> DataFrame:
    """One row: answers, how many say "seen" and how they were found, and the expected number and rate of wrong ones.

    A new key is called seen with chance c, so for each that was not, c / (1 - c)
    others were; ``wrong_rate`` is the share of wrong answers among those "seen".
    """
    wrong = F.coalesce(F.sum(F.when(F.col("how") == "new", F.col("chance") / (1 - F.col("chance")))), F.lit(0.0))
    counts = [F.count_if(F.col("how") == h).alias(f"from_{h}") for h in HOW[1:]]
    t = tested.agg(F.count("*").alias("answers"), F.count_if("seen").alias("seen"), *counts, wrong.alias("expected_wrong"))
    return t.withColumn("wrong_rate", F.when(F.col("seen") > 0, F.col("expected_wrong") / F.col("seen")).otherwise(0.0))
