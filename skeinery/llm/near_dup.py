"""Problem 5: near-duplicate records under small edits, by bit-sliced comparison.

A record is the set of its runs (three consecutive terms).  Records with equal
sets form a class and only one of them goes on.  Two sets with a Jaccard
similarity of at least t share a run among the first ``n - ceil(t n) + 1`` of
either, in any common order of runs; here rare runs come first.  Records that
meet at such a run are compared by fingerprints: the parities of their runs
over 256 positions, whose Hamming distance never exceeds the number of runs
that only one of the two has, so no similar pair is lost.  Fingerprints are
stored as vertical bit planes, 64 records a word; distances of a record to 64
others grow together in carry-save counters, and a block is left as soon as
all its distances exceed the radius.  What remains is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import materialize, release

_TERM = regex.compile(r"[\p{L}\p{N}]+")
BITS = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def runs_of(strings: list[str | None]) -> set[tuple[str, ...]]:
    """Distinct runs of three consecutive terms inside each string; one run of all terms where there are fewer."""
    found: set[tuple[str, ...]] = set()
    for s in strings:
        if s:
            t = _TERM.findall(s.lower())
            if len(t) > 2:
                found.update(zip(t, t[1:], t[2:]))
            elif t:
                found.add(tuple(t))
    return found


def _run_hashes(strings: list[str | None]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest("\0".join(r)) for r in runs_of(strings)], np.uint64).view(np.int64)
    h.sort()
    return h


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [_run_hashes(s or []) for s in batch.column(1).to_pylist()]
        offsets = np.zeros(len(sets) + 1, np.int32)
        np.cumsum([len(s) for s in sets], out=offsets[1:])
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "runs"])


def fingerprints(owner: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """Parities of ``BITS`` positions as four words for each of ``n`` owners of ``runs``."""
    at = owner * BITS + ((runs.view(np.uint64) >> np.uint64(17)).astype(np.int64) & (BITS - 1))
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def _looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Count of each of ``wanted`` among the sorted ``keys``, 0 where it isn't one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _steps(times: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``times``, one after another."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _meeting_keys(batch: pa.RecordBatch, share: float, hot_runs: np.ndarray, hot_counts: np.ndarray, most: int):
    """Where the classes of a batch (c, runs) must meet what is similar to them: (row, key, is a pair) and the fingerprints.

    A class meets others at the runs of its prefix, rare runs first.  A run of
    more than ``most`` classes would bring together too many, so there the key
    is the run with a later one of a prefix longer by one: similar sets of two
    runs or more in common share two in such prefixes.
    """
    offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
    runs = batch.column(1).values.to_numpy()[offsets[0] : offsets[-1]]
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    count = _looked_up(hot_runs, hot_counts, runs)
    order = np.lexsort((runs, count, owner))
    run, count, rank = runs[order], count[order], _steps(n)
    need = np.ceil(share * n - 1e-9).astype(np.int64)
    first = n - need + 1
    inside = rank < first[owner]
    crowded = inside & (count > most)
    single = np.flatnonzero(inside & (~crowded | (need[owner] < 2)))
    at = np.flatnonzero(crowded)
    times = np.minimum(first[owner[at]], n[owner[at]] - 1) - rank[at]
    left = np.repeat(at, times)
    right = left + 1 + _steps(times)
    mixed = (run[left].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (run[right].view(np.uint64) >> np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    rows = np.r_[owner[single], owner[left]]
    return rows, np.r_[run[single], mixed], np.arange(len(rows)) >= len(single), n, fingerprints(owner, runs, len(n))


def _pair_keys(share: float, hot_runs: np.ndarray, hot_counts: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key, pair, _, _ = _meeting_keys(batch, share, hot_runs, hot_counts, most)
            yield pa.RecordBatch.from_arrays([pa.array(key[pair])], names=["key"])

    return run


def _prefixes(share: float, hot_runs: np.ndarray, hot_counts: np.ndarray, most: int, heavy: np.ndarray, heavy_counts: np.ndarray):
    """For each class its fingerprint at each of its keys; a key of more than ``most`` classes is spread over a grid of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, _, n, prints = _meeting_keys(batch, share, hot_runs, hot_counts, most)
            c = batch.column(0).to_numpy()
            parts = np.maximum(1, -(-_looked_up(heavy, heavy_counts, key) // most))
            mine = ((c[row].view(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)).astype(np.int64) % parts
            row, key, mine, parts, other = np.repeat(row, parts), np.repeat(key, parts), np.repeat(mine, parts), np.repeat(parts, parts), _steps(parts)
            side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.int32)
            tile = np.minimum(mine, other) * parts + np.maximum(mine, other)
            for start in range(0, len(row), 50_000):
                s = slice(start, start + 50_000)
                p = np.ascontiguousarray(prints[row[s]])
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(tile[s]), pa.array(side[s]), pa.array(c[row[s]]), pa.array(n[row[s]].astype(np.int32)), _binaries(p)], names=["run", "tile", "side", "c", "n", "p"])

    return run


def _binaries(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (BITS // 8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _add(counter: list[np.ndarray], bit: np.ndarray) -> None:
    """Carry-save increment of bit-sliced counters by one plane."""
    for i, c in enumerate(counter):
        counter[i], bit = c ^ bit, c & bit
        if not bit.any():
            return
    counter.append(bit)


def _sum3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _at_most(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose counter is at most ``radius`` (one for each row)."""
    less = np.zeros_like(counter[0])
    equal = np.full_like(counter[0], _ALL)
    for i in reversed(range(max(len(counter), int(radius.max()).bit_length()))):
        bound = np.where(radius >> i & 1, _ALL, np.uint64(0))
        mine = counter[i] if i < len(counter) else np.zeros_like(less)
        less |= equal & bound & ~mine
        equal &= ~(bound ^ mine)
    return less | equal


def _sliced_distances(planes: np.ndarray, bits: np.ndarray, q: np.ndarray, b: np.ndarray, alive: np.ndarray, radius: np.ndarray):
    """Distances of queries ``q`` to the lanes ``alive`` of blocks ``b``; blocks are
    left once no lane is within ``radius``.  Gives (query, block * 64 + lane, distance)."""
    counter = [np.zeros(len(q), np.uint64)]
    for at in range(0, BITS, 16):
        level = [planes[j][b] ^ (np.uint64(0) - bits[q, j].astype(np.uint64)) for j in range(at, at + 15)]
        weight = 0
        while level:  # carry-save adders: 15 planes become one of each weight 1, 2, 4, 8
            up = []
            while len(level) > 2:
                s, c = _sum3(level.pop(), level.pop(), level.pop())
                level.append(s)
                up.append(c)
            for plane in level:
                while len(counter) <= weight:
                    counter.append(np.zeros(len(q), np.uint64))
                tail = counter[weight:]
                _add(tail, plane)
                counter[weight:] = tail
            level, weight = up, weight + 1
        _add(counter, planes[at + 15][b] ^ (np.uint64(0) - bits[q, at + 15].astype(np.uint64)))
        alive &= _at_most(counter, radius)
        some = alive != 0
        if some.mean() < 0.7:
            q, b, alive, radius = q[some], b[some], alive[some], radius[some]
            counter = [c[some] for c in counter]
            if not len(q):
                break
    lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64), np.uint8)
    row, lane = np.nonzero(lanes)
    distance = np.zeros(len(row), np.int64)
    for weight, plane in enumerate(counter):
        distance += ((plane[row] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
    return q[row], b[row] * 64 + lane, distance


def bit_sliced_pairs(group: np.ndarray, side: np.ndarray, size: np.ndarray, prints: np.ndarray, share: float, each: int = 60_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of equal ``group`` within the radius; rows come sorted by group and size.

    ``side`` 1 and 2 mark the two halves of a tile, compared only with each
    other; side 0 is compared with itself.  ``each`` comparisons of a query
    with a block of 64 are in work at a time.
    """
    n = len(group)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(bits.reshape(words, 64, BITS), axis=1, bitorder="little").transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0].T.copy()
    widest = int(size.max(initial=1)) + 1  # rows come by size inside a group: what is too large for a query lies behind its last
    last = np.searchsorted(group * widest + size, group * widest + np.minimum(np.floor(size / share + 1e-9).astype(np.int64), widest - 1), side="right") - 1
    factor = (1 - share) / (1 + share)
    radius = np.floor(factor * (size + np.floor(size / share + 1e-9)) + 1e-9).astype(np.int64)  # no larger set is similar
    query = np.flatnonzero(last > np.arange(n))
    blocks = last[query] // 64 - query // 64 + 1
    found = []
    ends = np.cumsum(blocks)
    start = 0
    while start < len(query):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - blocks[start] + each, side="right")))
        own, count = query[start:stop], blocks[start:stop]
        q = np.repeat(own, count)
        b = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + q // 64
        low, high = np.maximum(q + 1 - b * 64, 0), np.minimum(last[q] + 1 - b * 64, 64)
        keep = high > low
        q, b, low, high = q[keep], b[keep], low[keep], high[keep]
        width = (high - low).astype(np.uint64)
        alive = np.where(width == 64, _ALL, (np.uint64(1) << (width & np.uint64(63))) - np.uint64(1)) << low.astype(np.uint64)
        found.append(_sliced_distances(planes, bits, q, b, alive, radius[q]))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, distance = (np.concatenate(c) for c in zip(*found))
    ok = (distance <= np.floor(factor * (size[i] + size[j]) + 1e-9)) & (np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j]) - 1e-9)
    ok &= ((side[i] == 0) & (side[j] == 0)) | (side[i] + side[j] == 3)
    return i[ok], j[ok]


def _compare(share: float):
    def run(table: pa.Table) -> pa.Table:
        run_, tile = table["run"].to_numpy(), table["tile"].to_numpy()
        side, c, n = table["side"].to_numpy(), table["c"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        prints = np.frombuffer(b"".join(table["p"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        order = np.lexsort((c, n, tile, run_))
        run_, tile, side, c, n, prints = run_[order], tile[order], side[order], c[order], n[order], prints[order]
        group = np.cumsum(np.r_[0, (run_[1:] != run_[:-1]) | (tile[1:] != tile[:-1])])
        i, j = bit_sliced_pairs(group, side, n, prints, share)
        pairs = np.unique(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


class Records:
    """Classes of equal records and the similar pairs between them."""

    def __init__(self, records: DataFrame, *, key: str, strings: str, share: float = 0.7, most_hot: int = 1_000_000, least_hot: int = 20, tile: int = 16_384, rows_each: int = 20_000):
        """``strings`` is an array column; null arrays and null, empty or
        term-less strings add nothing, and a record without any run is similar
        to none.  Keys come out as strings, null keys are left out.  Repeated
        rows of a key are one record; should their strings differ, one row
        with a run counts, that of the least hash.

        A run is hot from ``least_hot`` classes on, or more where that many
        runs would be more than ``most_hot``; a key at which more than ``tile``
        classes meet is spread over tiles; ``rows_each`` rows go to a group.
        """
        runs = records.select(F.col(key).cast("string").alias("id"), F.col(strings).alias("s")).where("id is not null").mapInArrow(_hash_runs, "id string, runs array<bigint>")
        rows = materialize(runs.withColumn("c", F.xxhash64("runs")), "dup-rows")
        self.members = materialize(rows.groupBy("id").agg(F.min(F.struct((F.size("runs") == 0).alias("none"), "c")).alias("k")).select("id", F.when(~F.col("k.none"), F.col("k.c")).alias("c")), "dup-members")
        self.classes = materialize(rows.where(F.size("runs") > 0).groupBy("c").agg(F.min("runs").alias("runs")), "dup-classes")
        release(rows)
        counted = self.classes.select(F.explode("runs").alias("run")).groupBy("run").count()
        n = F.size("runs")
        sums = self.classes.agg(F.sum(n).alias("runs"), F.sum(n - F.ceil(n * share - 1e-9) + 1).alias("rows")).first()
        total, emitted = sums["runs"] or 0, sums["rows"] or 0
        least = max(least_hot, -(-total // most_hot))  # at most ``most_hot`` runs occur that often
        got = counted.where(F.col("count") > least).toArrow().sort_by("run")
        hot = (got["run"].to_numpy(), got["count"].to_numpy())
        heavy = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(hot[1]) and hot[1].max() > tile:  # how many classes the pairs of very hot runs bring together
            keys = materialize(self.classes.select("c", "runs").mapInArrow(_pair_keys(share, *hot, tile), "key bigint").groupBy("key").count(), "dup-keys")
            got = keys.where(F.col("count") > tile).toArrow().sort_by("key")  # fewer than rows / tile
            heavy = (got["key"].to_numpy(), got["count"].to_numpy())
            emitted += keys.agg(F.sum(F.col("count") * F.ceil(F.col("count") / tile))).first()[0] or 0
        prefixes = self.classes.select("c", "runs").mapInArrow(_prefixes(share, *hot, tile, *heavy), "run bigint, tile bigint, side int, c bigint, n int, p binary")
        groups = max(1, emitted // rows_each)
        grouped = prefixes.groupBy(F.pmod(F.xxhash64("run", "tile"), F.lit(groups)).alias("g"))
        candidates = grouped.applyInArrow(_compare(share), "a bigint, b bigint").distinct()
        sets = self.classes.select("c", "runs")
        left = sets.select(F.col("c").alias("a"), F.col("runs").alias("x"))
        right = sets.select(F.col("c").alias("b"), F.col("runs").alias("y"))
        both = candidates.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        similar = F.col("common") >= F.lit(share) * (F.size("x") + F.size("y") - F.col("common")) - 1e-9
        self.pairs = materialize(both.where(similar).select("a", "b"), "dup-pairs")

    def record_pairs(self) -> DataFrame:
        """``id_a, id_b`` of all similar records, members of a class included, smaller id first."""
        m = self.members.where("c is not null")
        a, b = m.select(F.col("c").alias("a"), F.col("id").alias("x")), m.select(F.col("c").alias("b"), F.col("id").alias("y"))
        across = self.pairs.join(a, "a").join(b, "b").select("x", "y")
        inside = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, group_id, links`` of every record: the least id of its connected
        group and the number of records similar to it."""
        size = self.members.where("c is not null").groupBy("c").agg(F.count("*").alias("members"), F.min("id").alias("first"))
        ends = self.pairs.unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.join(size.select(F.col("c").alias("b"), "members"), "b").groupBy("a").agg(F.sum("members").alias("near"))
        label = components(self.pairs)
        root = size.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        names = root.groupBy("root").agg(F.min("first").alias("group_id"))
        per = root.join(names, "root").join(near.withColumnRenamed("a", "c"), "c", "left")
        found = per.select("c", "group_id", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
        out = self.members.join(found, "c", "left")
        return out.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` of all nodes in ``pairs`` (a, b): the least node connected to each.

    Alternating large-star and small-star steps; every step is a grouped
    minimum with map-side combine and its result a written table, so neither a
    hub nor a long chain gathers in one task.
    """
    edges = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u's neighbour v
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then = materialize(small.select("v", "u"), "cc")
        stamp = then.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        edges = then
        if stamp == before:
            break
        before = stamp
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
