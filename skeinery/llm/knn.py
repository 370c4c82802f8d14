"""Problem 3: the most similar vectors of every vector, by an adaptive dimension scan.

Vectors are quantised integers; the score is their cosine.  Vectors with equal
numbers form a class, searched once.  The index has two levels: cells around
centroids fitted on a sample by the driver, and inside each cell lists of a few
hundred vectors whose centroids the cell's own task fits.  A vector goes once
to each cell it probes, however many lists it searches there.  Inside a list
the vectors are rotated at random and stored in blocks of columns.  After each
block the distance so far is put to a hypothesis test: a candidate whose
partial distance is too large to come from a true neighbour is abandoned.

With a least score the same kind of test already chooses cells and lists: a
neighbour of at least that score lies in another cell than the nearest only if
its part across the query points there, which for a random direction is a
normal variable of known spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.session import materialize

BLOCK = 32


def rotation(dim: int) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit vectors; empty lists restart at the least well placed vectors."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        home, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        for at in range(0, len(x), 8192):
            s = x[at : at + 8192] @ c.T
            home[at : at + 8192] = s.argmax(1)
            best[at : at + 8192] = s.max(1)
        order = np.argsort(home, kind="stable")
        at, size = np.unique(home[order], return_index=True)[1], np.bincount(home, minlength=lists)
        sums = np.add.reduceat(x[order], at, axis=0)
        c[size > 0] = sums
        empty = np.flatnonzero(size == 0)
        c[empty] = x[np.argsort(best)[: len(empty)]]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def reachable(scores: np.ndarray, home: np.ndarray, at: np.ndarray, centroids: np.ndarray, least: float, z: float) -> np.ndarray:
    """Whether a neighbour of cosine ``least`` or more may lie in the cells ``at`` of each row.

    ``scores`` are the row's cosines to the cells ``at``, the best of which is
    ``home``.  A neighbour is ``least * x + sqrt(1 - least**2) * u`` with u
    across x; it is nearer to cell j than to home only if u leans towards the
    difference of the two centroids by more than the gap of the scores.  For a
    random u that is a normal variable; beyond ``z`` deviations the cell is left out.
    """
    gap = scores.max(1, keepdims=True) - scores
    apart = 2.0 - 2.0 * np.einsum("ijk,ik->ij", centroids[at], centroids[home])
    across = np.sqrt(np.maximum(apart - gap * gap, 0.0))
    return gap * (least / np.sqrt(max(1.0 - least * least, 1e-9))) <= across * (z / np.sqrt(max(1, centroids.shape[1] - 1))) + 1e-6


def scan(queries: np.ndarray, bound: np.ndarray, members: np.ndarray, keep: int, significance: float = 2.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``keep`` members of each query among those that beat ``bound`` (a cosine); ties with the last come too.

    Both sides are rotated unit vectors.  Gives (query, member, score) rows.
    With squared distance t of the k-th neighbour over all D dimensions, a
    candidate with more than ``t * d / D * (1 + significance / sqrt(d))**2``
    over the first d is abandoned.
    """
    dim, n = queries.shape[1], len(members)
    limit = np.maximum(2.0 - 2.0 * bound, 1e-5).astype(np.float32)
    blocks = [(d, min(d + BLOCK, dim)) for d in range(0, dim, BLOCK)]
    # under each block of columns its squares and ones: one product gives |m|^2 - 2 q.m less what is allowed
    columns = [np.vstack([members[:, a:b].T, np.einsum("ij,ij->i", members[:, a:b], members[:, a:b])[None], np.ones((1, n), np.float32)]) for a, b in blocks]
    out_q, out_m, out_s = [], [], []
    each = min(len(queries), max(1, 400_000 // max(1, n)))
    total, add, below = np.empty(each * n, np.float32), np.empty(each * n, np.float32), np.empty(each * n, bool)  # fresh arrays would cost more than the sums
    for start in range(0, len(queries), each):
        x, t = queries[start : start + each], limit[start : start + each]
        over, step, alive = (a[: len(x) * n].reshape(len(x), n) for a in (total, add, below))
        rows = cols = value = None
        own, before = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
        for (a, b), column in zip(blocks, columns):
            part = x[:, a:b]
            own += np.einsum("ij,ij->i", part, part)
            allowed = t * np.float32(b / dim * (1 + significance / np.sqrt(b)) ** 2) if b < dim else t * np.float32(1 + 1e-5) + np.float32(1e-6)
            if rows is None:
                left_side = np.hstack([part * np.float32(-2.0), np.ones((len(x), 1), np.float32), (before - (allowed - own))[:, None]])
                before = allowed - own
                if a == 0:
                    np.matmul(left_side, column, out=over)
                else:
                    over += np.matmul(left_side, column, out=step)
                np.less_equal(over, 0, out=alive)
                left = np.count_nonzero(alive)
                if b == dim and left > 4 * keep * len(x) and n > keep:  # many left: only what is as near as the keep-th of its row
                    last = np.partition(over, keep - 1, axis=1)[:, keep - 1] + np.float32(4e-6)
                    alive &= over <= last[:, None]
                if b == dim or left < 0.05 * alive.size:
                    flat = np.flatnonzero(alive)
                    rows, cols = flat // n, flat % n
                    value = over.ravel()[flat] + allowed[rows]
            elif len(rows):
                value = value + ((part[rows] - column[:-2, cols].T) ** 2).sum(1)
                near = value <= allowed[rows]
                rows, cols, value = rows[near], cols[near], value[near]
            else:
                break
        if not len(rows):
            continue
        if len(rows) > keep:
            order = np.lexsort((value, rows))
            rows, cols, value = rows[order], cols[order], value[order]
            first = np.searchsorted(rows, rows)
            last = np.minimum(first + keep - 1, np.searchsorted(rows, rows, side="right") - 1)
            top = value <= value[last] + 4e-6
            rows, cols, value = rows[top], cols[top], value[top]
        out_q.append(rows + start)
        out_m.append(cols)
        out_s.append(1.0 - value / 2.0)
    return (np.concatenate(out_q), np.concatenate(out_m), np.concatenate(out_s)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The int8 rows of a column of equally long binaries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), np.int8)
    start, stop = column.offset * dim, (column.offset + len(column)) * dim
    return np.frombuffer(column.buffers()[2], np.int8)[start:stop].reshape(-1, dim)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 65_536):
        x, y = a[at : at + 65_536].astype(np.float64), b[at : at + 65_536].astype(np.float64)
        out[at : at + 65_536] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return out


#: Kept beyond k inside a list, so that rounding in the scan cannot cost a tie.
_SPARE = 3


def search_cell(x: np.ndarray, is_query: np.ndarray, is_member: np.ndarray, turn: np.ndarray, k: int, least: float | None, fine_size: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (query row, member row) of one cell; ``turn`` is each row's rank of this cell among its own.

    Members are divided into lists around centroids fitted here.  With
    ``least`` a query searches the lists that pass the test of ``reachable``;
    without it the nearest lists, fewer the farther the cell, its best list
    first, which sets the bound for the others.
    """
    qi, mi = np.flatnonzero(is_query), np.flatnonzero(is_member)
    if not len(qi) or not len(mi):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, q = x[mi], x[qi]
    lists = max(1, len(m) // fine_size)
    fine = fit_centroids(m[:: max(1, len(m) // (32 * lists))], lists, 4)
    home = (m @ fine.T).argmax(1)
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(lists + 1))
    scores = q @ fine.T
    best = scores.argmax(1)
    if least is not None:
        every = np.broadcast_to(np.arange(lists), scores.shape)
        wanted = np.empty(scores.shape, bool)
        for at in range(0, len(q), 2048):
            s = slice(at, at + 2048)
            wanted[s] = reachable(scores[s], best[s], every[s], fine, least, z)
        rounds = [wanted]
    else:
        many = np.minimum(lists, np.maximum(2, -(-64 // (turn[qi] + 1))))
        rank = np.argsort(np.argsort(-scores, axis=1), axis=1)
        first = rank == 0
        rounds = [first, (rank < many[:, None]) & ~first]
    bound = np.full(len(q), -1.0 if least is None else least, np.float32)
    top = np.full((len(q), k), -2.0, np.float32)
    found_q, found_m, found_s = [], [], []
    for wanted in rounds:
        for f in range(lists):
            rows, at = np.flatnonzero(wanted[:, f]), order[ends[f] : ends[f + 1]]
            if not len(rows) or not len(at):
                continue
            i, j, s = scan(q[rows], bound[rows], m[at], k + 1 + _SPARE)
            i, j = rows[i], at[j]
            other = qi[i] != mi[j]
            i, j, s = i[other], j[other], s[other]
            found_q.append(i)
            found_m.append(j)
            found_s.append(s)
            if least is None and len(i):
                by = np.lexsort((-s, i))
                i, s = i[by], s[by]
                turn_ = np.arange(len(i)) - np.searchsorted(i, i)
                few = turn_ < k
                touched, inverse = np.unique(i[few], return_inverse=True)
                new = np.full((len(touched), k), -2.0, np.float32)
                new[inverse, turn_[few]] = s[few]
                both = np.concatenate([top[touched], new], axis=1)
                top[touched] = -np.partition(-both, k - 1, axis=1)[:, :k]
                bound[touched] = np.maximum(top[touched].min(1) - np.float32(4e-6), -1.0)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, s = np.concatenate(found_q), np.concatenate(found_m), np.concatenate(found_s)
    near = s >= bound[i] - 1e-5
    return qi[i[near]], mi[j[near]]


def neighbours(
    vectors: DataFrame, *, key: str, vector: str, dim: int, k: int = 5, least: float | None = None, cell_size: int = 4096, fine_size: int = 256,
    reach: int = 8, sample: int = 65_536, part: int = 16_384, query_part: int = 60_000, z: float = 2.5,
) -> DataFrame:
    """``key, rank, neighbour, score``: for every key its ``k`` most similar others.

    ``score`` is the cosine of the integer vectors; equal scores rank the
    smaller key first.  With ``least`` only neighbours of at least that score
    are looked for.  Rows whose vector is null, has a null, has not ``dim``
    elements or is all zero, and null keys, take no part; keys are expected to
    be unique.  Fewer than k + 1 vectors give fewer neighbours; an empty table
    gives no row.

    Cells hold about ``cell_size`` vectors, or four times the square root of
    the number of vectors where that is more, so routing and search grow with
    n ** 1.5.  Their centroids are fitted on about ``sample`` vectors, never
    fewer than 16 a cell and never more than twice that; all vectors are
    assigned.  A query goes to at most ``reach`` cells, or 1.7 times the square
    root of their number where that is more.  A cell of more than ``part``
    vectors (as the sample tells) is split into parts, each searched by all
    queries of the cell, and queries are split into groups of about
    ``query_part``, so no task holds an unbounded cell; equal vectors meet only
    as one class, of which the k + 1 least keys are carried along.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    usable = (F.size(vector) == dim) & F.exists(vector, lambda e: e != 0) & ~F.exists(vector, lambda e: e.isNull())
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<tinyint>").alias("q")).where(F.col("id").isNotNull() & usable)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1)
            flat = q.flatten()
            v = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.array(np.arange(len(q) + 1, dtype=np.int32) * dim).buffers()[1], pa.py_buffer(flat.to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), v], names=["id", "v"])

    members = materialize(rows.mapInArrow(packed, f"id {kind}, v binary").withColumn("c", F.xxhash64("v")), "knn-members")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = materialize(first.groupBy("c").agg(F.min("v").alias("v"), F.array_sort(F.collect_list("id")).alias("heads")), "knn-classes")
    n = classes.count()
    cells = int(max(1, n // max(cell_size, 4 * int(np.sqrt(n)))))
    step = max(1, -(-n // max(sample, 16 * cells)))
    # in the order of the classes, so the same vectors always give the same centroids
    got = classes.where(F.pmod("c", F.lit(step)) == 0).select("c", "v").limit(2 * max(sample, 16 * cells)).toArrow().sort_by("c")
    spin = rotation(dim)
    x = unit(_matrix(got["v"], dim)) @ spin if got.num_rows else np.ones((1, dim), np.float32)
    cells = min(cells, len(x))
    centroids = fit_centroids(x, cells)
    reach = min(cells, max(reach, int(np.ceil(1.7 * np.sqrt(cells)))))
    shared = spark.sparkContext.broadcast(centroids)  # the square root of n rows at most

    def targets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each row, nearest first, and whether the row asks there."""
        c = shared.value
        scores = x @ c.T
        at = np.argpartition(-scores, reach - 1, axis=1)[:, :reach]
        own = np.take_along_axis(scores, at, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        at, own = np.take_along_axis(at, order, 1), np.take_along_axis(own, order, 1)
        asks = np.ones(at.shape, bool) if least is None else reachable(own, at[:, 0], at, c, least, z)
        return at, asks

    homes, asked = np.zeros(cells), np.zeros(cells)
    for start in range(0, len(x), 4096):
        at, asks = targets(x[start : start + 4096])
        homes += np.bincount(at[:, 0], minlength=cells)
        asked += np.bincount(at[asks], minlength=cells)
    parts = np.maximum(1, np.ceil(homes / len(x) * n / part)).astype(np.int64)
    groups = np.maximum(1, np.ceil(asked / len(x) * n / query_part)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once to every cell, part and group where it is member, query (1) or both (2)."""
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                b = batch.slice(start, 4096)
                c = b.column(0).to_numpy()
                at, asks = targets(unit(_matrix(b.column(1), dim)) @ spin)
                row, rank = np.nonzero(asks)
                cell = at[row, rank]
                row, rank, cell = (np.repeat(a, parts[cell]) for a in (row, rank, cell))
                fresh = np.r_[True, (row[1:] != row[:-1]) | (rank[1:] != rank[:-1])] if len(row) else np.zeros(0, bool)
                part_ = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
                group = (c[row] >> 23) % groups[cell]
                home = at[:, 0]
                mine = (c >> 11) % parts[home]
                both = (rank == 0) & (part_ == mine[row])
                # as a member to the other query groups of its own part
                more = np.repeat(np.arange(len(c)), groups[home])
                mgroup = np.arange(len(more)) - np.repeat(np.cumsum(groups[home]) - groups[home], groups[home])
                other = mgroup != (c[more] >> 23) % groups[home[more]]
                more, mgroup = more[other], mgroup[other]
                source = np.r_[row, more]
                is_member = np.r_[both, np.ones(len(more), bool)]
                heads = b.column(2).take(pa.array(np.where(is_member, source, -1), mask=~is_member))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[cell, home[more]].astype(np.int32)), pa.array(np.r_[part_, mine[more]].astype(np.int32)), pa.array(np.r_[group, mgroup].astype(np.int32)),
                        pa.array(np.r_[np.where(both, 2, 1), np.zeros(len(more))].astype(np.int32)), pa.array(np.r_[rank, np.zeros(len(more))].astype(np.int32)),
                        pa.array(c[source]), b.column(1).take(pa.array(source)), heads,
                    ],
                    names=["cell", "part", "grp", "role", "turn", "c", "v", "heads"],
                )

    hit = f"array<struct<s: double, id: {kind}>>"

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        role, c, v = table["role"].to_numpy(), table["c"].to_numpy(), _matrix(table["v"], dim)
        i, j = search_cell(unit(v) @ spin, role != 0, role != 1, table["turn"].to_numpy(), k, least, fine_size, z)
        score = _exact(v[i], v[j])
        if least is not None:
            i, j, score = i[score >= least], j[score >= least], score[score >= least]
        heads = table["heads"].combine_chunks()
        held = np.diff(heads.offsets.to_numpy()) if len(heads) else np.zeros(0, np.int64)
        held = np.where(role != 1, held, 0)
        twins = np.flatnonzero((role == 2) & (held > 1))  # the keys of the query's own class
        i, j, s = np.r_[i, twins], np.r_[j, twins], np.r_[-score, np.full(len(twins), -1.0)]
        times, starts = held[j], heads.offsets.to_numpy()[:-1][j] if len(heads) else j
        at = np.repeat(starts, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        own = np.repeat(i == j, times)
        flat = pa.table({"q": np.repeat(i, times), "own": own, "s": np.repeat(s, times), "id": heads.values.take(pa.array(at))}).sort_by([("q", "ascending"), ("own", "ascending"), ("s", "ascending"), ("id", "ascending")])
        q, own = flat["q"].to_numpy(), flat["own"].to_numpy()
        keep = (np.arange(len(q)) - np.searchsorted(q, q) < k) | own
        flat, q = flat.filter(pa.array(keep)), q[keep]
        rows, first = np.unique(q, return_index=True)
        hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)].astype(np.int32)), pa.StructArray.from_arrays([flat["s"].combine_chunks(), flat["id"].combine_chunks()], names=["s", "id"]))
        return pa.table({"c": c[rows], "hits": hits})

    sent = classes.select("c", "v", "heads").mapInArrow(send, f"cell int, part int, grp int, role int, turn int, c bigint, v binary, heads array<{kind}>")
    found = sent.groupBy("cell", "part", "grp").applyInArrow(search, f"c bigint, hits {hit}")
    best = found.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    mine = members.select("id", "c").join(best, "c").select("id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    out = mine.select("id", F.posexplode("hits").alias("rank", "h"))
    return out.select(F.col("id").alias(key), (F.col("rank") + 1).alias("rank"), F.col("h.id").alias("neighbour"), (-F.col("h.s")).alias("score"))
