"""Problem 9: long verbatim spans shared between documents.

Windows are hashed only at *cover positions*: positions whose residue modulo a
period lies in a difference cover.  For any two places in two texts there is a
shift below the period that puts both on cover positions, so any verbatim
match of the wanted length contains, at an aligned place in both texts, one
window that was hashed.  Windows found in more than one document are anchors;
around each anchor every candidate stretch of the wanted length is compared
exactly, which extends the anchor to the full match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.session import materialize, parts_for

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def difference_cover(most: int) -> tuple[int, list[int]]:
    """``(period, residues)``: a perfect difference set with a period of at most ``most``.

    Singer's construction over the field of q elements: the exponents at which
    the powers of a generator of GF(q^3) fall into a plane.  (1, [0]) if even
    q = 2 is too large.
    """
    fits = [q for q in range(2, 200) if all(q % d for d in range(2, q)) and q * q + q + 1 <= most]
    for q in reversed(fits):
        v = q * q + q + 1
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x = (0, 0, 1)  # coefficients of t^2, t, 1
                    found = []
                    for i in range(v):
                        if x[0] == 0:
                            found.append(i)
                        x = ((x[1] + a * x[0]) % q, (x[2] + b * x[0]) % q, (c * x[0]) % q)
                    if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                        return v, found
    return 1, [0]


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * _M1
    a = (a ^ (a >> np.uint64(27))) * _M2
    return a ^ (a >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Polynomial hashes of any window of an array of code points."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, points: np.ndarray) -> np.ndarray:
        n = len(points)
        if n + 1 > len(self.up):
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        return _mix((prefix[at + width] - prefix[at]) * self.down[at])


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Crowds:
    """Windows of which one task has seen many, by a small table of counts.

    The first ``few`` anchors of a window and those of as many more documents
    go the usual way; after that its anchors are told apart (``sure``).  Two
    windows that share a slot may be taken for a crowd together: that costs
    work, as every anchor is compared exactly in the end, and changes nothing.
    """

    def __init__(self, few: int, slots: int = 1 << 20):
        self.few, self.last = few, np.int64(slots - 1)
        self.anchors, self.docs = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.told: set[int] = set()

    def sure(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the anchors are of a crowd, and the hashes that became one just now."""
        slot = h.astype(np.int64) & self.last
        crowd = self.docs[slot] > self.few
        self.anchors += np.bincount(slot, minlength=len(self.anchors))
        many = self.anchors[slot] > self.few
        pairs = np.unique(np.stack([owner[many], slot[many]]), axis=1)[1]
        self.docs += np.bincount(pairs, minlength=len(self.docs))
        fresh = set(np.unique(h[crowd]).tolist()) - self.told
        self.told |= fresh
        return crowd, np.array(sorted(fresh), np.uint64)


_SURE, _MARK = 1, 2
_CROWD = np.int64(1) << np.int64(60)


def _anchor_blobs(length: int, buckets: int, few: int, chars_each: int = 1_500_000):
    """Map side: anchors of many texts as one packed row for each bucket; copies met in one task count once.

    A window met in very many documents of one task is surely shared: a mark
    goes to its bucket, and its further anchors go, flagged, to buckets chosen
    by document, so that no bucket gets more than a bounded number from a task.
    """
    period, residues = difference_cover(int(0.7 * length))
    width = length - period + 1
    names = ["bucket", "kind", "doc", "n", "h_low", "h_high", "p_low", "p_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        cover = np.zeros(0, np.int64)
        known: set[int] = set()
        crowds = _Crowds(few)

        def flush(keys: list[int], texts: list[str]):
            nonlocal cover
            sizes = np.array([len(t) for t in texts])
            if sizes.max() > len(cover) * period // len(residues) - period:
                blocks = int(sizes.max()) // period + 2
                cover = (np.arange(blocks)[:, None] * period + np.array(residues)).ravel()
            starts = np.cumsum(sizes) - sizes
            prefix = rolling.prefix(_points("".join(texts)))
            counts = np.searchsorted(cover, sizes - width + 1)
            at = np.concatenate([cover[:c] for c in counts])
            owner = np.repeat(np.arange(len(keys)), counts)
            h = rolling.windows(prefix, at + starts[owner], width) >> np.uint64(16)
            ids = np.array(keys, np.int64)
            crowd, marks = crowds.sure(h, owner)
            bucket = np.where(crowd, (_mix(ids.view(np.uint64)) % np.uint64(buckets))[owner], h % np.uint64(buckets)).astype(np.int64)
            kind = np.where(crowd, _SURE, 0)
            if len(marks):  # a mark is a row without a place
                h, at, owner = np.r_[h, marks], np.r_[at, np.zeros(len(marks), np.int64)], np.r_[owner, np.zeros(len(marks), np.int64)]
                bucket, kind = np.r_[bucket, (marks % np.uint64(buckets)).astype(np.int64)], np.r_[kind, np.full(len(marks), _MARK)]
            order = np.lexsort((kind, bucket)) if kind.any() else np.argsort(bucket, kind="stable")
            h, at, owner, bucket, kind = h[order], at[order], owner[order], bucket[order], kind[order]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
            rows = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
                o = owner[lo:hi]
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                n = np.diff(np.r_[first, len(o)]).astype(np.uint32)
                x, p = h[lo:hi], at[lo:hi]
                rows.append((int(bucket[lo]), int(kind[lo]), ids[o[first]].tobytes(), n.tobytes(), x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes(), p.astype(np.uint16).tobytes(), (p >> 16).astype(np.uint16).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(zip(*rows))], names=names)

        for batch in batches:
            keys: list[int] = []
            texts: list[str] = []
            held = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k in known:  # a copy: its anchors are there already
                    continue
                known.add(k)
                t = t.as_py()
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held >= chars_each:
                    yield flush(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield flush(keys, texts)

    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the anchors of one bucket (a partition) whose window occurs in two documents or more.

    ``members`` is their number, or ``_CROWD`` where a mark says that there are more elsewhere.
    """
    doc, h, pos, marks = [], [], [], []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[1:]]
        for kind, d, n, hl, hh, pl, ph in zip(*cols):
            hash_ = np.frombuffer(hl, np.uint32).astype(np.int64) | np.frombuffer(hh, np.uint16).astype(np.int64) << 32
            if kind == _MARK:
                marks.append(hash_)
                continue
            doc_ = np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32))
            pos_ = np.frombuffer(pl, np.uint16).astype(np.int32) | np.frombuffer(ph, np.uint16).astype(np.int32) << 16
            if kind == _SURE:
                yield from pa.table({"doc": doc_, "pos": pos_, "cls": hash_, "members": np.full(len(doc_), _CROWD)}).to_batches()
                continue
            doc.append(doc_)
            h.append(hash_)
            pos.append(pos_)
    if not doc:
        return
    doc, h, pos = np.concatenate(doc), np.concatenate(h), np.concatenate(pos)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    some = size > 1  # drop windows seen once before gathering the rest
    if marks:
        some |= np.isin(h[first], np.concatenate(marks))
    few = np.repeat(some, size)
    order, h, size = order[few], h[few], size[some]
    if not len(h):
        return
    doc, pos = doc[order], pos[order]
    first = np.r_[0, np.cumsum(size)[:-1]]
    shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    if marks:
        crowd = np.isin(h[first], np.concatenate(marks))
        shared, size_ = shared | crowd, np.where(crowd, _CROWD, size)
    else:
        size_ = size
    keep = np.repeat(shared, size)
    yield from pa.table({"doc": doc[keep], "pos": pos[keep], "cls": h[keep], "members": np.repeat(size_, size)[keep].astype(np.int64)}).to_batches()


def _contexts(length: int, width: int, buckets: int):
    """Each anchor with the text around it that any match of ``length`` through it can use."""
    reach = length - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for d, t, anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                t = t.as_py()
                for a in anchors:
                    p = a["pos"]
                    lead = min(p, reach)
                    for col, v in zip(out, (a["cls"] % buckets, d, p, a["cls"], lead, t[p - lead : p + width + reach])):
                        col.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _CTX)], names=list("bdpclt"))
                    out = [[], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _CTX)], names=list("bdpclt"))

    return run


_CTX = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]


def _extend(length: int, width: int):
    """Exact extension inside one bucket of anchor classes.

    For every shift x the stretch of ``length`` that begins x before the
    anchor is compared with the same stretch of the other members of its
    class, by sorting, never by pairs.
    """
    reach = length - width
    wide = length + reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        doc, pos, cls = (table.column(i).to_numpy() for i in (1, 2, 3))
        lead = table.column(4).to_numpy().astype(np.int64)
        texts = table.column(5).to_pylist()
        n = len(texts)
        sizes = np.array([len(t) for t in texts])
        points = np.zeros((n, wide), np.uint32)
        column = np.arange(wide)
        used = (column >= (reach - lead)[:, None]) & (column < (reach - lead + sizes)[:, None])
        points[used] = _points("".join(texts))
        up = _powers(_BASE, wide)
        prefix = np.zeros((n, wide + 1), np.uint64)
        for at in range(0, n, 4096):
            np.cumsum(_mix(points[at : at + 4096].astype(np.uint64) + np.uint64(1)) * up, axis=1, out=prefix[at : at + 4096, 1:])
        del points
        tail = sizes - lead - width
        salt = _mix(cls.astype(np.uint64))
        low, high = np.full(n, -1), np.full(n, -1)
        for x in range(reach + 1):
            rows = np.flatnonzero((lead >= x) & (tail >= reach - x))
            if len(rows) < 2:
                continue
            key = _mix(prefix[rows, reach - x + length] - prefix[rows, reach - x]) ^ salt[rows]
            order = np.argsort(key)
            key, d = key[order], doc[rows][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            hit = rows[order[np.repeat(shared, np.diff(np.r_[first, len(key)]))]]
            low[hit[low[hit] < 0]] = x
            high[hit] = x
        found = low >= 0
        yield from pa.table({"doc": doc[found], "a": (pos[found] - high[found]).astype(np.int64), "z": (pos[found] - low[found] + length).astype(np.int64)}).to_batches()

    return run


def _stretches(length: int, width: int):
    """All stretches of ``length`` through the anchors of a text, hashed, each once."""
    reach = length - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        for batch in batches:
            for d, t, anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                t = t.as_py()
                pos = np.array([a["pos"] for a in anchors], np.int64)
                at = np.unique((pos[:, None] - np.arange(reach + 1)).ravel())
                at = at[(at >= 0) & (at + length <= len(t))]
                h = rolling.windows(rolling.prefix(_points(t)), at, length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(h), pa.array(at)], names=["doc", "h", "a"])

    return run


def shared_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = 50_000, few: int = 64, bucket_bytes: int = 6 << 20, bucket_anchors: int = 16_000) -> DataFrame:
    """``key, span_start, span_end``: maximal runs of characters that lie in a
    stretch of at least ``length`` code points found verbatim under another key.

    Null keys and null texts take no part; texts below ``length`` have no span;
    equal rows of one key count as one document; a stretch repeated only inside
    one document is not shared.  Equal texts under different keys are shared
    whole.  Keys are expected to name one text each; if one names several, the
    spans of all are united.

    Equal texts form a class (by a 64-bit hash) and are searched once: a class
    of two keys or more is shared whole, and its members get the spans of the
    class by a join at the end.  Anchors travel packed, about ten bytes each,
    into buckets whose number follows the size of the input.  Of a window that
    one task meets in very many documents no more than about ``few`` anchors
    and as many documents go to its bucket, the others are spread over all; such a window, and any of more
    than ``hot`` anchors, is extended by counting its stretches in a plain
    aggregation with map-side combine instead of in one task, with the same
    result.
    """
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("the key must be an integer")
    period, _ = difference_cover(int(0.7 * length))
    width = length - period + 1
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).where(F.col("key").isNotNull() & (F.char_length("t") >= length))
    buckets = parts_for(docs, bucket_bytes)
    members = materialize(source.select("key", F.xxhash64("t").alias("doc"), F.char_length("t").cast("bigint").alias("z")), "span-members")
    classes = members.groupBy("doc").agg(F.min("key").alias("rep"), F.max("key").alias("last"), F.max("z").alias("z"))
    packed = source.select(F.xxhash64("t").alias("doc"), "t").mapInArrow(_anchor_blobs(length, buckets, few), "bucket bigint, kind bigint, doc binary, n binary, h_low binary, h_high binary, p_low binary, p_high binary")
    by_bucket = packed.repartitionById(buckets, F.col("bucket").cast("int"))
    anchors = materialize(by_bucket.mapInArrow(_shared_anchors, "doc bigint, pos int, cls bigint, members bigint"), "span-anchors")
    total = anchors.count()

    def with_text(chosen: DataFrame) -> DataFrame:
        """Each class with anchors once, with its text from the row of its least key."""
        per_class = chosen.groupBy("doc").agg(F.collect_set(F.struct("pos", "cls")).alias("anchors"))
        wanted = per_class.join(classes.select("doc", "rep"), "doc").select(F.col("rep").alias("key"), "doc", "anchors")
        texts = source.repartition(buckets, "key").join(wanted.repartition(buckets, "key").hint("shuffle_hash"), "key")
        return texts.where(F.xxhash64("t") == F.col("doc")).select("doc", "t", "anchors")

    groups = max(1, -(-total // bucket_anchors))
    cold = with_text(anchors.where(F.col("members") <= hot)).mapInArrow(_contexts(length, width, groups), "b bigint, d bigint, p int, c bigint, l int, t string")
    spans = cold.repartitionById(groups, F.col("b").cast("int")).mapInArrow(_extend(length, width), "doc bigint, a bigint, z bigint")
    if anchors.where(F.col("members") > hot).limit(1).count():
        stretches = materialize(with_text(anchors.where(F.col("members") > hot)).mapInArrow(_stretches(length, width), "doc bigint, h bigint, a bigint"), "span-hot")
        twice = stretches.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h")
        spans = spans.unionByName(stretches.join(twice, "h").select("doc", "a", (F.col("a") + length).alias("z")))
    copied = classes.where("rep <> last").select("doc", F.lit(0).cast("bigint").alias("a"), "z")
    found = _merge(spans.unionByName(copied))
    out = members.select("key", "doc").distinct().join(found, "doc").select(F.col("key").cast(kind).alias("doc"), F.col("span_start").alias("a"), F.col("span_end").alias("z"))
    return _merge(out).withColumnRenamed("doc", key)


def _merge(spans: DataFrame) -> DataFrame:
    """Union of the intervals [a, z) of each document; adjacent ones join."""
    order = Window.partitionBy("doc").orderBy("a", "z")
    before = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc", "run").agg(F.min("a").alias("span_start"), F.max("z").alias("span_end")).drop("run")


def shared_share(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, shared_chars, share`` of every document; null text gives null share, '' gives 0."""
    per = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("s"))
    n = F.char_length(text).cast("bigint")
    base = docs.select(F.col(key), n.alias("n_chars"))
    shared = F.when(F.col("n_chars").isNotNull(), F.coalesce("s", F.lit(0)).cast("bigint"))
    return base.join(per, key, "left").select(key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).when(F.col("n_chars") == 0, F.lit(0.0)).alias("share"))
