"""Problem 1: frequency of every distinct term, counted in burst tries.

Each worker routes terms through a trie of adaptive depth: a leaf is a compact
container of suffixes with their counters, and a container that grows too
large bursts into one leaf for each next character.  Workers see different
parts of the data and so burst at different places; the union of their burst
points is the routing table by which containers are split once more, so that
matching subtrees meet in one group and are merged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import materialize

_TERM = regex.compile(r"[\p{L}\p{N}]+")
#: Ends every stored term; no letter or number, so no term is a prefix of another.
_END = "\0"


def terms_of(text: str) -> list[str]:
    """Maximal runs of Unicode letters and numbers of the lower-cased text."""
    return _TERM.findall(text.lower())


class BurstTrie:
    """Counters of terms; ``leaves`` maps a prefix to its container."""

    def __init__(self, burst: int):
        self.burst = burst
        self.inner: set[str] = set()
        self.leaves: dict[str, dict[str, list[int]]] = {}
        self.size = 0

    def route(self, term: str) -> str:
        n = 0
        while term[:n] in self.inner:
            n += 1
        return term[:n]

    def add(self, term: str, occurrences: int, records: int) -> None:
        term += _END
        at = self.route(term)
        box = self.leaves.setdefault(at, {})
        held = box.get(term[len(at) :])
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return
        box[term[len(at) :]] = [occurrences, records]
        self.size += 1
        while len(box) > self.burst:
            self.inner.add(at)
            del self.leaves[at]
            for suffix, counts in box.items():
                self.leaves.setdefault(at + suffix[0], {})[suffix[1:]] = counts
            at = max((at + c for c in {s[0] for s in box}), key=lambda p: len(self.leaves[p]))
            box = self.leaves[at]


def _packed(prefix: str, box: dict[str, list[int]]) -> tuple[str, str, bytes, bytes]:
    items = sorted(box.items())
    counts = np.array([c for _, c in items], np.int64)
    return prefix, "".join(s if s else _END + _END for s, _ in items), counts[:, 0].tobytes(), counts[:, 1].tobytes()


def _unpacked(text: str, occurrences: bytes, records: bytes):
    """Triples (suffix, occurrences, records) of a packed container."""
    if text.startswith(_END + _END):  # the empty suffix: the term ended in the prefix
        suffixes = ["", *(s + _END for s in text[2:].split(_END)[:-1])]
    else:
        suffixes = [s + _END for s in text.split(_END)[:-1]]
    return zip(suffixes, np.frombuffer(occurrences, np.int64).tolist(), np.frombuffer(records, np.int64).tolist())


_BOX = "prefix string, suffixes string, occ binary, rec binary"
_BOX_TYPES = [pa.string(), pa.string(), pa.binary(), pa.binary()]


def _boxes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BOX_TYPES)], names=["prefix", "suffixes", "occ", "rec"])


def _shared_out(shares: dict[str, int]):
    """Containers of the prefixes in ``shares`` divided by a hash of the suffix; adds ``share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []
            for prefix, text, occ, rec in zip(*(c.to_pylist() for c in batch.columns)):
                n = shares.get(prefix, 1)
                if n == 1:
                    rows.append((prefix, text, occ, rec))
                    of.append(0)
                    continue
                boxes: dict[int, dict[str, list[int]]] = {}
                for suffix, o, r in _unpacked(text, occ, rec):
                    boxes.setdefault(zlib.crc32(suffix.encode("utf-8", "surrogatepass")) % n, {})[suffix] = [o, r]
                rows += [_packed(prefix, b) for b in boxes.values()]
                of += boxes
            yield pa.RecordBatch.from_arrays([*_boxes(rows).columns, pa.array(of, pa.int32())], names=["prefix", "suffixes", "occ", "rec", "share"])

    return run


def _count(burst: int, most_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in batches:
            occurrences: Counter = Counter()
            records: Counter = Counter()
            for s in batch.column(0):
                found = terms_of(s.as_py())
                occurrences.update(found)
                records.update(set(found))
            for term, n in occurrences.items():
                trie.add(term, n, records[term])
            if trie.size > most_terms:
                yield _boxes([_packed(p, b) for p, b in trie.leaves.items() if b])
                trie = BurstTrie(burst)
        yield _boxes([_packed(p, b) for p, b in trie.leaves.items() if b])

    return run


def _align(inner: frozenset[str]):
    """Split containers along the common routing table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for prefix, text, occ, rec in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix not in inner and (not prefix or prefix[:-1] in inner):
                    rows.append((prefix, text, occ, rec))
                    continue
                boxes: dict[str, dict[str, list[int]]] = {}
                for suffix, o, r in _unpacked(text, occ, rec):
                    term = prefix + suffix
                    n = 0
                    while term[:n] in inner:
                        n += 1
                    boxes.setdefault(term[:n], {})[term[n:]] = [o, r]
                rows += [_packed(p, b) for p, b in boxes.items()]
            yield _boxes(rows)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    box: dict[str, list[int]] = {}
    prefix = ""
    for batch in batches:
        for prefix, text, occ, rec in zip(*(c.to_pylist() for c in batch.columns[:4])):
            for suffix, o, r in _unpacked(text, occ, rec):
                held = box.get(suffix)
                if held is None:
                    box[suffix] = [o, r]
                else:
                    held[0] += o
                    held[1] += r
    items = list(box.items())
    for at in range(0, len(items), 50_000):
        part = items[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([(prefix + s)[:-1] for s, _ in part], pa.string()), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())], names=["term", "occurrences", "records"])


def term_counts(records: DataFrame, *, text: str, burst: int = 2048, most_terms: int = 400_000, most_routes: int = 200_000, group_terms: int = 500_000) -> DataFrame:
    """``term, occurrences, records`` of every distinct term of the texts, one row of input being one record.

    Null and empty texts hold no term; repeated rows are records of their own;
    an empty table gives no row.  Each worker holds at most ``most_terms``
    terms before it hands its trie on.  The routing table has at most
    ``most_routes`` burst points, those with most terms below them first; more
    would make groups smaller but change no result.  A group of more than
    ``group_terms`` terms, counted once for each worker that saw them, is
    divided by hash, so the merge too holds a bounded number whatever the
    prefixes.  A term found everywhere arrives once from each worker, so hot
    terms don't skew the merge.
    """
    fed = records.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    boxes = materialize(fed.mapInArrow(_count(burst, most_terms), _BOX), "term-boxes")
    held = F.expr("octet_length(occ) div 8").alias("n")
    above = F.transform(F.sequence(F.lit(0), F.char_length("prefix") - 1), lambda i: F.substring("prefix", F.lit(1), i))
    inner = boxes.where("prefix <> ''").select(F.explode(above).alias("p"), held).groupBy("p").agg(F.sum("n").alias("n"))
    # a prefix has no fewer terms than any longer one, so the first of this order are closed under shortening
    routes = frozenset(r["p"] for r in inner.orderBy(F.desc("n"), F.char_length("p"), "p").limit(most_routes).select("p").collect())
    aligned = materialize(boxes.mapInArrow(_align(routes), _BOX), "term-aligned")
    large = aligned.select("prefix", held).groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > group_terms).collect()  # at most all / group_terms
    shared = aligned.mapInArrow(_shared_out({r["prefix"]: -(-r["n"] // group_terms) for r in large}), _BOX + ", share int")
    return shared.groupBy("prefix", "share").applyInArrow(_merge, "term string, occurrences bigint, records bigint")


def marked_terms(records: DataFrame, *, text: str, fewest: int = 3, most_share: float = 0.05) -> DataFrame:
    """``term_counts`` with ``mark``: 'rare' below ``fewest`` records, 'common' above
    ``most_share`` of the records whose text is neither null nor '', else null."""
    whole = records.where(F.col(text).isNotNull() & (F.col(text) != "")).count()
    mark = F.when(F.col("records") < fewest, "rare").when(F.col("records") > most_share * whole, "common")
    return term_counts(records, text=text).withColumn("mark", mark)
