"""Problem 6: text that was decoded with the wrong character encoding.

Round-trip repair: encode the text as a wrongly chosen encoding would have
read it, decode the bytes strictly as the intended encoding, and keep the
result if a garbling cost drops clearly; repeat for nested layers.  The cost
is the surprise of the text under character pairs and triples counted over the whole
collection, where rightly decoded text prevails, plus fixed charges for what
words don't contain (control characters, drawing characters, mixed scripts).
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import materialize

LOST = "�"
#: Encodings by which bytes are often read though they are not in them.
READ_AS = ("latin-1", "cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "gbk", "cp932", "cp949", "big5")
#: Encodings the bytes may be in.
MEANT_AS = ("utf-8", "cp1251", "cp1250", "cp1252", "cp1253", "cp1254", "koi8-r", "cp866", "gbk", "cp932", "cp949", "euc-jp", "big5")

#: The table of counts has at least four slots for each distinct sequence, within these bounds (8 MB and 64 MB).
_LEAST_SLOTS, _MOST_SLOTS = 1 << 21, 1 << 24
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_C1 = re.compile("[\x80-\x9f]")
_PIECE = regex.compile(r"[^\s/._()\[\]{}]*[^\x00-\x7f](?:[^/._()\[\]{}\x00-\x20])*")
#: Where a character of several bytes may reach beyond a piece: separators that can be its last byte, blanks beyond ASCII.
_ACROSS = re.compile(r"[^\x00-\x7f][\[\]_{}]|[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _code(sequence: str) -> int:
    return zlib.crc32(sequence.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    """A coarse script of a letter, '' for what goes with any script."""
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    kind = unicodedata.category(c)
    if kind[0] == "M" or kind == "Lm":
        return ""
    if kind[0] != "L":
        return "SIGN" if kind in ("So", "Sm", "Sc", "Sk", "Cc", "Cn", "Co", "Cf") else ""
    first = unicodedata.name(c, "?").split(" ")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "HALFWIDTH": "CJK", "FULLWIDTH": "CJK", "HANGUL": "HANGUL"}.get(first, first)


@lru_cache(maxsize=65_536)
def _charge(c: str) -> float:
    """Charge for a character by itself."""
    kind = unicodedata.category(c)
    if kind in ("Cc", "Cn", "Co", "Cs"):
        return 6.0
    if c == "­" or 0x2500 <= ord(c) <= 0x259F:
        return 4.0
    return 0.0


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters, digits and anything beyond ASCII, that hold something beyond ASCII."""
    return [w for w in _WORD.findall(text) if not w.isascii()]


def sequence_counts(strings: list[str]) -> Counter:
    """Characters, pairs and triples (case folded, with word ends) of the distinct words of one record."""
    found: Counter = Counter()
    for w in {w for s in strings for w in words_of(s)}:
        w = "^" + w.lower() + "$"
        found.update(map(str.__add__, w, w[1:]))
        found.update(w[i : i + 3] for i in range(len(w) - 2))
        found.update(w)
    return found


class Cost:
    """Garbling cost of words under the counts; lower is more plausible."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.word = lru_cache(maxsize=200_000)(self._word)

    def _word(self, w: str) -> float:
        low = "^" + w.lower() + "$"
        counts, last, cost = self.counts, len(self.counts) - 1, 0.0
        for i in range(1, len(low)):
            a, b = low[i - 1], low[i]
            before = low[i - 2] if i > 1 else ""
            if a.isascii() and b.isascii() and before.isascii():
                continue
            one, two = counts[_code(a) & last], counts[_code(a + b) & last]
            chance = (min(two, one) + 0.3) / (one + 60.0)
            if before:
                pair = counts[_code(before + a) & last]
                chance = (min(counts[_code(before + a + b) & last], pair, two) + 4.0 * chance) / (pair + 4.0)
            cost -= math.log(chance)
        cost += sum(_charge(c) for c in w)
        scripts = [s for s in map(_script, w) if s]
        cost += 3.0 * sum(x != y for x, y in zip(scripts, scripts[1:]))
        cost += 1.5 * sum(x.islower() and y.isupper() and not y.isascii() for x, y in zip(w, w[1:]))
        return cost

    def __call__(self, text: str, limit: float = math.inf) -> float:
        """The cost of ``text``, or infinity as soon as it is known to reach ``limit``."""
        if limit < math.inf and 6.0 * len(_C1.findall(text)) >= limit:  # what they are charged by themselves
            return math.inf
        total = 0.0
        for w in words_of(text):
            total += self.word(w)
            if total >= limit:
                return math.inf
        return total


@lru_cache(maxsize=64)
def _single_byte(encoding: str) -> dict[int, int] | None:
    """Byte of each character of a single-byte encoding, C1 controls for the bytes it leaves undefined; None for others."""
    if encoding in ("gbk", "cp932", "cp949", "big5"):
        return None
    table = {c: c for c in range(0x80, 0xA0)}
    for byte in range(256):
        try:
            table[ord(bytes([byte]).decode(encoding))] = byte
        except UnicodeDecodeError:
            pass
    return table


def _encoded(text: str, encoding: str) -> bytes | None:
    """Bytes that ``encoding`` reads as ``text``; bytes it leaves undefined read as C1 controls."""
    table = _single_byte(encoding)
    try:
        return text.encode(encoding) if table is None else bytes([table[ord(c)] for c in text])
    except (UnicodeEncodeError, KeyError):
        return None


class Repairer:
    """Round-trip repair of strings.

    ``margin`` is the drop of cost that counts as clear.  Text that decodes
    strictly as UTF-8 is hardly ever so by chance, so ``utf8_margin`` is lower,
    and such a reading is replaced only by one that is cheaper by ``lead``.
    """

    def __init__(self, cost: Cost, margin: float = 1.5, utf8_margin: float = 0.5, lead: float = 4.0, layers: int = 3):
        self.cost, self.margin, self.utf8_margin, self.lead, self.layers = cost, margin, utf8_margin, lead, layers
        self.piece = lru_cache(maxsize=100_000)(self._piece)
        self.whole = lru_cache(maxsize=20_000)(self._whole)

    def _step(self, text: str) -> tuple[str, str, list[str]]:
        """The least garbled re-reading of ``text``, how its bytes were read, and all readings as UTF-8."""
        best, least, meant, utf8 = text, self.cost(text), "", []
        tried = {text}
        for wrong in READ_AS:
            raw = _encoded(text, wrong)
            if raw is None or raw in tried:
                continue
            tried.add(raw)
            for right in MEANT_AS:
                try:
                    other = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if other in tried:
                    continue
                tried.add(other)
                if right == "utf-8":
                    utf8.append(other)
                if (c := self.cost(other, least)) < least:
                    best, least, meant = other, c, right
        return best, meant, utf8

    def _piece(self, text: str) -> str:
        start = self.cost(text)
        best, least, margin = text, start, self.margin
        frontier = [(text, self.margin)]
        for _ in range(self.layers):
            then: list[tuple[str, float, bool]] = []
            for now, need in frontier:
                better, meant, utf8 = self._step(now)
                # a strict reading as UTF-8 is worth a second look though it seems no better by itself
                then += [(s, self.utf8_margin, True) for s in utf8]
                if meant and meant != "utf-8":
                    then.append((better, need, False))
            for s, need, strict in sorted(then, key=lambda x: not x[2]):
                # what was read strictly as UTF-8 gives way to another reading only for a clear gain
                bar = least if strict or margin == self.margin else least - self.lead
                if (c := self.cost(s, bar)) < bar:
                    best, least, margin = s, c, need
            frontier = [(s, need) for s, need, _ in then if not s.isascii()]
            if not frontier:
                break
        drop = start - least
        return best if drop >= margin and drop >= 0.15 * start else text

    def _whole(self, text: str) -> str:
        """One path component: as a whole, or word by word, whichever is less garbled."""
        if text.isascii():
            return text
        if len(_PIECE.findall(text)) == 1 and not _ACROSS.search(text):  # the rest is ASCII and costs nothing
            return _PIECE.sub(lambda m: self.piece(m.group()), text)
        whole = self.piece(text)
        parts = _PIECE.sub(lambda m: self.piece(m.group()), text)
        return whole if self.cost(whole) <= self.cost(parts) else parts

    def repair(self, text: str) -> str:
        return "/".join(map(self.whole, text.split("/")))


_repairers: dict[str, Repairer] = {}


def _for_worker(token: str, shared, margin: float) -> Repairer:
    """The repairer of one call, with its caches, kept between the tasks of a Python worker."""
    if token not in _repairers:
        _repairers.clear()
        _repairers[token] = Repairer(Cost(shared.value), margin)
    return _repairers[token]


def _count_sequences(most: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(map(_code, held)), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["code", "n"])
            held.clear()
            return batch

        for batch in batches:
            for strings in batch.column(0).to_pylist():
                held.update(sequence_counts([s for s in strings if s]))
            if len(held) > most:
                yield flush()
        yield flush()

    return run


def sequence_table(records: DataFrame, strings: str) -> np.ndarray:
    """Sequence counts over all records, in a table by hash whose size (a power of two) follows the distinct sequences.

    Beyond four million distinct sequences the table stays at 64 MB and
    unrelated ones begin to share a slot, rare ones mostly.
    """
    fed = records.select(F.filter(strings, lambda s: s.rlike(r"[^\x00-\x7F]")).alias("s")).where(F.size("s") > 0)
    counted = materialize(fed.mapInArrow(_count_sequences(), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "sequences")
    slots = min(_MOST_SLOTS, max(_LEAST_SLOTS, 1 << (4 * counted.count() - 1).bit_length()))
    got = counted.groupBy(F.col("code").bitwiseAND(slots - 1).alias("slot")).agg(F.sum("n").alias("n")).toArrow()  # at most ``slots`` rows
    table = np.zeros(slots, np.float32)
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    return table


def garbled_strings(records: DataFrame, *, key: str, strings: str, margin: float = 1.5) -> DataFrame:
    """``key, ord, text, repaired`` of every garbled string of the array column ``strings``.

    ``ord`` is the position in the array; ``repaired`` is null where characters
    are lost (U+FFFD) and so the original cannot be recovered.  Null arrays,
    null and empty strings and pure ASCII are never garbled; repeated rows of
    a key give one row for each distinct string; an empty table gives no row.
    Strings are taken whole, whatever their length.

    Two narrow passes: counting (a table of bounded size) and repair (cached by
    string in each worker); only the found strings are shuffled.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(sequence_table(records, strings))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = _for_worker(token, shared, margin)
        for batch in batches:
            keep: list[int] = []
            repaired: list[str | None] = []
            for i, s in enumerate(batch.column(2)):
                s = s.as_py()
                if LOST in s:
                    keep.append(i)
                    repaired.append(None)
                elif (r := fixer.repair(s)) != s:
                    keep.append(i)
                    repaired.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(repaired, pa.string())], names=["k", "ord", "text", "repaired"])

    kind = records.schema[key].dataType.simpleString()
    exploded = records.select(F.col(key).alias("k"), F.posexplode(strings).alias("ord", "text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return exploded.mapInArrow(run, f"k {kind}, ord int, text string, repaired string").distinct().withColumnRenamed("k", key)
