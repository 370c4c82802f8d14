"""Spelling help from the catalogue's own vocabulary."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinery.functions import text as T

_VOWELS = frozenset("aeiıoöuüy")


def skeleton(word: str) -> str:
    """Lower case without vowels but for the first character, repeats squeezed."""
    out = ""
    for i, c in enumerate(word.lower()):
        if (i and c in _VOWELS) or out.endswith(c):
            continue
        out += c
    return out


def edit_distance(a: str, b: str, budget: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, no part edited twice; ``budget + 1`` if beyond."""
    if abs(len(a) - len(b)) > budget:
        return budget + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        if min(row) > budget:
            return budget + 1
        rows.append(row)
    return rows[-1][-1]


class Vocabulary:
    """Known terms with their frequency, found again by skeleton or by first letter and length."""

    def __init__(self, terms: Iterable[tuple[str, int]]):
        self.known: dict[str, int] = {}
        self._by_skeleton: dict[str, list[str]] = defaultdict(list)
        self._by_shape: dict[tuple[str, int], list[str]] = defaultdict(list)
        for term, frequency in terms:
            t = term.lower()
            if len(t) >= 3:
                self.known[t] = frequency
                self._by_skeleton[skeleton(t)].append(t)
                self._by_shape[t[0], len(t)].append(t)

    def __contains__(self, word: str) -> bool:
        return word.lower() in self.known

    def _by_sound(self, w: str) -> dict[str, int]:
        key = skeleton(w)
        if len(key) < 2:
            return {}
        near = ((t, edit_distance(w, t, 2)) for t in self._by_skeleton.get(key, []) if abs(len(t) - len(w)) <= 2)
        return {t: d for t, d in near if d <= 2}

    def _by_letters(self, w: str) -> dict[str, int]:
        shapes = (t for n in (len(w) - 1, len(w), len(w) + 1) for t in self._by_shape.get((w[0], n), []))
        return {t: d for t in shapes if (d := edit_distance(w, t, 1)) <= 1}

    def suggestions(self, word: str, most: int) -> list[str]:
        """Closest known terms, then the more frequent; none for short or known words."""
        w = word.lower()
        if len(w) < 4 or w in self.known:
            return []
        found = self._by_letters(w) | self._by_sound(w)
        return sorted(found, key=lambda t: (found[t], -self.known[t]))[:most]

    def suggest(self, word: str) -> str | None:
        """One correction: the most frequent of the same skeleton, else the closest of the same shape."""
        w = word.lower()
        if len(w) < 4 or w in self.known:
            return None
        if sound := self._by_sound(w):
            return max(sound, key=lambda t: self.known[t])
        letters = self._by_letters(w)
        return min(letters, key=lambda t: (letters[t], -self.known[t])) if letters else None

    def corrected(self, query: str) -> str | None:
        words = query.split()
        fixed = [self.suggest(w) or w for w in words]
        return " ".join(fixed) if fixed != words else None

    def candidates(self, query: str, most: int, each: int = 6) -> list[str]:
        """Corrected queries by the sum of the positions of their words among the suggestions; the original is left out."""
        words = query.split()
        beam: list[tuple[int, tuple[str, ...]]] = [(0, ())]
        for w in words:
            options = [w, *self.suggestions(w, each)]
            grown = [(cost + i, (*done, o)) for (cost, done), (i, o) in product(beam, enumerate(options))]
            beam = sorted(grown, key=lambda x: x[0])[: 2 * most]
        texts = [" ".join(done) for _, done in beam if list(done) != words]
        return texts[:most]


def vocabulary_rows(terms: DataFrame, most: int = 300_000) -> DataFrame:
    """``term, doc`` worth suggesting: four letters or more, letters only, the ``most`` most frequent."""
    letters = F.col("term").rlike(r"^\p{L}+$") & (F.char_length("term") >= 4)
    return terms.where(letters).orderBy(F.desc("doc"), "term").limit(most).select("term", "doc")


def _distance_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y, 2) for x, y in zip(a, b)], dtype="Int32")


def distance(a: Column, b: Column) -> Column:
    """Edit distance with a budget of 2 (3 means more)."""
    return F.pandas_udf(_distance_batch, "int")(a, b)


def _deletions(c: Column) -> Column:
    """The word and what is left of it without any one of its letters."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c))))))


def fuzzy_join(words: DataFrame, vocabulary: DataFrame, *, most: int = 6) -> DataFrame:
    """``word, term, doc, distance, rank``: suggestions for many words at once.

    Two equi-joins: on the skeleton, and on what a word and a term have in
    common when each may drop one letter (words one edit apart, swaps
    included, always do).  Both are thinned by the plain edit distance, which
    counts a swap twice; only what it leaves undecided is measured in Python.
    """
    w = words.select(F.lower("word").alias("word")).where(F.char_length("word") >= 4).distinct()
    w = w.join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    v = vocabulary.select("term", "doc")
    sound = w.withColumn("key", T.skeleton(F.col("word"))).join(v.withColumn("key", T.skeleton(F.col("term"))), "key")
    sound = sound.where((F.char_length("key") >= 2) & (F.abs(F.char_length("word") - F.char_length("term")) <= 2)).withColumn("budget", F.lit(2))
    shared = [F.substring("word", 1, 1) == F.substring("term", 1, 1), F.abs(F.char_length("word") - F.char_length("term")) <= 1]
    letters = w.withColumn("key", F.explode(_deletions(F.col("word")))).join(v.withColumn("key", F.explode(_deletions(F.col("term")))), "key").where(shared[0] & shared[1])
    letters = letters.select("word", "term", "doc").distinct().withColumn("budget", F.lit(1))
    both = sound.select("word", "term", "doc", "budget").unionByName(letters.select("word", "term", "doc", "budget"))
    best = both.groupBy("word", "term").agg(F.max("doc").alias("doc"), F.max("budget").alias("budget"))
    plain = best.withColumn("distance", F.levenshtein("word", "term", 4)).where((F.col("distance") >= 0) & (F.col("distance") <= 2 * F.col("budget")))
    open_ = plain.where("distance > 1").withColumn("distance", distance(F.col("word"), F.col("term"))).where(F.col("distance") <= F.col("budget"))
    scored = plain.where("distance <= 1").unionByName(open_).drop("budget")
    order = Window.partitionBy("word").orderBy("distance", F.desc("doc"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
