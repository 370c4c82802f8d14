"""What a search text asks for: an immutable plan whose fields become literals in columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinery.functions import wordlists as W

_FILLERS = frozenset(W.FILLERS)
_APOSTROPHES = "'’"


@dataclass(frozen=True)
class QueryPlan:
    semantic_text: str = ""
    keyword_text: str = ""
    category: str | None = None
    year_range: tuple[int, int] | None = None
    year: int | None = None
    category_only: bool = False
    recognized: bool = False


def hinted_category(word: str) -> str | None:
    """Category a word names; longer keys tolerate up to four letters of suffix."""
    for key, category in W.CATEGORY_HINTS:
        if word == key or (len(key) >= 4 and word.startswith(key) and len(word) <= len(key) + 4):
            return category
    return None


def word_alias(word: str) -> str | None:
    for key, meant in W.WORD_ALIASES:
        if word.startswith(meant.split(" ")[0]):
            continue
        if word == key or (len(key) >= 5 and word.startswith(key) and len(word) <= len(key) + 4):
            return meant
    return None


def decade(token: str) -> tuple[int, int] | None:
    """The ten years that ``2000'lerin``, ``90s`` and the like mean."""
    m = re.fullmatch(r"([0-9]+)(.+)", token)
    if not m:
        return None
    suffix = m[2].lstrip(_APOSTROPHES)
    if suffix not in W.DECADE_SUFFIXES and not m[2].startswith("'"):
        return None
    n = int(m[1])
    start = n if len(m[1]) == 4 else (1900 if n >= 30 else 2000) + n if len(m[1]) == 2 else 0
    return (start, start + 9) if 1900 <= start <= 2030 and start % 10 == 0 else None


def understand(query: str | None) -> QueryPlan:
    """Years, aliases, fillers and the category intent of a query."""
    raw = (query or "").strip()
    q = raw.replace("İ", "i").lower()
    if not q:
        return QueryPlan()
    q = "".join(c if c.isalnum() or c in _APOSTROPHES or c.isspace() else " " for c in q)
    years, year, kept = None, None, []
    for token in q.split():
        base = token.strip(_APOSTROPHES)
        if span := decade(base):
            years = span
        elif re.fullmatch("[0-9]{4}", base) and 1900 <= int(base) <= 2039:
            year = int(base)
            kept.append(token)
        else:
            kept.append(base)
    text = " ".join(kept)
    recognized = year is not None or years is not None
    examples: set[str] = set()
    for phrase, meant, samples in W.CONCEPTS:
        if phrase in text:
            others = text.replace(phrase, " ").split()
            alone = all(w in _FILLERS or any(w == k for k, _ in W.CATEGORY_HINTS) for w in others)
            examples |= set(samples.split()) if alone else set()
            text = text.replace(phrase, f"{meant} {samples if alone else ''}")
            recognized = True
    for phrase, meant in W.PHRASE_ALIASES:
        if phrase in text:
            text, recognized = text.replace(phrase, meant), True
    if any(key in text for key, _ in W.WORD_ALIASES):
        swapped = [(w, word_alias(w)) for w in text.split()]
        recognized |= any(a for _, a in swapped)
        text = " ".join(a or w for w, a in swapped)
    for phrase in W.FILLERS:
        if " " in phrase:
            text = text.replace(phrase, " ")
    words = [w for w in text.split() if w not in _FILLERS]
    hints = [hinted_category(w) for w in words]
    if words and all(hints):
        joined = " ".join(words)
        return QueryPlan(joined, joined, hints[0], years, year, True, True)
    # the last word, or a first English plural, may state the category
    places = [i for i in (0, len(words) - 1) if len(words) >= 2 and hints[i] and (i or (words[0].endswith("s") and words[0].isascii()))]
    at = places[0] if places else None
    semantic = " ".join(words) or raw.lower()
    keyword = " ".join(w for i, w in enumerate(words) if i != at and w not in examples) or semantic
    return QueryPlan(semantic, keyword, hints[at] if at is not None else None, years, year, False, recognized or at is not None)


def _understood_batch(texts: pd.Series) -> pd.DataFrame:
    plans = [understand(t) for t in texts]
    years = [p.year_range or (None, None) for p in plans]
    rows = pd.DataFrame({"semantic": [p.semantic_text for p in plans], "keyword": [p.keyword_text for p in plans], "category": [p.category for p in plans], "first_year": [y[0] for y in years], "last_year": [y[1] for y in years]})
    return rows.astype({"first_year": "Int32", "last_year": "Int32"})


def understood(text: Column) -> Column:
    """The plan of each query as a struct, for logs of queries."""
    return F.pandas_udf(_understood_batch, "semantic string, keyword string, category string, first_year int, last_year int")(text)
