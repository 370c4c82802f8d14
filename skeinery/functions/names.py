"""Release-name parsing and document texts, as plain functions and Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinery.functions import wordlists as W

_BREAKS = re.compile(r"[._\[\](){},;|~]")
_SEASON = re.compile(r"s([0-9]+)(?:e([0-9]+))?")
_CROSS = re.compile(r"([0-9]{1,2})x([0-9]{2})")
_SEPARATORS = re.compile(r"[._\[\](){}]")
_TAGS = frozenset(W.NAME_TAGS)


@dataclass
class ParsedName:
    title: str = ""
    year: int | None = None
    season: int | None = None
    episode: int | None = None
    resolution: int | None = None
    tags: list[str] = field(default_factory=list)
    release_group: str | None = None


def _without_controls(s: str) -> str:
    return "".join(" " if unicodedata.category(c) == "Cc" else c for c in s)


def _split_group(name: str) -> tuple[str, str | None]:
    """Cut a trailing ``-GROUP``: one short word of letters, digits and underscores, not a number."""
    head, dash, tail = name.rpartition("-")
    tail = tail.strip()
    plausible = bool(dash and head) and 0 < len(tail.encode()) <= 20 and all(c.isalnum() or c == "_" for c in tail)
    if plausible and not re.fullmatch("[0-9]+", tail):
        return head, tail
    return name, None


def _season_episode(token: str) -> tuple[int, int | None] | None:
    m = _SEASON.fullmatch(token) or _CROSS.fullmatch(token)
    if not m:
        return None
    season, episode = int(m[1]), int(m[2]) if m[2] is not None else None
    return None if max(season, episode or 0) > 65_535 else (season, episode)


def parse_name(name: str | None) -> ParsedName:
    """Title, year, season, episode, resolution, tags and group of a release name.

    The title ends at the first recognised mark.  Never fails; null gives the
    empty parse.
    """
    body, group = _split_group((name or "").strip())
    words = _without_controls(_BREAKS.sub(" ", body)).split()
    out = ParsedName(release_group=group)
    ends = len(words)
    for i, word in enumerate(w.lower() for w in words):
        if out.year is None and i and re.fullmatch(r"\+?[0-9]+", word) and len(word) == 4 and 1900 <= int(word) <= 2039:
            out.year = int(word)
        elif out.resolution is None and word in W.RESOLUTIONS:
            out.resolution = W.RESOLUTIONS[word]
        elif out.season is None and (found := _season_episode(word)):
            out.season, out.episode = found
        elif word in _TAGS:
            if word not in out.tags:
                out.tags.append(word)
            if i == 0:
                continue
        else:
            continue
        ends = min(ends, i)
    out.title = " ".join(words[:ends]).strip("-").strip() or " ".join(words).strip("-").strip()
    return out


def normalize_name(name: str) -> str:
    return re.sub(" +", " ", _without_controls(_SEPARATORS.sub(" ", name))).strip()


def doc_text(name: str | None, category: str | None) -> str:
    """Clean title with year, season and the words of the category."""
    p = parse_name(name)
    if not p.title.strip():
        return normalize_name(name or "")
    out = normalize_name(p.title)
    if p.year is not None:
        out += f" {p.year}"
    if p.season is not None:
        out += f" season {p.season}"
    words = W.CATEGORY_TEXT.get(category or "")
    return f"{out} — {words}" if words else out


def doc_text_with_files(name: str | None, category: str | None, files: list[str] | None, most_bytes: int = 400) -> str:
    """``doc_text`` and the file names that add something, within a byte budget.

    Files equal but for digits (episodes) count once.
    """
    out = doc_text(name, category)
    seen: set[str] = set()
    extra = ""
    for path in files or []:
        base = normalize_name(re.split(r"[/\\]", path or "")[-1])
        if not base or base in out:
            continue
        signature = re.sub("[0-9]", "", base).lower()
        if signature in seen:
            continue
        seen.add(signature)
        if len(extra.encode()) + len(base.encode()) + 1 > most_bytes:
            break
        extra += f" {base}"
    return f"{out} — files:{extra}" if extra else out


def _doc_text_batch(names: pd.Series, categories: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([doc_text_with_files(n, c, None if p is None else list(p)) for n, c, p in zip(names, categories, paths)], dtype=object)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _season_of(w: Column) -> Column:
    """struct(season, episode) of one token, null if it is none."""
    shape = r"^(?:s([0-9]+)(?:e([0-9]+))?|([0-9]{1,2})x([0-9]{2}))$"

    def numbers(p: Column) -> Column:
        season, episode = p["season"].try_cast("bigint"), p["episode"].try_cast("bigint")
        small = (season <= 65_535) & ((p["episode"] == "") | (episode <= 65_535))
        return F.when(small, F.struct(season.cast("int").alias("season"), F.when(p["episode"] != "", episode.cast("int")).alias("episode")))

    part = [F.regexp_extract(w, shape, i) for i in (1, 2, 3, 4)]
    return F.when(w.rlike(shape), _let(F.struct(F.concat(part[0], part[2]).alias("season"), F.concat(part[1], part[3]).alias("episode")), numbers))


def _mark(w: Column, i: Column) -> Column:
    year = F.when((i > 0) & w.rlike("^[0-9]{4}$") & w.try_cast("int").between(1900, 2039), w.try_cast("int"))
    sizes = F.create_map(*(F.lit(x) for pair in W.RESOLUTIONS.items() for x in pair))
    return F.struct(i.alias("i"), w.alias("w"), year.alias("year"), F.try_element_at(sizes, w).alias("size"), _season_of(w).alias("s"), w.isin(*W.NAME_TAGS).alias("tag"))


def _summary(words: Column, marks: Column, release_group: Column) -> Column:
    def earliest(k: str) -> Column:
        return F.get(F.filter(marks, lambda m: m[k].isNotNull()), F.lit(0))

    def bare(w: Column) -> Column:
        return _stripped(F.regexp_replace(F.array_join(w, " "), "^-+|-+$", ""))

    def put(found: Column) -> Column:
        ends = F.array_min(F.array(F.size(words), found["y"]["i"], found["z"]["i"], found["s"]["i"], F.get(F.filter(found["tags"], lambda m: m["i"] > 0), F.lit(0))["i"]))
        title = _let(bare(F.slice(words, 1, ends)), lambda t: F.when(t != "", t).otherwise(bare(words)))
        return F.struct(
            title.alias("title"), found["y"]["year"].alias("year"), found["s"]["s"]["season"].alias("season"), found["s"]["s"]["episode"].alias("episode"),
            found["z"]["size"].alias("resolution"), F.array_distinct(F.transform(found["tags"], lambda m: m["w"])).alias("tags"), release_group.alias("release_group"),
        )

    return _let(F.struct(earliest("year").alias("y"), earliest("size").alias("z"), earliest("s").alias("s"), F.filter(marks, lambda m: m["tag"]).alias("tags")), put)


def parsed(name: Column) -> Column:
    """The parse of a name as a struct: ``parse_name`` in columns."""
    shape = r"(?s)^(.+)-([^-]*)$"

    def split(p: Column) -> Column:
        grouped = (F.octet_length(p["tail"]).between(1, 20)) & p["tail"].rlike(r"^[\p{L}\p{N}_]+$") & ~p["tail"].rlike("^[0-9]+$")
        return F.struct(F.when(grouped, p["head"]).otherwise(p["whole"]).alias("body"), F.when(grouped, p["tail"]).alias("release_group"))

    def read(p: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(p["body"], r"[._\[\](){},;|~\p{Cc}]", " "), r"(?U)\s+"), lambda w: w != "")
        return _let(words, lambda ws: _let(F.transform(F.transform(ws, F.lower), _mark), lambda marks: _summary(ws, marks, p["release_group"])))

    parts = _let(_stripped(F.coalesce(name, F.lit(""))), lambda n: F.struct(n.alias("whole"), F.regexp_extract(n, shape, 1).alias("head"), _stripped(F.regexp_extract(n, shape, 2)).alias("tail")))
    return _let(_let(parts, split), read)


def document(name: Column, category: Column, paths: Column) -> Column:
    """Text to embed for a record with its file paths."""
    return F.pandas_udf(_doc_text_batch, "string")(name, category, paths)
