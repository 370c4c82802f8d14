"""Text kernels as columns: everything here stays inside code generation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinery.functions import wordlists as W

LOST = "�"


def is_id(c: Column) -> Column:
    """40 hex digits in either case."""
    return (F.length(c) == 40) & c.rlike("^[0-9a-fA-F]{40}$")


def id_bytes(c: Column) -> Column:
    """20 bytes of a content id, null for anything else."""
    return F.when(is_id(c), F.unhex(c))


def bytes_id(c: Column) -> Column:
    return F.lower(F.hex(c))


def percent_encoded(c: Column) -> Column:
    """Keep ``A-Za-z0-9-_.~``; every other UTF-8 byte becomes %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def magnet(content_id: Column, name: Column | None = None) -> Column:
    link = F.concat(F.lit("magnet:?xt=urn:btih:"), F.lower(content_id))
    if name is None:
        return link
    return F.when(name.isNull() | (name == ""), link).otherwise(F.concat(link, F.lit("&dn="), percent_encoded(name)))


def extensions(files: Column) -> Column:
    """Distinct lower-case extensions: what follows the last dot of the whole path, at most 5 bytes."""
    dotted = F.filter(files, lambda f: F.contains(f["path"], F.lit(".")))
    found = F.transform(dotted, lambda f: F.substring_index(F.lower(f["path"]), ".", -1))
    return F.array_distinct(F.filter(found, lambda e: F.octet_length(e) <= 5))


def has_episode(c: Column) -> Column:
    return c.rlike("s[0-9]+e[0-9]")


def _any_word(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def _any_extension(found: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, wanted)))


def category(name: Column, files: Column) -> Column:
    """One of eight categories; the first rule that holds wins."""
    low = F.lower(F.coalesce(name, F.lit("")))
    found = F.coalesce(extensions(files), F.array().cast("array<string>"))
    return (
        F.when(_any_word(low, W.ADULT_WORDS + W.ADULT_CODES), "adult")
        .when(_any_word(low, W.GAME_WORDS), "game")
        .when(_any_extension(found, W.SOFTWARE_EXTENSIONS) | _any_word(low, W.SOFTWARE_WORDS), "software")
        .when(_any_extension(found, W.BOOK_EXTENSIONS) | _any_word(low, W.BOOK_WORDS), "book")
        .when(_any_extension(found, W.AUDIO_EXTENSIONS) | _any_word(low, W.AUDIO_WORDS), "audio")
        .when(_any_extension(found, W.VIDEO_EXTENSIONS) | _any_word(low, W.VIDEO_WORDS) | has_episode(low), "video")
        .when(_any_extension(found, ["iso"]), "software")
        .when(_any_extension(found, W.ARCHIVE_EXTENSIONS), "archive")
        .otherwise("other")
    )


def category_of_alias(name: str | None) -> str | None:
    """Category that a caller's word stands for; None means no filter."""
    low = (name or "").strip().lower()
    low = W.CATEGORY_ALIASES.get(low, low)
    return low if low in W.CATEGORIES else None


def normalized(c: Column) -> Column:
    """Separators and control characters to single spaces, trimmed."""
    spaced = F.regexp_replace(c, r"[._\[\](){}\p{Cc}]", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def skeleton(c: Column) -> Column:
    """Lower case without vowels but for the first character, repeats squeezed."""
    low = F.lower(c)
    rest = F.translate(F.substring(low, 2, 1 << 30), "aeiıoöuüy", "")
    return F.regexp_replace(F.concat(F.substring(low, 1, 1), rest), r"(.)\1+", "$1")


def garbled(c: Column) -> Column:
    return F.contains(c, F.lit(LOST))


def embeddable(c: Column) -> Column:
    """Names worth a vector: nothing lost and two characters or more."""
    return ~garbled(c) & (F.char_length(c) >= 2)


def truncated_query(c: Column, most: int = 256) -> Column:
    return F.substring(c, 1, most)


def season_episode(c: Column) -> Column:
    """struct(season, episode) of one token such as s01e02, s01 or 1x05; nulls where it is none."""
    low = F.lower(c)
    s = F.regexp_extract(low, r"^s([0-9]+)(?:e([0-9]+))?$", 1)
    e = F.regexp_extract(low, r"^s([0-9]+)(?:e([0-9]+))?$", 2)
    xs = F.regexp_extract(low, r"^([0-9]{1,2})x([0-9]{2})$", 1)
    xe = F.regexp_extract(low, r"^([0-9]{1,2})x([0-9]{2})$", 2)

    def number(a: Column, b: Column) -> Column:
        return F.when(a != "", a.try_cast("int")).when(b != "", b.try_cast("int"))

    return F.struct(number(s, xs).alias("season"), number(e, xe).alias("episode"))


def human_size(c: Column) -> Column:
    """1024-based size with one decimal below 10."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    n = c.cast("double")
    step = F.least(F.lit(len(units) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1.0))) / 10 + F.lit(1e-12))))
    value = n / F.pow(F.lit(1024.0), step)
    shown = F.when((value < 10) & (step > 0), F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)).otherwise(F.format_string("%d", F.floor(value + 0.5)))
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), (step + 1).cast("int")))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters whose decomposition starts with an ASCII letter, and those letters; marks map to nothing."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            source.append(chr(code).lower()[0])
            target.append(d[0].lower())
    pairs = dict(zip(source, target))
    marks = "".join(map(chr, range(0x300, 0x363)))
    return "".join(pairs) + marks, "".join(pairs.values())


def folded(c: Column) -> Column:
    """Lower case without diacritics on Latin letters; dotless i stays."""
    source, target = fold_table()
    return F.translate(F.lower(F.translate(c, "Σİ", "σi")), source, target)


def tokens(c: Column) -> Column:
    """Search tokens: folded runs of letters, numbers and private-use characters."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def date_short(seconds: Column) -> Column:
    """Day, month and year of two digits in the session's time zone; a dash for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "–").otherwise(F.date_format(F.timestamp_seconds(seconds), "dd.MM.yy"))


def date_full(seconds: Column) -> Column:
    """Date and time in the session's time zone; empty for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "dd.MM.yyyy HH:mm:ss"))
