"""Shared pieces of the SQL that checks the queries."""

from __future__ import annotations

from skeinery.functions import text as T
from skeinery.functions import wordlists as W
from skeinery.functions.binary import reserved_ranges

NOW = 1_757_500_000


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def _extensions(column: str, wanted: list[str]) -> str:
    return f"list_has_any({column}, [{', '.join(map(quoted, wanted))}])"


def category(low: str, found: str) -> str:
    return f"""CASE WHEN {_words(low, W.ADULT_WORDS + W.ADULT_CODES)} THEN 'adult'
 WHEN {_words(low, W.GAME_WORDS)} THEN 'game'
 WHEN {_extensions(found, W.SOFTWARE_EXTENSIONS)} OR {_words(low, W.SOFTWARE_WORDS)} THEN 'software'
 WHEN {_extensions(found, W.BOOK_EXTENSIONS)} OR {_words(low, W.BOOK_WORDS)} THEN 'book'
 WHEN {_extensions(found, W.AUDIO_EXTENSIONS)} OR {_words(low, W.AUDIO_WORDS)} THEN 'audio'
 WHEN {_extensions(found, W.VIDEO_EXTENSIONS)} OR {_words(low, W.VIDEO_WORDS)} OR regexp_matches({low}, 's[0-9]+e[0-9]') THEN 'video'
 WHEN {_extensions(found, ["iso"])} THEN 'software'
 WHEN {_extensions(found, W.ARCHIVE_EXTENSIONS)} THEN 'archive' ELSE 'other' END"""


RECORDS = """recs AS (SELECT id, max(name) AS name, coalesce(max(total_size), 0) AS total_size, max(files) AS files, min(first_seen) AS first_seen,
 max(last_seen) AS last_seen, max(seen_count) AS seen_count FROM torrents GROUP BY id)"""

STATES = """st AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC, seen_count DESC) AS n FROM torrent_state) WHERE n = 1)"""

ITEMS = f"""{RECORDS}, {STATES},
rx AS (SELECT *, lower(coalesce(name, '')) AS low, list_distinct(list_filter(list_transform(list_filter(coalesce(files, []), lambda f: contains(f.path, '.')),
 lambda f: lower(string_split(f.path, '.')[-1])), lambda e: strlen(e) <= 5)) AS exts FROM recs),
items AS (SELECT r.id, coalesce(r.name, '') AS name, r.total_size, CASE WHEN r.files IS NULL THEN 0 ELSE len(r.files) END AS file_count, r.first_seen, r.last_seen, r.seen_count,
 coalesce(s.metadata_status, 'pending') AS metadata_status, CASE WHEN s.probe_peers >= 0 THEN s.probe_peers END AS peer_count, CASE WHEN s.probe_at > 0 THEN s.probe_at END AS last_check,
 {category("r.low", "r.exts")} AS category, contains(coalesce(r.name, ''), '{T.LOST}') AS garbled, coalesce(s.metadata_status, 'pending') = 'fetched' AS fetched, r.files
 FROM rx r LEFT JOIN st s ON r.id = s.id)"""

FILES = """child AS (SELECT id, i - 1 AS ord, files[i].path AS path, coalesce(files[i].size, 0) AS size FROM (SELECT id, files, unnest(range(1, len(files) + 1)) AS i FROM recs WHERE files IS NOT NULL))"""

SUMMARY = "id, name, total_size, file_count, first_seen, last_seen, seen_count, peer_count, category, fetched"


def folded(column: str) -> str:
    source, target = T.fold_table()
    return f"translate(lower(translate({column}, 'Σİ', 'σi')), {quoted(source)}, {quoted(target)})"


def tokens(column: str) -> str:
    return f"regexp_extract_all({folded(column)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


DOCS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, ord) AS rank FROM child),
docs AS (SELECT i.id, i.name, coalesce(p.paths, '') AS paths FROM items i LEFT JOIN (SELECT id, string_agg(path, ' ' ORDER BY rank) AS paths FROM ranked WHERE rank <= 48 GROUP BY id) p ON i.id = p.id WHERE i.name <> ''),
tok AS (SELECT id, {tokens("name")} AS a, {tokens("paths")} AS b FROM docs),
lengths AS (SELECT id, len(a) + len(b) AS tokens FROM tok),
postings AS (SELECT term, id, sum(n) AS hits_name, sum(p) AS hits_paths FROM (SELECT id, unnest(a) AS term, 1 AS n, 0 AS p FROM tok UNION ALL SELECT id, unnest(b), 0, 1 FROM tok) GROUP BY term, id)"""

INDEX = f"{ITEMS}, {FILES}, {DOCS}"


def hits(terms: list[str]) -> str:
    values = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(terms))
    return f"""q(t, prefix) AS (VALUES {values}),
h AS (SELECT id, t, sum(10.0 * hits_name + 1.0 * hits_paths) AS hits FROM postings JOIN q ON starts_with(term, prefix) GROUP BY id, t)"""


def matched(terms: list[str]) -> str:
    return f"{hits(terms)}, matched AS (SELECT id FROM h GROUP BY id HAVING count(*) = {len(terms)})"


def bm25(terms: list[str]) -> str:
    return f"""{hits(terms)},
stats AS (SELECT count(*) AS docs, avg(tokens) AS mean FROM lengths),
w AS (SELECT t, mean, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM h, stats GROUP BY t, docs, mean),
bm AS (SELECT h.id, -sum(idf * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * tokens / mean))) AS score FROM h JOIN w USING (t) JOIN lengths USING (id) GROUP BY h.id HAVING count(*) = {len(terms)})"""


def public_peer(number: str, port: str) -> str:
    return f"{port} >= 1024" + "".join(f" AND NOT ({number} BETWEEN {a} AND {b})" for a, b in reserved_ranges())


SEEN = """seen AS (SELECT sighting_id, lower(infohash) AS id, source, coalesce(len(peers), 0) AS n_peers, greatest(coalesce(repeats, 0), 1) AS weight, seen_at,
 coalesce(source IN ('sample_peers', 'get_peers', 'announce'), false) AS hot FROM (SELECT *, row_number() OVER (PARTITION BY sighting_id ORDER BY arrived_at) AS n FROM sightings) WHERE n = 1 AND regexp_full_match(infohash, '[0-9a-fA-F]{40}'))"""


def lowered(column: str) -> str:
    """Lower case with the final sigma and the dotted I as in Unicode's full mapping."""
    return rf"lower(replace(regexp_replace({column}, '(\p{{L}}\p{{M}}*)Σ($|[^\p{{L}}\p{{M}}])', '\1ς\2', 'g'), 'İ', 'i̇'))"


def embeddings(names: str, dim: int) -> str:
    """``emb(id, v)``: the hashed text embedding of ``names(id, name)``, word by word with 64-bit FNV-1a."""
    return rf"""ew AS (SELECT id, unnest(regexp_extract_all({lowered("name")}, '[\p{{L}}\p{{N}}]+')) AS word FROM {names}),
eb AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM ew)),
eh AS (SELECT word, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT)), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM eb),
ec AS (SELECT id, (h % {dim})::INT AS pos, 1.0::DOUBLE AS x FROM ew JOIN eh USING (word) UNION ALL SELECT id, ((h >> 32) % {dim})::INT, CASE WHEN (h >> 63) = 1 THEN -0.5 ELSE 0.5 END FROM ew JOIN eh USING (word)),
es AS (SELECT id, pos, sum(x) AS x FROM ec GROUP BY id, pos),
em AS (SELECT id, map_from_entries(list((pos, x))) AS m, sqrt(sum(x * x)) AS n FROM es GROUP BY id),
emb AS (SELECT n.id, list_transform(range(0, {dim}), lambda i: CASE WHEN em.n > 0 THEN coalesce(em.m[i::INT], 0.0) / em.n ELSE 0.0 END) AS v FROM {names} n LEFT JOIN em ON n.id = em.id)"""


def int8(table: str) -> str:
    """``id, scale, q`` of ``emb``: symmetric int8, halves away from zero."""
    return f"""SELECT id, (top / 127.0)::FLOAT AS scale, CASE WHEN top > 0 THEN list_transform(v, lambda x: greatest(-127, least(127, sign(x) * floor(abs(x) * 127.0 / top + 0.5)))::INT) ELSE list_transform(v, lambda x: 0) END AS q
 FROM (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM {table})"""


def dot(column: str, query: list[int]) -> str:
    return f"list_sum(list_transform(range(1, {len(query) + 1}), lambda i: {column}[i]::BIGINT * {list(query)}[i]::BIGINT))::DOUBLE"
