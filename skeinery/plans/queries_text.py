"""Text kernels, decoders and vector kernels as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinery.functions import binary as B
from skeinery.functions import names as N
from skeinery.functions import spell as S
from skeinery.functions import text as T
from skeinery.functions import understanding as U
from skeinery.functions import vectors as V
from skeinery.functions import wordlists as W
from skeinery.operators import catalog as C
from skeinery.operators.fulltext import documents
from skeinery.plans import oracle as O
from skeinery.plans import stores
from skeinery.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _names(s, d):
    return C.records(s, d).where("name <> ''").select("id", "name")


_NAMES = f"WITH {O.RECORDS}, n AS (SELECT id, name FROM recs WHERE name <> '')"

_add("categorize", lambda s, d: C.records(s, d).select("id", T.category(F.col("name"), F.col("files")).alias("category")), f"WITH {O.ITEMS} SELECT id, category FROM items")
_add("normalize_name", lambda s, d: _names(s, d).select("id", T.normalized(F.col("name")).alias("text")), _NAMES + r" SELECT id, trim(regexp_replace(regexp_replace(name, '[._\[\](){}\p{Cc}]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS text FROM n")
_add("has_episode", lambda s, d: _names(s, d).where(T.has_episode(F.lower("name"))).select("id"), _NAMES + " SELECT id FROM n WHERE regexp_matches(lower(name), 's[0-9]+e[0-9]')")
_add("season_episode", lambda s, d: _names(s, d).select("id", F.explode(F.split("name", "[ ._]+")).alias("token")).select("id", "token", T.season_episode(F.col("token")).alias("x")).where("x.season is not null").select("id", "token", "x.season", "x.episode"), _NAMES + r""", t AS (SELECT id, unnest(regexp_split_to_array(name, '[ ._]+')) AS token FROM n), x AS (SELECT id, token, lower(token) AS low FROM t)
SELECT id, token, try_cast(coalesce(nullif(regexp_extract(low, '^s([0-9]+)(?:e([0-9]+))?$', 1), ''), nullif(regexp_extract(low, '^([0-9]{1,2})x([0-9]{2})$', 1), '')) AS INT) AS season,
 try_cast(coalesce(nullif(regexp_extract(low, '^s([0-9]+)(?:e([0-9]+))?$', 2), ''), nullif(regexp_extract(low, '^([0-9]{1,2})x([0-9]{2})$', 2), '')) AS INT) AS episode FROM x
WHERE regexp_matches(low, '^s([0-9]+)(?:e([0-9]+))?$') OR regexp_matches(low, '^([0-9]{1,2})x([0-9]{2})$')""")
_add("magnet_link", lambda s, d: C.records(s, d).select("id", T.magnet(F.col("id"), F.col("name")).alias("link")), f"WITH {O.RECORDS} SELECT id, 'magnet:?xt=urn:btih:' || lower(id) || CASE WHEN name IS NULL OR name = '' THEN '' ELSE '&dn=' || url_encode(name) END AS link FROM recs")
_add("valid_ids", lambda s, d: table(s, d, "sightings").select("sighting_id", T.is_id(F.col("infohash")).alias("ok"), T.bytes_id(T.id_bytes(F.col("infohash"))).alias("id")), "SELECT sighting_id, regexp_full_match(infohash, '[0-9a-fA-F]{40}') AS ok, CASE WHEN regexp_full_match(infohash, '[0-9a-fA-F]{40}') THEN lower(hex(unhex(infohash))) END AS id FROM sightings")
_add("garbled_names", lambda s, d: _names(s, d).where(T.garbled(F.col("name"))).select("id"), _NAMES + f" SELECT id FROM n WHERE contains(name, '{T.LOST}')")
_add("human_size", lambda s, d: C.files(s, d).select("id", "ord", T.human_size(F.col("size")).alias("shown")), f"""WITH {O.RECORDS}, {O.FILES}, u AS (SELECT id, ord, size, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 ELSE 4 END AS step FROM child)
SELECT id, ord, CASE WHEN step > 0 AND size / pow(1024, step) < 10 THEN printf('%.1f', floor(size / pow(1024, step) * 10 + 0.5) / 10) ELSE floor(size / pow(1024, step) + 0.5)::BIGINT::VARCHAR END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][step + 1] AS shown FROM u""")
_add("query_truncation", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", T.truncated_query(F.col("text")).alias("query")), "SELECT doc_id, substring(text, 1, 256) AS query FROM documents WHERE text IS NOT NULL")
def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[._\\[\\](){{}}\\p{{Cc}}]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


_TAG_LIST = "[" + ", ".join(map(O.quoted, W.NAME_TAGS)) + "]"
_SIZE = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.RESOLUTIONS.items()) + " END"
_SEASON, _CROSSED = "'^s([0-9]+)(?:e([0-9]+))?$'", "'^([0-9]{1,2})x([0-9]{2})$'"
_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PARSED = f"""{_NAMES}, b0 AS (SELECT id, regexp_replace(name, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS name FROM n),
b1 AS (SELECT id, name, regexp_extract(name, '(?s)^(.+)-([^-]*)$', 1) AS head, regexp_replace(regexp_extract(name, '(?s)^(.+)-([^-]*)$', 2), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS tail FROM b0),
b2 AS (SELECT *, strlen(tail) BETWEEN 1 AND 20 AND regexp_full_match(tail, '[\\p{{L}}\\p{{N}}_]+') AND NOT regexp_full_match(tail, '[0-9]+') AS grouped FROM b1),
b3 AS (SELECT id, CASE WHEN grouped THEN tail END AS release_group, list_filter(regexp_split_to_array(regexp_replace(CASE WHEN grouped THEN head ELSE name END, '[._\\[\\](){{}},;|~\\p{{Cc}}]', ' ', 'g'), '{_BLANK}+'), lambda w: w <> '') AS words FROM b2),
t0 AS (SELECT id, unnest(range(0, len(words))) AS i, lower(unnest(words)) AS w FROM b3),
t1 AS (SELECT *, CASE WHEN i > 0 AND regexp_full_match(w, '[0-9]{{4}}') AND try_cast(w AS INT) BETWEEN 1900 AND 2039 THEN w::INT END AS y, {_SIZE} AS z, list_contains({_TAG_LIST}, w) AS tag,
 try_cast(concat(regexp_extract(w, {_SEASON}, 1), regexp_extract(w, {_CROSSED}, 1)) AS BIGINT) AS s0, nullif(concat(regexp_extract(w, {_SEASON}, 2), regexp_extract(w, {_CROSSED}, 2)), '') AS e0 FROM t0),
t2 AS (SELECT *, s0 <= 65535 AND (e0 IS NULL OR coalesce(try_cast(e0 AS BIGINT), 99999) <= 65535) AS se FROM t1),
t3 AS (SELECT id, arg_min(y, i) FILTER (y IS NOT NULL) AS year, arg_min(z, i) FILTER (z IS NOT NULL) AS resolution, arg_min(s0, i) FILTER (se) AS season, arg_min(coalesce(e0::INT, -1), i) FILTER (se) AS episode,
 list_distinct(list(w) FILTER (tag)) AS found, list(w ORDER BY i) FILTER (tag) AS tags, least(min(i) FILTER (y IS NOT NULL), min(i) FILTER (z IS NOT NULL), min(i) FILTER (se), min(i) FILTER (tag AND i > 0)) AS stop FROM t2 GROUP BY id),
t4 AS (SELECT b3.id, words, release_group, year, resolution, season, nullif(episode, -1) AS episode, coalesce(tags, []) AS tags, coalesce(stop, len(words)) AS stop FROM b3 LEFT JOIN t3 ON b3.id = t3.id),
t5 AS (SELECT *, regexp_replace(regexp_replace(array_to_string(words[1:stop], ' '), '^-+|-+$', '', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS head, regexp_replace(regexp_replace(array_to_string(words, ' '), '^-+|-+$', '', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS whole FROM t4),
parsed AS (SELECT id, CASE WHEN head <> '' THEN head ELSE whole END AS title, year, season::INT AS season, episode, resolution, list_filter(tags, lambda t, k: list_position(tags, t) = k) AS tags, release_group FROM t5)"""
_add("parse_name", lambda s, d: _names(s, d).select("id", N.parsed(F.col("name")).alias("p")).select("id", "p.*"), f"{_PARSED} SELECT * FROM parsed")
_add("doc_text_files", lambda s, d: C.records(s, d).where("name <> ''").select("id", N.document(F.col("name"), T.category(F.col("name"), F.col("files")), F.col("files.path")).alias("text")), f"""{_PARSED.replace("WITH ", f"WITH {O.ITEMS}, ", 1).replace(O.RECORDS + ", n AS", "n AS", 1)},
o0 AS (SELECT p.id, i.name, files, CASE WHEN trim(title) = '' THEN {_norm("i.name")} ELSE {_norm("title")} || coalesce(' ' || year, '') || coalesce(' season ' || season, '') || CASE category {" ".join(f"WHEN '{k}' THEN ' — {v}'" for k, v in W.CATEGORY_TEXT.items())} ELSE '' END END AS base FROM parsed p JOIN items i ON p.id = i.id),
f0 AS (SELECT id, base, k, {_norm("regexp_extract(files[k].path, '[^/" + chr(92) * 4 + "]*$')")} AS name FROM (SELECT id, base, files, unnest(range(1, len(files) + 1)) AS k FROM o0 WHERE files IS NOT NULL)),
f1 AS (SELECT *, row_number() OVER (PARTITION BY id, lower(regexp_replace(name, '[0-9]', '', 'g')) ORDER BY k) AS nth FROM f0 WHERE name <> '' AND NOT contains(base, name)),
f2 AS (SELECT *, sum(strlen(name) + 1) OVER (PARTITION BY id ORDER BY k) AS bytes FROM f1 WHERE nth = 1),
f3 AS (SELECT id, string_agg(name, ' ' ORDER BY k) AS extra FROM f2 WHERE bytes <= 400 GROUP BY id)
SELECT o0.id, base || coalesce(' — files: ' || extra, '') AS text FROM o0 LEFT JOIN f3 ON o0.id = f3.id""")


_index = stores.text_index


_add("fts_documents", lambda s, d: documents(C.items(s, d), C.files(s, d)), f"WITH {O.INDEX} SELECT id, name, paths FROM docs")
_add("fts_vocab", lambda s, d: _index(s, d).vocabulary(), f"WITH {O.INDEX} SELECT term, count(*) AS doc, sum(hits_name + hits_paths)::BIGINT AS cnt FROM postings GROUP BY term")
_add("spell_vocab", lambda s, d: S.vocabulary_rows(_index(s, d).vocabulary(), 2000), f"WITH {O.INDEX}, v AS (SELECT term, count(*) AS doc FROM postings GROUP BY term) SELECT term, doc FROM v WHERE length(term) >= 4 AND regexp_full_match(term, '\\p{{L}}+') ORDER BY doc DESC, term LIMIT 2000")
_add("skeleton", lambda s, d: _index(s, d).vocabulary().select("term", T.skeleton(F.col("term")).alias("skeleton")), f"""WITH {O.INDEX}, v AS (SELECT DISTINCT term, lower(term) AS low FROM postings), c AS (SELECT term, list_filter(string_split(low, ''), lambda x, i: i = 1 OR NOT contains('aeiıoöuüy', x)) AS c FROM v)
SELECT term, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS skeleton FROM c""")


def _misspelt(s, d):
    """Terms of the vocabulary with their second letter dropped."""
    v = S.vocabulary_rows(_index(s, d).vocabulary())
    return v.where("doc >= 3").select(F.concat(F.substring("term", 1, 1), F.substring("term", 3, 100)).alias("word")), v


def fuzzy_suggestions(s, d):
    words, v = _misspelt(s, d)
    return S.fuzzy_join(words, v)


# edit distance with swaps, row by row: a row of the table is a list, two rows are carried
_DISTANCE = """list_reduce(list_prepend(list_concat(list_transform(range(0, m + 1), lambda j: 0::BIGINT), range(0, m + 1)), list_transform(range(1, n + 1), lambda i: [i])), lambda acc, x: list_concat(acc[m + 2:],
 list_reduce(list_prepend([x[1]], list_transform(range(1, m + 1), lambda j: [j])), lambda row, y: list_append(row, least(acc[m + 1 + y[1] + 1] + 1, row[-1] + 1, acc[m + 1 + y[1]] + (a[x[1]] <> b[y[1]])::INT,
 CASE WHEN x[1] > 1 AND y[1] > 1 AND a[x[1]] = b[y[1] - 1] AND a[x[1] - 1] = b[y[1]] THEN acc[y[1] - 1] + 1 ELSE 99 END)))))[-1]"""
_SKELETON = "array_to_string(list_filter(list_filter(string_split({0}, ''), lambda x, i: i = 1 OR NOT contains('aeiıoöuüy', x)), lambda x, i: i = 1 OR x <> list_filter(string_split({0}, ''), lambda z, k: k = 1 OR NOT contains('aeiıoöuüy', z))[i - 1]), '')"
_add("fuzzy_suggestions", fuzzy_suggestions, f"""WITH {O.INDEX}, v0 AS (SELECT term, count(*) AS doc FROM postings GROUP BY term),
v AS (SELECT term, doc, {_SKELETON.format("term")} AS skeleton FROM v0 WHERE length(term) >= 4 AND regexp_full_match(term, '\\p{{L}}+')),
w0 AS (SELECT DISTINCT lower(term[1] || term[3:]) AS word FROM v WHERE doc >= 3),
w AS (SELECT word, {_SKELETON.format("word")} AS skeleton FROM w0 WHERE length(word) >= 4 AND word NOT IN (SELECT term FROM v)),
c AS (SELECT word, term, max(doc) AS doc, max(budget) AS budget FROM (SELECT word, term, doc, 2 AS budget FROM w JOIN v ON w.skeleton = v.skeleton WHERE length(w.skeleton) >= 2 AND abs(length(word) - length(term)) <= 2
 UNION ALL SELECT word, term, doc, 1 FROM w JOIN v ON word[1] = term[1] WHERE abs(length(word) - length(term)) <= 1) GROUP BY word, term),
l AS (SELECT *, string_split(word, '') AS a, string_split(term, '') AS b, length(word) AS n, length(term) AS m FROM c WHERE strlen(word) > length(word) OR strlen(term) > length(term) OR levenshtein(word, term) <= 2 * budget),
d AS (SELECT word, term, doc, budget, {_DISTANCE} AS distance FROM l)
SELECT word, term, doc, distance, row_number() OVER (PARTITION BY word ORDER BY distance, doc DESC, term) AS rank FROM d WHERE distance <= budget QUALIFY rank <= 6""")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))


_add("vector_quantize", lambda s, d: _vectors(s, d).select("vec_id", V.quantized(F.col("v")).alias("x")).select("vec_id", F.round("x.scale", 9).alias("scale"), F.col("x.q").cast("array<int>").alias("q")), """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS top FROM embeddings)
SELECT vec_id, round(top / 127.0, 9) AS scale, list_transform(v, lambda x: greatest(-127, least(127, round(x * 127.0 / top)::INT))) AS q FROM m""")
_add("vector_dequantize", lambda s, d: _vectors(s, d).select("vec_id", F.col("v"), V.quantized(F.col("v")).alias("x")).select("vec_id", (F.array_max(F.zip_with("v", V.dequantized(F.col("x.q"), F.col("x.scale")), lambda a, b: F.abs(a.cast("double") - b))) <= F.col("x.scale") * 0.5000001).alias("within")), "SELECT vec_id, true AS within FROM embeddings")
_add("vector_cosine", lambda s, d: _vectors(s, d).alias("a").join(F.broadcast(_vectors(s, d).where("vec_id = 0").select(F.col("v").alias("w")))).select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine")), "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0")
_add("vector_normalize", lambda s, d: _vectors(s, d).select("vec_id", F.round(V.norm(V.l2_normalized(F.col("v"))), 6).alias("norm")), "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
_add("expected_success", lambda s, d: C.states(s, d).where("probe_peers >= 0").select("id", F.round(V.expected_success(0.05, F.col("probe_peers")), 9).alias("chance")), f"WITH {O.STATES} SELECT id, round(1 - pow(0.95::DOUBLE, probe_peers), 9) AS chance FROM st WHERE probe_peers >= 0")
_add("mock_embed", lambda s, d: _names(s, d).select("id", V.embedded(F.col("name"), 64).alias("v")), f"{_NAMES}, {O.embeddings('n', 64)} SELECT id, list_transform(v, lambda x: x::FLOAT) AS v FROM emb")

_NUMBER = "(string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT)"


def _peers(s, d):
    p = table(s, d, "sightings").select("sighting_id", F.explode("peers").alias("peer")).distinct()
    return p.select("sighting_id", "peer", F.regexp_extract("peer", r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3}):([0-9]{1,5})$", 1).alias("ip"), F.regexp_extract("peer", r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3}):([0-9]{1,5})$", 2).try_cast("int").alias("port"))


_add("public_peers", lambda s, d: _peers(s, d).where(B.is_public_peer(F.col("ip"), F.col("port"))).select("sighting_id", "peer"), rf"""WITH p AS (SELECT DISTINCT sighting_id, unnest(peers) AS peer FROM sightings), x AS (SELECT *, regexp_extract(peer, '^([0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}):([0-9]{{1,5}})$', 1) AS ip, try_cast(regexp_extract(peer, '^([0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}):([0-9]{{1,5}})$', 2) AS INT) AS port FROM p),
y AS (SELECT *, {_NUMBER} AS number FROM x WHERE ip <> '' AND list_max(list_transform(string_split(ip, '.'), lambda o: o::INT)) <= 255) SELECT sighting_id, peer FROM y WHERE {O.public_peer("number", "port")}""")

_add("peer_networks", lambda s, d: _peers(s, d).where("ip <> ''").groupBy((B.packed_ipv4(F.col("ip")) - F.pmod(B.packed_ipv4(F.col("ip")), F.lit(256))).alias("network")).agg(F.count("*").alias("n")), rf"""WITH p AS (SELECT DISTINCT sighting_id, unnest(peers) AS peer FROM sightings), x AS (SELECT *, regexp_extract(peer, '^([0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}):([0-9]{{1,5}})$', 1) AS ip FROM p)
SELECT CASE WHEN list_max(list_transform(string_split(ip, '.'), lambda o: o::INT)) <= 255 THEN {_NUMBER} - {_NUMBER} % 256 END AS network, count(*) AS n FROM x WHERE ip <> '' GROUP BY 1""")


def _packets(s, d):
    """DHT responses whose samples are the ids of each group of sightings, as a node would send them."""
    ids = table(s, d, "sightings").where(T.is_id(F.col("infohash"))).groupBy(F.expr("sighting_id div 8").alias("g")).agg(F.array_sort(F.collect_set(F.lower("infohash"))).alias("ids"))
    body = F.unhex(F.array_join("ids", ""))
    head = F.concat(F.lit("d1:rd7:samples"), (F.size("ids") * 20).cast("string"), F.lit(":")).cast("binary")
    return ids.select("g", F.concat(head, body, F.lit("e1:t2:aa1:y1:re").cast("binary")).alias("packet"))


_add("decode_dht", lambda s, d: _packets(s, d).select("g", B.decoded_message(F.col("packet")).alias("m")).select("g", "m.kind", F.posexplode("m.samples").alias("n", "id")), "WITH k AS (SELECT DISTINCT sighting_id // 8 AS g, lower(infohash) AS id FROM sightings WHERE regexp_full_match(infohash, '[0-9a-fA-F]{40}')) SELECT g, 'response' AS kind, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS n, id FROM k")


def _infos(s, d):
    """Single-file info dictionaries of the records."""
    name = F.col("name").cast("binary")
    return _names(s, d).join(C.records(s, d).select("id", "total_size"), "id").select("id", F.concat(F.concat(F.lit("d6:lengthi"), F.col("total_size").cast("string"), F.lit("e4:name"), F.octet_length("name").cast("string"), F.lit(":")).cast("binary"), name, F.lit("e").cast("binary")).alias("info"))


_add("decode_info", lambda s, d: _infos(s, d).select("id", B.decoded_info(F.col("info")).alias("i")).select("id", "i.name", "i.total_size", F.size("i.files").alias("n_files"), "i.error"), f"WITH {O.RECORDS} SELECT id, name, total_size, 1 AS n_files, NULL::VARCHAR AS error FROM recs WHERE name <> ''")
_add("bencode_length", lambda s, d: _infos(s, d).select("id", B.bencode_length(F.col("info")).alias("n")), f"WITH {O.RECORDS} SELECT id, (10 + length(total_size::VARCHAR) + 7 + length(strlen(name)::VARCHAR) + 1 + strlen(name) + 1)::INT AS n FROM recs WHERE name <> ''")
_add("verify_info", lambda s, d: _infos(s, d).select("id", B.verified(F.col("info"), F.sha1("info")).alias("ok"), F.sha1("info").alias("digest")), f"WITH {O.RECORDS} SELECT id, true AS ok, sha1('d6:lengthi' || total_size || 'e4:name' || strlen(name) || ':' || name || 'e') AS digest FROM recs WHERE name <> ''")


def _handshakes(s, d):
    """First packets of peers; every second one offers extensions."""
    even = F.col("seen_count") % 2 == 0
    reserved = F.when(even, F.unhex(F.lit("0000000000100000"))).otherwise(F.unhex(F.lit("0000000000000000")))
    return C.records(s, d).select("id", F.concat(F.lit(B.PROTOCOL), reserved, F.unhex("id"), F.lit(b"-XX0001-abcdefghijkl")).alias("packet"))


_add("peer_handshakes", lambda s, d: _handshakes(s, d).select("id", B.handshake(F.col("packet")).alias("h")).select("id", "h.info_hash", "h.extensions", "h.peer_id"), f"WITH {O.RECORDS} SELECT id, id AS info_hash, seen_count % 2 = 0 AS extensions, '{b'-XX0001-abcdefghijkl'.hex()}' AS peer_id FROM recs")


def _extended(s, d):
    """Extended handshakes that state the size of the metadata, and requests for one piece."""
    body = F.concat(F.lit("d1:md11:ut_metadatai3ee13:metadata_sizei"), F.col("total_size").cast("string"), F.lit("ee")).cast("binary")
    ask = F.concat(F.lit("d8:msg_typei0e5:piecei"), F.col("seen_count").cast("string"), F.lit("ee")).cast("binary")
    r = C.records(s, d).where("seen_count >= 0 AND total_size >= 0")
    return r.select("id", F.explode(F.array(B.extended_message(0, body), B.extended_message(3, ask))).alias("packet"))


_add("peer_messages", lambda s, d: _extended(s, d).select("id", B.peer_message(F.col("packet")).alias("m")).select("id", "m.*"), f"""WITH {O.RECORDS}, k AS (SELECT * FROM recs WHERE seen_count >= 0 AND total_size >= 0)
SELECT id, 'handshake' AS kind, 3 AS ut_metadata, total_size AS metadata_size, NULL::INT AS msg_type, NULL::BIGINT AS piece FROM k UNION ALL SELECT id, 'metadata', NULL, NULL, 0, seen_count FROM k""")
_add("dht_queries", lambda s, d: C.records(s, d).select("id", F.explode(F.array(*(B.query(m, F.lit(b"ab"), F.unhex(F.lit("11" * 20)), F.unhex("id")) for m in B.QUERY_KEYS))).alias("packet")).select("id", B.decoded_message(F.col("packet")).alias("m")).select("id", "m.kind", "m.method", "m.info_hash"), f"""WITH {O.RECORDS}
SELECT id, 'query' AS kind, unnest(['find_node', 'get_peers', 'other']) AS method, unnest([NULL, id, NULL]) AS info_hash FROM recs""")
_add("shown_dates", lambda s, d: C.records(s, d).select("id", T.date_short(F.col("last_seen")).alias("short"), T.date_full(F.col("last_seen")).alias("full")), f"""WITH {O.RECORDS} SELECT id, CASE WHEN coalesce(last_seen, 0) = 0 THEN '–' ELSE strftime(make_timestamp(last_seen * 1000000), '%d.%m.%y') END AS short,
 CASE WHEN coalesce(last_seen, 0) = 0 THEN '' ELSE strftime(make_timestamp(last_seen * 1000000), '%d.%m.%Y %H:%M:%S') END AS full FROM recs""")
#: Queries with what they must be understood as: meaning, keywords, category, first and last year.
UNDERSTOOD = [
    ("korku konulu filmleri listeler misin", "horror filmleri", "horror", "video", None, None),
    ("1980'lerin rock albümleri", "rock albümleri", "rock", "audio", 1980, 1989),
    ("velvet harbor 1999", "velvet harbor 1999", "velvet harbor 1999", None, None, None),
    ("books about lanterns", "books lanterns", "lanterns", "book", None, None),
    ("oyunlar", "oyunlar", "oyunlar", "game", None, None),
    ("", "", "", None, None, None),
]


def understood(s, d):
    return s.createDataFrame([(q,) for q, *_ in UNDERSTOOD], "text string").select("text", U.understood(F.col("text")).alias("u")).select("text", "u.semantic", "u.keyword", "u.category", "u.first_year", "u.last_year")


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else O.quoted(x)


_add("understood", understood, "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in UNDERSTOOD) + ") AS t(text, semantic, keyword, category, first_year, last_year)")
_add("decode_text", lambda s, d: _names(s, d).select("id", B.decoded_text(F.col("name").cast("binary")).alias("text")), _NAMES + " SELECT id, name AS text FROM n")
