"""Full-text, vector and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinery.functions import vectors as V
from skeinery.functions.understanding import understand
from skeinery.operators import analytics as A
from skeinery.operators import kept
from skeinery.operators import catalog as C
from skeinery.operators import rank as R
from skeinery.operators import search as S
from skeinery.operators import vector_search as VS
from skeinery.operators.fulltext import Index, compile_query, documents
from skeinery.plans import oracle as O
from skeinery.plans import stores
from skeinery.plans.queries_text import _PARSED as PARSED
from skeinery.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TEXT, TERMS = "Harbor 1080", ["harbor", "1080"]
DIM = 64


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


_index = stores.text_index


_add("fts_match_count", lambda s, d: _index(s, d).count(TEXT), f"WITH {O.INDEX}, {O.matched(TERMS)} SELECT count(*) AS n FROM matched")
_add("fts_match", lambda s, d: _index(s, d).matches("x26"), f"WITH {O.INDEX}, {O.matched(['x26'])} SELECT id FROM matched")
_add("fts_bm25", lambda s, d: _index(s, d).ranked(TEXT).withColumn("score", F.round("score", 6)), f"WITH {O.INDEX}, {O.bm25(TERMS)} SELECT id, round(score, 6) AS score FROM bm")
_add("fts_search_bm25", lambda s, d: S.Engine(stores.items(s, d), _index(s, d)).keyword(TEXT, S.Request(limit=50, keep=C.Filter(hide_adult=True))).drop("score"), f"""WITH {O.INDEX}, {O.bm25(TERMS)}
SELECT {O.SUMMARY} FROM bm JOIN items USING (id) WHERE fetched AND category <> 'adult' ORDER BY score, seen_count DESC, id LIMIT 50""")
_add("fts_refresh", lambda s, d: _refreshed(s, d).vocabulary(), f"WITH {O.INDEX} SELECT term, count(*) AS doc, sum(hits_name + hits_paths)::BIGINT AS cnt FROM postings GROUP BY term")


def _refreshed(s, d) -> Index:
    """The index after all documents of one category are written again."""
    docs = documents(C.items(s, d), C.files(s, d))
    again = docs.join(C.items(s, d).where("category = 'audio'").select("id"), "id", "left_semi")
    return Index.build(docs).refreshed(again)


_current = stores.vectors


def _nearest(s, d, k, least=float("-inf"), query=None):
    """The default path of searches: over the kept vector store."""
    return stores.vector_store(s, d).nearest(*(query or _example(s, d)), k=k, least=least)


_CURRENT = """cur AS (SELECT * EXCLUDE (n) FROM (SELECT e.*, row_number() OVER (PARTITION BY e.id ORDER BY e.seq DESC) AS n FROM torrent_embeddings e JOIN embed_models m ON e.model_id = m.model_id AND m.active) WHERE n = 1),
vec AS (SELECT * FROM cur WHERE len(q) = dim AND list_max(list_transform(q, lambda x: abs(x::INT))) > 0)"""
_add("latest_vectors", lambda s, d: VS.current(table(s, d, "torrent_embeddings"), table(s, d, "embed_models")).select("id", "seq", "model_id"), f"WITH {_CURRENT} SELECT id, seq, model_id FROM cur")
_add("model_switch", lambda s, d: VS.current(table(s, d, "torrent_embeddings"), model_id="birch-base-64").select("id", "seq"), "SELECT id, max(seq) AS seq FROM torrent_embeddings WHERE model_id = 'birch-base-64' GROUP BY id")


def _example(s, d) -> tuple[list[int], float]:
    """The first usable vector, as a query."""
    r = _current(s, d).where("scale is not null").orderBy("seq").select("q", "scale").first()
    return list(r["q"]), float(r["scale"])


_ONE = "one AS (SELECT q AS oq, scale AS os FROM vec WHERE scale IS NOT NULL ORDER BY seq LIMIT 1)"
_SCORED = f"WITH {_CURRENT}, {_ONE}, sc AS (SELECT id, seq, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::BIGINT * oq[i]::BIGINT))::DOUBLE * scale::DOUBLE * os::DOUBLE AS score FROM vec, one WHERE scale IS NOT NULL)"
_add("vector_topk_int8", lambda s, d: VS.nearest(_current(s, d), *_example(s, d), k=50).withColumn("score", F.round("score", 6)).drop("seq"), f"{_SCORED} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 50")
_add("vector_topk_store", lambda s, d: _nearest(s, d, 50).withColumn("score", F.round("score", 6)).drop("seq"), f"{_SCORED} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 50")
_add("vector_topk_columns", lambda s, d: VS.nearest_columns(_current(s, d), *_example(s, d), k=50).withColumn("score", F.round("score", 6)).drop("seq"), f"{_SCORED} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 50")
_add("vector_topk_packed", lambda s, d: VS.nearest_packed(VS.packed(_current(s, d), DIM), *_example(s, d), k=50).withColumn("score", F.round("score", 6)).drop("seq"), f"{_SCORED} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, seq LIMIT 50")
_add("vector_relative_cut", lambda s, d: R.relative_cut(_nearest(s, d, 100, 0.25), least=0.25).select("id", F.round("score", 6).alias("score")), f"""{_SCORED}, t AS (SELECT * FROM sc WHERE score >= 0.25 ORDER BY score DESC, seq LIMIT 100)
SELECT id, round(score, 6) AS score FROM t WHERE score >= 0.80 * (SELECT max(score) FROM t)""")
_add("vector_topk", lambda s, d: _topk_float(s, d), """WITH o AS (SELECT embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], w) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(w, w)) + 1e-9), 6) AS score FROM embeddings, o ORDER BY 2 DESC, vec_id LIMIT 20""")


def _topk_float(s, d):
    w = list(table(s, d, "embeddings").where("vec_id = 0").first()["embedding"])
    score = F.round(V.cosine(F.col("embedding"), F.array(*map(F.lit, w))), 6)
    return table(s, d, "embeddings").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


_add("embed_backlog_anti", lambda s, d: VS.backlog(stores.items(s, d), table(s, d, "torrent_embeddings"), "hazel-small-64").select("id", "name"), f"""WITH {O.ITEMS} SELECT id, name FROM items WHERE fetched AND NOT garbled AND length(name) >= 2
 AND NOT EXISTS (SELECT 1 FROM torrent_embeddings e WHERE e.id = items.id AND e.model_id = 'hazel-small-64')""")
_add("semi_candidates", lambda s, d: stores.items(s, d).join(F.broadcast(_nearest(s, d, 50).select("id")), "id", "left_semi").select("id", "name", "category"), f"""{_SCORED.replace("WITH ", f"WITH {O.ITEMS}, ", 1)}, t AS (SELECT id FROM sc ORDER BY score DESC, seq LIMIT 50) SELECT id, name, category FROM items WHERE id IN (SELECT id FROM t)""")


def _two_lists(s, d):
    visible = stores.items(s, d).where("fetched")
    found = visible.join(_index(s, d).matches(TEXT), "id", "left_semi")
    keyword = R.positions(found, [F.col("seen_count").desc(), F.col("last_seen").desc(), F.col("id").asc()], S.CANDIDATES)
    hits = _nearest(s, d, S.SEMANTIC_K)
    return keyword, R.positions(hits, [F.col("score").desc(), F.col("seq").asc()], S.SEMANTIC_K)


_LISTS = f"""{_SCORED.replace("WITH ", f"WITH {O.INDEX}, {O.matched(TERMS)}, ", 1)},
kw AS (SELECT id, row_number() OVER (ORDER BY seen_count DESC, last_seen DESC, id) - 1 AS pos FROM items WHERE fetched AND id IN (SELECT id FROM matched) QUALIFY pos < 400),
sem AS (SELECT id, row_number() OVER (ORDER BY score DESC, seq) - 1 AS pos FROM sc QUALIFY pos < 100),
rrf AS (SELECT id, sum(1.0::DOUBLE / (61 + pos)) AS score, min(first) AS first FROM (SELECT id, pos, pos AS first FROM kw UNION ALL SELECT id, pos, 4294967296 + pos FROM sem) GROUP BY id)"""
_add("rrf_fusion", lambda s, d: R.fused([(x, 1.0) for x in _two_lists(s, d)]).select("id", F.round("score", 9).alias("score")), f"{_LISTS} SELECT id, round(score, 9) AS score FROM rrf")


def hybrid_boosted(s, d):
    fused = R.fused([(x, 1.0) for x in _two_lists(s, d)]).join(stores.items(s, d).where("fetched AND category <> 'adult'"), "id")
    best = R.boosted(fused, category="video")
    return best.orderBy(F.desc("score"), "first").limit(60).select("id", "name", "category", F.round("score", 9).alias("score"))


_add("hybrid_boosted", hybrid_boosted, f"""{_LISTS}, b AS (SELECT i.id, i.name, i.category, score * CASE WHEN category = 'video' THEN 1.5::DOUBLE ELSE 1.0 END AS score, first FROM rrf JOIN items i ON rrf.id = i.id WHERE fetched AND category <> 'adult')
SELECT id, name, category, round(b.score, 9) AS score FROM b ORDER BY b.score DESC, first LIMIT 60""")
_add("hybrid_by_size", lambda s, d: R.fused([(x, 1.0) for x in _two_lists(s, d)]).join(stores.items(s, d).where("fetched"), "id").orderBy(*C.candidate_order("cat", True)).limit(60).select("id", "category", "name"), f"{_LISTS} SELECT i.id, category, name FROM rrf JOIN items i ON rrf.id = i.id WHERE fetched ORDER BY category DESC, lower(name) DESC, i.id LIMIT 60")


def _engine(s, d, scorer=None) -> S.Engine:
    names = stores.items(s, d).where("fetched AND name <> ''")
    quant = names.select("id", F.conv(F.substring("id", 1, 15), 16, 10).cast("bigint").alias("seq"), F.lit(DIM).alias("dim"), V.embedded_int8(F.col("name"), DIM).alias("x")).select("id", "seq", "dim", F.col("x.scale").alias("scale"), F.col("x.q").alias("q"))
    path = kept.folder(s, d, "name-vectors", ["torrents", "torrent_state"], lambda p: VS.VectorStore.write(quant, DIM, p))
    return S.Engine(stores.items(s, d), _index(s, d), stores.opened(s, path), 0.2, lambda t: V.embed_text(t, DIM).tolist(), scorer)


HYBRID, MISSPELT, MEANT = "harbor glass 1080p movies", "habror", "harbor"


def _searched(engine: S.Engine, request: S.Request, digits: int = 9):
    return engine.search(request).rows.withColumn("score", F.round("score", digits))


def _hybrid_sql(text: str, limit: int) -> str:
    """Keyword and name-vector candidates, fused, boosted by the category the query asks for."""
    plan = understand(text)
    q, scale = VS.quantized_query(V.embed_text(plan.semantic_text, DIM).tolist())
    return f"""WITH {O.INDEX}, {O.matched(compile_query(plan.keyword_text))},
nm AS (SELECT id, name FROM items WHERE fetched AND name <> ''), {O.embeddings("nm", DIM)}, nv AS ({O.int8("emb")}),
kw AS (SELECT id, row_number() OVER (ORDER BY seen_count DESC, last_seen DESC, id) - 1 AS pos FROM items WHERE fetched AND id IN (SELECT id FROM matched) QUALIFY pos < {S.CANDIDATES}),
sv AS (SELECT id, {O.dot("q", q)} * scale::DOUBLE * {scale!r}::DOUBLE AS score, ('0x' || substr(id, 1, 15))::BIGINT AS seq FROM nv),
st_ AS (SELECT * FROM sv WHERE score >= 0.2 ORDER BY score DESC, seq LIMIT {S.SEMANTIC_K}),
sem AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS pos FROM st_ WHERE score >= {R.RELATIVE_CUT}::DOUBLE * (SELECT max(score) FROM st_)),
rrf AS (SELECT id, sum(1.0::DOUBLE / (61 + pos)) AS score, min(first) AS first FROM (SELECT id, pos, pos AS first FROM kw UNION ALL SELECT id, pos, 4294967296 + pos FROM sem) GROUP BY id),
b AS (SELECT i.*, r.score * CASE WHEN category = '{plan.category}' THEN {R.BOOST_CATEGORY}::DOUBLE ELSE 1.0 END AS score, first FROM rrf r JOIN items i ON r.id = i.id WHERE fetched)
SELECT {O.SUMMARY}, round(b.score, 9) AS score FROM b ORDER BY b.score DESC, first LIMIT {limit}"""


_add("search_hybrid", lambda s, d: _searched(_engine(s, d), S.Request(text=HYBRID, limit=40, mode="hybrid")), _hybrid_sql(HYBRID, 40))


def _reranked_sql(text: str, limit: int) -> str:
    """The best of the hybrid candidates by the share of query words in title and category."""
    words = text.lower().split()
    inner = _hybrid_sql(text, R.RERANK_TOP).removeprefix("WITH ").rsplit("\nSELECT ", 1)[0]
    parsed = PARSED.replace("WITH ", "", 1).replace(O.RECORDS + ", ", "", 1).replace("n AS (SELECT id, name FROM recs", "n AS (SELECT id, name FROM top", 1)
    share = " + ".join(f"contains(low, {O.quoted(w)})::INT" for w in words)
    return f"""WITH {inner}, top AS (SELECT b.*, row_number() OVER (ORDER BY score DESC, first) AS pos FROM b QUALIFY pos <= {R.RERANK_TOP}), {parsed},
sc AS (SELECT t.*, 12.0::DOUBLE * ({share}) / {len(words)} - 6.0 AS rerank FROM (SELECT top.*, lower(concat_ws(' — ', p.title, category)) AS low FROM top LEFT JOIN parsed p ON top.id = p.id) t)
SELECT {O.SUMMARY}, round(score, 9) AS score FROM sc ORDER BY rerank DESC, pos LIMIT {limit}"""


_add("search_reranked", lambda s, d: _searched(_engine(s, d, R.lexical_score), S.Request(text=HYBRID, limit=20, mode="hybrid")), _reranked_sql(HYBRID, 20))
_add("search_corrected", lambda s, d: _searched(_engine(s, d), S.Request(text=MISSPELT, limit=20), 6), f"""WITH {O.INDEX}, {O.bm25([MEANT])}
SELECT {O.SUMMARY}, round(bm.score, 6) AS score FROM bm JOIN items USING (id) WHERE fetched ORDER BY bm.score, seen_count DESC, id LIMIT 20""")
_add("search_browse", lambda s, d: _engine(s, d).search(S.Request(text="movies", limit=50)).rows, f"WITH {O.ITEMS} SELECT {O.SUMMARY} FROM items WHERE fetched AND category = 'video' ORDER BY seen_count DESC, id LIMIT 50")


NONSENSE = {q: VS.quantized_query(V.embed_text(q, DIM).tolist()) for q in ("qwzx vbnp", "zzkk plmo", "xxqq wwvv", "jjhh ggff")}


def _noise(s, d):
    scores = None
    for q, (x, scale) in NONSENSE.items():
        hits = _nearest(s, d, 1, query=(x, scale)).select(F.lit(q).alias("query"), "score")
        scores = hits if scores is None else scores.unionByName(hits)
    return A.noise_floor(scores, 0.2).select(F.round("floor", 9).alias("floor"))


_add("noise_floor", _noise, f"WITH {_CURRENT}, b AS (" + " UNION ALL ".join(f"SELECT max({O.dot('q', x)} * scale::DOUBLE * {scale!r}::DOUBLE) AS best FROM vec WHERE scale IS NOT NULL" for x, scale in NONSENSE.values()) + ") SELECT round(greatest(median(best), 0.2), 9) AS floor FROM b")
WANTED = [("harbor 1080p", ["harbor"]), ("velvet flac", ["velvet"]), ("zzqqxx", [])]


def retrieval_quality(s, d):
    """hit@5 and MRR of keyword search for a few fixed texts."""
    index, items = _index(s, d), stores.items(s, d)
    found = None
    for text, _ in WANTED:
        page = S.Engine(items, index).keyword(text, S.Request(limit=20))
        ranked = R.positions(page, [F.col("score").asc(), F.col("seen_count").desc(), F.col("id").asc()], 20).join(page.select("id", "name"), "id")
        part = ranked.select(F.lit(text).alias("query"), (F.col("pos") + 1).alias("rank"), "name")
        found = part if found is None else found.unionByName(part)
    return A.evaluation(found, s.createDataFrame(WANTED, "query string, wanted array<string>"))


def _ranks_sql(n: int, text: str, wanted: list[str]) -> str:
    hit = f"contains(lower(name), {O.quoted(wanted[0])})" if wanted else "false"
    return f"""SELECT {n} AS q, {bool(wanted)} AS wanted, min(pos) FILTER ({hit}) AS first, count(*) AS n FROM (WITH {O.bm25(compile_query(text))}
 SELECT name, row_number() OVER (ORDER BY score, seen_count DESC, id) AS pos FROM bm JOIN items USING (id) WHERE fetched QUALIFY pos <= 20)"""


_add("retrieval_quality", retrieval_quality, f"WITH {O.INDEX}, r AS (" + " UNION ALL ".join(_ranks_sql(n, *w) for n, w in enumerate(WANTED)) + """)
SELECT count(*) FILTER (wanted) AS queries, avg(coalesce(first <= 5, false)::INT::DOUBLE) FILTER (wanted) AS hit_rate, avg(coalesce(1.0::DOUBLE / first, 0.0)) FILTER (wanted) AS mrr, avg((n = 0)::INT::DOUBLE) FILTER (NOT wanted) AS empty_ok FROM r""")
_add("lexical_evidence", lambda s, d: R.lexical_evidence(stores.items(s, d).where("fetched"), "zz harbor"), f"WITH {O.ITEMS} SELECT coalesce(bool_or(contains(lower(name), 'harbor')), false) AS evidence FROM items WHERE fetched")
