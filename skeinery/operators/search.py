"""Search over the catalogue: keyword, semantic and hybrid, with correction of weak queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.functions import names as N
from skeinery.functions.spell import Vocabulary, vocabulary_rows
from skeinery.functions.understanding import QueryPlan, understand
from skeinery.operators import catalog, rank, vector_search
from skeinery.operators.catalog import SUMMARY, Filter
from skeinery.operators.fulltext import Index, compile_query

CANDIDATES = 400
SEMANTIC_K = CANDIDATES // 4
MODES = {"fts": "fts", "text": "fts", "keyword": "fts", "semantic": "semantic", "sem": "semantic", "vector": "semantic", "hybrid": "hybrid"}


def mode_of(name: str | None) -> str:
    return MODES.get((name or "").strip().lower(), "auto")


@dataclass(frozen=True)
class Request:
    text: str = ""
    limit: int = 100
    offset: int = 0
    sort: str = ""
    descending: bool = True
    keep: Filter = Filter()
    mode: str = "auto"
    show_weak: bool = False


@dataclass
class Outcome:
    """Rows with what was done to get them."""

    rows: DataFrame
    used: str
    weak: bool = False
    corrected: str | None = None


@dataclass
class Engine:
    """What searches read: items, the text index and, where there are any, vectors (rows or packed blocks).

    ``embed`` turns a query into a vector; ``scorer`` reranks.  Either may be
    missing: the search then does without.
    """

    items: DataFrame
    index: Index
    vectors: DataFrame | vector_search.VectorStore | None = None
    least_score: float = 0.45
    embed: Callable[[str], list[float]] | None = None
    scorer: Callable[[str, str | None], float] | None = None
    _words: Vocabulary | None = None

    def keyword(self, text: str, request: Request) -> DataFrame:
        """One page of the matches, best bm25 first under relevance."""
        hits = self.index.ranked(text)
        rows = hits.join(self.items.where(F.col("fetched") & request.keep.column()), "id")
        if request.sort in catalog.SORT_KEYS:
            order = catalog.sort_order(request.sort, request.descending)
        else:
            order = [F.col("score").asc(), F.col("seen_count").desc(), F.col("id").asc()]
        return catalog.page(rows, order, request.limit, request.offset).select(*SUMMARY, "score")

    def semantic_ids(self, text: str) -> DataFrame | None:
        """``id, score`` near the text: the best hundred above the floor and within the relative cut."""
        if self.vectors is None or self.embed is None or not text.strip():
            return None
        q, scale = vector_search.quantized_query(self.embed(text))
        hits = vector_search.nearest_any(self.vectors, q, scale, k=SEMANTIC_K, least=self.least_score)
        return rank.relative_cut(hits, least=self.least_score)

    def candidates(self, keyword_text: str, semantic: DataFrame | None, request: Request, plan: QueryPlan) -> DataFrame:
        """Fused and boosted candidates with all item columns, ``score`` and ``pos``."""
        visible = self.items.where(F.col("fetched") & request.keep.column())
        lists = []
        if compile_query(keyword_text):
            found = visible.join(self.index.matches(keyword_text), "id", "left_semi")
            lists.append((rank.positions(found, [F.col("seen_count").desc(), F.col("last_seen").desc(), F.col("id").asc()], CANDIDATES), 1.0))
        if semantic is not None:
            lists.append((rank.positions(semantic, [F.col("score").desc(), F.col("id").asc()], SEMANTIC_K), 1.0))
        if not lists:
            return visible.limit(0).withColumns({"score": F.lit(0.0), "first": F.lit(0), "pos": F.lit(0)})
        rows = rank.fused(lists).join(visible, "id")
        wanted = None if request.keep.category else plan.category
        if wanted or plan.year_range:
            year = N.parsed(F.col("name"))["year"] if plan.year_range else None
            rows = rank.boosted(rows, category=wanted, years=plan.year_range, year=year)
        order = [F.col("score").desc(), F.col("first").asc()]
        if request.sort in catalog.SORT_KEYS:
            order = catalog.candidate_order(request.sort, request.descending)
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)) - 1)

    def once(self, request: Request, plan: QueryPlan | None = None) -> Outcome:
        """One search without correction."""
        text = request.text.strip()
        plan = plan or understand(text)
        if not text or (plan.category_only and not request.keep.category):
            keep = request.keep if not text else replace(request.keep, category=plan.category)
            sort = request.sort if request.sort in catalog.SORT_KEYS else "seen"
            return Outcome(catalog.browse(self.items, limit=request.limit, offset=request.offset, sort=sort, descending=request.descending, keep=keep), "browse")
        mode = mode_of(request.mode)
        semantic = None if mode == "fts" else self.semantic_ids(plan.semantic_text)
        if semantic is None and mode != "semantic":
            return Outcome(self.keyword(plan.keyword_text or text, request), "fts")
        found = self.candidates("" if mode == "semantic" else plan.keyword_text, semantic, request, plan)
        used = "semantic" if mode == "semantic" else "hybrid"
        if self.scorer is not None and request.sort not in catalog.SORT_KEYS:
            top = found.where(F.col("pos") < max(request.offset + request.limit, rank.RERANK_TOP))
            top = top.withColumn("doc", F.concat_ws(" — ", N.parsed(F.col("name"))["title"], F.col("category")))
            scored = rank.reranked(top, text, text="doc", scorer=self.scorer)
            scored = scored.sparkSession.createDataFrame(scored.collect(), scored.schema)  # a page of candidates, scored once
            best = scored.agg(F.max("best")).first()[0]
            if best is not None and best < rank.WEAK_SCORE and not request.show_weak and not rank.lexical_evidence(scored, text).first()[0]:
                return Outcome(scored.limit(0).select(*SUMMARY, "score"), used, weak=True)
            return Outcome(scored.offset(request.offset).limit(request.limit).select(*SUMMARY, "score"), used)
        page = found.where((F.col("pos") >= request.offset) & (F.col("pos") < request.offset + request.limit))
        return Outcome(page.orderBy("pos").select(*SUMMARY, "score"), used)

    def words(self) -> Vocabulary:
        """Vocabulary for corrections: at most 300,000 terms, kept for the life of the engine."""
        if self._words is None:
            rows = vocabulary_rows(self.index.vocabulary()).collect()
            self._words = Vocabulary((r["term"], r["doc"]) for r in rows)
        return self._words

    def best_candidate(self, text: str, most: int = 64) -> str | None:
        """The first corrected query that matches anything; all are matched in one pass."""
        candidates = self.words().candidates(text, most)
        first = self.index.matching(candidates).agg(F.min("n")).first()[0] if candidates else None
        return None if first is None else candidates[first]

    def search(self, request: Request) -> Outcome:
        """Search with the lexical shortcut for short queries and one corrected retry for weak ones."""
        plan = understand(request.text)
        tokens, corrected = request.text.split(), None
        short = not plan.recognized and 1 <= len(tokens) <= 2
        if short:
            unknown = all(len(t) >= 4 and t not in self.words() for t in tokens)
            if unknown and not self.index.matches(request.text).limit(1).count():
                corrected = self.best_candidate(request.text)
                if corrected:
                    request, plan = replace(request, text=corrected), understand(corrected)
                elif len(tokens) == 1:
                    return Outcome(self.items.limit(0).select(*SUMMARY), "fts" if mode_of(request.mode) == "fts" else "hybrid", weak=True)
            if mode_of(request.mode) != "semantic" and self.index.matches(request.text).limit(1).count():
                rows = self.keyword(request.text, request)
                if rows.limit(1).count():
                    return Outcome(rows, "fts", corrected=corrected)
        found = self.once(request, plan)
        found.corrected = corrected
        if not found.weak:
            return found
        if again := self.best_candidate(request.text.strip()):
            second = self.once(replace(request, text=again))
            if not second.weak and second.rows.limit(1).count():
                second.corrected = again
                return second
        return found
