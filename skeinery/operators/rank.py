"""Ranking: reciprocal rank fusion, boosts, cuts, reranking with a confidence gate."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
BOOST_CATEGORY, BOOST_YEAR = 1.5, 1.3
RELATIVE_CUT = 0.80
RERANK_TOP, WEAK_SCORE = 30, -4.5


def positions(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``id, pos`` of the first ``limit`` rows of an order, from 0."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)) - 1).select("id", "pos")


def fused(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """``id, score, first``: sum of weight / (k + position + 1) over the lists; ``first`` orders ties by first appearance.

    The lists are short (a few hundred candidates).
    """
    parts = None
    for n, (ranked, weight) in enumerate(lists):
        part = ranked.select("id", (F.lit(float(weight)) / (F.lit(k + 1) + F.col("pos"))).alias("s"), (F.lit(n * (1 << 32)) + F.col("pos")).alias("first"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("s").alias("score"), F.min("first").alias("first"))


def boosted(rows: DataFrame, *, category: str | None = None, years: tuple[int, int] | None = None, year: Column | None = None) -> DataFrame:
    """Multiply ``score`` for rows of the wanted category and, given a year column, of the wanted years."""
    factor = F.lit(1.0)
    if category:
        factor = factor * F.when(F.col("category") == category, BOOST_CATEGORY).otherwise(1.0)
    if years and year is not None:
        factor = factor * F.when(year.between(*years), BOOST_YEAR).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * factor)


def relative_cut(hits: DataFrame, *, least: float, share: float = RELATIVE_CUT) -> DataFrame:
    """Hits with at least ``least`` and at least ``share`` of the best score; for a short list of hits."""
    best = F.max("score").over(Window.partitionBy())
    return hits.where(F.col("score") >= least).withColumn("_best", best).where(F.col("score") >= share * F.col("_best")).drop("_best")


def lexical_score(query: str, text: str | None) -> float:
    """Stand-in for a cross-encoder: share of query words found, on a logit-like scale."""
    words = [w for w in query.lower().split() if w]
    low = (text or "").lower()
    if not words:
        return -10.0
    return 12.0 * sum(w in low for w in words) / len(words) - 6.0


def reranked(rows: DataFrame, query: str, *, text: str, order: str = "pos", top: int = RERANK_TOP, scorer: Callable[[str, str | None], float] = lexical_score) -> DataFrame:
    """The first ``top`` rows by score of the reranker, the rest as they were; adds ``rerank`` and ``best``.

    ``best`` is the best score, for the confidence gate: below ``WEAK_SCORE``
    the result is weak.
    """

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([float(scorer(query, t)) for t in texts], dtype="float64")

    score = F.pandas_udf(batch, "double")
    head = rows.where(F.col(order) < top).withColumn("rerank", score(F.col(text)))
    tail = rows.where(F.col(order) >= top).withColumn("rerank", F.lit(None).cast("double"))
    both = head.unionByName(tail).withColumn("best", F.max("rerank").over(Window.partitionBy()))
    return both.orderBy(F.col("rerank").desc_nulls_last(), order)


def lexical_evidence(rows: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Is any query word of three letters or more part of any name?"""
    words = [w for w in query.lower().split() if len(w) >= 3]
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(name), F.lit(w))
    return rows.agg(F.coalesce(F.max(found), F.lit(False)).alias("evidence"))
