"""p7_, p8_ and p9_ queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import packing, spans, tokens
from skeinery.session import materialize
from skeinery.sources.tables import table

CAPACITY = 2048


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encode_ids(table(spark, directory, "documents"))


def p8_pack(spark: SparkSession, directory: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, directory, "documents"))
    packed = packing.pack(counted, key="doc_id", size="n_tokens", capacity=CAPACITY)
    return packed.withColumnRenamed("n", "n_tokens")


def p8_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What a packing must keep: every document with text packed, each token once, no container too full, nothing cut below the capacity, places without gap or overlap."""
    counted = materialize(tokens.count_tokens(table(spark, directory, "documents")), "token-counts")
    packed = materialize(packing.pack(counted, key="doc_id", size="n_tokens", capacity=CAPACITY), "packed")
    per = packed.groupBy("doc_id").agg(F.sum("n").alias("placed"), F.count("*").alias("pieces"))
    docs = counted.where("n_tokens > 0").join(per, "doc_id", "left").agg(F.count("placed").alias("documents"), F.count_if(~F.col("n_tokens").eqNullSafe(F.col("placed"))).alias("lost_or_doubled"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("cut"))
    full = packed.groupBy("container").agg(F.sum("n").alias("n"), F.max(F.col("position") + F.col("n")).alias("end"), F.countDistinct("position").alias("places"), F.count("*").alias("pieces"))
    bad = full.agg(F.count_if(F.col("n") > CAPACITY).alias("too_full"), F.count_if((F.col("n") != F.col("end")) | (F.col("places") != F.col("pieces"))).alias("misplaced"))
    one = F.lit(1).alias("one")  # a row each
    return docs.select("*", one).join(bad.select("*", one), "one").drop("one")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return spans.shared_spans(table(spark, directory, "documents"))


def p9_share(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


QUERIES = {"p7_ids": p7_ids, "p8_pack": p8_pack, "p8_checks": p8_checks, "p9_found": p9_found, "p9_share": p9_share}
_SHARED = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, hash(substring(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, n - 199)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -201) + 200 AS new FROM w SEMI JOIN s ON w.h = s.h),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM g GROUP BY doc_id, run)
"""
# every window of every text: meant for the small tables
ORACLE: dict[str, str] = {
    "p8_checks": "SELECT count(*) AS documents, 0 AS lost_or_doubled, 0 AS cut, 0 AS too_full, 0 AS misplaced FROM documents WHERE text <> ''",
    "p9_found": _SHARED + "SELECT doc_id, span_start, span_end FROM spans",
    "p9_share": _SHARED + """SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN coalesce(shared, 0)::BIGINT END AS shared_chars, CASE WHEN text = '' THEN 0.0 WHEN text IS NOT NULL THEN coalesce(shared, 0)::DOUBLE / length(text) END AS share
FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS shared FROM spans GROUP BY doc_id) USING (doc_id)""",
}
