"""p3_ queries over ``torrent_embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import knn
from skeinery.sources.tables import table

K = 5
LEAST_SCORE = 0.85


def _current(spark: SparkSession, directory: str) -> tuple[DataFrame, int]:
    """Each record's current vector of the active model, and the model's dimension."""
    model = table(spark, directory, "embed_models").where("active").select("model_id", "dim").first()
    if model is None:
        return table(spark, directory, "torrent_embeddings").select("id", "q").limit(0), 1
    rows = table(spark, directory, "torrent_embeddings").where(F.col("model_id") == model["model_id"])
    last = rows.groupBy(F.lower("id").alias("id")).agg(F.max(F.struct("seq", "dim", "q")).alias("v"))
    return last.where(F.col("v.dim") == model["dim"]).select("id", F.col("v.q").alias("q")), int(model["dim"])


def p3_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """For each record its 5 most similar others with their scores."""
    rows, dim = _current(spark, directory)
    return knn.neighbours(rows, key="id", vector="q", dim=dim, k=K)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    rows, dim = _current(spark, directory)
    near = knn.neighbours(rows, key="id", vector="q", dim=dim, k=K, least=LEAST_SCORE)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
_NEAR = """
WITH cur AS (SELECT * FROM (SELECT lower(e.id) AS id, e.q, e.dim, m.dim AS wanted, row_number() OVER (PARTITION BY lower(e.id) ORDER BY seq DESC) AS n FROM torrent_embeddings e JOIN embed_models m ON e.model_id = m.model_id AND m.active) WHERE n = 1),
v AS (SELECT id, list_transform(q, lambda x: x::DOUBLE) AS q, list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM cur WHERE dim = wanted AND len(q) = dim AND list_max(list_transform(q, lambda x: abs(x::INT))) > 0),
p AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.q, b.q) / sqrt(a.s * b.s) AS score FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank, neighbour, score FROM p QUALIFY rank <= 5)
"""
# both compare all vectors with all: meant for the small tables
ORACLE: dict[str, str] = {
    "p3_neighbours": _NEAR + "SELECT id, rank, neighbour, score FROM near",
    "p3_found": _NEAR + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM near WHERE score >= 0.85",
}
