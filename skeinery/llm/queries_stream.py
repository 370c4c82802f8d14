"""p2_ and p4_ queries over ``sightings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import heavy, seen
from skeinery.sources.tables import table

SHARE = 1 / 200


def _is_key() -> Column:
    return (F.length("infohash") == 40) & F.col("infohash").rlike("^[0-9a-fA-F]{40}$")


def _weighted(spark: SparkSession, directory: str) -> DataFrame:
    """Each distinct sighting once, with its weight; deliveries repeat id, key and weight."""
    rows = table(spark, directory, "sightings").where(_is_key())
    weight = F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(1)).cast("bigint")
    return rows.select("sighting_id", F.lower("infohash").alias("infohash"), weight.alias("weight")).distinct()


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    found = heavy.heavy_items(_weighted(spark, directory), item="infohash", weight="weight", share=SHARE)
    return found.select(F.col("item").alias("infohash"))


def p2_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """The same ids with the bounds of their weights."""
    return heavy.heavy_items(_weighted(spark, directory), item="infohash", weight="weight", share=SHARE).withColumnRenamed("item", "infohash")


def p2_weights(spark: SparkSession, directory: str) -> DataFrame:
    """The exact weight of every candidate that has the share, by a second pass, and whether its bounds hold."""
    rows = _weighted(spark, directory)
    found = heavy.heavy_items(rows, item="infohash", weight="weight", share=SHARE).withColumnRenamed("item", "infohash")
    exact = rows.join(F.broadcast(found.select("infohash")), "infohash").groupBy("infohash").agg(F.sum("weight").alias("weight"))  # at most depth * width ids
    both = exact.join(found, "infohash").where(F.col("weight") >= SHARE * F.col("total_weight"))
    return both.select("infohash", "weight", F.col("weight").between(F.col("weight_lower"), F.col("weight_upper")).alias("within"))


def _tested(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "sightings").where(_is_key()).select("sighting_id", F.unhex("infohash").alias("key"))
    return seen.seen_before(rows, order="sighting_id", key="key")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return _tested(spark, directory).where("seen").select("sighting_id")


def p4_rate(spark: SparkSession, directory: str) -> DataFrame:
    """Answers, answers "seen" by where they were found, and the expected number and rate of wrong ones."""
    return seen.error_rate(_tested(spark, directory))


QUERIES = {"p2_found": p2_found, "p2_bounds": p2_bounds, "p2_weights": p2_weights, "p4_found": p4_found, "p4_rate": p4_rate}

_KEYED = "SELECT sighting_id, lower(infohash) AS k, max(greatest(coalesce(repeats, 0), 1)) AS w FROM sightings WHERE regexp_full_match(infohash, '[0-9a-fA-F]{40}') GROUP BY ALL"

ORACLE = {
    "p2_found": f"WITH s AS ({_KEYED}), t AS (SELECT k, sum(w) AS w FROM s GROUP BY k) SELECT k AS infohash FROM t WHERE w * 200 >= (SELECT sum(w) FROM t)",
    "p2_weights": f"WITH s AS ({_KEYED}), t AS (SELECT k, sum(w)::BIGINT AS w FROM s GROUP BY k) SELECT k AS infohash, w AS weight, true AS within FROM t WHERE w * 200 >= (SELECT sum(w) FROM t)",
    "p4_found": f"WITH s AS (SELECT DISTINCT sighting_id, k FROM ({_KEYED})) SELECT sighting_id FROM (SELECT sighting_id, row_number() OVER (PARTITION BY k ORDER BY sighting_id) AS n FROM s) WHERE n > 1",
}
