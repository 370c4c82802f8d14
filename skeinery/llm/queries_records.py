"""p1_, p5_ and p6_ queries over ``torrents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import mojibake, near_dup, terms
from skeinery.session import materialize
from skeinery.sources.tables import table


def _records(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each id with its name; copies carry the same name."""
    return table(spark, directory, "torrents").groupBy("id").agg(F.min("name").alias("name"))


def p1_terms(spark: SparkSession, directory: str) -> DataFrame:
    """Every distinct term with its counts and its mark (null: neither rare nor common)."""
    return terms.marked_terms(materialize(_records(spark, directory).select("name"), "names"), text="name")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return p1_terms(spark, directory).where(F.col("mark").isNotNull()).select("term", "mark")


def _near(spark: SparkSession, directory: str) -> near_dup.Records:
    paths = F.coalesce(F.col("files.path"), F.array().cast("array<string>"))
    rows = table(spark, directory, "torrents").select("id", F.concat(F.array("name"), paths).alias("strings"))
    return near_dup.Records(rows, key="id", strings="strings", share=0.7)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _near(spark, directory).record_pairs()


def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    return _near(spark, directory).groups()


def p6_repaired(spark: SparkSession, directory: str) -> DataFrame:
    """Garbled names (``ord`` -1) and paths with the text restored where possible."""
    paths = F.coalesce(F.col("files.path"), F.array().cast("array<string>"))
    rows = table(spark, directory, "torrents").select("id", F.concat(F.array("name"), paths).alias("strings"))
    return mojibake.garbled_strings(rows, key="id", strings="strings").withColumn("ord", F.col("ord") - 1)


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return p6_repaired(spark, directory).select("id", "ord").distinct()


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_repaired": p6_repaired}

_TERMS = r"""
WITH names AS (SELECT id, min(name) AS name FROM torrents GROUP BY id HAVING min(name) IS NOT NULL AND min(name) <> ''),
low AS (SELECT id, lower(replace(regexp_replace(name, '(\p{L}\p{M}*)Σ($|[^\p{L}\p{M}])', '\1ς\2', 'g'), 'İ', 'i̇')) AS name FROM names),
t AS (SELECT id, unnest(regexp_extract_all(name, '[\p{L}\p{N}]+')) AS term FROM low),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM names) THEN 'common' END AS mark FROM c)
"""

_RUNS = r"""
WITH s AS (SELECT id, unnest(list_concat([name], list_transform(coalesce(files, []), lambda f: f.path))) AS s FROM torrents),
low AS (SELECT DISTINCT id, lower(replace(regexp_replace(s, '(\p{L}\p{M}*)Σ($|[^\p{L}\p{M}])', '\1ς\2', 'g'), 'İ', 'i̇')) AS s FROM s WHERE s <> ''),
t AS (SELECT id, regexp_extract_all(s, '[\p{L}\p{N}]+') AS t FROM low),
r AS (SELECT DISTINCT id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS run FROM t),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * common >= 7 * (x.n + y.n - common))
"""

ORACLE = {
    "p5_found": _RUNS + "SELECT id_a, id_b FROM pairs",
    "p5_groups": _RUNS.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), root AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY a), deg AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT id, least(id, coalesce(least, id)) AS group_id, coalesce(links, 0) AS links FROM (SELECT DISTINCT id FROM torrents WHERE id IS NOT NULL) LEFT JOIN root USING (id) LEFT JOIN deg USING (id)""",
    "p1_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT term, occurrences, records, mark FROM m",
}
