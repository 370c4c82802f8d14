"""Full-text search: postings, vocabulary, prefix match, bm25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.functions import text as T
from skeinery.operators.catalog import largest_files

NAME_WEIGHT, PATH_WEIGHT = 10.0, 1.0
K1, B = 1.2, 0.75
MAX_PATHS = 48


def compile_query(query: str | None, *, split: bool = True) -> list[str]:
    """Folded prefix terms of a query; all must match.

    Words are split where letters and numbers end, so ``24.04`` asks for 24
    and 04; ``split=False`` joins what is left of each word instead.
    """
    source, target = T.fold_table()
    table = {ord(a): b for a, b in zip(source, target)} | {ord(a): None for a in source[len(target) :]}
    terms: list[str] = []
    for word in (query or "").translate(str.maketrans("Σİ", "σi")).lower().translate(table).split():
        if split:
            terms += "".join(c if c.isalnum() else " " for c in word).split()
        elif joined := "".join(c for c in word if c.isalnum()):
            terms.append(joined)
    return terms


def documents(items: DataFrame, files: DataFrame, most_paths: int = MAX_PATHS) -> DataFrame:
    """``id, name, paths``: the searchable text of every record that has a name."""
    named = items.where(F.col("name") != "").select("id", "name")
    chosen = largest_files(files, most_paths)
    paths = chosen.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda f: f["path"]), " ").alias("paths"))
    return named.join(paths, "id", "left").select("id", "name", F.coalesce("paths", F.lit("")).alias("paths"))


@dataclass
class Index:
    """``postings(term, id, hits_name, hits_paths, tokens)``, ``lengths(id, tokens)`` and, once written, ``stats(docs, mean)``.

    ``tokens`` is the length of the document, so that ranking needs no join.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame) -> Index:
        tokens = docs.select("id", T.tokens(F.col("name")).alias("a"), T.tokens(F.col("paths")).alias("b")).withColumn("tokens", (F.size("a") + F.size("b")).cast("bigint"))
        each = tokens.select("id", "tokens", F.explode(F.concat(F.transform("a", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("p"))), F.transform("b", lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("p"))))).alias("t"))
        postings = each.groupBy(F.col("t.term").alias("term"), "id").agg(F.sum("t.n").alias("hits_name"), F.sum("t.p").alias("hits_paths"), F.max("tokens").alias("tokens"))
        return Index(postings, tokens.select("id", "tokens"))

    def _stats(self) -> DataFrame:
        return self.stats if self.stats is not None else self.lengths.agg(F.count("*").alias("docs"), F.avg("tokens").alias("mean"))

    def write(self, folder: str) -> Index:
        """Keep the index as tables ordered by term, so a prefix reads only the row groups that can hold it."""
        ordered = self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        ordered.write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        spark = self.lengths.sparkSession
        Index(self.postings, spark.read.parquet(f"{folder}/lengths"))._stats().write.mode("overwrite").parquet(f"{folder}/stats")
        return Index.read(spark, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "lengths", "stats")))

    def vocabulary(self) -> DataFrame:
        """``term, doc, cnt``."""
        return self.postings.groupBy("term").agg(F.count("*").alias("doc"), F.sum(F.col("hits_name") + F.col("hits_paths")).alias("cnt"))

    def refreshed(self, changed: DataFrame) -> Index:
        """The index after the documents ``changed`` (id, name, paths) replace their earlier versions."""
        new = Index.build(changed)
        ids = changed.select("id")
        return Index(self.postings.join(ids, "id", "left_anti").unionByName(new.postings), self.lengths.join(ids, "id", "left_anti").unionByName(new.lengths))

    def _hits(self, terms: list[str]) -> DataFrame:
        """``id, t, hits``: weighted hits of each query term, by prefix.

        The terms are literals, so the prefixes reach the scan as pushed
        filters and one pass over the postings serves all of them.
        """
        which = F.filter(F.array(*(F.when(F.startswith("term", F.lit(t)), F.lit(i)) for i, t in enumerate(terms))), lambda x: x.isNotNull())
        any_ = F.lit(False)
        for t in terms:
            any_ = any_ | F.startswith("term", F.lit(t))
        weight = NAME_WEIGHT * F.col("hits_name") + PATH_WEIGHT * F.col("hits_paths")
        return self.postings.where(any_).select("id", "tokens", F.explode(which).alias("t"), weight.alias("w")).groupBy("id", "t").agg(F.sum("w").alias("hits"), F.max("tokens").alias("tokens"))

    def matching(self, queries: list[str]) -> DataFrame:
        """``n``: the positions of those of ``queries`` that match anything, in one pass over the postings."""
        asked = [(n, t) for n, q in enumerate(queries) for t in dict.fromkeys(compile_query(q))]
        terms = list(dict.fromkeys(t for _, t in asked))
        if not terms:
            return self.lengths.select(F.lit(0).alias("n")).limit(0)
        spark = self.lengths.sparkSession
        need = spark.createDataFrame([(n, terms.index(t), sum(m == n for m, _ in asked)) for n, t in asked], "n int, t int, terms int")
        met = self._hits(terms).select("id", "t").join(F.broadcast(need), "t")  # a row for each term of each query asked
        return met.groupBy("id", "n").agg(F.count("*").alias("c"), F.max("terms").alias("terms")).where("c = terms").select("n").distinct()

    def matches(self, query: str | None) -> DataFrame:
        """Ids in which every term of the query begins some token."""
        terms = list(dict.fromkeys(compile_query(query)))
        if not terms:
            return self.lengths.select("id").limit(0)
        return self._hits(terms).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("id")

    def count(self, query: str | None) -> DataFrame:
        return self.matches(query).agg(F.count("*").alias("n"))

    def ranked(self, query: str | None) -> DataFrame:
        """``id, score`` of the matches: bm25 with weighted columns, lower is better."""
        terms = list(dict.fromkeys(compile_query(query)))
        if not terms:
            return self.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
        hits = self._hits(terms)
        found = hits.groupBy("t").agg(F.count("*").alias("df"))
        raw = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = found.join(F.broadcast(self._stats())).select("t", "mean", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))  # a row for each query term
        parts = hits.join(F.broadcast(weights), "t")
        part = F.col("idf") * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("tokens") / F.col("mean")))
        per = parts.groupBy("id").agg(F.count("*").alias("n"), F.sum(part).alias("s"))
        return per.where(F.col("n") == len(terms)).select("id", (-F.col("s")).alias("score"))
