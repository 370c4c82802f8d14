"""Exact search over quantised vectors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinery.functions import text as T
from skeinery.functions import vectors as V


def current(embeddings: DataFrame, models: DataFrame | None = None, model_id: str | None = None) -> DataFrame:
    """The newest vector of each id for one model (or the active one): later writes replace earlier ones."""
    if model_id is not None:
        rows = embeddings.where(F.col("model_id") == model_id)
    else:
        rows = embeddings.join(F.broadcast(models.where("active").select("model_id")), "model_id", "left_semi")
    newest = Window.partitionBy("id").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def usable(rows: DataFrame) -> DataFrame:
    """Vectors of the stated dimension that aren't all zero."""
    return rows.where((F.size("q") == F.col("dim")) & F.exists("q", lambda e: e != 0))


def quantized_query(vector: list[float]) -> tuple[list[int], float]:
    """int8 form of a query vector, halves away from zero."""
    q, scale = V.int8(np.asarray(vector))
    return q.astype(int).tolist(), scale


def _single(dim: int) -> type:
    """Single precision holds int8 dot products exactly up to 1,040 dimensions."""
    return np.float32 if dim <= 1040 else np.float64


class _Best:
    """The best ``k`` of what one partition has scored: the k-th score bounds every later block."""

    def __init__(self, query: list[int], scale: float, k: int, least: float):
        self.dim, self.k = len(query), k
        self.q = np.asarray(query, _single(self.dim))
        self.scale, self.bound, self.least = scale, least, least
        self.rows = np.empty((max(1, 262_144 // max(1, self.dim)), self.dim), self.q.dtype)  # fits a core's cache; reused
        self.dots = np.empty(len(self.rows), self.q.dtype)
        self.score, self.seq, self.name = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, m: np.ndarray, scales: np.ndarray, seqs: Callable[[np.ndarray], np.ndarray], names: Callable[[np.ndarray], np.ndarray]) -> None:
        """Score the int8 rows ``m``; order and names are looked up only for rows that reach the bound."""
        step = len(self.rows)
        for a in range(0, len(m), step):
            n = min(step, len(m) - a)
            np.copyto(self.rows[:n], m[a : a + n])
            np.dot(self.rows[:n], self.q, out=self.dots[:n])
            score = self.dots[:n].astype(np.float64) * scales[a : a + n] * self.scale
            at = np.flatnonzero(score >= self.bound)
            if not len(at):
                continue
            score = np.concatenate([self.score, score[at]])
            seq = np.concatenate([self.seq, seqs(at + a)])
            name = np.concatenate([self.name, names(at + a)])
            order = np.lexsort((seq, -score))[: self.k]
            self.score, self.seq, self.name = score[order], seq[order], name[order]
            if len(order) == self.k:
                self.bound = max(self.least, self.score[-1])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.name, pa.string()), pa.array(self.seq), pa.array(self.score)], names=["id", "seq", "score"])


def nearest(rows: DataFrame, query: list[int], scale: float, *, k: int, least: float = float("-inf")) -> DataFrame:
    """``id, seq, score``: the ``k`` vectors with the highest scale * scale * dot, at least ``least``; ties by write order.

    Every partition keeps its own best ``k`` in NumPy and its k-th score as the
    bound of what follows, so only k rows a partition reach the final sort.
    """
    dim = len(query)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(query, scale, k, least)
        for batch in batches:
            if batch.num_rows:
                m = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                seq, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0)
                held.add(m, batch.column(2).to_numpy(zero_copy_only=False), lambda at: seq[at], lambda at: ids.take(pa.array(at)).to_numpy(zero_copy_only=False))
        yield held.batch()

    fed = rows.where((F.size("q") == dim) & F.col("scale").isNotNull()).select("id", "seq", F.col("scale").cast("double").alias("s"), "q")
    return fed.mapInArrow(best, "id string, seq bigint, score double").orderBy(F.desc("score"), "seq").limit(k)


def nearest_any(vectors: DataFrame | VectorStore, query: list[int], scale: float, *, k: int, least: float = float("-inf")) -> DataFrame:
    """``nearest`` over rows, packed blocks or a store, whichever ``vectors`` is."""
    if isinstance(vectors, VectorStore):
        return vectors.nearest(query, scale, k=k, least=least)
    return (nearest_packed if "seqs" in vectors.columns else nearest)(vectors, query, scale, k=k, least=least)


def nearest_columns(rows: DataFrame, query: list[int], scale: float, *, k: int, least: float = float("-inf")) -> DataFrame:
    """``nearest`` with built-in columns only, without Python on the executors."""
    literal = F.array(*(F.lit(x).cast("tinyint") for x in query))
    score = V.dot(F.col("q"), literal).cast("double") * F.col("scale").cast("double") * F.lit(scale)
    kept = rows.where((F.size("q") == len(query)) & F.col("scale").isNotNull()).select("id", "seq", score.alias("score")).where(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), "seq").limit(k)


PACKED = "n int, ids binary, seqs binary, scales binary, q binary"


def packed(rows: DataFrame, dim: int, block: int = 65_536) -> DataFrame:
    """Vectors as blocks of ``block``: contiguous int8 rows with their ids (40 hex digits), write order and scales.

    Meant to be kept (``persist`` or a written table) and asked many times with
    ``nearest_packed``: a query then moves bytes instead of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            q = t["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            parts = [b"".join(t["id"].to_pylist()), t["seq"].to_numpy().tobytes(), t["scale"].to_numpy().tobytes(), q.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["n", "ids", "seqs", "scales", "q"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield flush()
                held = []
        if any(b.num_rows for b in held):
            yield flush()

    kept = rows.where((F.size("q") == dim) & F.col("scale").isNotNull() & T.is_id(F.col("id")))
    return kept.select(F.unhex("id").alias("id"), "seq", F.col("scale").cast("float").alias("scale"), "q").mapInArrow(run, PACKED)


def nearest_packed(blocks: DataFrame, query: list[int], scale: float, *, k: int, least: float = float("-inf")) -> DataFrame:
    """``nearest`` over packed blocks: matrix products in cache-sized pieces, k rows a partition to the final sort."""
    dim = len(query)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(query, scale, k, least)
        for batch in batches:
            for n, ids, seqs, scales, m in zip(*batch.columns):
                matrix = np.frombuffer(m.as_buffer(), np.int8).reshape(n.as_py(), dim)
                seq, names = np.frombuffer(seqs.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), "V20")
                held.add(matrix, np.frombuffer(scales.as_buffer(), np.float32), lambda at: seq[at], lambda at: np.array([names[i].tobytes().hex() for i in at], object))
        yield held.batch()

    return blocks.mapInArrow(best, "id string, seq bigint, score double").orderBy(F.desc("score"), "seq").limit(k)


_LAID = "file string, n int"


def _local(path: str) -> str | None:
    """The plain path of a folder that every executor mounts (a ``file:`` URI), None for an object store."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path if path.startswith("/") else None


@dataclass
class VectorStore:
    """Packed vectors laid out once and asked many times.

    Where the shared folder is mounted, each block is a flat file that Python
    workers map into memory: a query moves nothing but its k best rows, and
    the workers of one machine share the pages.  Elsewhere the blocks are a
    Parquet table and every query reads it.  The list of block files goes to
    the driver: one entry for 65,536 vectors.
    """

    spark: SparkSession
    dim: int
    files: list[tuple[str, int]] | None = None
    blocks: DataFrame | None = None

    @staticmethod
    def write(rows: DataFrame, dim: int, folder: str, block: int = 65_536) -> VectorStore:
        place = _local(folder)
        blocks = packed(rows, dim, block)
        if place is None:
            blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
        else:

            def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                os.makedirs(f"{place}/flat", exist_ok=True)
                for batch in batches:
                    for n, *parts in zip(*batch.columns):
                        name = f"{place}/flat/{uuid.uuid4().hex}"  # a repeated task leaves a file that no list names
                        with open(name, "wb") as f:
                            for part in reversed(parts):  # q, scales, seqs, ids
                                f.write(part.as_buffer())
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.as_py()], pa.int32())], names=["file", "n"])

            blocks.mapInArrow(lay, _LAID).write.mode("overwrite").parquet(f"{folder}/laid")
        return VectorStore.read(rows.sparkSession, folder, dim)

    @staticmethod
    def read(spark: SparkSession, folder: str, dim: int) -> VectorStore:
        if _local(folder) is None:
            return VectorStore(spark, dim, blocks=spark.read.parquet(f"{folder}/blocks"))
        return VectorStore(spark, dim, [tuple(r) for r in spark.read.parquet(f"{folder}/laid").collect()])

    def nearest(self, query: list[int], scale: float, *, k: int, least: float = float("-inf")) -> DataFrame:
        """``id, seq, score`` as ``nearest`` gives them."""
        if self.files is None:
            return nearest_packed(self.blocks, query, scale, k=k, least=least)
        if len(query) != self.dim:
            raise ValueError(f"the store holds vectors of {self.dim} dimensions")
        dim, files = self.dim, self.files

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Best(query, scale, k, least)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    name, n = files[i]
                    flat = np.memmap(name, np.uint8, "r")
                    q, rest = flat[: n * dim].view(np.int8).reshape(n, dim), flat[n * dim :]
                    scales, seqs, names = (np.ndarray(n, kind, rest, a * n) for a, kind in ((0, np.float32), (4, np.int64), (12, "V20")))
                    held.add(q, scales, lambda at: seqs[at], lambda at: np.array([names[j].tobytes().hex() for j in at], object))
            yield held.batch()

        numbers = self.spark.range(0, len(files), 1, max(1, min(len(files), 4 * self.spark.sparkContext.defaultParallelism)))
        return numbers.mapInArrow(best, "id string, seq bigint, score double").orderBy(F.desc("score"), "seq").limit(k)


def backlog(items: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Fetched items with a name worth a vector that have none of this model yet."""
    done = vectors.where(F.col("model_id") == model_id).select("id")
    worth = F.col("fetched") & ~F.col("garbled") & (F.char_length("name") >= 2)
    return items.where(worth).join(done, "id", "left_anti")


def index_memory(rows: DataFrame) -> DataFrame:
    """Bytes an in-memory index of the vectors would take, by dimension."""
    return rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("dim") + F.lit(4) + F.lit(52)).alias("bytes"))
