"""The kept tables that several queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinery.operators import catalog as C
from skeinery.operators import kept
from skeinery.operators import vector_search as VS
from skeinery.operators.fulltext import Index, documents
from skeinery.sources.tables import table

_ITEMS, _VECTORS = ["torrents", "torrent_state"], ["torrent_embeddings", "embed_models"]
DIM = 64


def items(spark: SparkSession, directory: str) -> DataFrame:
    """Items as browsing reads them: category and file count are stored, so listings leave ``files`` unread."""
    return kept.table(spark, directory, "items", _ITEMS, lambda: C.items(spark, directory))


def text_index(spark: SparkSession, directory: str) -> Index:
    def write(path: str) -> None:
        Index.build(documents(items(spark, directory), C.files(spark, directory))).write(path)

    return Index.read(spark, kept.folder(spark, directory, "text-index", _ITEMS, write))


def vectors(spark: SparkSession, directory: str) -> DataFrame:
    """The usable current vector of each id under the active model."""
    return kept.table(spark, directory, "vectors", _VECTORS, lambda: VS.usable(VS.current(table(spark, directory, "torrent_embeddings"), table(spark, directory, "embed_models"))))


def vector_store(spark: SparkSession, directory: str) -> VS.VectorStore:
    """The same laid out for repeated queries."""
    return opened(spark, kept.folder(spark, directory, "vector-store", _VECTORS, lambda p: VS.VectorStore.write(vectors(spark, directory), DIM, p)))


_open: dict[str, VS.VectorStore] = {}


def opened(spark: SparkSession, path: str) -> VS.VectorStore:
    """A store whose list of blocks is read once."""
    if path not in _open or _open[path].spark is not spark:
        _open[path] = VS.VectorStore.read(spark, path, DIM)
    return _open[path]
