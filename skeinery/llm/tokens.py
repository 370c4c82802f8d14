"""Problem 7: the whole corpus as token ids, and token counts for packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm import byte_bpe


def default_vocabulary() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_ids(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, ids_each: int = 2_000_000) -> DataFrame:
    """``key, ids``: the ids of every text, without special tokens.

    One narrow pass: no shuffle, whole texts, one output row for each input
    row.  Null and empty texts both give the empty list; a null key is kept;
    repeated rows stay repeated; other columns are not read.  Pieces are
    memoised in a bounded table per worker; pieces it does not hold are
    encoded by backtracking.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.for_worker(path)
        held = byte_bpe.PieceIds(bpe)
        look, findall = held.__getitem__, bpe.findall
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            parts: list[bytes] = []
            ends: list[int] = []
            first = total = 0
            for n, s in enumerate(texts):
                s = s.as_py()
                if s:
                    ids = b"".join(map(look, findall(s)))
                    parts.append(ids)
                    total += len(ids) // 4
                ends.append(total)
                if total >= ids_each or n + 1 == len(texts):
                    offsets = np.zeros(len(ends) + 1, np.int32)
                    offsets[1:] = ends
                    values = np.frombuffer(b"".join(parts), np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(ends)), lists], names=["k", "ids"])
                    parts, ends, first, total = [], [], n + 1, 0

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key, n_tokens`` of every row; null and empty texts count 0 tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.for_worker(path)
        look, findall = byte_bpe.PieceCounts(bpe).__getitem__, bpe.findall
        for batch in batches:
            counts = [sum(map(look, findall(s))) if (s := t.as_py()) else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["k", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def decode_ids(ids: DataFrame, *, key: str = "doc_id", column: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key, text``: the inverse of ``encode_ids``; null lists give null, empty lists ''."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.for_worker(path)
        for batch in batches:
            texts = [None if not x.is_valid else bpe.decode_bytes(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(F.col(key).alias("k"), F.col(column).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
