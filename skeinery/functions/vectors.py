"""Vector kernels as columns, and a deterministic text embedding."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def quantized(v: Column) -> Column:
    """struct(scale, q): symmetric int8 with scale max|x|/127, halves away from zero; zeros for a zero or non-finite vector."""
    x = F.transform(v, lambda e: e.cast("double"))
    top = F.array_max(F.transform(x, F.abs))
    ok = top.isNotNull() & (top > 0) & (top < float("inf")) & ~F.isnan(top)
    q = F.transform(x, lambda e: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(e * F.lit(127.0) / top).cast("int"))).cast("tinyint"))
    return F.struct(F.when(ok, top / 127.0).otherwise(0.0).alias("scale"), F.when(ok, q).otherwise(F.transform(v, lambda e: F.lit(0).cast("tinyint"))).alias("q"))


def dequantized(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda e: e.cast("double") * scale.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Integer dot product of int8 vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def dot_double(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot_double(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def l2_normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def expected_success(p: Column | float, n: Column) -> Column:
    """Chance that one of ``n`` tries with chance ``p`` each succeeds."""
    p = F.lit(p) if isinstance(p, float) else p
    return 1 - F.pow(1 - p, n)


def mean_pooled(states: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, normalised; ``states`` is an array of arrays."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m == 1, s)), lambda s: s.isNotNull())
    total = F.aggregate(kept, F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0)), lambda a, s: F.zip_with(a, s, lambda x, y: x + y.cast("double")))
    return l2_normalized(total)


def last_pooled(states: Column, mask: Column) -> Column:
    """The last token vector whose mask is 1, normalised."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m == 1, s)), lambda s: s.isNotNull())
    return l2_normalized(F.element_at(kept, -1))


_FNV = (0xCBF29CE484222325, 0x100000001B3)


def embed_text(text: str | None, dim: int) -> np.ndarray:
    """Hashed words with sign, normalised; the same text gives the same vector everywhere."""
    v = np.zeros(dim)
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        h = _FNV[0]
        for byte in word.encode():
            h = (h ^ byte) * _FNV[1] & 0xFFFFFFFFFFFFFFFF
        v[h % dim] += 1.0
        v[(h >> 32) % dim] += -0.5 if h >> 63 else 0.5
    n = np.linalg.norm(v)
    return v / n if n else v


def embedded(text: Column, dim: int = 64) -> Column:
    """Arrow UDF around ``embed_text``; any embedder of texts can take its place."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([embed_text(t, dim).astype(np.float32) for t in texts])

    return run(text)


def embedded_int8(text: Column, dim: int = 64) -> Column:
    """struct(scale, q) of the text's vector, quantised in the same Arrow batch."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [int8(embed_text(t, dim)) for t in texts]
        return pd.DataFrame({"scale": [s for _, s in rows], "q": [q for q, _ in rows]})

    return F.pandas_udf(run, "scale double, q array<tinyint>")(text)


def int8(vector: np.ndarray) -> tuple[np.ndarray, float]:
    """int8 form and scale of one vector, halves away from zero; zeros for a zero or non-finite one."""
    x = np.asarray(vector, np.float64)
    top = float(np.abs(x).max(initial=0.0))
    if not np.isfinite(top) or top == 0:
        return np.zeros(len(x), np.int8), 0.0
    return np.clip(np.sign(x) * np.floor(np.abs(x) * 127.0 / top + 0.5), -127, 127).astype(np.int8), top / 127.0
