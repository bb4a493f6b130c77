"""Dense retrieval over keyed int8 vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as tx


def quantized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("vec", tx.quantize(F.col(column)))


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Adds ``score``, the dot product of int8 vectors with a float query; the query travels as a literal."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", tx.dot(F.col("vec"), q))


def scored_matrix(vectors: DataFrame, query: list[float]) -> DataFrame:
    """As ``scored``, one matrix product per Arrow batch: faster for wide vectors."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(np.stack(v.to_numpy()).astype(np.float64) @ q if len(v) else np.zeros(0))

    return vectors.withColumn("score", product("vec"))


def top_vectors(vectors: DataFrame, query: list[float], want: int = 40) -> DataFrame:
    return scored(vectors, query).orderBy(F.desc("score"), "doc_id", "ordinal").limit(want)


def best_chunks(vectors: DataFrame, query: list[float], want: int = 40) -> DataFrame:
    """Best chunk of every document, best documents first; ties by document and ordinal. Combined before the shuffle."""
    best = scored(vectors, query).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("b"))
    return best.select("doc_id", (-F.col("b.o")).alias("ordinal"), F.col("b.score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(want)


def hash_embedding(text: str, dim: int = 384) -> list[float]:
    """Character 3- to 5-grams, hashed, log-weighted, of unit length."""
    t = re.sub(r"\s+", " ", (text or "").lower())
    counts = Counter(t[i : i + n] for n in (3, 4, 5) for i in range(max(0, len(t) - n + 1)))
    v = np.zeros(dim)
    for gram, c in counts.items():
        v[int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=4).digest(), "little") % dim] += 1 + math.log(c)
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def embed(chunks: DataFrame, dim: int = 384, encode=None) -> DataFrame:
    """Adds ``vec`` to ``chunks(title, text)``. ``encode``: a function from a list of texts to vectors."""

    @F.pandas_udf("array<double>")
    def vectors(titles: pd.Series, texts: pd.Series) -> pd.Series:
        joined = [f"{a}\n{b}" if a else b for a, b in zip(titles, texts, strict=True)]
        return pd.Series([list(map(float, v)) for v in encode(joined)] if encode else [hash_embedding(t, dim) for t in joined])

    return quantized(chunks.withColumn("_v", vectors("title", "text")), "_v").drop("_v")
