"""The vector artifact: chunks with int8 vectors as one Parquet table beside what they were made from.

A build is written under its own name and taken up by a pointer, so readers see all of it or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import chunks, vectors


def fingerprint(docs: DataFrame, model: str, dim: int) -> str:
    """Changes with any body, the model or its width, not with the order of rows."""
    h = docs.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(F.col("id").cast("string"), F.coalesce("body", F.lit(""))), F.lit((1 << 40) + 15))).alias("s")).first()
    return f"{model}:{dim}:{h.n}:{h.s or 0}"


def build(docs: DataFrame, root: str, model: str = "hash", dim: int = 384, encode=None, configured: list[str] | None = None) -> dict:
    """Writes the vectors of all chunks of ``docs(id, title, body)`` and returns the pointer's content."""
    spark = docs.sparkSession
    cut = chunks.chunked(chunks.units(docs, configured))
    made = vectors.embed(cut, dim, encode).select("doc_id", "ordinal", "heading", "preview", "vec")
    name = f"vectors-{uuid.uuid4().hex}"
    made.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ordinal").write.parquet(f"{root}/{name}")
    meta = {"table": name, "model": model, "dim": dim, "fingerprint": fingerprint(docs, model, dim)}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return meta


def _pointer(spark: SparkSession, root: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{root}/current").limit(1).collect()
        return json.loads(rows[0].value) if rows else None
    except (AnalysisException, ValueError):
        return None


def load(spark: SparkSession, root: str, probe_dim: int | None = None) -> tuple[DataFrame | None, str]:
    """(vectors, "ok") or (None, why). Vectors of another width than the encoder's cannot be compared with a query."""
    meta = _pointer(spark, root)
    if meta is None:
        return None, "no artifact"
    if probe_dim is not None and probe_dim != meta["dim"]:
        return None, f"the encoder gives {probe_dim} numbers, the artifact holds {meta['dim']}"
    table = spark.read.parquet(f"{root}/{meta['table']}")
    if not table.where(F.size("vec") != meta["dim"]).isEmpty():
        return None, "a vector has another width"
    return table, "ok"


def status(docs: DataFrame, root: str) -> tuple[bool, str]:
    meta = _pointer(docs.sparkSession, root)
    if meta is None:
        return False, "no artifact"
    current = meta["fingerprint"] == fingerprint(docs, meta["model"], meta["dim"])
    return current, "current" if current else "content changed"


class ArtifactRanker:
    """Semantic search over an artifact, for ``Corpus.ranker``."""

    def __init__(self, table: DataFrame, dim: int, encode=None):
        self.table, self.dim, self.encode = table, dim, encode

    def rank_chunks(self, query: str, want: int) -> DataFrame:
        q = self.encode([query])[0] if self.encode else vectors.hash_embedding(query, self.dim)
        scored = vectors.scored_matrix(self.table, [float(x) for x in q])
        return scored.orderBy(F.desc("score"), "doc_id", "ordinal").limit(want).select("doc_id", "ordinal", "heading", "preview", "score")
