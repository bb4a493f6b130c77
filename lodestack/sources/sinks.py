"""Sinks: versioned index tables, the compact index, the drift file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import catalog, drift, search

SCHEMA_VERSION = 2


def write_index(docs: DataFrame, root: str, state: str, fields: tuple[str, ...] = search.INDEXED, stemmed: bool = True) -> str:
    """Writes docs, postings and doc_len under a new version and then points ``current`` at it; readers never see half an index.

    Postings lie in order of term and id; a common term spreads over many files.
    """
    version = uuid.uuid4().hex
    base = f"{root}/{version}"
    docs.write.parquet(f"{base}/docs")
    stored = docs.sparkSession.read.parquet(f"{base}/docs")
    search.postings(stored, None, fields, stemmed).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{base}/postings")
    search.doc_lengths(stored, fields).write.parquet(f"{base}/doc_len")
    meta = docs.sparkSession.createDataFrame([(version, SCHEMA_VERSION, state)], "version string, schema int, state string")
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def index_status(spark: SparkSession, root: str, state: str) -> tuple[bool, str]:
    """(current, reason)."""
    try:
        row = spark.read.schema("version string, schema int, state string").json(f"{root}/current").first()
    except Exception as e:  # noqa: BLE001  an absent folder has several exception types across stores
        return False, f"no index: {type(e).__name__}"
    if row is None:
        return False, "no index"
    if row.schema != SCHEMA_VERSION:
        return False, "schema version differs"
    return (True, "current") if row.state == state else (False, "content changed")


def open_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    version = spark.read.schema("version string, schema int, state string").json(f"{root}/current").first().version
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in ("docs", "postings", "doc_len")}


def _back(places: int):
    return lambda x: x - places


def search_index(index: dict[str, DataFrame], query: str, limit: int = 10, where=None, stemmed: bool = True) -> DataFrame:
    """BM25 from stored postings: only the query's terms are read (pushed to the files). ``stemmed`` as the index was written."""
    wanted = search.phrases(query, stemmed)
    docs = index["docs"]
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in wanted for t in p})
    mine = index["postings"].where(F.col("term").isin(terms))
    stats = index["doc_len"].agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    by_doc = mine.groupBy("id").pivot("term", terms).agg(F.first("positions"))
    for i, phrase in enumerate(wanted):
        places = [F.transform(F.coalesce(F.col(f"`{t}`"), F.array().cast("array<int>")), _back(k)) for k, t in enumerate(phrase)]
        both = places[0]
        for p in places[1:]:
            both = F.array_intersect(both, p)
        by_doc = by_doc.withColumn(f"c{i}", F.size(both))
    dfs = by_doc.agg(*(F.count_if(F.col(f"c{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    hits = by_doc.where(" and ".join(f"c{i} > 0" for i in range(len(wanted)))).join(index["doc_len"], "id")
    if where is not None:
        hits = hits.join(docs.drop("body").where(where).select("id"), "id", "left_semi")
    scored = hits.crossJoin(F.broadcast(stats.crossJoin(dfs)))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        raw = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"c{i}")
        score = score - F.when(raw <= 0, 1e-6).otherwise(raw) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("dl") / F.col("avgdl")))
    return scored.select("id", score.alias("score")).orderBy("score", "id").limit(max(1, min(limit, search.POOL)))


def write_compact_index(docs: DataFrame, path: str) -> None:
    catalog.compact_index(docs).orderBy("id").write.mode("overwrite").json(path)


def write_drift(rows: DataFrame, path: str) -> None:
    drift.to_tsv(rows).write.mode("overwrite").option("sep", "\t").csv(path)


def same_content(expected: DataFrame, stored: DataFrame) -> tuple[bool, str]:
    """Whether a generated table still has the rows it should have."""
    more, less = expected.exceptAll(stored).limit(1).count(), stored.exceptAll(expected).limit(1).count()
    return (not more and not less), "current" if not more and not less else "differs"
