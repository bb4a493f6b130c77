"""Catalog aggregates over ``docs``: overview, holdings, coverage, paging, health.

What could not be measured is null, never zero or false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(docs: DataFrame, column: str) -> DataFrame:
    return docs.groupBy(column).agg(F.count("*").alias("n"))


def resolved_slug(declared: Column, path_slug: Column, registered: Column | None, sentinels: list[str]) -> Column:
    """A sentinel stands for itself; then a declared slug the registry knows (or no registry is readable); then the path's; then the declared one.

    ``registered``: whether the registry has the declared slug; None if no registry is readable.
    """
    known = F.lit(True) if registered is None else registered
    return F.when(declared.isin(sentinels), declared).when(declared.isNotNull() & (declared != "") & known, declared).otherwise(F.coalesce(F.when(path_slug != "", path_slug), F.when(declared != "", declared)))


def bucketed(docs: DataFrame, registry: DataFrame | None, sentinels: list[str], slug: str = "issuing_body_slug") -> DataFrame:
    """Adds ``bucket``: unattributed, declared_no_body, in_registry, no_registry_entry; the last two only with a readable registry."""
    empty = F.col(slug).isNull() | (F.col(slug) == "")
    first = F.when(empty, "unattributed").when(F.col(slug).isin(sentinels), "declared_no_body")
    if registry is None:
        return docs.withColumn("bucket", first)
    known = registry.select(F.col("slug").alias("_known")).where(F.col("_known").isNotNull()).distinct()
    joined = docs.join(known, F.col(slug) == F.col("_known"), "left")
    return joined.withColumn("bucket", first.when(F.col("_known").isNotNull(), "in_registry").otherwise("no_registry_entry")).drop("_known")


def coverage(docs: DataFrame, registry: DataFrame | None, sentinels: list[str]) -> DataFrame:
    """One row from one scan: total and the four buckets; unanswerable buckets are null."""
    b = bucketed(docs, registry, sentinels)
    count = lambda name: F.count_if(F.coalesce(F.col("bucket") == name, F.lit(False)))
    measured = lambda name: count(name) if registry is not None else F.lit(None).cast("long")
    return b.agg(F.count("*").alias("total"), count("unattributed").alias("unattributed"), count("declared_no_body").alias("declared_no_body"), measured("in_registry").alias("in_registry"), measured("no_registry_entry").alias("no_registry_entry"))


def completeness(cov: DataFrame, sentinels_declared: bool = False) -> DataFrame:
    """Adds ``complete``: null where it cannot be told, never true without a registry."""
    with_registry = (F.col("no_registry_entry") == 0) & (F.col("unattributed") == 0)
    without = F.when(F.col("unattributed") > 0, F.lit(False))
    verdict = F.when(F.col("total") == 0, F.lit(None).cast("boolean")).when(F.col("in_registry").isNull(), without).otherwise(with_registry)
    if sentinels_declared:
        verdict = F.when(F.col("declared_no_body").isNotNull(), verdict)
    return cov.withColumn("complete", verdict)


def holdings(docs: DataFrame, slug: str) -> DataFrame:
    return docs.where(F.col("issuing_body_slug") == slug).groupBy("content_mode").agg(F.count("*").alias("n"))


def page_for_slug(docs: DataFrame, slug: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A stable page by id, each row with the total before paging."""
    mine = docs.where(F.col("issuing_body_slug") == slug)
    total = mine.agg(F.count("*").alias("total"))
    page = mine.orderBy("id").offset(max(0, offset)).limit(max(1, min(limit, 200)))
    return page.crossJoin(F.broadcast(total))  # one row


def health(docs: DataFrame, configured_types: list[str] | None = None) -> DataFrame:
    """Types all of whose documents have no searchable body; ``problem`` only for types with configured headings (all, if none are named)."""
    per = docs.groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("body_chars") == 0).alias("empty"))
    problem = F.col("doc_type").isin(configured_types) if configured_types is not None else F.lit(True)
    return per.withColumn("problem", (F.col("n") == F.col("empty")) & problem)


def overdue(docs: DataFrame, as_of: str, days: int, limit: int | None = 50) -> DataFrame:
    """Documents never verified or verified more than ``days`` before ``as_of``; bad dates count as never."""
    at = F.try_to_date("last_verified")
    late = docs.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), at)).where(F.col("age_days").isNull() | (F.col("age_days") > days))
    late = late.orderBy(F.col("age_days").desc_nulls_first(), "id")
    return late.limit(limit) if limit else late


def compact_index(docs: DataFrame) -> DataFrame:
    """id -> [title, doc_type, path, status]."""
    return docs.select("id", F.array("title", "doc_type", "path", "status").alias("entry"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per group, a number that changes with any id or text and not with their order: the sum of 60 bits of every document's digest.

    Sums are combined before the shuffle; nothing is gathered.
    """
    piece = F.sha2(F.concat(F.col("id"), F.lit(":"), F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)).cast("binary"), 256)
    number = F.conv(F.substring(piece, 1, 15), 16, 10).cast("decimal(20,0)")
    return docs.groupBy("doc_type").agg(F.sum(number).cast("string").alias("fingerprint"), F.count("*").alias("n"))


def profile(docs: DataFrame, registry: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """registry with its holdings and the curated overlay; a body without documents holds 0."""
    held = docs.groupBy(F.col("issuing_body_slug").alias("slug")).agg(F.count("*").alias("n_documents"))
    out = registry.join(held, "slug", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    return out.join(profiles, "slug", "left") if profiles is not None else out
