"""Report tables: counts, tallies and bounded tops; what is rendered from them stays small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as tx

#: Rows that reports show at most.
TOPS = {"overdue": 50, "grounding": 15, "ids": 10, "candidates": 8, "suggestions": 3, "missing_tokens": 5}


def hosts_of(sources: DataFrame, most: int = TOPS["ids"]) -> DataFrame:
    """(host, sources, ids): how many sources a host has and the first few ids, combined before the shuffle."""
    rows = sources.select(tx.url_host(F.col("url")).alias("host"), "id").where("host is not null")
    counted = rows.groupBy("host").agg(F.count("*").alias("sources"))
    from pyspark.sql.window import Window

    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("id"))).where(F.col("r") <= most)
    listed = first.groupBy("host").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return counted.join(listed, "host")


def group_filter(sources: DataFrame, groups: list[str]) -> DataFrame:
    return sources.where(F.col("grp").isin(groups))


def breakdown(findings: DataFrame) -> DataFrame:
    """Groups by number of changes, most first, then by name."""
    return findings.orderBy(F.desc("changed"), "grp")


def not_located(updates: DataFrame, plan: DataFrame) -> DataFrame:
    """Ids to be written that no manifest line was found for."""
    return updates.select("id").subtract(plan.select("id"))


def embedded_documents(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def tally(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings and the exit code of a run."""
    counts = findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return counts.withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))


def provenance_totals(checked: DataFrame) -> DataFrame:
    """Documents checked, with a full text, and quotations over ``checked(has_snapshot, full_text, quotes)``."""
    return checked.agg(
        F.count_if("has_snapshot").alias("checked"), F.count_if(F.col("full_text").isNotNull()).alias("fulltexts"), F.coalesce(F.sum(F.size("quotes")), F.lit(0)).alias("quotes")
    )


def unused_recheck(sources: DataFrame) -> DataFrame:
    """Number of sources that declare a recheck interval, which nothing reads."""
    return sources.agg(F.count_if(F.col("recheck").isNotNull()).alias("declared"))


def first_by_path(docs: DataFrame, limit: int | None) -> DataFrame:
    """A limited scan takes the first paths; without a limit, everything."""
    return docs if limit is None else docs.orderBy("path").limit(limit)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.select("candidate").where("candidate is not null").distinct().orderBy("candidate")


def status(docs: DataFrame, manifests: int, today, overdue: DataFrame) -> str:
    """The status report: counts by type, most first, and the first overdue documents. Only bounded rows come to the driver."""
    types = docs.groupBy("doc_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_type").limit(200).collect()
    late = overdue.orderBy("id").limit(TOPS["overdue"]).collect()
    lines = ["# Status", "", f"Generated {today}", "", f"Sources: {manifests}", "", "| type | documents |", "|---|---|"]
    lines += [f"| {r.doc_type} | {r.n} |" for r in types]
    lines += ["", "## Overdue", "", *(f"- {r.id}" for r in late)]
    return "\n".join(lines) + "\n"
