"""Neighbours, bounded walks and citations over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 6
RESERVED = ["corpus", "archetype", "authoritative_source", "id", "title"]


def neighbours(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """One hop from ``starts(id)``: (id, rel, pos, target, title, doc_type, external). A target that is no node is external."""
    mine = starts.select(F.col("id").alias("src")).distinct()
    known = nodes.select(F.col("id").alias("dst"), "title", "doc_type", F.lit(True).alias("_known"))
    hop = edges.join(mine, "src").join(known, "dst", "left")
    return hop.select(F.col("src").alias("id"), "rel", "pos", F.col("dst").alias("target"), "title", "doc_type", F.col("_known").isNull().alias("external"))


def walk(edges: DataFrame, nodes: DataFrame, start: str, rels: list[str], depth: int = 3) -> DataFrame:
    """Breadth-first from ``start``: (level, id, via, external). Seen ids do not come again, external ones are not walked on."""
    from lodestack.plans.pinning import pin

    usable = edges.where(F.col("rel").isin(rels)).select("src", "dst", "rel")
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_known"))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start,)], "id string")
    frontier, levels = seen, []
    for level in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        hop = usable.join(frontier.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min(F.struct("rel", "src")).alias("v"))
        fresh = hop.join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti").join(known, "dst", "left")
        fresh = pin(fresh.select(F.lit(level).alias("level"), F.col("dst").alias("id"), F.col("v.src").alias("via"), F.col("_known").isNull().alias("external")))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        frontier = fresh.where("not external").select("id")
        seen = seen.unionByName(fresh.select("id"))
    empty = spark.createDataFrame([], "level int, id string, via string, external boolean")
    return reduce(DataFrame.unionByName, levels, empty)


def reserved_names(edges: DataFrame) -> DataFrame:
    return edges.select("rel").distinct().where(F.col("rel").isin(RESERVED))


def edges_of(docs: DataFrame) -> DataFrame:
    """Relationships of the frontmatter, a map of arrays, as edges."""
    by_rel = docs.select(F.col("id").alias("src"), F.explode("relationships").alias("rel", "targets"))
    return by_rel.select("src", "rel", F.posexplode("targets").alias("pos", "dst"))


def resolve_citations(citations: DataFrame, schemes: list[tuple[str, str, str]], nodes: DataFrame) -> DataFrame:
    """``citations(citation)`` against ``schemes`` of (corpus, pattern, template with $1..): (citation, corpus, candidate, id, title, status).

    All schemes are tried in order. Candidates that are no legal id are dropped. status: resolved,
    unresolved (a candidate, no node) or no_scheme.
    """
    tried = [
        F.when(F.col("citation").rlike(pattern), F.struct(F.lit(i).alias("pos"), F.lit(corpus).alias("corpus"), F.lower(F.regexp_replace(F.regexp_extract(F.col("citation"), pattern, 0), pattern, template)).alias("candidate")))
        for i, (corpus, pattern, template) in enumerate(schemes)
    ]
    some = citations.withColumn("c", F.filter(F.array_compact(F.array(*tried)), lambda s: s["candidate"].rlike(r"^[a-z0-9][a-z0-9._-]+$")))
    rows = some.select("citation", F.explode_outer("c").alias("c")).select("citation", "c.pos", "c.corpus", "c.candidate")
    met = rows.join(nodes.select(F.col("id").alias("candidate"), "title"), "candidate", "left")
    status = F.when(F.col("candidate").isNull(), "no_scheme").when(F.col("title").isNull(), "unresolved").otherwise("resolved")
    best = met.withColumn("status", status).groupBy("citation").agg(F.min_by(F.struct("corpus", "candidate", "title", "status"), F.struct(F.col("title").isNull(), "pos")).alias("b"))
    return best.select("citation", "b.corpus", "b.candidate", "b.title", "b.status")


def resolve_siblings(candidates: DataFrame, index: DataFrame, state: str) -> DataFrame:
    """``candidates(citation, candidate, pos)`` against a sibling's index; state: fresh, stale or unavailable.

    An unavailable sibling leaves ``found`` null: not checked is not absent.
    """
    hit = candidates.join(index.select(F.col("id").alias("candidate"), "title", "status"), "candidate", "left")
    first = hit.groupBy("citation").agg(F.min_by(F.struct("candidate", "title", "status"), F.when(F.col("title").isNotNull(), F.col("pos"))).alias("b"))
    found = F.lit(None).cast("boolean") if state == "unavailable" else F.col("b.title").isNotNull()
    note = F.when(F.col("b.status") != "current", F.when(F.col("b.status") == "", F.lit("unknown")).otherwise(F.col("b.status")))
    return first.select("citation", "b.candidate", "b.title", found.alias("found"), note.alias("status_note"), F.lit(state == "stale").alias("stale"))


def name_candidates(queries: DataFrame, registry: DataFrame, fields: list[str], most: int = 8) -> DataFrame:
    """Bodies one of whose names contains the query, ignoring case: (query, slug, field, name, unique).

    Fields are tried in order; one match per body.
    """
    from pyspark.sql.window import Window

    names = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("name")) for i, f in enumerate(fields)))
    flat = registry.select("slug", F.explode(names).alias("n")).where("n.name is not null")
    met = flat.join(queries.select("query"), F.contains(F.lower("n.name"), F.lower("query")))
    per_body = met.groupBy("query", "slug").agg(F.min("n").alias("n"))
    w = Window.partitionBy("query")
    counted = per_body.withColumn("found", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("slug")))
    return counted.where(F.col("at") <= most).select("query", "slug", "n.field", "n.name", (F.col("found") == 1).alias("unique"))
