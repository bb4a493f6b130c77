"""The query surface: one object over a catalog, with every answer a DataFrame or a plain dict.

Unknown is never reported as absent: what a missing registry, graph or ranker cannot tell is None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as tx
from lodestack.operators import catalog, chunks, graph, search

LARGE = 51_200
SEMANTIC_ONLY = "(semantic match)"
RESERVED_QUERIES = {"search", "get", "resolve", "neighbours", "chain", "overview", "profile", "documents_for_slug", "health"}


class Ranker(Protocol):
    """Semantic search: chunks (doc_id, ordinal, score), best first."""

    def rank_chunks(self, query: str, want: int) -> DataFrame: ...


@dataclass
class Corpus:
    spark: SparkSession
    docs: DataFrame
    name: str = "corpus"
    archetype: str = "documents"
    source: str | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    registry: DataFrame | None = None
    profiles: DataFrame | None = None
    sentinels: list[str] = field(default_factory=list)
    schemes: list[tuple[str, str, str]] = field(default_factory=list)
    ranker: Ranker | None = None
    named: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def envelope(self, df: DataFrame) -> DataFrame:
        """The three fields every answer bears; they win over columns of the same name."""
        return df.withColumns({"corpus": F.lit(self.name), "archetype": F.lit(self.archetype), "authoritative_source": F.lit(self.source)})

    def issuing_body_filter(self, value: str) -> dict:
        """Which column a filter on a body's name uses: the registry's slug if it is one, else free text."""
        if self.registry is None:
            return {"value": value, "matched": "issuing_body", "registry_checked": False}
        known = not self.registry.where(F.col("slug") == value).isEmpty()
        return {"value": value, "matched": "issuing_body_slug" if known else "issuing_body", "registry_checked": True}

    def search(self, query: str, doc_type: str | None = None, issuing_body: str | None = None, limit: int = 10, mode: str = "hybrid") -> DataFrame:
        """rank, id and catalog columns of the best hits; keyword statistics are those of the whole catalog.

        The ranker's pool is four times the limit, 40 at least, filtered afterwards; the keyword side stays at 40.
        Without a ranker every mode is keyword.
        """
        limit = max(1, min(limit, search.POOL))
        where = F.lit(True)
        if doc_type:
            where = where & (F.col("doc_type") == doc_type)
        if issuing_body:
            where = where & (F.col(self.issuing_body_filter(issuing_body)["matched"]) == issuing_body)
        semantic = self.ranker is not None and mode in {"hybrid", "semantic"}
        pool = search.POOL if semantic else limit
        keyword = search.ranked(search.keyword_search(self.docs, query, pool, where, search.INDEXED, stemmed=True), ["score", "id"])
        if not semantic:
            order = keyword.select("id", "rank")
        else:
            found = self.ranker.rank_chunks(query, max(4 * limit, search.POOL))
            best = found.groupBy(F.col("doc_id").alias("id")).agg(F.max("score").alias("score"))
            kept = best.join(self.docs.where(where).select("id"), "id", "left_semi")
            vector = search.ranked(kept, [F.desc("score"), "id"])
            lists = [keyword, vector] if mode == "hybrid" else [vector]
            order = search.ranked(search.fuse(lists), [F.desc("rrf"), "first.list", "first.rank"]).select("id", "rank")
        top = order.where(F.col("rank") <= limit)
        hits = search.excerpts(top, self.docs, query)
        hits = hits.join(keyword.select("id", F.lit(True).alias("_kw")), "id", "left")
        hits = hits.withColumn("snippet", F.when(F.col("_kw"), F.col("snippet")).otherwise(F.lit(SEMANTIC_ONLY))).drop("_kw")
        return self.envelope(hits.join(self.docs.drop("body"), "id").orderBy("rank"))

    def exists(self, doc_id) -> dict | None:
        """id, title and type of a document; None if there is none."""
        row = self.docs.where(F.col("id") == doc_id).select(*(c for c in ("id", "title", "doc_type") if c in self.docs.columns)).first()
        return row.asDict() if row else None

    def get(self, doc_id, part: str = "auto") -> dict:
        """One document or one part of it: full, a heading, ``chunk:N``; a large one gives its glance and headings."""
        row = self.docs.where(F.col("id") == doc_id).withColumns({"_h": tx.headings(F.col("body")), "_glance": tx.section(F.col("body"), "At a glance")}).first()
        if row is None:
            near = self.search(str(doc_id).replace("-", " "), limit=3)
            return {"error": "unknown document", "did_you_mean": [r.id for r in near.select("id").collect()]}
        out = {k: v for k, v in row.asDict().items() if k not in {"body", "_h", "_glance"} and v not in (None, "")}
        body = row["body"] or ""
        if part.startswith("chunk:"):
            mine = self.docs.where(F.col("id") == doc_id).select("id", F.lit("").alias("title"), "body")
            pieces = {r.ordinal: r.text for r in chunks.chunked(chunks.units(mine)).select("ordinal", "text").collect()}
            n = int(part[6:]) if part[6:].isdigit() else -1
            return out | {"text": pieces[n], "of": len(pieces)} if n in pieces else {"error": "no such chunk", "of": len(pieces)}
        if part == "auto" and len(body.encode()) > LARGE:
            return out | {"at_a_glance": row["_glance"], "headings": list(row["_h"])}
        if part in {"auto", "full"}:
            return out | {"text": body}
        names = list(row["_h"])
        heading = part if part in names else next((n for n in names if n.lower() == part.lower()), None)
        if heading is None:
            return {"error": "no such part", "near": [n for n in names if part.lower()[:4] in n.lower()][:8]}
        found = self.docs.where(F.col("id") == doc_id).select(tx.section(F.col("body"), heading).alias("t")).first()
        return out | {"text": found["t"]}

    def resolve(self, citations: DataFrame) -> DataFrame:
        nodes = self.nodes if self.nodes is not None else self.docs.select("id", "title")
        return self.envelope(graph.resolve_citations(citations, self.schemes, nodes))

    def neighbours(self, ids: list[str]) -> DataFrame:
        self._needs_graph()
        return self.envelope(graph.neighbours(self.edges, self.nodes, self.spark.createDataFrame([(i,) for i in ids], "id string")))

    def chain(self, doc_id: str, rels: list[str], depth: int = 3) -> DataFrame:
        self._needs_graph()
        return self.envelope(graph.walk(self.edges, self.nodes, doc_id, rels, depth))

    def _needs_graph(self) -> None:
        if self.edges is None or self.nodes is None:
            raise LookupError("no graph was read; that says nothing about neighbours")

    def overview(self) -> dict:
        by = lambda c: {r[0]: r[1] for r in catalog.counts_by(self.docs, c).collect()}
        return {"corpus": self.name, "doc_types": by("doc_type"), "content_modes": by("content_mode"), "edges": None if self.edges is None else self.edges.count()}

    def coverage(self) -> DataFrame:
        return catalog.completeness(catalog.coverage(self.docs, self.registry, self.sentinels), bool(self.sentinels))

    def profile(self, query: str, fields: tuple[str, ...] = ("name",)) -> DataFrame:
        if not query.strip():
            raise ValueError("an empty query names no body")
        if self.registry is None:
            raise LookupError("no registry was read; that says nothing about bodies")
        found = graph.name_candidates(self.spark.createDataFrame([(query,)], "query string"), self.registry, list(fields))
        held = catalog.profile(self.docs, self.registry, self.profiles)
        return self.envelope(found.join(held.drop(*fields), "slug"))

    def documents_for_slug(self, slug: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """Refuses an empty slug and a sentinel: neither is a body that holds documents."""
        if not slug or slug in self.sentinels:
            raise ValueError(f"{slug!r} is no body")
        return self.envelope(catalog.page_for_slug(self.docs.drop("body"), slug, limit, offset))

    def health(self) -> DataFrame:
        return catalog.health(self.docs)

    def register(self, name: str, query: Callable[[], DataFrame]) -> None:
        """Adds a named query; names taken or reserved are refused."""
        if name in RESERVED_QUERIES or name in self.named:
            raise ValueError(f"{name!r} is taken")
        self.named[name] = query

    def query(self, name: str) -> DataFrame:
        return self.envelope(self.named[name]().withColumn("executed_query", F.lit(name)).withColumn("executed_at", F.current_timestamp()))
