"""Data-quality rules as queries that return findings, and grounding statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as tx

#: Fixed values of the document schema.
DOC_STATUS = ["current", "superseded", "repealed", "draft", "unknown"]
CONTENT_MODES = ["verbatim", "mixed", "summary"]
VERBATIM_TYPES = ["statute", "rule", "policy"]
#: Fields that are true of a document but not quoted from its source.
STRUCTURAL = [
    "schema_version", "corpus", "jurisdiction", "id", "doc_type", "source_url", "source_format", "source_sha256", "retrieved", "last_verified", "verified_by",
    "maintainer", "content_mode", "snapshot_policy", "snapshot_id", "status", "authority_level", "issuing_body", "tags", "relationships", "conversion_notes",
    "content_exception", "migration_pending", "last_reviewed", "citation", "title", "source_version", "effective_date", "expires",
]
#: The number part of a citation.
CITED_NUMBER = r"^(?:\d+\s+)?[A-Z]{2,6}\.?\s+(\S+)$"

Rule = tuple[str, str, Callable[[], Column]]


def schema_rules(verbatim_types: list[str] = VERBATIM_TYPES) -> list[tuple[str, str, Column]]:
    """(rule, level, condition that breaks it) of the fixed core and its conditional parts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    verbatim = F.col("doc_type").isin(verbatim_types) & F.col("content_exception").isNull() & ~F.coalesce("migration_pending", F.lit(False))
    return [
        ("id_pattern", "error", ~tx.is_legal_id(text("id"))),
        ("title_required", "error", text("title") == ""),
        ("status_enum", "error", ~text("status").isin(DOC_STATUS)),
        ("content_mode_enum", "error", ~text("content_mode").isin(CONTENT_MODES)),
        ("sha256_pattern", "error", F.col("source_sha256").isNotNull() & ~F.col("source_sha256").rlike("^[0-9a-f]{64}$")),
        ("verbatim_retrieved", "error", verbatim & (text("retrieved") == "")),
        ("verbatim_sha256", "error", verbatim & (text("source_sha256") == "")),
        ("verbatim_mode", "error", verbatim & ~text("content_mode").isin("verbatim", "mixed")),
        ("reference_is_summary", "error", (F.col("doc_type") == "external_reference") & (text("content_mode") != "summary")),
        ("id_is_file_name", "error", F.col("id") != F.regexp_extract("path", r"([^/]+)\.md$", 1)),
    ]


def check(docs: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(path, level, rule) of every broken rule, from one projection."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for rule, level, bad in rules)))
    return docs.select("path", F.explode(broken).alias("f")).select("path", "f.level", "f.rule")


def orphan_relationships(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Targets that are no document: an error if the target looks like an id, else a warning."""
    lost = edges.join(universe.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    return lost.select("src", "rel", "dst", F.when(tx.is_slug(F.col("dst")), "error").otherwise("warn").alias("level"))


def orphan_joins(docs: DataFrame, universe: DataFrame) -> DataFrame:
    """Joined document ids that do not exist, with their index; null ids are skipped."""
    rows = docs.select("id", F.posexplode("joins").alias("i", "j")).where("j.document_id is not null")
    return rows.select("id", "i", F.col("j.document_id").alias("dst")).join(universe.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")


def unregistered_slugs(docs: DataFrame, registry: DataFrame, sentinels: list[str]) -> DataFrame:
    declared = docs.where((F.col("declared_slug") != "") & ~F.col("declared_slug").isin(sentinels))
    return declared.join(registry.select(F.col("slug").alias("declared_slug")).distinct(), "declared_slug", "left_anti")


def resolution_universe(graph_ids: DataFrame, content_ids: DataFrame, current: DataFrame) -> DataFrame:
    """The graph's ids, or the content's where there is no graph, and the current documents'."""
    base = content_ids if graph_ids.isEmpty() else graph_ids
    return base.select("id").union(current.select("id")).distinct()


def provenance(docs: DataFrame, snapshots: DataFrame, fail: float = 0.70, warn: float = 0.90) -> DataFrame:
    """Per document: snapshot present, hash equal, first line out of order, coverage and its level. Not checked is null."""
    joined = docs.join(snapshots.select(F.col("snapshot_id").alias("_sid"), "txt", "raw"), F.coalesce("snapshot_id", "id") == F.col("_sid"), "left") if "snapshot_id" in docs.columns else docs.join(snapshots.select(F.col("snapshot_id").alias("_sid"), "txt", "raw"), F.col("id") == F.col("_sid"), "left")
    full = tx.section(F.col("body"), "Full text", stripped=False)
    lines = F.filter(F.transform(F.split(full, "\n"), lambda x: tx.normalize_ws(x)), lambda x: x != "")
    ratio = tx.coverage_ratio(full, F.col("txt"))
    level = F.when(ratio < fail, "error").when(ratio < warn, "warn").when(ratio.isNotNull(), "ok")
    return joined.select(
        "id", F.col("_sid").isNotNull().alias("has_snapshot"), (tx.snapshot_hash(F.col("txt"), F.col("raw")) == F.col("source_sha256")).alias("hash_equal"),
        tx.ordered_containment(lines, tx.normalize_ws(F.col("txt"))).alias("first_missing"), ratio.alias("coverage"), level.alias("level"),
    )


def token_multiset_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(id, token)`` on both sides -> (id, token, missing, extra), counts of what one side has more."""
    a = expected.groupBy("id", "token").agg(F.count("*").alias("a"))
    b = actual.groupBy("id", "token").agg(F.count("*").alias("b"))
    d = a.join(b, ["id", "token"], "full_outer").select("id", "token", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    return d.where("d <> 0").select("id", "token", F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def grounded(assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """``assertions(id, field, value)`` against ``sources(id, txt)``: adds found; null where there is no source text.

    Values under three characters are no assertions. A citation also counts as found by its number part.
    """
    usable = assertions.where(F.length(F.trim("value")) >= 3)
    joined = usable.join(sources.select("id", tx.fold(F.col("txt")).alias("_txt")), "id", "left")
    number = F.regexp_extract("value", CITED_NUMBER, 1)
    found = F.contains(F.col("_txt"), tx.fold(F.col("value"))) | ((number != "") & F.contains(F.col("_txt"), tx.fold(number)))
    return joined.withColumn("found", found).drop("_txt")


def grounding_rate(checked: DataFrame) -> DataFrame:
    """Per field, structural ones too: values checked and found; nothing found in a field that should be quoted is marked."""
    rate = checked.where("found is not null").groupBy("field").agg(F.count("*").alias("checked"), F.count_if("found").alias("grounded"))
    return rate.withColumn("nothing", (F.col("grounded") == 0) & ~F.col("field").isin(STRUCTURAL))


def constant_and_absent(checked: DataFrame) -> DataFrame:
    """Values on more than one document that no source has; structural fields and registry slugs are no quotations."""
    each = checked.where(F.col("found").isNotNull() & ~F.col("field").isin(STRUCTURAL) & ~tx.is_registry_slug(F.col("value")))
    g = each.groupBy("field", "value").agg(F.count_distinct("id").alias("docs"), F.count_if("found").alias("hits"))
    return g.where("docs > 1 and hits = 0").select("field", "value", "docs")


def citation_misses(checked: DataFrame) -> DataFrame:
    """Citations that their source lacks."""
    cited = tx.is_citation(F.col("value")) & ~tx.is_date_like(F.col("value")) & ~F.col("field").isin(STRUCTURAL)
    return checked.where(~F.col("found") & cited).groupBy("field", "value").agg(F.count_distinct("id").alias("docs"))


def quotes_found(quotes: DataFrame, texts: DataFrame, width: int = 3) -> DataFrame:
    """``quotes(item_id, quote)`` -> (item_id, found): does any text of ``texts(txt)`` contain the folded quotation?

    The second to the last but one word of a quotation are whole words of a text that holds it, so a text is compared
    only with quotations whose words 2 to 4 it has in a row. Quotations of fewer than five words meet every text
    with their second word, of fewer than three words every word that contains theirs.
    """
    folded = quotes.select("item_id", tx.fold(F.col("quote")).alias("q")).withColumn("w", F.split("q", " "))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), tx.fold(F.col("txt")).alias("t"))
    run = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " "))

    def runs(n: int) -> Column:
        def of(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
            return F.array_distinct(F.transform(starts, lambda i: run(words, i, n)))

        # Bound to a variable, the words are split once and not for every run.
        return F.element_at(F.transform(F.array(F.split("t", " ")), of), 1)

    found = []
    for n, some in ((width, F.size("w") >= width + 2), (1, F.size("w").between(3, width + 1))):
        keyed = folded.where(some).select("item_id", "q", run(F.col("w"), F.lit(2), n).alias("key"))
        wanted = keyed.select("key").distinct()
        each = texts.select("t", F.explode(runs(n)).alias("key")).join(wanted, "key", "left_semi")
        found.append(each.join(keyed, "key").where(F.contains(F.col("t"), F.col("q"))).select("item_id").distinct())
    short = folded.where(F.size("w") < 3).select("item_id", "q")
    vocabulary = texts.select(F.explode(F.split("t", " ")).alias("word")).distinct()
    single = short.where(~F.contains(F.col("q"), F.lit(" "))).join(vocabulary, F.contains(F.col("word"), F.col("q"))).select("item_id")
    double = short.where(F.contains(F.col("q"), F.lit(" "))).join(texts, F.contains(F.col("t"), F.col("q"))).select("item_id")
    hits = found[0].unionByName(found[1]).unionByName(single).unionByName(double).distinct().withColumn("hit", F.lit(True))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("found"))
