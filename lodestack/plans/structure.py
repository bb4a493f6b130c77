"""Queries of layout, reports, readers and text parts over the test tables, with the SQL that gives the same rows.

Documents get paths under three roots, one of them scoped; bodies are built around their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as tx
from lodestack.operators import catalog, drift, graph, layout, reports, validation

ROOTS = [layout.Root("laws", "statute"), layout.Root("memos", "memo"), layout.Root("bodies", None, {"rules": "rule", "policies": "policy"})]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_PATH = """case doc_id % 5 when 0 then 'laws/d' || doc_id || '.md' when 1 then 'memos/d' || doc_id || '.md' when 2 then 'bodies/' || source || '/rules/d' || doc_id || '.md'
 when 3 then 'bodies/' || source || '/other/d' || doc_id || '.md' else 'drafts/d' || doc_id || '.md' end"""
_TYPE = "case when doc_id % 7 = 0 then 'memo' when doc_id % 5 = 0 then 'statute' when doc_id % 5 = 2 then 'rule' when doc_id % 11 = 0 then 'note' else 'policy' end"
_PLACED = f"(select doc_id, source, text, {_PATH} as path, {_TYPE} as doc_type from documents)"
_HERE = "case when path like 'laws/%' then 'statute' when path like 'memos/%' then 'memo' when path like 'bodies/%/rules/%' then 'rule' end"
_THERE = "case doc_type when 'statute' then 'laws' when 'memo' then 'memos' when 'rule' then 'bodies' when 'policy' then 'bodies' end"


def placed(s, d) -> DataFrame:
    return table(s, d, "documents").selectExpr("doc_id", "source", "text", f"{_PATH} as path", f"{_TYPE} as doc_type")


@query("path_doc_type", f"select doc_id, {_HERE} as doc_type, path like 'laws/%' or path like 'memos/%' or path like 'bodies/%' as content from {_PLACED}")
def _(s, d):
    return placed(s, d).select("doc_id", layout.doc_type_for(F.col("path"), ROOTS).alias("doc_type"), layout.in_content(F.col("path"), ROOTS).alias("content"))


@query("path_scope_slug", f"select doc_id, case when path like 'bodies/%' then source end as slug from {_PLACED}")
def _(s, d):
    return placed(s, d).select("doc_id", layout.scope_slug(F.col("path"), ROOTS).alias("slug"))


@query("expected_root", f"select doc_id, {_THERE} as root from {_PLACED}")
def _(s, d):
    return placed(s, d).select("doc_id", layout.expected_root(F.col("doc_type"), ROOTS).alias("root"))


@query("misplaced_documents", f"""select path, doc_type, coalesce(here, there) as expected, case when here is not null then 'type' else 'root' end as kind from (select *, {_HERE} as here, {_THERE} as there from {_PLACED})
 where case when here is not null then here <> doc_type else there is not null end""")
def _(s, d):
    return layout.misplaced(placed(s, d), ROOTS)


@query("missing_marker", "select 'd' || doc_id as path from documents where not contains(text, 'the ')")
def _(s, d):
    return layout.without_marker(table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("body")), "the ")


@query("unregistered_scopes", f"select path, source as slug from {_PLACED} where path like 'bodies/%' and source not in (select 'src' || i from range(12) t(i))")
def _(s, d):
    return layout.unregistered_scopes(placed(s, d), ROOTS, s.range(12).select(F.concat(F.lit("src"), "id").alias("slug")))


@query("sentinels_in_registry", "select distinct source as slug from documents where source in ('src1', 'src7')")
def _(s, d):
    return layout.sentinels_in_registry(table(s, d, "documents").select(F.col("source").alias("slug")), ["src1", "src7", "none"])


@query("registry_faults", "select 'row without a slug' as fault, null as field, count(*) as n from supplier where s_suppkey % 3 = 0 having count(*) > 0 union all select 'field without a name', 'alias', 0 union all select 'field without a name', 'other', 0")
def _(s, d):
    rows = table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("slug"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("alias"))
    return layout.registry_faults(rows, ["name", "alias", "other"])


@query("changed_scope", f"select path from {_PLACED} where doc_id % 4 = 1")
def _(s, d):
    changed = layout.union_of_listings([placed(s, d).where(f"doc_id % {m} = 1").select("path") for m in (4, 8)])
    return layout.scope(placed(s, d), "changed", changed).select("path")


@query("hosts_of_sources", r"""with h as (select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, page_id from pages)
 select host, count(*) as sources, list_sort(list(page_id))[1:10] as ids from h group by 1""")
def _(s, d):
    return reports.hosts_of(table(s, d, "pages").select(F.col("page_id").alias("id"), "url"))


@query("group_filter", "select event_type, count(*) as n from events where event_type in ('click', 'view', 'purchase') group by 1")
def _(s, d):
    e = table(s, d, "events").withColumn("grp", F.col("event_type"))
    return reports.group_filter(e, ["click", "view", "purchase"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("not_located", "select distinct l_partkey as id from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 3 <> 0)")
def _(s, d):
    return reports.not_located(table(s, d, "lineitem").select(F.col("l_partkey").alias("id")), table(s, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id")))


@query("embedded_documents", "select count(distinct vec_id // 4) as documents, count(*) as chunks from embeddings")
def _(s, d):
    return reports.embedded_documents(table(s, d, "embeddings").select(F.expr("vec_id div 4").alias("doc_id")))


@query("findings_tally", "select count(*) filter (toxic = 1) as errors, count(*) filter (toxic = 0 and quality = 0) as warnings, case when count(*) filter (toxic = 1) > 0 then 1 else 0 end as exit_code from labels")
def _(s, d):
    return reports.tally(table(s, d, "labels").select(F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warn").otherwise("ok").alias("level")))


_QUOTED = """'## At a glance' || chr(10) || 'doc ' || doc_id || chr(10) || '## Full text' || chr(10) || case when doc_id % 3 = 0 then '> **[VERBATIM]** "one ' || doc_id || '"' || chr(10) || '> **[VERBATIM]** "two"' || chr(10) else '' end || 'end' || chr(10) || '## ' || lang || chr(10) || 'x'"""


def bodies(s, d) -> DataFrame:
    return table(s, d, "documents").selectExpr("doc_id", "lang", "text", f"{_QUOTED.replace('chr(10)', 'char(10)')} as body")


@query("document_headings", "select doc_id, ['At a glance', 'Full text', lang] as headings from documents where lang is not null")
def _(s, d):
    return bodies(s, d).where("lang is not null").select("doc_id", tx.headings(F.col("body")).alias("headings"))


@query("document_section", "select doc_id, 'doc ' || doc_id as glance, 'x' as last, null as none from documents where lang = 'en'")
def _(s, d):
    b = F.col("body")
    return bodies(s, d).where("lang = 'en'").select("doc_id", tx.section(b, "At a glance").alias("glance"), tx.section(b, "en").alias("last"), tx.section(b, "Nowhere").alias("none"))


@query("verbatim_quotes", "select doc_id, case when doc_id % 3 = 0 then ['one ' || doc_id, 'two'] else [] end as quotes from documents where lang is not null")
def _(s, d):
    return bodies(s, d).where("lang is not null").select("doc_id", tx.verbatim_quotes(F.col("body")).alias("quotes"))


@query("provenance_totals", "select count(*) filter (doc_id % 2 = 0) as checked, count(*) as fulltexts, (2 * count(*) filter (doc_id % 3 = 0))::bigint as quotes from documents where lang is not null")
def _(s, d):
    b = bodies(s, d).where("lang is not null")
    rows = b.select((F.col("doc_id") % 2 == 0).alias("has_snapshot"), tx.section(F.col("body"), "Full text").alias("full_text"), tx.verbatim_quotes(F.col("body")).alias("quotes"))
    return reports.provenance_totals(rows)


@query("report_body", "select p_partkey, 'Parts' || chr(10) || chr(10) || p_brand as body from part")
def _(s, d):
    made = F.concat(F.lit("Parts\nGenerated 2024-01-0"), F.col("p_partkey") % 9 + 1, F.lit("\n"), F.col("p_brand"), F.lit(" 2024-05-01T10:00Z"))
    return table(s, d, "part").select("p_partkey", tx.report_body(made).alias("body"))


@query("escaped_html", "select page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as digest from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(tx.escape_html(F.col("html")).cast("binary"), 256).alias("digest"))


@query("percent_and_size", "select lang, printf('%.1f%%', 100.0 * count(*) filter (n_chars >= 3200) / count(*)) as share, printf('%d KB', (sum(n_chars) // 1024)::bigint) as size from documents group by 1")
def _(s, d):
    g = table(s, d, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") >= 3200).alias("a"), F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return g.select("lang", tx.percent(F.col("a"), F.col("n")).alias("share"), tx.kilobytes(F.col("c")).alias("size"))


@query("unescaped_references", r"""select page_id, case page_id % 8 when 0 then 'é<ü&x' when 1 then 'A€' when 2 then '&unknown;' when 3 then '©right' when 4 then 'a&b' when 5 then '&' when 6 then '𝔄' else '�' end as text from pages""")
def _(s, d):
    given = ["&eacute;&lt;&uuml&amp;x", "&#65;&#x80;", "&unknown;", "&copyright", "a&b", "&", "&Afr;", "&#xD800;"]
    k = F.col("page_id") % 8
    raw = F.coalesce(*(F.when(k == i, F.lit(t)) for i, t in enumerate(given)))
    return table(s, d, "pages").select("page_id", tx.unescape(raw).alias("text"))


@query("resolution_universe", "select p_partkey as id from part where p_partkey % 2 = 0 union select s_suppkey from supplier")
def _(s, d):
    p = table(s, d, "part")
    return validation.resolution_universe(p.where("p_partkey % 2 = 0").selectExpr("p_partkey as id"), p.selectExpr("p_partkey as id"), table(s, d, "supplier").selectExpr("s_suppkey as id"))


@query("universe_without_graph", "select p_partkey as id from part union select s_suppkey from supplier")
def _(s, d):
    p = table(s, d, "part")
    return validation.resolution_universe(p.where("false").selectExpr("p_partkey as id"), p.selectExpr("p_partkey as id"), table(s, d, "supplier").selectExpr("s_suppkey as id"))


@query("duplicate_sources", "select url, count(*) as n from (select case when page_id % 10 = 0 then 'same' else url end as url from pages) group by 1 having count(*) > 1")
def _(s, d):
    rows = table(s, d, "pages").select(F.when(F.col("page_id") % 10 == 0, "same").otherwise(F.col("url")).alias("id"))
    return drift.duplicate_sources(rows.withColumn("grp", F.lit("g"))).select(F.col("id").alias("url"), "n")


@query("reserved_relations", "select distinct case when l_returnflag = 'A' then 'title' else 'r' || l_returnflag end as rel from lineitem where l_returnflag = 'A'")
def _(s, d):
    rel = F.when(F.col("l_returnflag") == "A", "title").otherwise(F.concat(F.lit("r"), "l_returnflag"))
    return graph.reserved_names(table(s, d, "lineitem").select(rel.alias("rel")))


@query("sibling_resolution", """with c as (select o_orderkey::varchar as citation, 'p' || (o_orderkey % 300) as candidate from orders),
 i as (select 'p' || p_partkey as id, p_name as title, case p_partkey % 3 when 0 then 'current' when 1 then '' else 'repealed' end as status from part where p_partkey < 200)
 select citation, case when i.id is not null then candidate end as candidate, title, i.id is not null as found, case when status = '' then 'unknown' when status <> 'current' then status end as status_note, true as stale from c left join i on i.id = c.candidate""")
def _(s, d):
    c = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("citation"), F.concat(F.lit("p"), F.col("o_orderkey") % 300).alias("candidate"), F.lit(0).alias("pos"))
    state = F.when(F.col("p_partkey") % 3 == 0, "current").when(F.col("p_partkey") % 3 == 1, "").otherwise("repealed")
    index = table(s, d, "part").where("p_partkey < 200").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("title"), state.alias("status"))
    return graph.resolve_siblings(c, index, "stale")


@query("orphan_findings", """select src, dst, case when l_partkey % 2 = 0 then 'error' else 'warn' end as level from
 (select l_orderkey as src, l_partkey, case when l_partkey % 2 = 0 then 'part-' || l_partkey else 'Part No. ' || l_partkey end as dst from lineitem where l_partkey % 10 = 0 or l_partkey % 2 = 1)""")
def _(s, d):
    dst = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("part-"), "l_partkey")).otherwise(F.concat(F.lit("Part No. "), "l_partkey"))
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit("part").alias("rel"), dst.alias("dst"))
    universe = table(s, d, "lineitem").where("l_partkey % 10 <> 0").select(F.concat(F.lit("part-"), "l_partkey").alias("id"))
    return validation.orphan_relationships(edges, universe).select("src", "dst", "level")


@query("provenance_levels", """select doc_id as id, doc_id % 6 <> 0 as has_snapshot, case when doc_id % 6 <> 0 then doc_id % 4 <> 0 end as hash_equal from documents""")
def _(s, d):
    """Snapshot present and digest equal for every document."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("txt"))
    digest = tx.snapshot_hash(F.col("txt"), F.col("txt").cast("binary"))
    docs = t.select("id", F.concat(F.lit("## Full text\n"), "txt").alias("body"), F.when(F.col("id") % 4 != 0, digest).otherwise("0" * 64).alias("source_sha256"))
    snaps = t.where("id % 6 <> 0").select(F.col("id").alias("snapshot_id"), "txt", F.col("txt").cast("binary").alias("raw"))
    return validation.provenance(docs, snaps).select("id", "has_snapshot", "hash_equal")


@query("existing_documents", "select doc_type, count(*) as n from (select lang as doc_type from documents where doc_id % 2 = 0) group by 1")
def _(s, d):
    ids = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("doc_type"))
    return catalog.counts_by(t.join(ids.distinct(), "id", "left_semi"), "doc_type")
