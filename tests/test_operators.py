"""Operators on small frames of our own."""

import hashlib
import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack.api import Corpus
from lodestack.functions import text as tx
from lodestack.functions.stemming import porter
from lodestack.operators import catalog, chunks, drift, graph, layout, reports, search, validation, vectors
from lodestack.plans import registry
from lodestack.sources import artifact, corpus, sinks

BODIES = [("a", "Permit for the river. Permit 137-090-0000 granted."), ("b", "The café keeps a permit and the rule 0000 090 137."), ("c", "Nothing here."), ("d", "")]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, "rule" if i < "c" else "memo", f"org-{i}", "verbatim", b, len(b), f"title {i}") for i, b in BODIES]
    return spark.createDataFrame(rows, "id string, doc_type string, issuing_body_slug string, content_mode string, body string, body_chars long, title string").cache()


def test_bm25_equals_a_full_text_engine(spark, small):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, body, tokenize='unicode61 remove_diacritics 0')")
    db.executemany("insert into t values (?, ?)", BODIES)
    for query in ["permit", "permit the", "permit permit", "137-090-0000"]:
        phrase = " ".join(f'"{t}"' for t in query.split())
        want = dict(db.execute("select id, bm25(t) from t where t match ?", (phrase,)))
        got = {r.id: r.score for r in search.keyword_search(small, query).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got)


def test_filter_keeps_statistics_of_the_whole(small):
    every = {r.id: r.score for r in search.keyword_search(small, "permit").collect()}
    some = {r.id: r.score for r in search.keyword_search(small, "permit", where=F.col("id") == "a").collect()}
    assert some == {"a": every["a"]}


def test_query_without_tokens_finds_nothing(small):
    assert search.keyword_search(small, "...").count() == 0


def test_stored_index_gives_the_same_scores(spark, small, tmp_path):
    root = str(tmp_path / "index")
    sinks.write_index(small, root, "s1")
    index = sinks.open_index(spark, root)
    for query in ["permit the", "137-090-0000"]:
        a = {r.id: round(r.score, 9) for r in search.keyword_search(small, query, fields=search.INDEXED, stemmed=True).collect()}
        assert {r.id: round(r.score, 9) for r in sinks.search_index(index, query).collect()} == a
    assert sinks.index_status(spark, root, "s1") == (True, "current")
    assert sinks.index_status(spark, root, "s2") == (False, "content changed")
    assert sinks.index_status(spark, str(tmp_path / "none"), "s1")[0] is False


def test_fusion_keeps_first_seen_order_on_ties(spark):
    a, b = (spark.createDataFrame([(x, 1)], "id string, rank int") for x in ("k", "v"))
    assert [r.id for r in search.fuse([a, b]).collect()] == ["k", "v"]


def test_excerpt_marks_hits_and_is_earliest():
    text = "x " * 30 + "permit one " + "y " * 30 + "permit two"
    out = search.excerpt(text, ["permits"], 6)
    assert out.startswith("… ") and "[permit]" in out and out.endswith(" …")
    assert search.excerpt("", ["a"]) == ""


def test_chunks_cover_the_text_and_overlap(spark):
    import random

    r = random.Random(4)
    texts = ["".join(r.choices("ab. \n", weights=[9, 9, 1, 3, 1], k=r.randint(0, 600))) for _ in range(150)] + ["", " \n", "é𝄞" * 300]
    for size in (20, 50, 80):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks.cut(F.col("t"), size, size // 5).alias("p")).collect()
        for text, pieces in rows:
            assert all(0 < len(p) <= size for p in pieces)
            assert bool(pieces) == bool(text.strip()) and text.strip().endswith("".join(pieces[-1:]))
            at = 0
            for p in pieces:
                found = text.find(p, max(0, at - size))
                assert found >= 0
                assert not text[at:found].strip() or found <= at
                at = max(at, found + len(p))


def test_chunk_edges(spark):
    def cut(text, size=3200, overlap=200):
        return list(spark.createDataFrame([(text,)], "t string").select(chunks.cut(F.col("t"), size, overlap)).first()[0])

    assert [len(p) for p in cut("x" * 3200)] == [3200] and [len(p) for p in cut("x" * 3201)] == [3200, 201]
    # A blank line in the second half goes before a later sentence end; before the middle it counts for nothing.
    assert cut("a" * 12 + "\n\n" + "b" * 3 + ". " + "c" * 20, 20, 2)[0] == "a" * 12
    assert cut("a" * 5 + "\n\n" + "b" * 8 + ". " + "c" * 20, 20, 2)[0] == "a" * 5 + "\n\n" + "b" * 8 + "."
    assert cut("a" * 5 + "\n\n" + "b" * 40, 20, 2)[0] == "a" * 5 + "\n\n" + "b" * 13


def test_single_unit_adds_the_body(spark):
    d = spark.createDataFrame([("a", "t", "## At a glance\nshort\n"), ("b", "t", "## At a glance\ng\n## Full text\nlong\n"), ("c", "t", "")], "id string, title string, body string")
    got = {(r.doc_id, r.heading) for r in chunks.units(d).collect() if r.text}
    assert ("b", "Full text") in got and ("b", "Body") not in got and ("a", "Body") in got


def test_sections(spark):
    d = spark.createDataFrame([("## A\n\none\n### x\ny\n## B\ntwo",)], "b string")
    r = d.select(tx.section(F.col("b"), "A").alias("a"), tx.section(F.col("b"), "x", 3).alias("x"), tx.section(F.col("b"), "C").alias("c"), tx.headings(F.col("b")).alias("h")).first()
    assert (r.a, r.x, r.c, list(r.h)) == ("one\n### x\ny", "y", None, ["A", "B"])


def test_ordered_containment(spark):
    d = spark.createDataFrame([(["a", "b"], "a b"), (["b", "a"], "a b"), ([], "a")], "l array<string>, t string")
    assert [r[0] for r in d.select(tx.ordered_containment(F.col("l"), F.col("t"))).collect()] == [None, "a", None]


def test_text_functions(spark):
    r = spark.createDataFrame([("‘A’ —  b\t",)], "s string").select(tx.ws_only(F.col("s")), tx.normalize_ws(F.col("s")), tx.fold(F.col("s"))).first()
    assert tuple(r) == ("‘A’ — b", "'A' — b", "a - b")


def test_coverage_is_null_without_registry_and_sums_with_one(spark, small):
    reg = spark.createDataFrame([("org-a",), (None,)], "slug string")
    c = catalog.completeness(catalog.coverage(small, reg, ["org-d"])).first()
    assert (c.total, c.declared_no_body, c.in_registry, c.no_registry_entry, c.complete) == (4, 1, 1, 2, False)
    n = catalog.completeness(catalog.coverage(small, None, [])).first()
    assert (n.in_registry, n.no_registry_entry, n.complete) == (None, None, None)
    assert catalog.completeness(catalog.coverage(small.limit(0), reg, [])).first().complete is None


def test_walk_ends_on_cycles_and_externals(spark):
    e = spark.createDataFrame([("a", "r", "b", 0), ("b", "r", "a", 0), ("a", "r", "a", 0), ("b", "r", "ext", 0), ("ext", "r", "c", 0)], "src string, rel string, dst string, pos int")
    n = spark.createDataFrame([("a", "A", "t"), ("b", "B", "t"), ("c", "C", "t")], "id string, title string, doc_type string")
    assert {(r.level, r.id, r.external) for r in graph.walk(e, n, "a", ["r"], 6).collect()} == {(1, "b", False), (2, "ext", True)}


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "id int, token string")
    b = spark.createDataFrame([(1, "x"), (1, "z")], "id int, token string")
    assert {(r.token, r.missing, r.extra) for r in validation.token_multiset_difference(a, b).collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}


def test_drift_states_and_baselines(spark):
    m = spark.createDataFrame([("g", "1", "u", "old", 0), ("g", "2", "u", "", 1), ("g", "3", "u", "same", 2), ("h", "4", "u", "old", 3), ("h", "5", "u", "old", 4), ("h", "6", "u", "x", 5)], "grp string, id string, url string, sha256 string, pos int")
    o = spark.createDataFrame([("g", "1", "ok", "new"), ("g", "2", "ok", "new"), ("g", "3", "ok", "same"), ("h", "4", "ok", "n4"), ("h", "5", "ok", "n5"), ("h", "6", "fetch_failed", None)], "grp string, id string, status string, new_sha256 string")
    d = drift.compare(m, o)
    by = {r.id: (r.changed, r.compared) for r in d.collect()}
    assert by == {"1": (True, True), "2": (True, False), "3": (False, True), "4": (True, True), "5": (True, True), "6": (None, False)}
    assert [r.grp for r in drift.group_findings(d).collect()] == ["h"]
    assert [r.id for r in drift.tickets(d, 2).orderBy("rank").collect()] == ["1", "4"]
    seeded = {r.id: (r.outcome, r.sha256) for r in drift.update_baselines(m, d, "seed").collect()}
    assert seeded["2"] == ("written", "new") and seeded["1"] == ("left_alone", "old") and seeded["6"] == ("failed", "x")
    with pytest.raises(ValueError):
        drift.update_baselines(m, d, "other")


@pytest.mark.parametrize("name", ["drift_compare", "stream_drift"])
def test_drift_of_short_pages_equals_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    short, long = "<p>few words</p><a onclick='track(%d)'>x</a>", "<p>" + "many words here " * 20 + "</p><a onclick='track(%d)'>x</a>"
    rows = [(i, f"http://{'www.' * (i % 4 == 0)}h{i % 3}.org/{i}", (short if i % 2 else long) % i) for i in range(1, 25)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{path}/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()))
    # The operator itself hashes all bytes of a short page, as the toolkit does.
    digest = spark.createDataFrame(rows[:1], "page_id long, url string, html string").select(tx.content_hash(F.col("html"), F.lit("html"), registry.VOLATILE[:1])).first()[0]
    assert digest == hashlib.sha256(rows[0][2].encode()).hexdigest()


@pytest.mark.parametrize("name", ["stream_drift", "drift_compare"])
def test_drift_of_odd_pages_equals_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    odd = ["cut &quot</p>", "&eacute;&#233;&AMP;&amp;lt;&amp", "a\x0bb\x85c\u2028d\u3000e", "\u3000", "<\u017fcript>gone</scrIpt>", "<style>a</script>b</style>", "&nbsp;\xa0 \t&#39;&apos;&copy&middot;"]
    pages = [f"{o}<p>{'many words here ' * n}{o}" for n in (1, 20) for o in odd] + [None]
    urls = ["https://h.org/1", "http://user@h.org:8/", "http://under_score.org?q", "http://exämple.org/a b|c", "HTTP://H.ORG/", "ftp://h.org", "http://www.[h].org#x", "", None]
    rows = [(i, urls[i % len(urls)], pages[i % len(pages)]) for i in range(1, 1 + len(urls) * len(pages))]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{path}/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()))


def test_watched_values(spark):
    rows = [('{"k": 1, "c": [{"n": 2}]}',), ('{"c": []}',), ("[]",), ("{",), ('{"k": null, "c": [{"n": 1}]}',)]
    got = [r.w.status for r in spark.createDataFrame(rows, "p string").select(drift.watched_digest(F.col("p"), ["k", "c[].n"]).alias("w")).collect()]
    assert got == ["ok", "watch_missing", "unreadable", "unreadable", "ok"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: a\ntitle: T\nretrieved: 2024-01-02\nrelationships:\n  implements: [b]\n---\n## Full text\nhello\n")
    (tmp_path / "_x.md").write_text("skip")
    (tmp_path / "bad.md").write_text("---\n- 1\n---\nbody")
    md = corpus.read_markdown(spark, [str(tmp_path)])
    assert {r.path.rsplit("/", 1)[1]: r.parse_error for r in md.select("path", "parse_error").collect()} == {"a.md": None, "bad.md": "frontmatter is not a mapping"}
    r = corpus.catalog_of(md).first()
    assert (r.id, r.retrieved, r.searchable, r.relationships) == ("a", "2024-01-02", "hello", {"implements": ["b"]})
    (tmp_path / "m.yml").write_text("sources: [{id: 1, url: u}]")
    assert [x.grp for x in corpus.read_manifest(spark, str(tmp_path / "m.yml")).collect()] == ["m"]
    assert corpus.read_manifest(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.read_manifest(spark, str(tmp_path / "none.yml"))
    assert corpus.read_registry(None).declared is False
    broken = corpus.read_registry(str(tmp_path / "none.yml"))
    assert broken.declared and not broken.readable
    (tmp_path / "i.json").write_text(json.dumps({"documents": {"x": ["T", "rule", "p"]}}))
    index, state = corpus.read_sibling_index(spark, "s", str(tmp_path / "i.json"))
    assert state == "fresh" and index.first().title == "T"
    assert corpus.read_sibling_index(spark, "s", str(tmp_path / "j.json"))[1] == "unavailable"
    assert graph.edges_of(corpus.catalog_of(md)).first().dst == "b"


def test_robots():
    r = corpus.parse_robots("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /x\nCrawl-delay: 5 # slow")
    assert r["ai_blocked"] == ["GPTBot", "CCBot"] and r["crawl_delay"] == "5" and r["allowed"] and r["states_position"]
    assert corpus.parse_robots(None)["ai_blocked"] is None
    assert corpus.parse_robots("User-agent: *\nDisallow: /")["ai_blocked"] == [] and not corpus.parse_robots("User-agent: *\nDisallow: /")["allowed"]
    assert corpus.parse_robots("User-agent: ClaudeBot\nDisallow:")["states_position"] is False
    assert corpus.parse_robots("User-agent: ccbot\nDisallow: /private")["ai_blocked"] == ["CCBot"]
    assert corpus.parse_robots("Content-Signal: ai-train=no")["content_signal"] == "ai-train=no"


def test_robots_report(spark):
    hosts = spark.createDataFrame([("a.org", "User-agent: GPTBot\nDisallow: /"), ("b.org", None), ("c.org", "")], "host string, robots string")
    sources = spark.createDataFrame([(i, f"https://{h}/x") for i, h in enumerate(["a.org", "a.org", "b.org", "c.org", "d.org"])], "id long, url string")
    got = {r.host: (r.sources, r.stance) for r in corpus.robots_report(sources, hosts).collect()}
    assert got == {"a.org": (2, "position stated"), "b.org": (1, "unknown"), "c.org": (1, "allowed"), "d.org": (1, "unknown")}


def test_stemmed_search_equals_a_full_text_engine(spark):
    rows = [("a1", "The permits of the river", ["water", "law"], "Permitted uses are running"), ("b2", "café rules", [], "Permit the cafe. OAR 137-090-0000"), ("c3", "Nothing", ["permit"], "élan of runners")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id, title, tags, body, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?, ?, ?)", [(i, t, " ".join(g), b) for i, t, g, b in rows])
    docs = spark.createDataFrame(rows, "id string, title string, tags array<string>, body string")
    for query in ["permit", "permitting", "cafe", "run", "elan", "law", "b2", "137-090-0000", "rules cafe", "river water"]:
        want = dict(db.execute("select id, bm25(t) from t where t match ?", (" ".join(f'"{t}"' for t in query.split()),)))
        got = {r.id: r.score for r in search.keyword_search(docs, query, fields=search.INDEXED, stemmed=True).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got), query


def test_stems_equal_those_of_a_full_text_engine():
    words = "caresses ponies caress feed agreed plastered motoring sing conflated hopping falling hissing fizzed filing happy relational digitizer vietnamization hopefulness formalize electrical adjustment adoption controlling rate flies yes geology".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, w) values (?, ?)", enumerate(words))
    assert dict(db.execute("select doc, term from v")) == {i: porter(w) for i, w in enumerate(words)}


def test_references_are_decoded_as_browsers_do(spark):
    import html

    texts = ["&eacute;", "&Eacute&lt", "&notit; &notin;", "&#233;&#xe9;&#xE9", "&#x80;&#150;&#0;&#x110000;&#99999999999;", "&#1;x", "a & b &c; &;", "&amp;lt;", "&nbsp;|", "&fjlig;&NotEqualTilde;", "&#xD800;", "no reference"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {t: html.unescape(t) for t in texts}


def test_vector_artifact(spark, small, tmp_path):
    root = str(tmp_path / "vectors")
    assert artifact.load(spark, root) == (None, "no artifact")
    artifact.build(small, root, dim=32)
    table, why = artifact.load(spark, root, 32)
    assert why == "ok" and {r.doc_id for r in table.collect()} == {"a", "b", "c"}
    assert artifact.load(spark, root, 64)[0] is None
    assert artifact.status(small, root) == (True, "current") and artifact.status(small.limit(2), root)[0] is False
    c = Corpus(spark, small.withColumn("issuing_body", F.lit("x")), ranker=artifact.ArtifactRanker(table, 32))
    assert {h.id for h in c.search("permit river", mode="semantic").collect()} == {"a", "b", "c"}
    assert c.get("a", "chunk:0")["text"].startswith("Permit") and c.exists("a")["title"] == "title a" and c.exists("zz") is None


def test_hash_embedding_keeps_ends_and_has_unit_length():
    v = vectors.hash_embedding(" abc  d ")
    assert len(v) == 384 and math.isclose(sum(x * x for x in v), 1) and v != vectors.hash_embedding("abc d")
    assert vectors.hash_embedding("ab") == [0.0] * 384


def test_quotations_of_every_length(spark):
    quotes = ["one", "art of", "of the deal", "the art of the", "the art of the deal", "SMART — of", "rt of the deal yes", "absent words of five here", ""]
    texts = ["smart  of the deal", "The Art\nof the deal yes", "someone"]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    got = {r.item_id: r.found for r in validation.quotes_found(q, spark.createDataFrame([(t,) for t in texts], "txt string")).collect()}
    folded = [" ".join(t.lower().split()) for t in texts]
    assert got == {i: any(" ".join(x.lower().replace("—", "-").split()) in t for t in folded) for i, x in enumerate(quotes)}


def test_layout_and_reports(spark):
    roots = [layout.Root("laws", "statute"), layout.Root("b", None, {"rules": "rule"})]
    d = spark.createDataFrame([("laws/a.md", "statute"), ("b/x/rules/a.md", "rule"), ("b/x", "rule"), ("other/z.md", "memo")], "path string, doc_type string")
    got = [(r.t, r.s) for r in d.select(layout.doc_type_for(F.col("path"), roots).alias("t"), layout.scope_slug(F.col("path"), roots).alias("s")).collect()]
    assert got == [("statute", None), ("rule", "x"), (None, None), (None, None)]
    assert [(r.path, r.kind) for r in layout.misplaced(d, roots).collect()] == [("b/x", "root")]
    with pytest.raises(ValueError):
        layout.scope(d, "changed")
    text = reports.status(d, 3, "2024-01-01", d.select(F.col("path").alias("id")))
    assert "| rule | 2 |" in text and "- laws/a.md" in text
    assert reports.tally(spark.createDataFrame([("warn",)], "level string")).first().exit_code == 0


def test_corpus_object(spark, small):
    c = Corpus(spark, small.withColumn("issuing_body", F.lit("x")), registry=spark.createDataFrame([("org-a", "River Board")], "slug string, name string"))
    hits = c.search("permit", limit=5).collect()
    assert hits[0].corpus == "corpus" and {h.id for h in hits} == {"a", "b"}
    assert c.get("a")["text"].startswith("Permit") and "error" in c.get("zz")
    assert [r.slug for r in c.profile("river").collect()] == ["org-a"]
    assert c.documents_for_slug("org-a").first().total == 1
    with pytest.raises(ValueError):
        c.documents_for_slug("")
    with pytest.raises(LookupError):
        c.neighbours(["a"])
    c.register("mine", lambda: small.select("id"))
    with pytest.raises(ValueError):
        c.register("mine", lambda: small)
    assert c.query("mine").count() == 4


def test_every_sql_belongs_to_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
