"""Readers: Markdown with frontmatter, source manifests, registries, graphs, sibling indexes, robots texts.

Every reader tells "could not read" from "is not there": problems are columns or strings, not exceptions,
except for a configured file that is missing, which raises.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.robotparser
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_SECONDS = 86_400
#: Agents whose mention is a position on crawling for models.
AI_AGENTS = (
    "ClaudeBot", "Claude-Web", "anthropic-ai", "GPTBot", "ChatGPT-User", "OAI-SearchBot", "CCBot", "Google-Extended", "PerplexityBot",
    "Applebot-Extended", "Bytespider", "meta-externalagent", "Amazonbot", "Diffbot", "cohere-ai", "AI2Bot", "Timpibot",
)


def _plain(value):
    """Dates as ISO strings, all the way down."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def parse_frontmatter(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(frontmatter as JSON, body, problem) of a Markdown file that starts with a YAML mapping."""
    if text is None or not text.startswith("---\n"):
        return None, text, "no frontmatter"
    end = text.find("\n---", 4)
    if end < 0:
        return None, text, "frontmatter is not closed"
    try:
        fm = yaml.load(text[4:end], Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        return None, text[end + 4 :], f"bad YAML: {str(e).splitlines()[0]}"
    if not isinstance(fm, dict):
        return None, text[end + 4 :], "frontmatter is not a mapping"
    return json.dumps(_plain(fm), sort_keys=True, ensure_ascii=False), text[end + 4 :], None


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, fm VARIANT, body, parse_error) of all *.md below ``paths``; names with a leading underscore and CHANGELOG.md are left out."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(paths, wholetext=True)
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~name.startswith("_") & (name != "CHANGELOG.md"))

    @F.pandas_udf("fm string, body string, parse_error string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_frontmatter(t) for t in texts], columns=["fm", "body", "parse_error"])

    parsed = files.withColumn("p", parse("value"))
    return parsed.select("path", "size", F.try_parse_json("p.fm").alias("fm"), "p.body", "p.parse_error")


def frontmatter(name: str, kind: str = "string"):
    """A field of ``fm``; null if it is missing or of another kind."""
    return F.try_variant_get("fm", f"$.{name}", kind)


def catalog_of(markdown: DataFrame, headings: list[str] | None = None) -> DataFrame:
    """The docs table of parsed Markdown files."""
    from lodestack.functions import text as tx

    names = ["id", "doc_type", "issuing_body", "issuing_body_slug", "citation", "title", "status", "source_url", "retrieved", "effective_date", "content_mode", "content_exception", "last_verified", "source_sha256"]
    searchable = tx.searchable_body(F.col("body"), headings)
    return markdown.where("parse_error is null").select(
        "path", *(frontmatter(n).alias(n) for n in names), frontmatter("relationships", "map<string,array<string>>").alias("relationships"), frontmatter("tags", "array<string>").alias("tags"),
        "size", F.length(searchable).cast("long").alias("body_chars"), searchable.alias("searchable"), tx.section(F.col("body"), "At a glance").alias("glance"), "body",
    )


def changed_since(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change) between two ``(path, digest)`` states."""
    a, b = now.select("path", F.col("digest").alias("a")), then.select("path", F.col("digest").alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where("not a <=> b").select("path", change.alias("change"))


def state_key(files: DataFrame) -> DataFrame:
    """One digest of all paths and contents: order-free sums of digests, so nothing is gathered."""
    h = F.sha2(F.concat_ws(":", "path", F.sha2(F.col("value").cast("binary"), 256)).cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return files.agg(F.sha2(F.concat_ws("-", F.count("*"), *(part(i) for i in range(5))).cast("binary"), 256).alias("state"))


def read_manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """(grp, id, url, sha256, format, watch, pos, file) of a manifest file or a folder of group files; unset gives none, missing raises."""
    schema = "grp string, id string, url string, sha256 string, format string, watch array<string>, pos int, file string"
    if path is None:
        return spark.createDataFrame([], schema)
    p = Path(path)
    files = sorted(p.glob("*.yml")) if p.is_dir() else [p]
    if not files or not files[0].exists():
        raise FileNotFoundError(f"source manifest {path} has no groups")
    rows = []
    for f in files:
        content = yaml.safe_load(f.read_text()) or {}
        for s in content.get("sources", []):
            rows.append((content.get("group", f.stem), str(s["id"]), s.get("url"), s.get("sha256") or "", s.get("format"), s.get("watch"), len(rows), f.name))
    return spark.createDataFrame(rows, schema)


@dataclass
class Readable:
    """A small table that may be undeclared, unreadable or there."""

    declared: bool = False
    rows: list[dict] = field(default_factory=list)
    problem: str | None = None

    @property
    def readable(self) -> bool:
        return self.declared and self.problem is None


def read_registry(path: str | None, key: str = "entries") -> Readable:
    """Never raises: entries, or what is wrong."""
    if path is None:
        return Readable()
    try:
        content = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as e:
        return Readable(True, problem=f"{path}: {type(e).__name__}")
    entries = content.get(key) if isinstance(content, dict) else None
    if not isinstance(entries, list):
        return Readable(True, problem=f"{path}: {key} is not a list")
    return Readable(True, [_plain(e) for e in entries if isinstance(e, dict)])


def read_profiles(path: str | None) -> Readable:
    if path is None:
        return Readable()
    try:
        content = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as e:
        return Readable(True, problem=f"{path}: {type(e).__name__}")
    profiles = content.get("profiles") if isinstance(content, dict) else None
    if not isinstance(profiles, dict):
        return Readable(True, problem=f"{path}: profiles is not a mapping")
    return Readable(True, [{"slug": k, "notes": json.dumps(_plain(v))} for k, v in profiles.items()])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; a missing file is an empty graph."""
    if not Path(path).exists():
        return spark.createDataFrame([], "id string, title string, doc_type string"), spark.createDataFrame([], "src string, rel string, dst string, pos int")
    g = spark.read.schema("nodes array<struct<id string, title string, doc_type string>>, edges array<struct<`from` string, type string, `to` string>>").option("multiLine", True).json(path)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*")
    edges = g.select(F.posexplode("edges").alias("pos", "e")).select(F.col("e.from").alias("src"), F.col("e.type").alias("rel"), F.col("e.to").alias("dst"), "pos")
    return nodes, edges


def read_sibling_index(spark: SparkSession, name: str, path: str, now: float | None = None) -> tuple[DataFrame, str]:
    """(index, state) of a sibling's compact index: fresh, stale (older than a day) or unavailable. Never raises."""
    schema = "sibling string, id string, title string, doc_type string, path string, status string"
    try:
        p = Path(path)
        age = (now or time.time()) - p.stat().st_mtime
        documents = json.loads(p.read_text())["documents"]
        rows = [(name, k, *[(list(v) + [None] * 4)[i] for i in range(4)]) for k, v in documents.items()]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return spark.createDataFrame([], schema), "unavailable"
    return spark.createDataFrame(rows, schema), "fresh" if age < CACHE_SECONDS else "stale"


def parse_robots(text: str | None, agent: str = "lodestack", path: str = "/") -> dict:
    """What a robots text says: may ``agent`` fetch ``path``, which AI agents are refused any path, the content signal, the crawl delay.

    Two questions that stay apart: permission for us, and a stated position on this kind of use. Nothing is
    known of a text that could not be read.
    """
    if text is None:
        return {"reachable": None, "allowed": None, "ai_blocked": None, "states_position": None, "crawl_delay": None, "content_signal": None}
    bare = (line.partition("#")[0] for line in text.splitlines())
    pairs = [(k.strip().lower(), v.strip()) for k, colon, v in (line.partition(":") for line in bare) if colon and k.strip()]
    # Runs of agent lines and runs of rules take turns; other keys belong to no group.
    grammar = [p for p in pairs if p[0] in ("user-agent", "disallow", "allow", "crawl-delay")]
    runs = [(named, [p for p in run]) for named, run in itertools.groupby(grammar, key=lambda p: p[0] == "user-agent")]
    refused: set[str] = set()
    for (named, heads), (_, rules) in itertools.pairwise(runs):
        if named and any(k == "disallow" and v for k, v in rules):
            refused.update(v.lower() for _, v in heads)
    told = {k: v for k, v in reversed(pairs)}
    blocked = [a for a in AI_AGENTS if a.lower() in refused]
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(text.splitlines())
    signal = told.get("content-signal")
    return {"reachable": True, "allowed": parser.can_fetch(agent, path), "ai_blocked": blocked, "states_position": bool(blocked or signal), "crawl_delay": told.get("crawl-delay"), "content_signal": signal}


def robots(hosts: DataFrame, agent: str = "lodestack") -> DataFrame:
    """``hosts(host, robots)``: adds the parsed record; a null text was not reachable, so nothing is known."""

    @F.pandas_udf("reachable boolean, allowed boolean, ai_blocked array<string>, states_position boolean, crawl_delay string, content_signal string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_robots(t, agent) for t in texts])

    return hosts.withColumn("r", parse("robots")).select("host", "r.*")


def robots_report(sources: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host of ``sources(id, url)``: number of sources and what its robots text says; hosts never asked are unknown. Reports, never blocks."""
    per_host = sources.groupBy(F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host")).agg(F.count("*").alias("sources"), F.min("id").alias("first_id"))
    joined = per_host.join(robots(hosts), "host", "left")
    stance = F.when(F.col("reachable").isNull(), "unknown").when(~F.col("allowed"), "refused").when(F.col("states_position"), "position stated").otherwise("allowed")
    return joined.withColumn("stance", stance)
