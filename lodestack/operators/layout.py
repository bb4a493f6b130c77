"""Where content lies: roots, types and slugs told from paths, and the checks that follow from them.

A root is (path, doc_type, scoped, subdirs): the first part of a path; the type of what lies there; whether the
second part is the slug of a body; for scoped roots, the types of the third part's folders as a map.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Root:
    path: str
    doc_type: str | None = None
    subdirs: dict[str, str] = field(default_factory=dict)

    @property
    def scoped(self) -> bool:
        return bool(self.subdirs)


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def doc_type_for(path: Column, roots: list[Root]) -> Column:
    """Type of the first root that claims the path; a scoped root needs a slug and a known folder. Null if none does."""
    parts, found = _parts(path), []
    for r in roots:
        here = parts[0] == r.path
        if r.scoped:
            types = F.create_map(*(F.lit(x) for kv in r.subdirs.items() for x in kv))
            found.append(F.when(here & (F.size(parts) >= 3), types[F.get(parts, F.lit(2))]))
        else:
            found.append(F.when(here, F.lit(r.doc_type)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def scope_slug(path: Column, roots: list[Root]) -> Column:
    """The second part of a path below a scoped root, else null."""
    scoped = [r.path for r in roots if r.scoped]
    return F.when(_parts(path)[0].isin(scoped) & (F.size(_parts(path)) >= 3), F.get(_parts(path), F.lit(1)))


def expected_root(doc_type: Column, roots: list[Root]) -> Column:
    """Root where documents of a type belong: the first that holds it, unscoped ones first."""
    order = [r for r in roots if not r.scoped] + [r for r in roots if r.scoped]
    held = [F.when(doc_type.isin([r.doc_type] if not r.scoped else list(r.subdirs.values())), r.path) for r in order]
    return F.coalesce(*held, F.lit(None).cast("string"))


def in_content(path: Column, roots: list[Root]) -> Column:
    return _parts(path)[0].isin([r.path for r in roots])


def misplaced(docs: DataFrame, roots: list[Root]) -> DataFrame:
    """(path, doc_type, expected, kind) of ``docs(path, doc_type)`` whose type is not that of their place."""
    here, there = doc_type_for(F.col("path"), roots), expected_root(F.col("doc_type"), roots)
    rows = docs.select("path", "doc_type", here.alias("here"), there.alias("there"))
    wrong = F.when(F.col("here").isNotNull(), ~F.col("here").eqNullSafe(F.col("doc_type"))).otherwise(F.col("there").isNotNull())
    kind = F.when(F.col("here").isNotNull(), "type").otherwise("root")
    return rows.where(wrong).select("path", "doc_type", F.coalesce("here", "there").alias("expected"), kind.alias("kind"))


def without_marker(docs: DataFrame, marker: str) -> DataFrame:
    """Paths of documents whose body lacks the disclaimer's marker."""
    return docs.where(~F.contains(F.coalesce("body", F.lit("")), F.lit(marker))).select("path")


def unregistered_scopes(docs: DataFrame, roots: list[Root], registry: DataFrame) -> DataFrame:
    """(path, slug) below scoped roots whose slug is no body of the registry."""
    scoped = docs.select("path", scope_slug(F.col("path"), roots).alias("slug")).where("slug is not null")
    return scoped.join(registry.select("slug").distinct(), "slug", "left_anti").select("path", "slug")


def sentinels_in_registry(registry: DataFrame, sentinels: list[str]) -> DataFrame:
    """Slugs that are both a body and a sentinel; there must be none."""
    return registry.where(F.col("slug").isin(sentinels)).select("slug").distinct()


def name_values(c: Column, kind: str) -> Column:
    """Names of a registry field, a text or a list of texts (``kind``: the column's type name)."""
    return F.filter(c, lambda x: x.isNotNull()) if kind == "array" else F.array_compact(F.array(c.cast("string")))


def registry_faults(registry: DataFrame, name_fields: list[str]) -> DataFrame:
    """(fault, field, n): rows without a slug, and name fields that no row fills."""
    kinds = {f: registry.schema[f].dataType.typeName() for f in name_fields if f in registry.columns}
    bare = F.count_if(F.coalesce("slug", F.lit("")) == "").alias("bare")
    filled = [F.max(F.size(name_values(F.col(f), k))).alias(f"_{f}") for f, k in kinds.items()]
    one = registry.agg(bare, *filled)
    faults = [F.when(F.col("bare") > 0, F.struct(F.lit("row without a slug").alias("fault"), F.lit(None).cast("string").alias("field"), F.col("bare").alias("n")))]
    for f in name_fields:
        empty = F.coalesce(F.col(f"_{f}"), F.lit(0)) == 0 if f in kinds else F.lit(True)
        faults.append(F.when(empty, F.struct(F.lit("field without a name").alias("fault"), F.lit(f).alias("field"), F.lit(0).cast("long").alias("n"))))
    return one.select(F.explode(F.array_compact(F.array(*faults))).alias("f")).select("f.*")


def scope(docs: DataFrame, mode: str, changed: DataFrame | None = None) -> DataFrame:
    """Documents that a validation run looks at: all (``full``), those of ``changed(path)``, or none but their relationships.

    A relationships-only run keeps all documents but only what points elsewhere.
    """
    if mode == "full":
        return docs
    if mode == "changed":
        if changed is None:
            raise ValueError("a changed-only run needs the changed paths")
        return docs.join(changed.select("path").distinct(), "path", "left_semi")
    if mode == "relationships":
        return docs.select(*(c for c in ("id", "path", "relationships", "joins") if c in docs.columns))
    raise ValueError(f"unknown scope {mode!r}")


def union_of_listings(listings: list[DataFrame]) -> DataFrame:
    """Paths that any of the listings (committed, staged, not tracked) has, each once."""
    return reduce(DataFrame.unionByName, (x.select("path") for x in listings)).distinct()
