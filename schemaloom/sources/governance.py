"""Governed tags and business glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError
from schemaloom.sources.rows import edges_of, nodes_of
from schemaloom.store import GraphBatch

# Prefixes of tags that the platform manages itself.
SYSTEM_PREFIXES = ("system.", "class.", "ai.", "sap.")


def namespace(override: str | None, metastore: str | None, host: str | None) -> str:
    """Where tag ids belong: what is configured, else the metastore, else the host."""
    for name in (override, metastore, host):
        if name:
            return name
    raise ConfigError("no namespace for tag ids")


def tag_rows(policies: DataFrame, *, include_system: bool = False, prefixes: tuple[str, ...] = SYSTEM_PREFIXES) -> DataFrame:
    """(tag_key, tag_description, value_name) of policies (tag_key, description, values array<struct<name>>).

    Policies without a key are skipped; one without values gives a row with NULL.
    """
    keyed = policies.filter(F.col("tag_key").isNotNull() & (F.col("tag_key") != ""))
    if not include_system:
        for p in prefixes:
            keyed = keyed.filter(~F.col("tag_key").startswith(p))
    return keyed.select("tag_key", F.nullif("description", F.lit("")).alias("tag_description"), F.explode_outer("values").alias("v")).select("tag_key", "tag_description", F.col("v.name").alias("value_name"))


def tag_batch(policies: DataFrame, source: str, *, include_system: bool = False) -> GraphBatch:
    rows = tag_rows(policies, include_system=include_system).withColumn("source", F.lit(source))
    valued = rows.filter("value_name is not null")
    key, value = ids.tag_key_id("source", "tag_key"), ids.tag_value_id("source", "tag_key", "value_name")
    return GraphBatch(
        {"GovernanceTagKey": nodes_of(rows, "GovernanceTagKey", key, name="tag_key", description="tag_description"), "GovernanceTagValue": nodes_of(valued, "GovernanceTagValue", value, name="value_name")},
        {"GovernanceTagKey-HAS_VALUE_OPTION-GovernanceTagValue": edges_of(valued, key, value)},
    )


def assignment_batch(assigned: DataFrame, source: str, label: str) -> GraphBatch:
    """Tags on objects (object_id, tag_key, value_name); a value without definition stays a free one."""
    rows = assigned.withColumn("source", F.lit(source))
    tag = ids.tag_assignment_id("object_id", "tag_key", "value_name")
    return GraphBatch(
        {"GovernanceTag": nodes_of(rows, "GovernanceTag", tag, key="tag_key", value="value_name")},
        {f"{label}-TAGGED_WITH-GovernanceTag": edges_of(rows, F.col("object_id"), tag), "GovernanceTag-HAS_DEFINITION-GovernanceTagValue": edges_of(rows.filter("value_name is not null"), tag, ids.tag_value_id("source", "tag_key", "value_name"))},
    )


def slug(path: Column | str, kind: str) -> Column:
    """The name after ``…/<kind>/`` at the end of a resource path; NULL if the path has another form."""
    p = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.when((F.size(p) >= 2) & (F.try_element_at(p, F.lit(-2)) == kind), F.try_element_at(p, F.lit(-1)))


def glossary_path(path: Column | str) -> Column:
    """The path up to the glossary's name; NULL if there is none."""
    c = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(c, "^((?:[^/]*/)*?glossaries/[^/]+)", 1), F.lit(""))


def glossary_batch(terms: DataFrame, links: DataFrame | None = None) -> GraphBatch:
    """Terms (term_id, term_name, term_description, glossary_id, glossary_name, category_id) and links (entity_id, entity_type, term_id).

    Only terms below a category count.  Links are left-joined to the terms, the ones without a term fall away.
    """
    rows = terms.filter(F.col("category_id").contains("/categories/")).withColumns({"category": slug("category_id", "categories"), "term": slug("term_id", "terms")})
    g, c, t = ids.glossary_id("glossary_id"), ids.category_id("glossary_id", "category"), ids.term_id("glossary_id", "category", "term")
    batch = GraphBatch(
        {
            "Glossary": nodes_of(rows, "Glossary", g, name="glossary_name", resource_path=glossary_path("category_id")),
            "Category": nodes_of(rows, "Category", c, name="category", resource_path="category_id"),
            "BusinessTerm": nodes_of(rows, "BusinessTerm", t, name="term_name", description="term_description", resource_path="term_id"),
        },
        {"Glossary-HAS_CATEGORY-Category": edges_of(rows, g, c), "Category-HAS_BUSINESS_TERM-BusinessTerm": edges_of(rows, c, t)},
    )
    if links is not None:
        known = rows.select("term_id", t.alias("business_term")).dropDuplicates(["term_id"])
        for kind, label in (("COLUMN", "Column"), ("TABLE", "Table")):
            tagged = links.filter(F.col("entity_type") == kind).select("entity_id", "term_id").distinct().join(known, "term_id", "left")
            batch.edges[f"{label}-TAGGED_WITH-BusinessTerm"] = edges_of(tagged, F.col("entity_id"), F.col("business_term"))
    return batch


def link_rows(references: DataFrame) -> DataFrame:
    """(entity_id, entity_type, term_id), as :func:`glossary_batch` takes them, of references (entry_name, path, term_id)."""
    entity, kind = linked_entity("entry_name", "path")
    return references.select(entity.alias("entity_id"), kind.alias("entity_type"), "term_id")


def linked_entity(name: Column | str, path: Column | str) -> tuple[Column, Column]:
    """(entity_id, entity_type) of an entry reference; a path names a column, no path a table."""
    n, p = (F.col(c) if isinstance(c, str) else c for c in (name, path))
    parts = F.split(F.element_at(F.split(n, "/entries/"), -1), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    column = F.element_at(F.split(p, r"\."), -1)
    has = F.coalesce(p != "", F.lit(False))
    return F.when(has, ids.column_id(at(3), at(5), at(7), column)).otherwise(ids.table_id(at(3), at(5), at(7))), F.when(has, "COLUMN").otherwise("TABLE")
