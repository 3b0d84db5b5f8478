"""Catalogues that come as JSON documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError
from schemaloom.operators.nested import flatten
from schemaloom.sources.rows import hierarchy_batch, reference_edges
from schemaloom.store import GraphBatch

_RELATIONAL = """product string, schemas array<struct<name:string,remarks:string>>,
tables array<struct<schema:string,name:string,remarks:string,columns:array<struct<name:string,type:string,nullable:boolean,remarks:string,is_primary_key:boolean,is_foreign_key:boolean>>>>,
foreign_keys array<struct<source_schema:string,source_table:string,source_column:string,target_schema:string,target_table:string,target_column:string>>"""


def _text(c: str):
    return F.nullif(F.col(c), F.lit(""))


def database_of_url(url: str) -> str:
    """The database name in a JDBC URL: the tail of its path, parameters apart."""
    plain = re.split(r"[?;]", url, maxsplit=1)[0]
    name = plain.rstrip("/").rpartition("/")[2]
    if not name or ":" in name:
        raise ConfigError("the URL names no database; pass its name")
    return name


def url_database(url: Column | str) -> Column:
    """The same as a column; NULL where the URL names no database."""
    c = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(c, r"^[^?;]*/([^/?;:]+)/*(?:[?;].*)?$", 1), F.lit(""))


def relational_catalog(spark: SparkSession, path: str, database: str, *, schemas: list[str] | None = None, platform: str | None = None, service: str | None = None) -> GraphBatch:
    """A crawled relational catalogue (one JSON document)."""
    doc = spark.read.schema(_RELATIONAL).option("multiLine", True).json(path)
    db = F.lit(database).alias("database")
    s = doc.select(F.explode("schemas").alias("s")).select(db, F.col("s.name").alias("schema"), _text("s.remarks").alias("description"))
    t = doc.select(F.explode("tables").alias("t"))
    tables = t.select(db, F.col("t.schema").alias("schema"), F.col("t.name").alias("table"), _text("t.remarks").alias("description"))
    c = t.select("t.schema", F.col("t.name").alias("table"), F.explode("t.columns").alias("c"))
    columns = c.select(db, "schema", "table", F.col("c.name").alias("column"), "c.type", "c.nullable", _text("c.remarks").alias("description"), "c.is_primary_key", "c.is_foreign_key")
    refs = doc.select(F.explode("foreign_keys").alias("k")).select("k.*").withColumns({"source_database": F.lit(database), "target_database": F.lit(database)})
    if schemas is not None:
        s, tables, columns = (f.filter(F.col("schema").isin(schemas)) for f in (s, tables, columns))
        refs = refs.filter(F.col("source_schema").isin(schemas) & F.col("target_schema").isin(schemas))
    batch = hierarchy_batch({"database": s.select("database").distinct(), "schema": s, "table": tables, "column": columns}, platform=platform or None, service=service or None)
    batch.edges["Column-REFERENCES-Column"] = reference_edges(refs, criteria=False)
    return batch


def unity_pages(pages: DataFrame, page_id: str = "page_id", payload: str = "payload") -> GraphBatch:
    """Pages of a REST catalogue; keys are unknown there, so the key flags stay NULL."""
    levels = flatten(pages, page_id, payload, wanted={"tables.columns"})
    if "tables" not in levels:
        return GraphBatch()
    tables = levels["tables"].table(members={"database": ("catalog_name",), "schema": ("schema_name",), "table": ("name",), "description": ("comment",)}).filter("database is not null and schema is not null and table is not null")
    frames = {"database": tables.select("database").distinct(), "schema": tables.select("database", "schema").distinct(), "table": tables}
    if "tables.columns" in levels:
        members = {"column": ("name",), "type": ("type_text",), "nullable": ("nullable",), "description": ("comment",)}
        cols = levels["tables.columns"].table(members=members).filter("column <> ''")
        frames["column"] = cols.drop(page_id).join(tables.select("row_key", "pos_0", "database", "schema", "table"), ["row_key", "pos_0"]).withColumn("nullable", F.col("nullable").cast("boolean"))
    return hierarchy_batch(frames)


def aspect_entries(entries: DataFrame) -> DataFrame:
    """Rows for :func:`entry_catalog` of catalogue entries with their aspects.

    ``entries`` has (project_id, dataset_id, table_id, description, system, platform, aspects map<string,string>),
    the aspects as JSON texts by key.  Keys are matched by the part that names the kind: the fields come from
    the aspects whose key holds ``schema``, in order of key, the resource name from the last whose key holds ``storage``.
    """
    of = lambda kind: F.array_sort(F.filter(F.map_entries("aspects"), lambda e: F.contains(e["key"], F.lit(kind)) & e["value"].isNotNull()))
    field = "array<struct<name:string,dataType:string,metadataType:string,mode:string,description:string>>"
    fields = F.flatten(F.transform(of("schema"), lambda e: F.coalesce(F.from_json(e["value"], f"struct<fields:{field}>")["fields"], F.array().cast(field))))
    storage = F.transform(of("storage"), lambda e: F.get_json_object(e["value"], "$.resourceName"))
    return entries.select(
        F.col("project_id").alias("database"), F.col("dataset_id").alias("schema"), F.col("table_id").alias("table"), "description",
        F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["dataType"].alias("type"), f["mode"].alias("mode"), f["description"].alias("description"))).alias("fields"),
        F.upper("platform").alias("platform"), F.upper("system").alias("service"), F.coalesce(F.try_element_at(storage, F.lit(-1)), F.lit("")).alias("resource_name"),
    )


def entry_catalog(entries: DataFrame) -> GraphBatch:
    """One row per table with its fields: (database, schema, table, description, fields array<struct<name,type,mode,description>>).

    A field is nullable only if its mode says so.  Entries with columns platform and service name these themselves.
    """
    placed = ["platform", "service"] if {"platform", "service"} <= set(entries.columns) else []
    fixed = {} if placed else {"platform": "GCP", "service": "BIGQUERY"}
    rows = entries.select("database", "schema", "table", "description", F.explode_outer("fields").alias("f"))
    cols = rows.filter("f.name is not null").select("database", "schema", "table", F.col("f.name").alias("column"), F.col("f.type").alias("type"), (F.upper("f.mode") == "NULLABLE").alias("nullable"), F.col("f.description").alias("description"))
    return hierarchy_batch({"database": entries.select("database", *placed).distinct(), "schema": entries.select("database", "schema").distinct(), "table": entries.select("database", "schema", "table", "description").dropDuplicates(["database", "schema", "table"]), "column": cols}, **fixed)
