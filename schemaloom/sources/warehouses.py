"""Whole warehouses: information-schema frames to graph batches.

``read`` gives a frame by its information-schema name, for example
``lambda t: spark.read.jdbc(url, f"information_schema.{t}", properties=p)`` or a reader of
exported files; filters on it are pushed to the source.  Column names are compared
without case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.sources import infoschema as info
from schemaloom.sources.rows import hierarchy_batch, reference_edges, value_nodes
from schemaloom.store import GraphBatch

Read = Callable[[str], DataFrame]


def _samples(columns: DataFrame, service: str, table: Callable[[str], DataFrame] | None, n: int) -> DataFrame | None:
    """Samples of all tables; the columns' list is metadata and read by the driver, the data are not."""
    if table is None:
        return None
    by_table: dict[tuple, list[str]] = {}
    for r in (info.sampleable(columns, service, "type") if service else columns).select("database", "schema", "table", "column").collect():
        by_table.setdefault((r.database, r.schema, r.table), []).append(r["column"])
    out = None
    for (db, schema, name), cols in by_table.items():
        s = info.sample_values(table(f"{db}.{schema}.{name}"), cols, n).select(F.lit(db).alias("database"), F.lit(schema).alias("schema"), F.lit(name).alias("table"), "column", "value")
        out = s if out is None else out.unionByName(s)
    return out


def bigquery(read: Read, project: str, dataset: str, *, table: Callable[[str], DataFrame] | None = None, n: int = 10) -> GraphBatch:
    """Dataset description from the options (a row without one where there is none), base tables, columns with key flags from constraint names."""
    place = [F.lit(project).alias("database"), F.lit(dataset).alias("schema")]
    options = read("SCHEMATA_OPTIONS").filter("option_name = 'description'").select(F.col("option_value").alias("description"))
    schemas = info.with_default_row(options.select(F.lit(dataset).alias("schema"), "description"), {"schema": dataset}).select(place[0], "schema", "description")
    keys = ["table_catalog", "table_schema", "table_name"]
    tables = info.left_described(read("TABLES").filter("table_type = 'BASE TABLE'"), read("TABLE_OPTIONS"), keys).select(*place, F.col("table_name").alias("table"), "description")
    at = ["table_name", "column_name"]
    described = read("COLUMN_FIELD_PATHS").filter("field_path = column_name").select(*at, "description").dropDuplicates(at)
    columns = info.constraint_flags(read("COLUMNS").join(described, at, "left"), read("KEY_COLUMN_USAGE"), at)
    columns = columns.select(*place, F.col("table_name").alias("table"), F.col("column_name").alias("column"), F.col("data_type").alias("type"), (F.upper("is_nullable") == "YES").alias("nullable"), "description", "is_primary_key", "is_foreign_key")
    usage = read("KEY_COLUMN_USAGE").select("constraint_name", F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"))
    targets = read("CONSTRAINT_COLUMN_USAGE").select("constraint_name", F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"))
    ends = {f"{s}_{k}": F.lit(v) for s in ("source", "target") for k, v in (("database", project), ("schema", dataset))}
    refs = info.references_by_name(read("TABLE_CONSTRAINTS").select("constraint_name", "constraint_type"), usage, targets).withColumns(ends)
    return info.schema_batch(schemas, tables, columns, refs, _samples(columns, "bigquery", table, n), platform="GCP", service="BIGQUERY")


def snowflake(read: Read, database: str, schema: str, *, table: Callable[[str], DataFrame] | None = None, n: int = 10) -> GraphBatch:
    """Keys come from the frames PRIMARY_KEYS and IMPORTED_KEYS; references to other databases are dropped; views are tables."""
    schemas = read("SCHEMATA").select(F.col("catalog_name").alias("database"), F.col("schema_name").alias("schema"), F.col("comment").alias("description"))
    schemas = info.require_schema(schemas, database, schema)
    here = (F.col("table_catalog") == database) & (F.col("table_schema") == schema)
    name = [F.col("table_catalog").alias("database"), F.col("table_schema").alias("schema"), F.col("table_name").alias("table")]
    tables = read("TABLES").filter(here).select(*name, F.col("comment").alias("description"))
    imported = read("IMPORTED_KEYS")
    cols = info.member_flag(read("COLUMNS").filter(here), read("PRIMARY_KEYS"), ["table_name", "column_name"], "is_primary_key")
    cols = info.member_flag(cols, imported.select(F.col("fk_table_name").alias("table_name"), F.col("fk_column_name").alias("column_name")), ["table_name", "column_name"], "is_foreign_key")
    columns = cols.select(*name, F.col("column_name").alias("column"), F.col("data_type").alias("type"), info.nullable_flag().alias("nullable"), F.col("comment").alias("description"), "is_primary_key", "is_foreign_key")
    refs = info.same_database(imported, "fk_database_name", "pk_database_name").select(*[F.col(f"{k}_{p}_name").alias(f"{s}_{p}") for s, k in (("source", "fk"), ("target", "pk")) for p in ("database", "schema", "table", "column")])
    return info.schema_batch(schemas, tables, columns, refs, _samples(columns, "snowflake", table, n), platform="SNOWFLAKE", service="SNOWFLAKE")


def databricks(read: Read, catalog: str, schema: str, *, table: Callable[[str], DataFrame] | None = None, n: int = 10) -> GraphBatch:
    """Keys from constraint types; references paired by position, the unresolved dropped."""
    schemas = read("schemata").select(F.col("catalog_name").alias("database"), F.col("schema_name").alias("schema"), F.col("comment").alias("description"))
    schemas = info.require_schema(schemas, catalog, schema)
    here = (F.col("table_catalog") == catalog) & (F.col("table_schema") == schema)
    name = [F.col("table_catalog").alias("database"), F.col("table_schema").alias("schema"), F.col("table_name").alias("table")]
    tables = read("tables").filter(here).select(*name, F.col("comment").alias("description"))
    at = ["table_catalog", "table_schema", "table_name", "column_name"]
    usage, constraints = read("key_column_usage"), read("table_constraints").select("constraint_catalog", "constraint_schema", "constraint_name", "constraint_type")
    cols = info.typed_flags(read("columns").filter(here), usage, constraints, at, ["constraint_catalog", "constraint_schema", "constraint_name"])
    columns = cols.select(*name, F.col("column_name").alias("column"), F.col("data_type").alias("type"), info.nullable_flag().alias("nullable"), F.col("comment").alias("description"), "is_primary_key", "is_foreign_key")
    end = lambda s: [F.col(c).alias(f"{s}_{p}") for p, c in zip(("database", "schema", "table", "column"), at, strict=True)]
    fk = usage.select("constraint_name", F.col("position_in_unique_constraint").alias("position"), *end("source"))
    pk = usage.select("constraint_name", F.col("ordinal_position").alias("position"), *end("target"))
    refs, _ = info.references_by_position(read("referential_constraints").select("constraint_name", "unique_constraint_name"), fk, pk)
    return info.schema_batch(schemas, tables, columns, refs, _samples(columns, "databricks", table, n), platform="DATABRICKS", service="UNITY_CATALOG")


def jdbc(read: Read, database: str, schemas: list[str] | None = None, *, table: Callable[[str], DataFrame] | None = None, n: int = 10, platform: str | None = None, service: str | None = None) -> GraphBatch:
    """The standard information schema of any database: keys from constraint types, references paired by position."""
    keep = (lambda df: df if schemas is None else df.filter(F.col("table_schema").isin(schemas)))
    name = [F.lit(database).alias("database"), F.col("table_schema").alias("schema"), F.col("table_name").alias("table")]
    tables = keep(read("tables")).select(*name)
    at = ["table_schema", "table_name", "column_name"]
    usage = keep(read("key_column_usage"))
    constraints = read("table_constraints").select("constraint_schema", "constraint_name", "constraint_type")
    cols = info.typed_flags(keep(read("columns")), usage, constraints, at, ["constraint_schema", "constraint_name"])
    columns = cols.select(*name, F.col("column_name").alias("column"), F.col("data_type").alias("type"), info.nullable_flag().alias("nullable"), "is_primary_key", "is_foreign_key")
    end = lambda s: [F.lit(database).alias(f"{s}_database"), *[F.col(c).alias(f"{s}_{p}") for p, c in zip(("schema", "table", "column"), at, strict=True)]]
    key = F.concat_ws(".", "constraint_schema", "constraint_name")
    fk = usage.filter("position_in_unique_constraint is not null").select(key.alias("constraint_name"), F.col("position_in_unique_constraint").alias("position"), *end("source"))
    pk = usage.select(key.alias("constraint_name"), F.col("ordinal_position").alias("position"), *end("target"))
    unique = F.concat_ws(".", "unique_constraint_schema", "unique_constraint_name")
    refs, _ = info.references_by_position(read("referential_constraints").select(key.alias("constraint_name"), unique.alias("unique_constraint_name")), fk, pk)
    named = tables.select("database", "schema").distinct()
    batch = hierarchy_batch({"database": tables.select("database").distinct(), "schema": named, "table": tables, "column": columns}, platform=platform, service=service)
    batch.edges["Column-REFERENCES-Column"] = reference_edges(refs, criteria=False)
    samples = _samples(columns, "", table, n)
    if samples is not None:
        batch.nodes["Value"], batch.edges["Column-HAS_VALUE-Value"] = value_nodes(samples)
    return batch
