"""Information-schema shapes of warehouses.

Frames come from any reader (``spark.read.jdbc``, exported Parquet or CSV); the
functions here are the relational work on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError
from schemaloom.sources.rows import hierarchy_batch, reference_edges, value_nodes
from schemaloom.store import GraphBatch

# Column types whose values are not sampled.
UNSAMPLED = {
    "bigquery": ("prefix", ["ARRAY", "STRUCT", "GEOGRAPHY", "JSON", "BIGNUMERIC"]),
    "snowflake": ("base", ["VARIANT", "OBJECT", "ARRAY", "MAP", "GEOGRAPHY", "GEOMETRY", "VECTOR"]),
    "databricks": ("prefix", ["ARRAY", "MAP", "STRUCT", "BINARY", "VARIANT"]),
}


def described(options: DataFrame, *, key: str, value: str, name: str = "option_name") -> DataFrame:
    """(key, description) of option rows named ``description``."""
    return options.filter(F.col(name) == "description").select(key, F.col(value).alias("description"))


def with_default_row(df: DataFrame, default: dict[str, str | None]) -> DataFrame:
    """The rows, or one default row where there are none; an anti-join of the default with one row decides, no action runs."""
    some = df.select(F.lit(1).alias("one")).limit(1)
    none = df.sparkSession.createDataFrame([(1,)], "one int").join(some, "one", "left_anti")
    return df.unionByName(none.select(*[F.lit(default.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def left_described(base: DataFrame, options: DataFrame, keys: list[str], *, option: str = "description", value: str = "option_value") -> DataFrame:
    """Left join in which the option filter belongs to the join, so rows without the option stay."""
    wanted = options.filter(F.col("option_name") == option).select(*keys, F.col(value).alias(option))
    return base.join(wanted, keys, "left")


def constraint_flags(columns: DataFrame, usage: DataFrame, keys: list[str], *, constraint: str = "constraint_name") -> DataFrame:
    """Primary and foreign key flags from constraint names (``…pk$``, ``….fk_…``), one row per column."""
    flags = usage.groupBy(*keys).agg(F.bool_or(F.col(constraint).endswith("pk$")).alias("is_primary_key"), F.bool_or(F.col(constraint).contains(".fk_")).alias("is_foreign_key"))
    return columns.join(flags, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_primary_key", "is_foreign_key")})


def typed_flags(columns: DataFrame, usage: DataFrame, constraints: DataFrame, keys: list[str], constraint_keys: list[str]) -> DataFrame:
    """The same from constraint types."""
    kinds = usage.join(constraints.filter(F.col("constraint_type").isin("PRIMARY KEY", "FOREIGN KEY")), constraint_keys)
    flags = kinds.groupBy(*keys).agg(F.bool_or(F.col("constraint_type") == "PRIMARY KEY").alias("is_primary_key"), F.bool_or(F.col("constraint_type") == "FOREIGN KEY").alias("is_foreign_key"))
    return columns.join(flags, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_primary_key", "is_foreign_key")})


def member_flag(columns: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Flag of rows whose key is in ``keys`` (a membership test, never a fan-out)."""
    return columns.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def nullable_flag(column: str = "is_nullable"):
    """Anything but NO is nullable."""
    return F.coalesce(F.upper(F.trim(F.col(column).cast("string"))) != "NO", F.lit(True))


def same_database(refs: DataFrame, a: str, b: str) -> DataFrame:
    """References within one database, letter case apart."""
    return refs.filter(F.lower(a) == F.lower(b))


def references_by_name(constraints: DataFrame, usage: DataFrame, targets: DataFrame) -> DataFrame:
    """References joined on the constraint name only; a composite key fans out, the upsert collapses it."""
    return constraints.filter(F.col("constraint_type") == "FOREIGN KEY").join(usage, "constraint_name", "left").join(targets, "constraint_name", "left")


def references_by_position(referential: DataFrame, fk: DataFrame, pk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) references, columns paired by ordinal position.

    ``referential`` has (constraint_name, unique_constraint_name), ``fk`` (constraint_name,
    position, source_*), ``pk`` (constraint_name, position, target_*).
    """
    keyed = pk.select(F.col("constraint_name").alias("unique_constraint_name"), "position", *[c for c in pk.columns if c not in ("constraint_name", "position")], F.lit(True).alias("found_"))
    joined = referential.join(fk, "constraint_name").join(keyed, ["unique_constraint_name", "position"], "left")
    return joined.filter("found_").drop("found_"), joined.filter("found_ is null").drop("found_")


def sampleable(columns: DataFrame, service: str, kind: str = "data_type") -> DataFrame:
    """Columns whose type can be sampled as text."""
    if service not in UNSAMPLED:
        raise ConfigError(f"unknown service {service!r}")
    way, words = UNSAMPLED[service]
    t = F.upper(F.trim(F.col(kind)))
    if way == "base":
        return columns.filter(~F.coalesce(F.trim(F.regexp_replace(t, r"\(.*$", "")).isin(words), F.lit(False)))
    return columns.filter(~F.coalesce(reduce(lambda a, b: a | b, [t.startswith(w) for w in words]), F.lit(False)))


def sample_values(table: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value): the n smallest distinct non-null values of each column, as text, in one scan.

    The scan is unpivoted and made distinct with map-side aggregation; the rank's limit
    is pushed below the shuffle.
    """
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.column", "x.value").filter("value is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return long.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")


def schema_batch(schemas: DataFrame, tables: DataFrame, columns: DataFrame, references: DataFrame | None = None, samples: DataFrame | None = None, *, platform: str, service: str) -> GraphBatch:
    """The batch of a warehouse: frames with database, schema, table, column names and properties."""
    database = schemas.select("database").distinct()
    batch = hierarchy_batch({"database": database, "schema": schemas, "table": tables, "column": columns}, platform=platform, service=service)
    if references is not None:
        batch.edges["Column-REFERENCES-Column"] = reference_edges(references, criteria=False)
    if samples is not None:
        batch.nodes["Value"], batch.edges["Column-HAS_VALUE-Value"] = value_nodes(samples)
    return batch


def require_schema(schemas: DataFrame, database: str, schema: str) -> DataFrame:
    """The wanted schema; an error if it does not exist."""
    found = schemas.filter((ids.normalize("database") == ids.normalize(F.lit(database))) & (ids.normalize("schema") == ids.normalize(F.lit(schema))))
    if found.isEmpty():
        raise ConfigError(f"schema {schema!r} does not exist in {database!r}")
    return found
