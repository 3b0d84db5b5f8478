"""The driver's tables read as a metadata graph.

Regions are databases, nations schemas, suppliers tables, parts columns (each of its
smallest supplier), quantities example values, part types business terms.  A table has
the term of the part with its own key.  Two
parts refer to each other as the smallest and largest part of an order.
Embeddings belong to the nation, supplier or part whose key is the vector's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.store import GraphStore


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def catalog_graph(spark: SparkSession, sf: str, path: str | None = None) -> GraphStore:
    region, nation, supplier, part, lineitem = (read(spark, sf, t) for t in ("region", "nation", "supplier", "part", "lineitem"))
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    with_vector = lambda df, key: df.join(vectors, F.col(key) == F.col("vec_id"), "left")
    g = GraphStore(spark, path)
    g.upsert_nodes("Database", region.select(_key("d", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    g.upsert_nodes("Schema", with_vector(nation, "n_nationkey").select(_key("s", "n_nationkey").alias("id"), F.col("n_name").alias("name"), "embedding"))
    g.upsert_nodes("Table", with_vector(supplier, "s_suppkey").select(_key("t", "s_suppkey").alias("id"), F.col("s_name").alias("name"), "embedding"))
    g.upsert_nodes(
        "Column",
        with_vector(part, "p_partkey").select(_key("c", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("type"), (F.col("p_size") > 5).alias("nullable"), (F.col("p_size") < 10).alias("is_primary_key"), (F.col("p_size") < 25).alias("is_foreign_key"), "embedding"),
    )
    g.upsert_nodes("BusinessTerm", part.select(F.concat(F.lit("b"), F.col("p_type")).alias("id"), F.col("p_type").alias("name")).distinct())
    quantity = F.col("l_quantity").cast("int").cast("string")
    g.upsert_nodes("Value", lineitem.select(F.concat(F.lit("v"), quantity).alias("id"), quantity.alias("value")).distinct())
    g.upsert_edges("Database-HAS_SCHEMA-Schema", nation.select(_key("d", "n_regionkey").alias("src_id"), _key("s", "n_nationkey").alias("dst_id")))
    g.upsert_edges("Schema-HAS_TABLE-Table", supplier.select(_key("s", "s_nationkey").alias("src_id"), _key("t", "s_suppkey").alias("dst_id")))
    owner = lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    g.upsert_edges("Table-HAS_COLUMN-Column", owner.select(_key("t", "l_suppkey").alias("src_id"), _key("c", "l_partkey").alias("dst_id")))
    ends = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).filter("a <> b")
    g.upsert_edges("Column-REFERENCES-Column", ends.select(_key("c", "a").alias("src_id"), _key("c", "b").alias("dst_id")))
    g.upsert_edges("Column-HAS_VALUE-Value", lineitem.select(_key("c", "l_partkey").alias("src_id"), F.concat(F.lit("v"), quantity).alias("dst_id")))
    g.upsert_edges("Column-TAGGED_WITH-BusinessTerm", part.select(_key("c", "p_partkey").alias("src_id"), F.concat(F.lit("b"), F.col("p_type")).alias("dst_id")))
    first = supplier.join(part, F.col("s_suppkey") == F.col("p_partkey"))
    g.upsert_edges("Table-TAGGED_WITH-BusinessTerm", first.select(_key("t", "s_suppkey").alias("src_id"), F.concat(F.lit("b"), F.col("p_type")).alias("dst_id")))
    return g


def domain_graph(spark: SparkSession, sf: str) -> GraphStore:
    """Regions as domains, nations as their datasets, suppliers as columns, customers as metrics, a join per supplier."""
    region, nation, supplier, customer = (read(spark, sf, t) for t in ("region", "nation", "supplier", "customer"))
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    g = GraphStore(spark)
    low = F.lower("r_name")
    by_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    g.upsert_nodes("Domain", region.select(low.alias("id"), F.col("r_name").alias("name")))
    g.upsert_nodes("Table", nation.select(_key("t", "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    g.upsert_nodes("Column", supplier.select(_key("c", "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    metrics = customer.join(vectors, F.col("c_custkey") == F.col("vec_id"), "left")
    g.upsert_nodes("Metric", metrics.select(_key("m", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), "embedding"))
    g.upsert_nodes("BusinessTerm", customer.select(F.concat(F.lit("b"), F.col("c_mktsegment")).alias("id"), F.col("c_mktsegment").alias("name")).distinct())
    g.upsert_nodes("Expression", customer.select(F.concat(F.lit("e"), F.col("c_mktsegment")).alias("id"), F.lit("ANSI_SQL").alias("dialect"), F.concat(F.lit("SUM("), F.col("c_mktsegment"), F.lit(")")).alias("expression")).distinct())
    g.upsert_nodes("Join", supplier.select(_key("j", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("k")).alias("from_columns"), F.array(F.lit("k")).alias("to_columns")))
    g.upsert_edges("Domain-HAS_TABLE-Table", by_region.select(low.alias("src_id"), _key("t", "n_nationkey").alias("dst_id")))
    g.upsert_edges("Table-HAS_COLUMN-Column", supplier.select(_key("t", "s_nationkey").alias("src_id"), _key("c", "s_suppkey").alias("dst_id")))
    owners = customer.join(by_region, F.col("c_nationkey") == F.col("n_nationkey"))
    g.upsert_edges("Domain-HAS_METRIC-Metric", owners.select(low.alias("src_id"), _key("m", "c_custkey").alias("dst_id")))
    g.upsert_edges("Metric-TAGGED_WITH-BusinessTerm", customer.select(_key("m", "c_custkey").alias("src_id"), F.concat(F.lit("b"), F.col("c_mktsegment")).alias("dst_id")))
    g.upsert_edges("Metric-HAS_EXPRESSION-Expression", customer.select(_key("m", "c_custkey").alias("src_id"), F.concat(F.lit("e"), F.col("c_mktsegment")).alias("dst_id")))
    g.upsert_edges("Join-HAS_SOURCE_TABLE-Table", supplier.select(_key("j", "s_suppkey").alias("src_id"), _key("t", "s_nationkey").alias("dst_id")))
    g.upsert_edges("Join-HAS_TARGET_TABLE-Table", supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_key("j", "s_suppkey").alias("src_id"), _key("t", "n_regionkey").alias("dst_id")))
    return g
