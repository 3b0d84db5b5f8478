"""Sources, loaders, identifiers and evaluation over the driver's tables, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import connectors, enrichment, evalkit, ids
from schemaloom.errors import ConfigError, SchemaloomWarning, StateError
from schemaloom.functions import identifiers
from schemaloom.functions import text as tx
from schemaloom.materialize import shared_dir
from schemaloom.operators.similar import most_similar
from schemaloom.plans import context as cx
from schemaloom.plans.search import GraphSearch
from schemaloom.queries.tpch_graph import catalog_graph, domain_graph, read
from schemaloom.sources import catalog_json, governance, infoschema, osi, querylog, rows, warehouses
from schemaloom.sources.csv_bundle import CsvBundle
from schemaloom.store import GraphBatch, GraphStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_N = "replace(replace(lower({0}), ' ', '_'), '-', '_')".format
_PATH = ("database", "schema", "table", "column")


def _id(side: str = "", depth: int = 4) -> str:
    return " || '.' || ".join(_N(f"{side}{p}_name") for p in _PATH[:depth])


# ---------------------------------------------------------------- bundles and flat rows


@_query(f"SELECT {_id(depth=3)} AS table_id, count(DISTINCT {_id()}) AS n_columns FROM column_info GROUP BY 1")
def csv_bundle_columns(spark, sf):
    folder = _scratch(spark, "bundle")
    names = [f"{p}_name" for p in _PATH]
    read(spark, sf, "column_info").select(*names, "data_type", "is_nullable", "description").write.option("header", True).option("escape", '"').csv(f"{folder}/column_info.csv")
    batch = CsvBundle(spark, folder).extract(include_relationships=["HAS_COLUMN"])
    return batch.edges["Table-HAS_COLUMN-Column"].groupBy(F.col("src_id").alias("table_id")).agg(F.count("*").alias("n_columns"))


@_query("SELECT DISTINCT 'tpc_h.main.part.' || c || '.' || md5(v) AS value_id, v AS value FROM (SELECT 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part)")
def value_rows(spark, sf):
    part = read(spark, sf, "part")
    names = [F.lit(v).alias(k) for k, v in (("database", "TPC-H"), ("schema", "Main"), ("table", "part"))]
    once = [part.select(*names, F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("p_brand", "p_type", "p_brand")]
    nodes, _ = rows.value_nodes(once[0].unionByName(once[1]).unionByName(once[2]))
    return nodes.select(F.col("id").alias("value_id"), "value")


@_query(f"SELECT DISTINCT {_id('source_')} AS src_id, {_id('target_')} AS dst_id FROM column_references_info WHERE {_id('source_')} <> {_id('target_')}")
def self_references_left_out(spark, sf):
    r = read(spark, sf, "column_references_info")
    plain = r.withColumnsRenamed({f"{s}_{p}_name": f"{s}_{p}" for s in ("source", "target") for p in _PATH})
    return rows.reference_edges(plain, criteria=False).select("src_id", "dst_id")


@_query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def missing_numbers(spark, sf):
    return rows.without_nan(read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


# ---------------------------------------------------------------- warehouses


@_query("""WITH r AS (SELECT 'fk' || reference_id AS k, * FROM column_references_info)
SELECT k AS constraint_name, source_table_name AS source_table, source_column_name AS source_column, CASE WHEN reference_id % 5 <> 0 THEN target_table_name END AS target_table, CASE WHEN reference_id % 5 <> 0 THEN target_column_name END AS target_column
FROM r WHERE reference_id % 3 <> 0""")
def references_by_constraint_name(spark, sf):
    r = read(spark, sf, "column_references_info").withColumn("constraint_name", F.concat(F.lit("fk"), "reference_id"))
    kinds = r.select("constraint_name", F.when(F.col("reference_id") % 3 == 0, "PRIMARY KEY").otherwise("FOREIGN KEY").alias("constraint_type"))
    usage = r.select("constraint_name", F.col("source_table_name").alias("source_table"), F.col("source_column_name").alias("source_column"))
    targets = r.filter("reference_id % 5 <> 0").select("constraint_name", F.col("target_table_name").alias("target_table"), F.col("target_column_name").alias("target_column"))
    return infoschema.references_by_name(kinds, usage, targets).drop("constraint_type")


def _frames(spark, sf) -> dict[str, DataFrame]:
    """Information-schema frames of the crawled catalogue; columns crawled twice count once."""
    c = read(spark, sf, "column_info").groupBy(*[f"{p}_name" for p in _PATH]).agg(F.min("data_type").alias("data_type"), F.max(F.col("is_nullable").cast("int")).alias("n"))
    named = [F.col("database_name").alias("table_catalog"), F.col("schema_name").alias("table_schema"), "table_name"]
    comment = F.lit(None).cast("string").alias("comment")
    r = read(spark, sf, "column_references_info")
    own = r.select(F.col("source_database_name").alias("table_catalog"), F.col("source_schema_name").alias("table_schema"), F.col("source_table_name").alias("table_name"), F.col("source_column_name").alias("column_name"), F.concat(F.lit("fk"), "reference_id").alias("constraint_name"), F.lit(1).alias("ordinal_position"), F.when(F.col("reference_id") % 4 == 0, 2).otherwise(1).alias("position_in_unique_constraint"))
    other = r.select(F.col("target_database_name").alias("table_catalog"), F.col("target_schema_name").alias("table_schema"), F.col("target_table_name").alias("table_name"), F.col("target_column_name").alias("column_name"), F.concat(F.lit("uq"), "reference_id").alias("constraint_name"), F.lit(1).alias("ordinal_position"), F.lit(None).cast("int").alias("position_in_unique_constraint"))
    usage = own.unionByName(other)
    place = {"constraint_catalog": F.lit("x"), "constraint_schema": F.lit("y")}
    key = lambda p: F.concat(F.lit(p), "reference_id")
    frames = {
        "schemata": c.select(F.col("database_name").alias("catalog_name"), "schema_name", comment).distinct(),
        "tables": c.select(*named, comment).distinct(),
        "columns": c.select(*named, "column_name", "data_type", F.when(F.col("n") == 0, "NO").when(F.col("n") == 1, "YES").alias("is_nullable"), comment),
        "primary_keys": read(spark, sf, "column_info").filter("is_primary_key").select("table_name", "column_name"),
        "imported_keys": r.select(*[F.col(f"{s}_{p}_name").alias(f"{k}_{p}_name") for s, k in (("source", "fk"), ("target", "pk")) for p in _PATH]),
        "key_column_usage": usage.withColumns(place),
        "table_constraints": usage.select("constraint_name", F.when(F.col("constraint_name").startswith("fk"), "FOREIGN KEY").otherwise("PRIMARY KEY").alias("constraint_type")).withColumns(place),
        "referential_constraints": r.select(key("fk").alias("constraint_name"), key("uq").alias("unique_constraint_name"), F.lit("y").alias("constraint_schema"), F.lit("y").alias("unique_constraint_schema")),
    }
    return frames


def _first_schema(spark, sf):
    """The schema of the first catalogue row."""
    return read(spark, sf, "column_info").orderBy("column_row_id").select("database_name", "schema_name").first()


_WHERE = "(database_name, schema_name) = (SELECT (database_name, schema_name) FROM column_info ORDER BY column_row_id LIMIT 1)"
_CRAWLED = f"""SELECT {_id()} AS id, database_name, schema_name, table_name, column_name, data_type, nullable FROM (
SELECT database_name, schema_name, table_name, column_name, min(data_type) AS data_type, coalesce(bool_or(is_nullable), true) AS nullable FROM column_info WHERE {_WHERE} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_id()} ORDER BY column_name) = 1"""


@_query(f"""SELECT id, data_type AS type, nullable, (table_name, column_name) IN (SELECT (table_name, column_name) FROM column_info WHERE is_primary_key) AS is_primary_key,
(table_name, column_name) IN (SELECT (source_table_name, source_column_name) FROM column_references_info) AS is_foreign_key FROM ({_CRAWLED})""")
def warehouse_columns_by_membership(spark, sf):
    frames, at = _frames(spark, sf), _first_schema(spark, sf)
    batch = warehouses.snowflake(lambda t: frames[t.lower()], at.database_name, at.schema_name)
    return batch.nodes["Column"].select("id", "type", "nullable", "is_primary_key", "is_foreign_key")


@_query(f"SELECT DISTINCT {_id('source_')} AS src_id, {_id('target_')} AS dst_id FROM column_references_info WHERE lower(source_database_name) = lower(target_database_name) AND {_id('source_')} <> {_id('target_')}")
def warehouse_references_same_database(spark, sf):
    frames, at = _frames(spark, sf), _first_schema(spark, sf)
    return warehouses.snowflake(lambda t: frames[t.lower()], at.database_name, at.schema_name).edges["Column-REFERENCES-Column"].select("src_id", "dst_id")


_ENDS = ", ".join(f"{{0}}_{p}_name" for p in _PATH)


@_query(f"""SELECT id, nullable, (database_name, schema_name, table_name, column_name) IN (SELECT ({_ENDS.format('target')}) FROM column_references_info) AS is_primary_key,
(database_name, schema_name, table_name, column_name) IN (SELECT ({_ENDS.format('source')}) FROM column_references_info) AS is_foreign_key FROM ({_CRAWLED})""")
def warehouse_columns_by_type(spark, sf):
    frames, at = _frames(spark, sf), _first_schema(spark, sf)
    return warehouses.databricks(lambda t: frames[t], at.database_name, at.schema_name).nodes["Column"].select("id", "nullable", "is_primary_key", "is_foreign_key")


@_query(f"SELECT DISTINCT {_id('source_')} AS src_id, {_id('target_')} AS dst_id FROM column_references_info WHERE reference_id % 4 <> 0 AND {_id('source_')} <> {_id('target_')}")
def warehouse_references_by_position(spark, sf):
    frames, at = _frames(spark, sf), _first_schema(spark, sf)
    return warehouses.databricks(lambda t: frames[t], at.database_name, at.schema_name).edges["Column-REFERENCES-Column"].select("src_id", "dst_id")


_IN_DB = " || '.' || ".join(["'db'", *[_N(f"{{0}}_{p}_name") for p in _PATH[1:]]])


@_query(f"SELECT DISTINCT {_IN_DB.format('source')} AS src_id, {_IN_DB.format('target')} AS dst_id FROM column_references_info WHERE reference_id % 4 <> 0 AND {_IN_DB.format('source')} <> {_IN_DB.format('target')}")
def jdbc_references(spark, sf):
    frames = _frames(spark, sf)
    return warehouses.jdbc(lambda t: frames[t], "DB").edges["Column-REFERENCES-Column"].select("src_id", "dst_id")


@_query(f"SELECT 'tpc_h.' || {_N('r_name')} || '.' || {_N('n_name')} || '.' || c AS id, c = 'n_nationkey' AS is_primary_key FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['n_nationkey', 'n_name']) AS c)")
def jdbc_catalogue_file(spark, sf):
    place = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    column = lambda n, key: F.struct(F.lit(n).alias("name"), F.lit("INT").alias("type"), F.lit(False).alias("nullable"), F.lit("").alias("remarks"), F.lit(key).alias("is_primary_key"), F.lit(False).alias("is_foreign_key"))
    table = F.struct(F.col("r_name").alias("schema"), F.col("n_name").alias("name"), F.lit("").alias("remarks"), F.array(column("n_nationkey", True), column("n_name", False)).alias("columns"))
    doc = place.agg(F.collect_set(F.struct(F.col("r_name").alias("name"), F.lit("").alias("remarks"))).alias("schemas"), F.collect_list(table).alias("tables"), F.array().cast("array<string>").alias("foreign_keys"))
    path = _scratch(spark, "catalogue")
    doc.select(F.to_json(F.struct("*"))).write.text(path)
    return catalog_json.relational_catalog(spark, path, "TPC-H").nodes["Column"].select("id", "is_primary_key")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS database_name FROM customer")
def jdbc_url_database(spark, sf):
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("jdbc:postgresql://host:5432/"), "c_mktsegment", F.lit("?ssl=true"))).otherwise(F.lit("jdbc:postgresql://host:5432"))
    return read(spark, sf, "customer").select("c_custkey", catalog_json.url_database(url).alias("database_name"))


@_query(f"SELECT DISTINCT {_id()} AS id, min(data_type) OVER (PARTITION BY {_id()}) AS type, true AS nullable FROM column_info")
def catalogue_entries_by_aspect(spark, sf):
    c = read(spark, sf, "column_info").select(*[ids.normalize(f"{p}_name").alias(p) for p in _PATH], "data_type").groupBy(*_PATH).agg(F.min("data_type").alias("dataType"))
    fields = F.collect_list(F.struct(F.col("column").alias("name"), "dataType", F.lit("NULLABLE").alias("mode")))
    aspects = F.create_map(F.lit("1.global.schema"), F.to_json(F.struct(fields.alias("fields"))), F.lit("1.global.storage"), F.lit('{"resourceName": "r"}'), F.lit("other"), F.lit(None).cast("string"))
    entries = c.groupBy(F.col("database").alias("project_id"), F.col("schema").alias("dataset_id"), F.col("table").alias("table_id")).agg(aspects.alias("aspects")).withColumns({"description": F.lit(None).cast("string"), "system": F.lit("BigQuery"), "platform": F.lit("gcp")})
    return catalog_json.entry_catalog(catalog_json.aspect_entries(entries)).nodes["Column"].select("id", "type", "nullable")


# ---------------------------------------------------------------- tags, logs


@_query(f"SELECT vec_id, 'meta_store.' || {_N('name')} AS tag_key_id FROM tag_keys")
def tag_key_ids(spark, sf):
    name = governance.namespace(None, "Meta-Store", "host")
    return read(spark, sf, "tag_keys").select("vec_id", ids.tag_key_id(F.lit(name), "name").alias("tag_key_id"))


@_query(f"SELECT DISTINCT {_id()} || '.' || {_N('glossary_name')} || '.' || md5(coalesce(term_name, '')) AS tag_id FROM column_term_info WHERE {_id()} || {_N('glossary_name')} IS NOT NULL")
def tag_assignments(spark, sf):
    links = read(spark, sf, "column_term_info").select(ids.column_id(*[f"{p}_name" for p in _PATH]).alias("object_id"), F.col("glossary_name").alias("tag_key"), F.col("term_name").alias("value_name"))
    return governance.assignment_batch(links, "src", "Column").nodes["GovernanceTag"].select(F.col("id").alias("tag_id"))


@_query(f"""WITH l AS (SELECT link_id, {_id()} AS c, {_id(depth=3)} AS t, column_name FROM column_term_info WHERE {_id()} IS NOT NULL)
SELECT link_id, CASE WHEN link_id % 3 = 0 THEN t ELSE c END AS entity_id, CASE WHEN link_id % 3 = 0 THEN 'TABLE' ELSE 'COLUMN' END AS entity_type FROM l""")
def glossary_links(spark, sf):
    links = read(spark, sf, "column_term_info").filter(ids.column_id(*[f"{p}_name" for p in _PATH]).isNotNull())
    entry = F.concat(F.lit("projects/1/locations/us/entryGroups/@bigquery/entries/bigquery.googleapis.com/projects/"), "database_name", F.lit("/datasets/"), "schema_name", F.lit("/tables/"), "table_name")
    path = F.when(F.col("link_id") % 3 != 0, F.concat(F.lit("Schema."), "column_name"))
    rows_ = governance.link_rows(links.select(entry.alias("entry_name"), path.alias("path"), F.col("link_id").alias("term_id")))
    return rows_.withColumnRenamed("term_id", "link_id")


@_query("SELECT 'p' || user_id AS project, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def audit_entries(spark, sf):
    request = F.when(F.col("event_type") != "error", F.struct(F.concat(F.lit("p"), "user_id").alias("projectId"), F.lit("SELECT 1").alias("query")))
    path = _scratch(spark, "audit")
    read(spark, sf, "events").select(F.to_json(F.struct(F.struct(F.struct(request.alias("jobQueryRequest")).alias("serviceData")).alias("protoPayload")))).write.text(path)
    return querylog.audit_file(spark, path, lines=True).groupBy("project").agg(F.count("*").alias("n"))


@_query("""SELECT event_id AS query_id FROM (SELECT * FROM events WHERE event_type IN ('view', 'click', 'purchase') AND ts >= TIMESTAMP '2024-01-01' AND user_id % 5 <> 0 ORDER BY ts DESC, event_id LIMIT 100) WHERE event_id % 3 <> 0""")
def recent_statements(spark, sf):
    e = read(spark, sf, "events")
    log = e.select(F.col("event_id").alias("query_id"), F.when(F.col("event_type").isin("view", "click", "purchase"), "SELECT").otherwise("SHOW").alias("query_type"), F.when(F.col("user_id") % 10 == 0, F.lit(None)).when(F.col("user_id") % 5 == 0, "  ").otherwise("SELECT 1").alias("query_text"), F.when(F.col("event_id") % 3 == 0, "000904").alias("error_code"), F.col("ts").alias("start_time"))
    return querylog.recent_statements(log, now=dt.datetime(2024, 1, 31)).select("query_id")


# ---------------------------------------------------------------- identifiers


@_query(f"SELECT term_row_id, {_N('glossary_name')} AS glossary_id, {_N('glossary_name')} || '.' || {_N('category_name')} AS category_id, {_N('glossary_name')} || '.' || {_N('category_name')} || '.' || {_N('term_name')} AS term_id FROM business_term_info")
def glossary_ids(spark, sf):
    return read(spark, sf, "business_term_info").select("term_row_id", ids.glossary_id("glossary_name").alias("glossary_id"), ids.category_id("glossary_name", "category_name").alias("category_id"), ids.term_id("glossary_name", "category_name", "term_name").alias("term_id"))


@_query(f"SELECT c_custkey, {_N('c_mktsegment')} AS model_id, {_N('c_mktsegment')} || '.' || {_N('c_name')} AS metric_id, {_N('c_mktsegment')} || '.' || {_N('c_name')} AS join_id, c_name || '.' || {_N('c_mktsegment')} AS cte_id, c_name || '.' || {_N('c_mktsegment')} AS query_column_id FROM customer")
def model_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", ids.model_id("c_mktsegment").alias("model_id"), ids.metric_id("c_mktsegment", "c_name").alias("metric_id"), ids.join_id("c_mktsegment", "c_name").alias("join_id"), ids.cte_id("c_name", "c_mktsegment").alias("cte_id"), ids.query_column_id("c_name", "c_mktsegment").alias("query_column_id"))


@_query("SELECT p_partkey, md5(p_type || '::' || p_name) AS a, 'o.' || md5(p_name) AS ai_context_id, 'o.' || md5(p_brand || '::' || p_name) AS extension_id FROM part")
def aspect_ids(spark, sf):
    part = read(spark, sf, "part")
    return part.select("p_partkey", F.substring_index(ids.expression_id(F.lit("o"), "p_type", "p_name"), ".", -1).alias("a"), ids.ai_context_id(F.lit("o"), "p_name").alias("ai_context_id"), ids.custom_extension_id(F.lit("o"), "p_brand", "p_name").alias("extension_id"))


@_query("SELECT column_row_id, CASE WHEN regexp_full_match(column_name, '[A-Za-z_][A-Za-z0-9_$]*') THEN upper(column_name) END AS plain, CASE WHEN column_name <> '' THEN column_name END AS exact FROM column_info")
def identifiers_folded(spark, sf):
    quoted = F.concat(F.lit('"'), F.replace("column_name", F.lit('"'), F.lit('""')), F.lit('"'))
    return read(spark, sf, "column_info").select("column_row_id", identifiers.folded("column_name").alias("plain"), identifiers.folded(quoted).alias("exact"))


@_query("SELECT column_row_id, '''' || replace(replace(description, '\\', '\\\\'), '''', '''''') || '''' AS text FROM column_info")
def literals_escaped(spark, sf):
    return read(spark, sf, "column_info").select("column_row_id", identifiers.literal(F.col("description")).alias("text"))


@_query("""SELECT column_row_id, CASE WHEN s IS NULL OR s = '' THEN 'error' WHEN regexp_full_match(s, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') AND len(string_split(s, '.')) < 3 THEN 'error'
WHEN regexp_full_match(s, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') AND len(string_split(s, '.')) = 3 THEN 'table' ELSE 'query' END AS kind
FROM (SELECT column_row_id, CASE WHEN column_row_id % 3 = 0 THEN table_name ELSE database_name || '.' || schema_name || '.' || table_name END AS s FROM column_info)""")
def model_source_kinds(spark, sf):
    full = F.concat_ws(".", "database_name", "schema_name", "table_name")
    named = F.when(F.col("column_row_id") % 3 == 0, F.col("table_name")).when(F.concat("database_name", "schema_name", "table_name").isNotNull(), full)
    return read(spark, sf, "column_info").select("column_row_id", osi.source_kind(named).alias("kind"))


_TRIM = "regexp_replace({0}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')".format


@_query(f"SELECT doc_id, sha256({_TRIM('subject_id')} || chr(10) || {_TRIM('text')}) AS question_id, 'simple_lookup' AS archetype FROM documents")
def question_ids(spark, sf):
    bank = read(spark, sf, "documents").select("doc_id", F.col("subject_id").alias("question"), F.col("text").alias("sql"), F.lit("simple_lookup").alias("archetype"))
    return evalkit.question_bank(bank).select("doc_id", "question_id", "archetype")


# ---------------------------------------------------------------- the store


@_query("""SELECT label, n FROM (SELECT 'Database' AS label, count(*) AS n FROM region UNION ALL SELECT 'Schema', count(*) FROM nation UNION ALL SELECT 'Table', count(*) FROM supplier UNION ALL SELECT 'Column', count(*) FROM part
UNION ALL SELECT 'BusinessTerm', count(DISTINCT p_type) FROM part UNION ALL SELECT 'Value', count(DISTINCT CAST(l_quantity AS INT)) FROM lineitem UNION ALL SELECT 'Schema-HAS_TABLE-Table', count(*) FROM supplier UNION ALL SELECT 'Table-HAS_COLUMN-Column', count(DISTINCT l_partkey) FROM lineitem)""")
def snapshot_counts(spark, sf):
    """A graph ingested twice, written, checked for repeated ids and read again."""
    path = _scratch(spark, "store")
    g = catalog_graph(spark, sf, path=path)
    again = catalog_graph(spark, sf)
    g.ingest(GraphBatch({k: again.nodes(k) for k in ("Database", "Schema", "Table")}, {"Schema-HAS_TABLE-Table": again.edges("Schema-HAS_TABLE-Table")}))
    g.save()
    g = GraphStore.load(spark, path)
    frames = {k: g.nodes(k) for k in ("Database", "Schema", "Table", "Column", "BusinessTerm", "Value")} | {k: g.edges(k) for k in ("Schema-HAS_TABLE-Table", "Table-HAS_COLUMN-Column")}
    out = None
    for name, df in frames.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_STORED = f"SELECT {_N('glossary_name')} || '.' || {_N('category_name')} || '.' || {_N('term_name')} AS id, term_name AS name FROM business_term_info"


@_query(f"""WITH stored AS (SELECT id, min(name) AS name FROM ({_STORED}) WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT DISTINCT {_id()} AS c, 'osi.synonyms.' || {_N('term_name')} AS synonym, min(term_name) OVER (PARTITION BY {_N('term_name')}) AS name FROM column_term_info WHERE term_name IS NOT NULL)
SELECT DISTINCT c AS src_id, coalesce(stored.id, synonym) AS dst_id FROM links LEFT JOIN stored USING (name) WHERE c IS NOT NULL""")
def terms_merged_by_name(spark, sf):
    """Synonyms of a model meet the stored terms of their name, which keep their ids."""
    terms, links = read(spark, sf, "business_term_info"), read(spark, sf, "column_term_info").filter("term_name is not null")
    column = ids.column_id(*[f"{p}_name" for p in _PATH])
    synonym = ids.dotted(F.lit("osi"), F.lit("synonyms"), "term_name")
    g = GraphStore(spark)
    g.upsert_nodes("Column", links.select(column.alias("id")))
    g.upsert_nodes("BusinessTerm", terms.select(ids.term_id("glossary_name", "category_name", "term_name").alias("id"), F.col("term_name").alias("name")))
    batch = GraphBatch({"BusinessTerm": links.select(synonym.alias("id"), F.col("term_name").alias("name"))}, {"Column-TAGGED_WITH-BusinessTerm": links.select(column.alias("src_id"), synonym.alias("dst_id"))}, {"BusinessTerm": "name"})
    g.ingest(batch, overwrite=True)
    return g.edges("Column-TAGGED_WITH-BusinessTerm").select("src_id", "dst_id").distinct()


@_query("SELECT 'm' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_mktsegment AS description FROM customer")
def chosen_properties_only(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), "c_custkey")
    g = GraphStore(spark)
    g.upsert_nodes("Metric", c.filter("c_custkey % 2 = 0").drop("c_custkey"))
    g.upsert_nodes("Metric", c.drop("c_custkey"), properties=["description"])
    return g.nodes("Metric").select("id", "name", "description")


@_query("SELECT n_nationkey, n_name AS name, round(embedding[1], 6) AS first FROM nation LEFT JOIN embeddings ON vec_id = n_nationkey")
def embeddings_written_back(spark, sf):
    g = GraphStore(spark)
    nation, vectors = read(spark, sf, "nation"), read(spark, sf, "embeddings")
    g.upsert_nodes("Schema", nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")))
    g.set_embeddings("Schema", vectors.select(F.col("vec_id").cast("string").alias("id"), "embedding"))
    return g.nodes("Schema").select(F.col("id").cast("int").alias("n_nationkey"), "name", F.round(F.col("embedding")[0], 6).alias("first"))


@_query("SELECT '1.0' AS initial_version, '2.0' AS latest_version, '2024-01-01' AS created, '2024-02-01' AS updated")
def version_stamp(spark, sf):
    g = GraphStore(spark)
    for version, month in (("1.0", 1), ("2.0", 2)):
        g.stamp(version, dt.datetime(2024, month, 1))
    return g.nodes("GraphInfo").select("initial_version", "latest_version", F.date_format("create_date", "yyyy-MM-dd").alias("created"), F.date_format("last_updated", "yyyy-MM-dd").alias("updated"))


@_query("""SELECT label, kind FROM (SELECT * FROM (VALUES ('Database', 'FULLTEXT'), ('Schema', 'FULLTEXT'), ('Table', 'FULLTEXT'), ('Column', 'FULLTEXT'), ('BusinessTerm', 'FULLTEXT')) t(label, kind)
UNION ALL SELECT 'Schema', 'VECTOR' WHERE EXISTS (SELECT * FROM embeddings JOIN nation ON vec_id = n_nationkey) UNION ALL SELECT 'Table', 'VECTOR' WHERE EXISTS (SELECT * FROM embeddings JOIN supplier ON vec_id = s_suppkey)
UNION ALL SELECT 'Column', 'VECTOR' WHERE EXISTS (SELECT * FROM embeddings JOIN part ON vec_id = p_partkey))""")
def search_indexes(spark, sf):
    return spark.createDataFrame(sorted(catalog_graph(spark, sf).indexes()), "label string, kind string")


@_query("SELECT * FROM (VALUES ('Table', 'terms'), ('Column', 'terms'), ('Metric', CAST(NULL AS VARCHAR)), ('Schema', 'vector')) t(label, way)")
def search_strategy(spark, sf):
    s = GraphSearch(catalog_graph(spark, sf))
    return spark.createDataFrame([(label, s.strategy(label)) for label in ("Table", "Column", "Metric", "Schema")], "label string, way string")


@_query("SELECT true AS terms, false AS models, true AS same_version, false AS other_version")
def graph_probes(spark, sf):
    g = domain_graph(spark, sf)
    g.stamp("1.0", dt.datetime(2024, 1, 1))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SchemaloomWarning)
        return spark.createDataFrame([(g.has_terms(), g.has_models(), g.check_version("1.0"), g.check_version("2.0"))], "terms boolean, models boolean, same_version boolean, other_version boolean")


@_query("SELECT 'StateError' AS before_extract, 'StateError' AS after_close, (SELECT count(DISTINCT event_type) FROM events WHERE event_type <> 'error') AS n_keys")
def connector_lifecycle(spark, sf):
    policies = read(spark, sf, "events").select(F.when(F.col("event_type") == "error", "system.error").otherwise(F.col("event_type")).alias("tag_key"), F.lit("").alias("description"), F.array(F.struct(F.lit("x").alias("name"))).alias("values"))
    tags, g, seen = connectors.governed_tags(policies, source="src"), GraphStore(spark), []
    for step in (lambda: tags.load(g), lambda: (tags.ingest(g), tags.close(), tags.extract())):
        try:
            step()
        except (StateError, ConfigError) as e:
            seen.append(type(e).__name__)
    return g.nodes("GovernanceTagKey").agg(F.count("*").alias("n_keys")).select(F.lit(seen[0]).alias("before_extract"), F.lit(seen[1]).alias("after_close"), "n_keys")


# ---------------------------------------------------------------- embeddings


@_query("SELECT doc_id, 64 AS dimensions, true AS unit FROM documents WHERE text <> ''")
def embedded_texts(spark, sf):
    provider = enrichment.hashing_provider()
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"), F.lit(None).cast("array<float>").alias("embedding"))
    v = enrichment.embedded(enrichment.candidates(docs), provider)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return v.select(F.col("id").cast("bigint").alias("doc_id"), F.size("embedding").alias("dimensions"), (F.abs(norm - 1) < 1e-3).alias("unit"))


@_query("""SELECT id, other, round(score, 6) AS score FROM (SELECT q.vec_id AS id, x.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 9) DESC, x.vec_id) AS k FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0) WHERE k <= 10""")
def vec_topk_batch(spark, sf):
    """Every vector whose id is divisible by 50 asks all others."""
    e = read(spark, sf, "embeddings")
    return most_similar(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding").select("id", "other", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- evaluation

_GOLD = ("SELECT c_name FROM shop.customer WHERE c_acctbal > 0", "SELECT o.o_orderkey, c.c_name FROM shop.orders o JOIN shop.customer c ON o.o_custkey = c.c_custkey", "SELEC nothing FROM")


@_query("SELECT * FROM (VALUES (0, 'shop.customer', 'c_acctbal,c_name', 0, 0), (1, 'shop.customer,shop.orders', 'c_custkey,c_name,o_custkey,o_orderkey', 1, 2), (2, '', '', 0, 0)) t(q, tables, columns, n_joins, n_aliases)")
def required_objects(spark, sf):
    found = []
    for q, sql in enumerate(_GOLD):
        r = evalkit.required_objects(spark, sql)
        found.append((q, ",".join(sorted(r["tables"])), ",".join(sorted(r["columns"])), len(r["joins"]), len(r["aliases"])))
    return spark.createDataFrame(found, "q int, tables string, columns string, n_joins int, n_aliases int")


@_query("SELECT * FROM (VALUES (0, true, true, true), (1, false, true, true), (2, false, true, false), (3, false, false, false)) t(q, exact_match, table_match, structural_match)")
def structural_matches(spark, sf):
    gold = _GOLD[0]
    tries = (gold.lower().replace("from", "\n FROM "), gold.replace("c_acctbal > 0", "0 < c_acctbal"), "SELECT c_phone FROM shop.customer", _GOLD[2])
    found = [(q, *[evalkit.structural_equivalence(spark, t, gold)[k] for k in ("exact_match", "table_match", "structural_match")]) for q, t in enumerate(tries)]
    return spark.createDataFrame(found, "q int, exact_match boolean, table_match boolean, structural_match boolean")


@_query("SELECT * FROM (VALUES ('SELECT count(*) FROM orders_ WHERE o_totalprice > 0', true), ('SELECT nothing FROM orders_', false), ('SELEC 1', false)) t(sql, valid)")
def dry_runs(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders_")
    texts = ("SELECT count(*) FROM orders_ WHERE o_totalprice > 0", "SELECT nothing FROM orders_", "SELEC 1")
    return spark.createDataFrame([(t, evalkit.is_valid(spark, t)) for t in texts], "sql string, valid boolean")


@_query("""WITH owner AS (SELECT l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey), ends AS (SELECT DISTINCT a, b FROM (SELECT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY l_orderkey) WHERE a <> b),
named AS (SELECT p, s_name || '.' || p_name AS t FROM owner JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey), refs AS (SELECT DISTINCT x AS p, t FROM (SELECT a AS x, b AS y FROM ends UNION ALL SELECT b, a FROM ends) JOIN named ON y = named.p),
vals AS (SELECT p, string_agg(v, ', ' ORDER BY v) AS few FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v) AS k FROM (SELECT DISTINCT l_partkey AS p, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS v FROM lineitem)) WHERE k <= 3 GROUP BY p),
shown AS (SELECT s, p, '  - ' || p_name || ' (' || p_brand || '): ' || p_type || CASE WHEN p_size < 10 THEN ' [primary key]' WHEN p_size < 25 THEN ' [foreign key]' ELSE '' END || CASE WHEN p_size > 5 THEN '' ELSE ' [NOT NULL]' END || ' (examples: ' || few || ')' AS line FROM owner JOIN part ON p = p_partkey JOIN vals USING (p)),
lines AS (SELECT s, line FROM shown UNION ALL SELECT s, '    -> references ' || t FROM shown JOIN refs USING (p) UNION ALL SELECT DISTINCT s, 'Columns:' FROM shown UNION ALL SELECT DISTINCT s, 'Description: None' FROM shown UNION ALL SELECT DISTINCT s, 'Table: ' || n_name || '.' || s_name FROM shown JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT s, 'Joins:' FROM shown UNION ALL SELECT DISTINCT s, '  - other on a, b' FROM shown)
SELECT 't' || s AS table_id, string_agg(line, ';' ORDER BY line) AS lines FROM lines GROUP BY s""")
def context_as_text(spark, sf):
    joins = F.array(F.struct(F.lit("other").alias("table_name"), F.array(F.lit("a"), F.lit("b")).alias("column_names")))
    text = evalkit.table_text(cx.full_metadata(catalog_graph(spark, sf)).withColumn("joins", joins))
    return text.select("table_id", F.array_join(F.array_sort(F.split("text", "\n")), ";").alias("lines"))


_W = "len(regexp_extract_all(lower({0}), '[a-z0-9]+'))".format


@_query(f"SELECT doc_id, coalesce({_W('text')}, 0) AS mcp_schema_tokens, coalesce({_W('text')}, 0) AS full_schema_tokens, coalesce({_W('subject_id')}, 0) AS few_shot_tokens, coalesce({_W('text')}, 0) + coalesce({_W('subject_id')}, 0) AS mcp_total_context_tokens, 0 AS token_reduction_absolute, CASE WHEN coalesce({_W('text')}, 0) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS token_reduction_pct FROM documents")
def token_measures(spark, sf):
    samples = read(spark, sf, "documents").select("doc_id", F.split("text", "\n\n").alias("chunks"), F.col("text").alias("full_schema"), F.array("subject_id").alias("examples"))
    measured = evalkit.token_counts(samples, lambda c: F.size(tx.tokens(c)).cast("bigint"))
    return measured.select("doc_id", "mcp_schema_tokens", "full_schema_tokens", "few_shot_tokens", "mcp_total_context_tokens", "token_reduction_absolute", "token_reduction_pct")


@_query("SELECT n_nationkey, round(2 / 3, 6) AS object_recall, 0.5::DOUBLE AS object_precision, round(2 / 6, 6) AS compat_precision FROM nation")
def object_scores(spark, sf):
    place = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = place.select("n_nationkey", F.array("n_name").alias("required_tables"), F.array(F.lit("a"), F.lit("b")).alias("required_columns"), F.array(F.concat("r_name", F.lit("."), "n_name"), F.concat("r_name", F.lit(".other"))).alias("retrieved"), F.array(F.lit("B"), F.lit("c")).alias("retrieved_columns"))
    now = evalkit.object_scores(s)
    then = evalkit.object_scores(now.withColumnsRenamed({"object_recall": "r", "object_precision": "p"}), compat=True)
    return then.select("n_nationkey", F.round("r", 6).alias("object_recall"), F.col("p").alias("object_precision"), F.round("object_precision", 6).alias("compat_precision"))
