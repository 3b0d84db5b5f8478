"""The general training-data problems: nested records, orphans, hierarchies, repeated deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.functions.term_rule import term_key
from schemaloom.operators.delivery import accepted_messages, surplus_deliveries
from schemaloom.operators.hierarchy import department_descendants, department_tree
from schemaloom.operators.nested import nested_rows
from schemaloom.operators.orphans import orphan_counts, orphan_references


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested_rows(_read(spark, sf, "audit_log"), _read(spark, sf, "unity_pages"))


def p1_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`p1_found` that SQL can check: types nest without bound, lists do not."""
    return p1_found(spark, sf).filter("record_kind <> 'field'")


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References and parents of both kinds under one key; a tag keeps columns and terms apart.

    A term name whose glossary or category is NULL is a reference that no term can match.
    """
    full = lambda side: F.concat(F.lit("c:"), ids.column_id(*[f"{side}{x}_name" for x in ("database", "schema", "table", "column")]))
    term = F.concat(F.lit("t:"), F.to_json(F.array("glossary_name", "category_name", term_key("term_name"))))
    term = F.when(F.col("term_name").isNotNull() & F.col("glossary_name").isNotNull() & F.col("category_name").isNotNull(), term)
    columns, terms = _read(spark, sf, "column_info"), _read(spark, sf, "business_term_info")
    parents = columns.select(full("").alias("key"), F.col("created_at").alias("start"), F.col("dropped_at").alias("end")).unionByName(
        terms.select(term.alias("key"), F.col("created_at").alias("start"), F.col("retired_at").alias("end"))
    )
    row = lambda table, i, key, t: _read(spark, sf, table).select(F.lit(table).alias("ref_table"), F.col(i).alias("ref_id"), key.alias("key"), F.col(t).alias("ref_time"))
    refs = (
        row("column_references_info", "reference_id", full("target_"), "extracted_at")
        .unionByName(row("query_column_info", "usage_id", F.concat(F.lit("c:"), ids.normalize("column_id")), "logged_at"))
        .unionByName(row("column_term_info", "link_id", F.when(F.col("term_name").isNotNull(), F.coalesce(term, F.lit("t:"))), "tagged_at"))
    )
    return refs, parents


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(*_references(spark, sf))


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_counts(*_references(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return department_tree(_read(spark, sf, "departments"))


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return department_descendants(_read(spark, sf, "departments"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_deliveries(_read(spark, sf, "audit_log"))


def p6_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return accepted_messages(_read(spark, sf, "audit_log"))


def _opened(text: str) -> str:
    """JSON of a text, or of the text that it encodes."""
    inner = f"json_extract_string({text}::JSON, '$')"
    return f"(CASE WHEN NOT coalesce(json_valid({text}), false) THEN NULL WHEN json_type({text}::JSON) <> 'VARCHAR' THEN {text}::JSON WHEN json_valid({inner}) THEN {inner}::JSON END)"


def _listed(source: str, keep: str, json: str) -> str:
    """(keep, pos, e): the entries of the list, object or text ``json`` of every row of ``source``."""
    text = "json_extract_string(j, '$')"
    return f"""(SELECT {keep}, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT {keep}, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) = 'OBJECT' THEN [j] END AS l
FROM (SELECT {keep}, CASE WHEN json_type(j) = 'VARCHAR' THEN {_opened(text)} ELSE j END AS j FROM (SELECT {keep}, {json} AS j FROM {source}))))"""


_PAGES = _listed(f"(SELECT page_id, {_opened('payload')} AS p FROM unity_pages)", "page_id", "json_extract(p, '$.tables')")
_PAGE_COLUMNS = _listed(f"(SELECT page_id, pos AS parent, e AS p FROM {_PAGES})", "page_id, parent", "json_extract(p, '$.columns')")
_GRANTS = _listed(f"(SELECT delivery_id, {_opened('proto_payload')} AS p FROM audit_log)", "delivery_id", "json_extract(p, '$.authorizationInfo')")
_P1_LISTS = f"""SELECT 'permission' AS record_kind, delivery_id AS record_id, -1 AS parent_pos, pos AS child_pos, json_extract_string(e, '$.permission') AS child_path FROM {_GRANTS} WHERE json_extract_string(e, '$.permission') <> ''
UNION ALL SELECT 'column', page_id, parent, pos, json_extract_string(e, '$.name') FROM {_PAGE_COLUMNS} WHERE json_extract_string(e, '$.name') <> ''"""
_NORM = "replace(replace(lower({0}), ' ', '_'), '-', '_')"
_full = lambda side: " || '.' || ".join(_NORM.format(f"{side}{x}_name") for x in ("database", "schema", "table", "column"))
_TERM = "to_json([glossary_name, category_name, array_to_string(list_sort(regexp_extract_all(lower(term_name), '[\\p{L}\\p{N}]+')), ' ')])"
_REFS = f"""
refs AS (
  SELECT 'column_references_info' AS ref_table, reference_id AS ref_id, 'c:' || {_full("target_")} AS key, extracted_at AS t FROM column_references_info
  UNION ALL SELECT 'query_column_info', usage_id, 'c:' || {_NORM.format("column_id")}, logged_at FROM query_column_info
  UNION ALL SELECT 'column_term_info', link_id, CASE WHEN glossary_name IS NOT NULL AND category_name IS NOT NULL AND term_name IS NOT NULL THEN 't:' || {_TERM} WHEN term_name IS NOT NULL THEN 't:' END, tagged_at FROM column_term_info),
parents AS (
  SELECT 'c:' || {_full("")} AS key, created_at AS s, dropped_at AS e FROM column_info
  UNION ALL SELECT CASE WHEN term_name IS NOT NULL AND glossary_name IS NOT NULL AND category_name IS NOT NULL THEN 't:' || {_TERM} END, created_at, retired_at FROM business_term_info),
judged AS (
  SELECT ref_table, ref_id, any_value(strftime(t, '%Y-%m')) AS ref_month,
         coalesce(bool_or(coalesce(p.s <= t, p.key IS NOT NULL) AND (p.e IS NULL AND p.key IS NOT NULL OR p.e > t)), false) AS alive,
         CASE WHEN count(p.key) = 0 THEN 'missing' WHEN bool_or(coalesce(p.e <= t, false)) THEN 'deleted' ELSE 'late' END AS orphan_kind
  FROM refs LEFT JOIN parents p USING (key) WHERE refs.key IS NOT NULL GROUP BY ref_table, ref_id)
"""
_P3 = f"WITH {_REFS} SELECT ref_table, ref_id, ref_month, orphan_kind FROM judged WHERE NOT alive"
_P3_COUNTS = f"""WITH {_REFS} SELECT ref_table, ref_month, count(*) AS n_refs,
  count(*) FILTER (NOT alive AND orphan_kind = 'missing') AS n_missing, count(*) FILTER (NOT alive AND orphan_kind = 'deleted') AS n_deleted,
  count(*) FILTER (NOT alive AND orphan_kind = 'late') AS n_late FROM judged GROUP BY ref_table, ref_month"""
_P4 = """
WITH RECURSIVE last AS (
  SELECT upper(trim(department_id)) AS id, nullif(upper(trim(parent_department_id)), '') AS p,
         row_number() OVER (PARTITION BY upper(trim(department_id)) ORDER BY created_at DESC NULLS LAST, nullif(upper(trim(parent_department_id)), '') DESC NULLS LAST) AS rn
  FROM departments WHERE trim(department_id) <> ''),
link AS (SELECT a.id, b.id AS parent FROM (SELECT * FROM last WHERE rn = 1) a LEFT JOIN (SELECT id FROM last WHERE rn = 1) b ON a.p = b.id),
climb AS (
  SELECT id, id AS node, 0 AS d FROM link
  UNION SELECT c.id, l.parent, CASE WHEN c.d > 300 THEN c.d ELSE c.d + 1 END FROM climb c JOIN link l ON c.node = l.id WHERE l.parent IS NOT NULL),
met AS (SELECT DISTINCT id, node FROM climb),
endless AS (SELECT id, min(node) AS root FROM climb WHERE d > 250 GROUP BY id),
counts AS (SELECT node AS id, count(*) - 1 AS n FROM met GROUP BY node),
tops AS (SELECT c.id, max(c.d) AS depth, arg_max(c.node, c.d) AS root, string_agg(c.node, '/' ORDER BY c.d DESC) AS path FROM climb c ANTI JOIN endless e ON c.id = e.id GROUP BY c.id)
SELECT link.id AS department_id, coalesce(e.root, t.root) AS root_department_id, CASE WHEN e.id IS NULL THEN t.depth ELSE -1 END::INT AS node_depth,
       CASE WHEN e.id IS NULL THEN t.path ELSE '' END AS full_path, counts.n AS n_descendants
FROM link JOIN counts USING (id) LEFT JOIN endless e ON e.id = link.id LEFT JOIN tops t ON t.id = link.id
"""
_P4_DESCENDANTS = _P4[: _P4.index("endless AS")].rstrip().rstrip(",").replace("met AS (SELECT DISTINCT id, node FROM climb)", "met AS (SELECT id, node, min(d) AS d FROM climb GROUP BY id, node)") + " SELECT node AS department_id, id AS descendant_id, d::INT AS distance FROM met WHERE id <> node"
_KEPT = "SELECT log_name, insert_id, min(delivery_id) AS kept_id, count(*) AS copies FROM audit_log WHERE insert_id IS NOT NULL AND log_name IS NOT NULL GROUP BY ALL"
_P6 = f"SELECT kept_id, delivery_id AS dropped_id FROM audit_log JOIN ({_KEPT}) USING (log_name, insert_id) WHERE delivery_id > kept_id"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_lists, p3_found, p3_counts, p4_found, p4_descendants, p6_found, p6_accepted)}


def oracle_sql() -> dict[str, str]:
    return {"p1_lists": _P1_LISTS, "p3_found": _P3, "p3_counts": _P3_COUNTS, "p4_found": _P4, "p4_descendants": _P4_DESCENDANTS, "p6_found": _P6, "p6_accepted": _KEPT}
