"""The metadata graph's operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import evalkit, ids
from schemaloom.functions import text as tx
from schemaloom.materialize import shared_dir
from schemaloom.operators import upsert
from schemaloom.plans import context as cx
from schemaloom.plans import search as se
from schemaloom.queries.tpch_graph import catalog_graph, domain_graph, read
from schemaloom.sources import governance as gov
from schemaloom.sources import infoschema as info
from schemaloom.sources import querylog as ql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_N = "replace(replace(lower({0}), ' ', '_'), '-', '_')".format

# ---------------------------------------------------------------- identifiers


@_query(f"SELECT c_custkey, {_N('c_name')} AS name_id, 'tpc_h.main.' || {_N('c_mktsegment')} || '.' || {_N('c_name')} AS column_id FROM customer")
def id_normalize(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", ids.normalize("c_name").alias("name_id"), ids.column_id(F.lit("TPC-H"), F.lit("Main"), "c_mktsegment", "c_name").alias("column_id"))


@_query(f"SELECT p_partkey, 'd.s.part.' || {_N('p_brand')} || '.' || md5(p_name) AS value_id, 'src.' || {_N('p_type')} || '.' || md5(p_brand) AS tag_value_id, 'o1.' || md5(p_type || '::' || p_name) AS expression_id FROM part")
def id_value_md5(spark, sf):
    lit = F.lit
    return read(spark, sf, "part").select("p_partkey", ids.value_id(lit("d"), lit("s"), lit("part"), "p_brand", "p_name").alias("value_id"), ids.tag_value_id(lit("Src"), "p_type", "p_brand").alias("tag_value_id"), ids.expression_id(lit("o1"), "p_type", "p_name").alias("expression_id"))


@_query("SELECT doc_id, sha256(text) AS query_id FROM documents")
def id_query_sha256(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ids.query_id("text").alias("query_id"))


@_query(f"SELECT {_N('column_id')} AS node_id, count(DISTINCT column_id) AS raw_names FROM query_column_info WHERE column_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT column_id) > 1")
def id_collisions(spark, sf):
    rows = read(spark, sf, "query_column_info").filter("column_id is not null").select(ids.normalize("column_id").alias("node_id"), "column_id")
    return upsert.id_collisions(rows, "node_id", "column_id")


# ---------------------------------------------------------------- warehouse scans


def _sampled(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM {table} WHERE {c} IS NOT NULL ORDER BY 2 LIMIT 10)" for c in columns)


@_query(_sampled("part", ["p_name", "p_brand", "p_type"]) + " UNION ALL " + _sampled("orders", ["o_orderstatus", "o_orderpriority"]))
def sample_values_topn(spark, sf):
    return info.sample_values(read(spark, sf, "part"), ["p_name", "p_brand", "p_type"]).unionByName(info.sample_values(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@_query("SELECT n_nationkey, n_name, CASE WHEN r_regionkey < 2 THEN r_name END AS description FROM nation LEFT JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -1, 'default', NULL")
def infoschema_left_join_default(spark, sf):
    options = read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.when(F.col("r_regionkey") < 2, "description").otherwise("other").alias("option_name"), F.col("r_name").alias("option_value"))
    nation = read(spark, sf, "nation")
    out = info.left_described(nation, options, ["n_regionkey"]).select("n_nationkey", "n_name", "description")
    none = info.with_default_row(out.filter("n_nationkey > 1000"), {"n_nationkey": "-1", "n_name": "default"})
    return out.unionByName(none)


@_query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_foreign_key FROM orders")
def key_flags_semi(spark, sf):
    keys = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return info.member_flag(read(spark, sf, "orders").select("o_orderkey"), keys, ["o_orderkey"], "is_foreign_key")


@_query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS is_primary_key, bool_or(l_returnflag = 'A') AS is_foreign_key FROM lineitem GROUP BY l_orderkey")
def key_flags_aggregated(spark, sf):
    rows = read(spark, sf, "lineitem")
    usage = rows.select("l_orderkey", F.when(F.col("l_returnflag") == "R", "x.pk$").when(F.col("l_returnflag") == "A", "x.fk_y").otherwise("x.uq").alias("constraint_name"))
    return info.constraint_flags(rows.select("l_orderkey").distinct(), usage, ["l_orderkey"])


@_query("""SELECT 'part' AS target, count(*) AS n_dangling FROM lineitem ANTI JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey
UNION ALL SELECT 'supplier', count(*) FROM lineitem ANTI JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey
UNION ALL SELECT 'orders', count(*) FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""")
def fk_references_dangling(spark, sf):
    lines = read(spark, sf, "lineitem")
    parts = []
    for name, key, target, cond in (("part", "l_partkey", "p_partkey", "p_size < 25"), ("supplier", "l_suppkey", "s_suppkey", "s_acctbal > 0"), ("orders", "l_orderkey", "o_orderkey", "o_orderstatus = 'F'")):
        edges = lines.select(F.lit("x").alias("src_id"), F.col(key).alias("dst_id"))
        one = spark.createDataFrame([("x",)], "id string")
        lost = upsert.dangling(edges, one, read(spark, sf, name).filter(cond).select(F.col(target).alias("id")))
        parts.append(lost.agg(F.lit(name).alias("target"), F.count("*").alias("n_dangling")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- upserts

_OLD, _NEW = "o_orderdate < TIMESTAMP '1999-01-01'", "o_orderdate >= TIMESTAMP '1997-01-01'"


def _snapshots(spark, sf):
    o = read(spark, sf, "orders")
    stored = o.filter(_OLD).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    batch = o.filter(_NEW).select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("price"))
    return stored, batch


def _merge_sql(price: str) -> str:
    return f"""SELECT coalesce(s.o_orderkey, b.o_orderkey) AS o_orderkey, s.o_orderstatus, {price} AS price
FROM (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS p FROM orders WHERE {_OLD}) s FULL JOIN (SELECT o_orderkey, round(o_totalprice * 2, 2) AS p FROM orders WHERE {_NEW}) b ON s.o_orderkey = b.o_orderkey"""


@_query(_merge_sql("CASE WHEN s.o_orderkey IS NOT NULL THEN s.p ELSE b.p END"))
def merge_on_create(spark, sf):
    return upsert.merge(*_snapshots(spark, sf), ["o_orderkey"])


@_query(_merge_sql("CASE WHEN b.o_orderkey IS NOT NULL THEN b.p ELSE s.p END"))
def merge_overwrite(spark, sf):
    return upsert.merge(*_snapshots(spark, sf), ["o_orderkey"], overwrite=True)


@_query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def merge_first_wins(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return upsert.merge(rows.filter("l_orderkey < 0"), rows, ["l_orderkey"], order=["l_linenumber", "l_partkey"])


@_query("SELECT c_custkey AS src_id, c_nationkey AS dst_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def edge_merge_endpoints(spark, sf):
    c = read(spark, sf, "customer")
    nations = read(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return upsert.existing_endpoints(c.select(F.col("c_custkey").alias("src_id"), F.col("c_nationkey").alias("dst_id")), c.select(F.col("c_custkey").alias("id")), nations)


# ---------------------------------------------------------------- tags and glossaries


def _policies(spark, sf, prefix: str = ""):
    e = read(spark, sf, "events")
    key = F.when(F.col("event_type") == "error", F.concat(F.lit(prefix), F.col("event_type"))).otherwise(F.col("event_type"))
    value = F.when(F.col("event_type") != "view", F.array(F.struct(F.get_json_object("props", "$.k").alias("name"))))
    return e.select(key.alias("tag_key"), F.lit("").alias("description"), value.alias("values"))


@_query("SELECT event_type AS tag_key, CAST(NULL AS VARCHAR) AS tag_description, CASE WHEN event_type <> 'view' THEN props ->> '$.k' END AS value_name, count(*) AS n FROM events GROUP BY ALL")
def tag_policy_flatten(spark, sf):
    return gov.tag_rows(_policies(spark, sf)).groupBy("tag_key", "tag_description", "value_name").agg(F.count("*").alias("n"))


@_query("SELECT event_type AS tag_key, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def tag_prefix_exclude(spark, sf):
    return gov.tag_rows(_policies(spark, sf, "system.")).groupBy("tag_key").agg(F.count("*").alias("n"))


@_query("SELECT term_row_id, 'projects/p/glossaries/' || glossary_name AS glossary_path, category_name AS category_slug, CAST(NULL AS VARCHAR) AS wrong_kind FROM business_term_info")
def glossary_path_slug(spark, sf):
    path = F.concat(F.lit("projects/p/glossaries/"), "glossary_name", F.lit("/categories/"), "category_name")
    return read(spark, sf, "business_term_info").select("term_row_id", gov.glossary_path(path).alias("glossary_path"), gov.slug(path, "categories").alias("category_slug"), gov.slug(path, "terms").alias("wrong_kind"))


# ---------------------------------------------------------------- job logs


def _jobs(spark, sf):
    e = read(spark, sf, "events")
    refs = F.array(F.struct(F.lit("main").alias("dataset_id"), F.col("event_type").alias("table_id")), F.struct(F.lit("main").alias("dataset_id"), F.concat(F.lit("u"), F.col("user_id")).alias("table_id")), F.struct(F.lit("other").alias("dataset_id"), F.lit("x").alias("table_id")))
    return e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), refs.alias("referenced_tables"), F.col("ts").alias("creation_time"))


_NOW = dt.datetime(2024, 1, 31)
_JOBS = """SELECT event_id AS job_id, event_type, unnest([event_type, 'u' || user_id]) AS table_id, ts FROM events"""


@_query(f"SELECT job_id, table_id FROM (SELECT * FROM ({_JOBS}) WHERE ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, job_id, table_id LIMIT 100) WHERE event_type <> 'error'")
def joblog_window_topn_then_drop_failed(spark, sf):
    return ql.recent_jobs(_jobs(spark, sf), dataset="main", now=_NOW).select("job_id", "t.table_id")


@_query(f"SELECT table_id, count(*) AS n FROM ({_JOBS}) GROUP BY table_id")
def joblog_unnest(spark, sf):
    return ql.referenced_tables(_jobs(spark, sf), "main").groupBy("t.table_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- catalogue and context


@_query("SELECT n_name AS schema_name, r_name AS database_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def list_parents(spark, sf):
    return cx.list_schemas(catalog_graph(spark, sf))


@_query("SELECT n_name AS schema_name, string_agg(s_name, ',' ORDER BY s_name) AS table_names FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 7 GROUP BY n_name")
def list_children_by_name(spark, sf):
    name = read(spark, sf, "nation").filter("n_nationkey = 7").first().n_name
    return cx.list_tables_by_schema(catalog_graph(spark, sf), name).select("schema_name", F.array_join("table_names", ",").alias("table_names"))


_COLS = """
owner AS (SELECT l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey),
ends AS (SELECT DISTINCT a, b FROM (SELECT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY l_orderkey) WHERE a <> b),
named AS (SELECT p, s_name || '.' || p_name AS t FROM owner JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey),
refs AS (SELECT x AS p, string_agg(DISTINCT t, ',' ORDER BY t) AS refs FROM (SELECT a AS x, b AS y FROM ends UNION ALL SELECT b, a FROM ends) JOIN named ON y = named.p GROUP BY x),
vals AS (SELECT l_partkey AS p, string_agg(v, ',' ORDER BY v) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY v) AS k FROM (SELECT DISTINCT l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS v FROM lineitem)) WHERE k <= 5 GROUP BY l_partkey),
cols AS (SELECT owner.s, owner.p, p_name || '|' || p_brand || '|' || CASE WHEN p_size < 10 THEN 'primary' WHEN p_size < 25 THEN 'foreign' ELSE '' END || '|' || coalesce(refs, '') || '|' || coalesce(examples, '') AS c
         FROM owner JOIN part ON p = p_partkey LEFT JOIN refs USING (p) LEFT JOIN vals USING (p)),
tabs AS (SELECT s_suppkey AS s, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _flat(df: DataFrame, *scores: str) -> DataFrame:
    one = lambda c: F.concat_ws("|", c["column_name"], c["data_type"], F.coalesce(c["key_type"], F.lit("")), F.array_join(c["references"], ","), F.array_join(c["examples"], ","))
    return df.select("table_name", "schema_name", "database_name", F.col("num_columns").cast("bigint").alias("num_columns"), F.array_join(F.array_sort(F.transform("columns", one)), ";").alias("columns"), *[F.round(s, 6).alias(s) for s in scores])


_FLAT = "s_name AS table_name, n_name AS schema_name, r_name AS database_name, count(*) AS num_columns, string_agg(c, ';' ORDER BY c) AS columns"


@_query(f"WITH {_COLS} SELECT {_FLAT} FROM cols JOIN tabs USING (s) GROUP BY s, s_name, n_name, r_name")
def full_context(spark, sf):
    return _flat(cx.full_metadata(catalog_graph(spark, sf)))


def _reference_list(spark, sf, directed):
    g = catalog_graph(spark, sf)
    r = cx.references(g.edges("Column-REFERENCES-Column"), g.nodes("Column"), g.nodes("Table"), g.edges("Table-HAS_COLUMN-Column"), directed=directed)
    return r.select("id", F.array_join("references", ",").alias("refs"))


@_query(f"WITH {_COLS} SELECT 'c' || p AS id, refs FROM refs")
def refs_undirected(spark, sf):
    return _reference_list(spark, sf, False)


@_query(f"WITH {_COLS} SELECT 'c' || a AS id, string_agg(t, ',' ORDER BY t) AS refs FROM ends JOIN named ON b = named.p GROUP BY a")
def refs_directed(spark, sf):
    return _reference_list(spark, sf, True)


@_query("""SELECT r_name AS domain_name, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS num_metrics,
(SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS num_tables, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS num_columns,
(SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS num_joins FROM region""")
def domain_counts(spark, sf):
    return cx.list_domains(domain_graph(spark, sf)).drop("domain_description")


@_query("SELECT c_name AS metric_name, c_mktsegment AS metric_description, r_name AS domain_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def domain_metrics(spark, sf):
    return cx.list_metrics_by_domain(domain_graph(spark, sf), "Asia")


@_query("""WITH n AS (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
t AS (SELECT n_name || '(' || coalesce(string_agg(s_name, ',' ORDER BY s_name), '') || ')' AS t FROM n LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name),
m AS (SELECT c_name || ':' || c_mktsegment || ':SUM(' || c_mktsegment || ')' AS m FROM customer JOIN n ON c_nationkey = n_nationkey),
j AS (SELECT s_name || ':' || n.n_name || '>' || b.n_name AS j FROM supplier JOIN n ON s_nationkey = n.n_nationkey JOIN nation a ON a.n_nationkey = n.n_nationkey JOIN nation b ON b.n_nationkey = a.n_regionkey)
SELECT 'ASIA' AS domain_name, (SELECT string_agg(t, ';' ORDER BY t) FROM t) AS tables, (SELECT string_agg(m, ';' ORDER BY m) FROM m) AS metrics, (SELECT string_agg(j, ';' ORDER BY j) FROM j) AS joins""")
def domain_context(spark, sf):
    d = cx.domain_context(domain_graph(spark, sf), "Asia")
    joined = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), ";").alias(c)
    table = lambda t: F.concat(t["table_name"], F.lit("("), F.array_join(F.transform(t["columns"], lambda c: c["column_name"]), ","), F.lit(")"))
    metric = lambda m: F.concat_ws(":", m["metric_name"], F.array_join(m["synonyms"], ","), F.array_join(F.transform(m["expressions"], lambda e: e["expression"]), ","))
    join = lambda j: F.concat(j["join_name"], F.lit(":"), j["from_table"], F.lit(">"), j["to_table"])
    return d.select("domain_name", joined("tables", table), joined("metrics", metric), joined("joins", join))


@_query("SELECT DISTINCT c_name AS metric_name, r_name AS domain_name, 'ANSI_SQL' AS dialect, 'SUM(' || c_mktsegment || ')' AS expression FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 42")
def metric_expression_filter(spark, sf):
    name = read(spark, sf, "customer").filter("c_custkey = 42").first().c_name
    return cx.metric_expression(domain_graph(spark, sf), name, dialect="ANSI_SQL")


@_query("SELECT l_orderkey, unnest(list(l_partkey ORDER BY l_linenumber)) AS from_column, unnest(list(l_suppkey ORDER BY l_linenumber)) AS to_column FROM lineitem GROUP BY l_orderkey")
def zip_join_columns(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    pairs = cx.paired("x.l_partkey", "x.l_suppkey", ("from_column", "to_column"))
    return rows.select("l_orderkey", F.explode(pairs).alias("p")).select("l_orderkey", "p.from_column", "p.to_column")


@_query("SELECT o_orderstatus, string_agg(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderpriority END, ',' ORDER BY CASE WHEN o_totalprice > 100000 THEN o_orderpriority END) AS priorities FROM orders GROUP BY o_orderstatus")
def collect_case_distinct(spark, sf):
    some = cx.collected_if(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.nullif(F.array_join(some, ","), F.lit("")).alias("priorities"))


# ---------------------------------------------------------------- search


def _probe(spark, sf, i: int = 0) -> list[float]:
    return [float(x) for x in read(spark, sf, "embeddings").orderBy("vec_id").limit(i + 1).collect()[i].embedding]


_Q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_VEC = f"SELECT vec_id, (1 + list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[])) / 2 AS score FROM embeddings"
_WORD = "large copper"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _bm25_sql(table: str, key: str, fields: list[str], query: str) -> str:
    """BM25 of a query in SQL, the sum over fields and words."""
    terms = tx.query_words(query)
    toks = ", ".join(f"{_words(f)} AS t{i}" for i, f in enumerate(fields))
    stats = ", ".join([*(f"count(t{i}) AS n{i}, avg(len(t{i})) AS m{i}" for i in range(len(fields))), *(f"count(*) FILTER (list_contains(t{i}, '{w}')) AS d{i}_{k}" for i in range(len(fields)) for k, w in enumerate(terms))])
    part = []
    for i in range(len(fields)):
        for k, w in enumerate(terms):
            tf = f"len(list_filter(t{i}, lambda x: x = '{w}'))"
            part.append(f"coalesce(CASE WHEN {tf} > 0 THEN ln(1 + (n{i} - d{i}_{k} + 0.5) / (d{i}_{k} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(t{i}) / m{i})) END, 0)")
    return f"SELECT {key} AS id, {' + '.join(part)} AS score FROM (SELECT {key}, {toks} FROM {table}), (SELECT {stats} FROM (SELECT {toks} FROM {table})) WHERE {' + '.join(part)} > 0"


@_query(f"SELECT vec_id AS id, round(score, 6) AS score FROM (SELECT * FROM ({_VEC}) ORDER BY score DESC, vec_id LIMIT 10) WHERE score > 0.5")
def vec_topk(spark, sf):
    hits = se.vector_hits(read(spark, sf, "embeddings"), _probe(spark, sf), 10, node="vec_id")
    return hits.select("id", F.round("score", 6).alias("score"))


_COLUMN_VEC = f"(SELECT p_partkey AS p, score FROM ({_VEC}) JOIN part ON vec_id = p_partkey ORDER BY score DESC, 'c' || p_partkey LIMIT 10)"


def _rolled(hits: str, limit: int = 5) -> str:
    return f"""WITH {_COLS}, h AS (SELECT * FROM {hits}), r AS (SELECT owner.s, avg(score) AS score FROM h JOIN owner USING (p) GROUP BY owner.s)
SELECT {_FLAT}, round(max(r.score), 6) AS column_avg_score FROM r JOIN cols USING (s) JOIN h ON h.p = cols.p JOIN tabs USING (s) GROUP BY s, s_name, n_name, r_name ORDER BY max(r.score) DESC, 't' || s LIMIT {limit}"""


@_query(_rolled(f"(SELECT * FROM {_COLUMN_VEC} WHERE score > 0.5)"))
def vec_column_rollup_avg(spark, sf):
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables_by_columns("vector", se.Request(vector=_probe(spark, sf))), "column_avg_score")


@_query(f"""WITH {_COLS}, h AS (SELECT * FROM (SELECT s_suppkey AS s, score FROM ({_VEC}) JOIN supplier ON vec_id = s_suppkey ORDER BY score DESC, 't' || s_suppkey LIMIT 10) WHERE score > 0.5)
SELECT {_FLAT}, round(max(h.score), 6) AS table_score FROM h JOIN cols USING (s) JOIN tabs USING (s) GROUP BY s, s_name, n_name, r_name""")
def vec_table(spark, sf):
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables("vector", se.Request(vector=_probe(spark, sf))), "table_score")


@_query(f"""WITH {_COLS}, v AS ({_VEC}), h AS (SELECT * FROM (SELECT n_nationkey AS n, score FROM v JOIN nation ON vec_id = n_nationkey ORDER BY score DESC, 's' || n_nationkey LIMIT 5) WHERE score > 0.5),
t AS (SELECT s_suppkey AS s, v.score, h.score AS up FROM h JOIN supplier ON s_nationkey = n JOIN v ON vec_id = s_suppkey WHERE v.score > h.score - 0.2)
SELECT {_FLAT}, round(max(t.up), 6) AS schema_score, round(max(t.score), 6) AS table_score FROM t JOIN cols USING (s) JOIN tabs USING (s) GROUP BY s, s_name, n_name, r_name ORDER BY max(t.up) DESC, max(t.score) DESC, 't' || s LIMIT 5""")
def vec_parent_relative(spark, sf):
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables_by_schemas(se.Request(vector=_probe(spark, sf))), "schema_score", "table_score")


@_query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql('documents', 'doc_id', ['text'], 'nightly voyage queue')}) ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, sf):
    return se.text_hits(read(spark, sf, "documents"), "nightly (voyage) queue!", 10, node="doc_id", fields=("text",)).select("id", F.round("score", 6).alias("score"))


@_query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql('part', 'p_partkey', ['p_name', 'p_type'], _WORD)}) ORDER BY score DESC, id LIMIT 10")
def bm25_two_field(spark, sf):
    return se.text_hits(read(spark, sf, "part"), _WORD, 10, node="p_partkey", fields=("p_name", "p_type")).select("id", F.round("score", 6).alias("score"))


@_query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql('part', 'p_partkey', ['p_name', 'p_type'], _WORD)})")
def bm25_postings(spark, sf):
    part = read(spark, sf, "part")
    fields = ["p_name", "p_type"]
    return tx.bm25_from_postings(tx.postings(part, "p_partkey", fields), tx.field_stats(part, fields), _WORD).select(F.col("node").alias("id"), F.round("score", 6).alias("score"))


def _part_words(spark, sf) -> str:
    """Words of the first part's name and type, so that the query finds something."""
    p = read(spark, sf, "part").filter("p_partkey = 1").first()
    return f"{p.p_name} {p.p_type}"


_PART_TEXT = "(SELECT p_partkey, p_name, p_type FROM part)"
_ASK = "(SELECT list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) FROM part WHERE p_partkey = 1)"


def _bm25_asked(table: str, key: str, fields: list[str], ask: str = _ASK) -> str:
    """The same for a query that is itself a table's row: postings joined with the asked words."""
    post = " UNION ALL ".join(f"SELECT {key} AS id, {i} AS f, unnest({_words(f)}) AS w, len({_words(f)}) AS l FROM {table}" for i, f in enumerate(fields))
    stat = " UNION ALL ".join(f"SELECT {i} AS f, count({f}) AS n, avg(len({_words(f)})) AS m FROM {table}" for i, f in enumerate(fields))
    return f"""(WITH post AS ({post}), tf AS (SELECT id, f, w, any_value(l) AS l, count(*) AS tf FROM post WHERE list_contains({ask}, w) GROUP BY id, f, w), df AS (SELECT f, w, count(*) AS df FROM tf GROUP BY f, w), st AS ({stat})
SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM tf JOIN df USING (f, w) JOIN st USING (f) GROUP BY id)"""


_COLUMN_TEXT = f"(SELECT id AS p, score FROM {_bm25_asked(_PART_TEXT, 'p_partkey', ['p_name', 'p_type'])} ORDER BY round(score, 9) DESC, 'c' || id LIMIT 10)"


@_query(_rolled(_COLUMN_TEXT))
def bm25_rollup_avg(spark, sf):
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables_by_columns("text", se.Request(text=_part_words(spark, sf))), "column_avg_score")


_VEC_HITS = f"(SELECT * FROM {_COLUMN_VEC} WHERE score > 0.5)"
_HYBRID = f"(SELECT p, max(score) AS score FROM (SELECT p, score / max(score) OVER () AS score FROM {_VEC_HITS} UNION ALL SELECT p, score / max(score) OVER () FROM {_COLUMN_TEXT}) GROUP BY p)"


@_query(f"SELECT 'c' || p AS id, round(score, 6) AS score FROM {_HYBRID}")
def hybrid_node(spark, sf):
    s = se.GraphSearch(catalog_graph(spark, sf))
    return s.hits("Column", "hybrid", se.Request(text=_part_words(spark, sf), vector=_probe(spark, sf)), 10).select("id", F.round("score", 6).alias("score"))


@_query(_rolled(_HYBRID))
def hybrid_rollup(spark, sf):
    r = se.Request(text=_part_words(spark, sf), vector=_probe(spark, sf))
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables_by_columns("hybrid", r), "column_avg_score")


_TERM_HITS = f"(SELECT id AS b, score AS t FROM {_bm25_asked('(SELECT DISTINCT p_type, NULL::VARCHAR AS d FROM part)', 'p_type', ['p_type'])} ORDER BY round(score, 9) DESC, 'b' || id LIMIT 10)"
_BRIDGE = f"(SELECT p, max(score) AS score FROM (SELECT p, (score / max(score) OVER () + t / max(t) OVER ()) / 2 AS score FROM {_COLUMN_TEXT} JOIN part ON p = p_partkey JOIN {_TERM_HITS} ON b = p_type) GROUP BY p)"
_BRIDGED = f"(SELECT p, max(score) AS score FROM (SELECT p, score / max(score) OVER () AS score FROM {_VEC_HITS} UNION ALL SELECT p, score FROM {_BRIDGE}) GROUP BY p)"


@_query(f"SELECT 'c' || p AS id, round(score, 6) AS score FROM {_BRIDGED}")
def hybrid_term_bridge_node(spark, sf):
    s = se.GraphSearch(catalog_graph(spark, sf))
    return s.hits("Column", "terms", se.Request(text=_part_words(spark, sf), vector=_probe(spark, sf)), 10).select("id", F.round("score", 6).alias("score"))


@_query(_rolled(_BRIDGED))
def hybrid_term_bridge_rollup(spark, sf):
    r = se.Request(text=_part_words(spark, sf), vector=_probe(spark, sf))
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables_by_columns("terms", r), "column_avg_score")


def _supplier_words(spark, sf) -> str:
    """Words of the first supplier's name and the first part's type."""
    return f"{read(spark, sf, 'supplier').filter('s_suppkey = 1').first().s_name} {read(spark, sf, 'part').filter('p_partkey = 1').first().p_type}"


_ASK_TABLE = "(SELECT list_distinct(regexp_extract_all(lower(s_name || ' ' || p_type), '[a-z0-9]+')) FROM supplier, part WHERE s_suppkey = 1 AND p_partkey = 1)"
_TABLE_TEXT = f"(SELECT id AS s, score FROM {_bm25_asked('(SELECT s_suppkey, s_name FROM supplier)', 's_suppkey', ['s_name'], _ASK_TABLE)} ORDER BY round(score, 9) DESC, 't' || id LIMIT 10)"
_TABLE_VEC = f"(SELECT * FROM (SELECT s_suppkey AS s, score FROM ({_VEC}) JOIN supplier ON vec_id = s_suppkey ORDER BY score DESC, 't' || s_suppkey LIMIT 10) WHERE score > 0.5)"
_TABLE_HYBRID = f"(SELECT s, max(score) AS score FROM (SELECT s, score / max(score) OVER () AS score FROM {_TABLE_VEC} UNION ALL SELECT s, score / max(score) OVER () FROM {_TABLE_TEXT}) GROUP BY s)"
_TABLE_TERMS = f"(SELECT id AS b, score AS t FROM {_bm25_asked('(SELECT DISTINCT p_type FROM part)', 'p_type', ['p_type'], _ASK_TABLE)} ORDER BY round(score, 9) DESC, 'b' || id LIMIT 10)"
_TABLE_BRIDGE = f"(SELECT s, max(score) AS score FROM (SELECT s, (score / max(score) OVER () + t / max(t) OVER ()) / 2 AS score FROM {_TABLE_TEXT} JOIN part ON s = p_partkey JOIN {_TABLE_TERMS} ON b = p_type) GROUP BY s)"
_TABLE_BRIDGED = f"(SELECT s, max(score) AS score FROM (SELECT s, score / max(score) OVER () AS score FROM {_TABLE_VEC} UNION ALL SELECT s, score FROM {_TABLE_BRIDGE}) GROUP BY s)"


def _tables_found(hits: str, cut: int) -> str:
    """Tables found by themselves: the hits are cut before expansion, which drops tables without columns."""
    return f"""WITH {_COLS}, h AS (SELECT * FROM {hits} ORDER BY score DESC, 't' || s LIMIT {cut})
SELECT {_FLAT}, round(max(h.score), 6) AS table_score FROM h JOIN cols USING (s) JOIN tabs USING (s) GROUP BY s, s_name, n_name, r_name"""


def _table_search(spark, sf, way: str) -> DataFrame:
    r = se.Request(text=_supplier_words(spark, sf), vector=_probe(spark, sf))
    return _flat(se.GraphSearch(catalog_graph(spark, sf)).tables(way, r), "table_score")


@_query(_tables_found(_TABLE_TEXT, 10))
def text_table(spark, sf):
    return _table_search(spark, sf, "text")


@_query(_tables_found(_TABLE_HYBRID, 5))
def hybrid_table(spark, sf):
    return _table_search(spark, sf, "hybrid")


@_query(_tables_found(_TABLE_BRIDGED, 5))
def hybrid_term_bridge_table(spark, sf):
    return _table_search(spark, sf, "terms")


@_query(_rolled(_COLUMN_TEXT))
def text_index_rollup(spark, sf):
    """The text search of a stored snapshot, which reads the postings of its words only."""
    g = catalog_graph(spark, sf, path=f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    g.save()
    return _flat(se.GraphSearch(g).tables_by_columns("text", se.Request(text=_part_words(spark, sf))), "column_avg_score")


_METRIC = f"(SELECT c_custkey AS m, score FROM ({_VEC}) JOIN customer ON vec_id = c_custkey ORDER BY score DESC, 'm' || c_custkey LIMIT 40)"
_OWNED = "JOIN customer ON m = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_METRIC_OUT = f"SELECT c_name AS metric_name, r_name AS domain_name, c_mktsegment AS synonyms, 'SUM(' || c_mktsegment || ')' AS expressions, round(score, 6) AS metric_score FROM {{0}} {_OWNED} WHERE r_name = 'ASIA' ORDER BY score DESC, 'm' || m LIMIT 10"


def _metric_rows(df: DataFrame) -> DataFrame:
    return df.select("metric_name", "domain_name", F.array_join("synonyms", ",").alias("synonyms"), F.array_join(F.transform("expressions", lambda e: e["expression"]), ",").alias("expressions"), F.round("metric_score", 6).alias("metric_score"))


@_query(_METRIC_OUT.format(f"(SELECT * FROM {_METRIC} WHERE score > 0.5)"))
def metric_vec_domain_filter(spark, sf):
    return _metric_rows(se.GraphSearch(domain_graph(spark, sf)).metrics("vector", se.Request(vector=_probe(spark, sf), k=40, domain="Asia")))


_SEGMENT = "BUILDING"
_METRIC_TEXT = f"(SELECT id AS m, score FROM ({_bm25_sql('customer', 'c_custkey', ['c_name', 'c_mktsegment'], _SEGMENT)}) ORDER BY round(score, 9) DESC, 'm' || id LIMIT 40)"


@_query(_METRIC_OUT.format(_METRIC_TEXT))
def metric_text(spark, sf):
    return _metric_rows(se.GraphSearch(domain_graph(spark, sf)).metrics("text", se.Request(text=_SEGMENT, k=40, domain="Asia")))


@_query(_METRIC_OUT.format(f"(SELECT m, max(score) AS score FROM (SELECT m, score / max(score) OVER () AS score FROM (SELECT * FROM {_METRIC} WHERE score > 0.5) UNION ALL SELECT m, score / max(score) OVER () FROM {_METRIC_TEXT}) GROUP BY m)"))
def metric_hybrid_domain_filter(spark, sf):
    return _metric_rows(se.GraphSearch(domain_graph(spark, sf)).metrics("hybrid", se.Request(text=_SEGMENT, vector=_probe(spark, sf), k=40, domain="Asia")))


@_query(_METRIC_OUT.format(f"(SELECT m, max(score) AS score FROM (SELECT m, score / max(score) OVER () AS score FROM (SELECT * FROM {_METRIC} WHERE score > 0.5) UNION ALL SELECT m, (score / max(score) OVER () + 1) / 2 FROM {_METRIC_TEXT} JOIN customer ON m = c_custkey WHERE c_mktsegment = '{_SEGMENT}') GROUP BY m)"))
def metric_hybrid_terms(spark, sf):
    return _metric_rows(se.GraphSearch(domain_graph(spark, sf)).metrics("terms", se.Request(text=_SEGMENT, vector=_probe(spark, sf), k=40, domain="Asia")))


@_query("SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '[+\\-&|!(){}\\[\\]^\"~*?:\\\\]', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS clean FROM documents")
def lucene_sanitize(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.sanitize("text").alias("clean"))


# ---------------------------------------------------------------- evaluation

_ASKED = "regexp_extract_all(lower(subject_id), '[a-z0-9]+')"


@_query(f"""SELECT doc_id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(a)), 1), 6) AS recall, round(len(list_intersect(a, b)) / greatest(len(list_distinct(b)), 1), 6) AS "precision", len(list_distinct(a)) - len(list_intersect(a, b)) AS n_missing
FROM (SELECT doc_id, {_ASKED} AS a, {_words('text')} AS b FROM documents WHERE text IS NOT NULL AND subject_id IS NOT NULL)""")
def set_precision_recall(spark, sf):
    d = read(spark, sf, "documents").filter("text is not null and subject_id is not null").select("doc_id", tx.tokens("subject_id").alias("required"), tx.tokens("text").alias("retrieved"))
    return evalkit.retrieval_scores(d).select("doc_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.size("missing").cast("bigint").alias("n_missing"))


@_query(f"""SELECT doc_id, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS utilization
FROM (SELECT doc_id, {_ASKED} AS a, list_distinct({_words('text')}) AS b FROM documents WHERE text IS NOT NULL AND subject_id IS NOT NULL)""")
def context_utilization(spark, sf):
    d = read(spark, sf, "documents").filter("text is not null and subject_id is not null")
    return d.select("doc_id", F.round(evalkit.utilization(tx.tokens("subject_id"), F.array_distinct(tx.tokens("text"))), 6).alias("utilization"))


@_query(f"""SELECT doc_id, round(len(list_filter(a, lambda x: contains(lower(text), x))) / greatest(len(a), 1), 6) AS faithfulness
FROM (SELECT doc_id, text, {_ASKED} AS a FROM documents WHERE text IS NOT NULL AND subject_id IS NOT NULL)""")
def faithfulness_contains(spark, sf):
    d = read(spark, sf, "documents").filter("text is not null and subject_id is not null").select("doc_id", "text", tx.tokens("subject_id").alias("used"))
    return evalkit.faithfulness(d, context="text").select("doc_id", F.round("faithfulness", 6).alias("faithfulness"))


def _two_results(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    one = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    two = c.filter("c_mktsegment <> 'BUILDING'").join(o, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return one, two


@_query("""WITH x AS (SELECT c_mktsegment AS m, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT (SELECT count(*) FROM x WHERE m = 'BUILDING') = 0 AS execution_match, (SELECT count(*) FROM x) AS generated_rows, (SELECT count(*) FROM x WHERE m <> 'BUILDING') AS gold_rows, (SELECT count(*) FROM x WHERE m <> 'BUILDING') AS shared_rows""")
def exec_match_multiset(spark, sf):
    return evalkit.execution_match(*_two_results(spark, sf))


@_query("""WITH x AS (SELECT c_mktsegment AS m, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY m, s) AS k FROM x), b AS (SELECT *, row_number() OVER (ORDER BY m, s) AS k FROM x WHERE m <> 'BUILDING')
SELECT count(*) AS gold_rows, count(*) FILTER (a.m = b.m AND a.s = b.s AND a.n = b.n) AS matching_rows, count(*) FILTER (a.m = b.m AND a.s = b.s AND a.n = b.n) / count(*) AS row_match_pct FROM b LEFT JOIN a USING (k)""")
def exec_match_positional(spark, sf):
    order = ["c_mktsegment", "o_orderstatus"]
    return evalkit.positional_match(*_two_results(spark, sf), order, order)


@_query("""SELECT *, token_reduction >= 0.5 AS token_gate, object_recall >= 0.9 AS recall_gate, abs(accuracy_delta) <= 0.05 AS accuracy_gate, token_reduction >= 0.5 AND object_recall >= 0.9 AND abs(accuracy_delta) <= 0.05 AS all_gates FROM (
SELECT event_type, count(*) AS n, round(avg((value > 20)::INT), 6) AS semantic_match, round(avg((value > 18)::INT), 6) AS full_match, round(avg((value > 20)::INT) - avg((value > 18)::INT), 6) AS accuracy_delta,
round(avg(1 - value / greatest(user_id, 1)), 6) AS token_reduction, round(CASE WHEN count(*) > 1 THEN stddev_samp(1 - value / greatest(user_id, 1)) ELSE 0 END, 6) AS token_reduction_stdev,
round(avg(least(value / 10, 1)), 6) AS object_recall, round(CASE WHEN count(*) > 1 THEN stddev_samp(least(value / 10, 1)) ELSE 0 END, 6) AS object_recall_stdev FROM events GROUP BY event_type)""")
def report_gates(spark, sf):
    e = read(spark, sf, "events").select("event_type", (F.col("value") > 20).cast("double").alias("semantic_match"), (F.col("value") > 18).cast("double").alias("full_match"), evalkit.token_reduction(F.col("value"), F.col("user_id")).alias("token_reduction"), F.least(F.col("value") / 10, F.lit(1.0)).alias("object_recall"))
    r = evalkit.report(e, "event_type")
    return r.withColumns({c: F.round(c, 6) for c, t in r.dtypes if t == "double"})


@_query(f"SELECT source, round(1 - sum(len({_words('text')})) / greatest((SELECT sum(len({_words('text')})) FROM documents), 1), 6) AS token_reduction FROM documents GROUP BY source")
def token_reduction(spark, sf):
    d = read(spark, sf, "documents").select("source", F.size(tx.tokens("text")).alias("n"))
    n = d.agg(F.sum(F.when(F.col("n") >= 0, F.col("n")))).first()[0]
    return d.groupBy("source").agg(F.round(evalkit.token_reduction(F.sum(F.when(F.col("n") >= 0, F.col("n"))), F.lit(n)), 6).alias("token_reduction"))


# ---------------------------------------------------------------- gold questions


def _gold(name: str, sql: str, **kinds: str) -> None:
    """A gold question in SQL that both engines read; Spark plans it over views of the files."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return evalkit.answer(spark, sql, {t: read(spark, sf, t) for t in ("customer", "orders", "lineitem", "part", "nation") if t in sql})

    run.__name__ = name
    _QUERIES[name] = run
    _SQL[name] = sql.format(**{t: t for t in ("customer", "orders", "lineitem", "part", "nation")})


_gold("gold_count", "SELECT count(*) AS n FROM {customer}")
_gold("gold_filter", "SELECT p_partkey, p_name FROM {part} WHERE p_size > 40 AND p_retailprice < 1500")
_gold("gold_join2", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
_gold("gold_join4_distinct", "SELECT DISTINCT n_name, p_brand FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {part} ON l_partkey = p_partkey")
_gold("gold_agg_join", "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
_gold("gold_avg", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean FROM {orders} GROUP BY o_orderstatus")
_gold("gold_left_join_count", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
_gold("gold_date_range", "SELECT count(*) AS n FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
_gold("gold_top3", "SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 3")
_gold("gold_top1_category", "SELECT p_type, sum(l_quantity) AS quantity FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type ORDER BY sum(l_quantity) DESC, p_type LIMIT 1")


# ---------------------------------------------------------------- lineage and semantic models

_TEXTS = [
    "SELECT a.order_id, b.name FROM shop.sales.orders AS a JOIN shop.sales.customers AS b ON a.customer_id = b.id WHERE a.total > 10",
    "WITH big AS (SELECT customer_id FROM `shop.sales.orders` o WHERE o.total > 100) SELECT c.name FROM shop.sales.customers c JOIN big ON c.id = big.customer_id",
    "SELECT x.id FROM shop.sales.items x WHERE x.id IN (SELECT y.item_id FROM shop.sales.lines y WHERE y.qty::int > 2)",
    "SELEC nothing FROM",
]


def _lineage(spark, which: str) -> DataFrame:
    import warnings

    from schemaloom.lineage import lineage_frames

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return lineage_frames(spark.createDataFrame([(t,) for t in _TEXTS], "query string"))[which]


@_query("SELECT * FROM (VALUES ('shop.sales.orders', 'orders', 2), ('shop.sales.customers', 'customers', 2), ('shop.sales.items', 'items', 1), ('shop.sales.lines', 'lines', 1)) t(table_id, table_name, n_queries)")
def lineage_tables(spark, sf):
    return _lineage(spark, "table_info").groupBy("table_id", "table_name").agg(F.count_distinct("query_id").alias("n_queries"))


@_query("SELECT 'shop.sales.' || c AS column_id FROM (VALUES ('orders.order_id'), ('customers.name'), ('orders.customer_id'), ('customers.id'), ('orders.total'), ('items.id'), ('lines.item_id'), ('lines.qty')) t(c)")
def lineage_columns(spark, sf):
    return _lineage(spark, "column_info").select("column_id").distinct()


@_query("SELECT 'shop.sales.customers.id' AS left_column_id, 'shop.sales.orders.customer_id' AS right_column_id")
def lineage_joins(spark, sf):
    return _lineage(spark, "references_info").select("left_column_id", "right_column_id")


@_query("SELECT 'big' AS cte_name, 'SELECT customer_id FROM `shop.sales.orders` o WHERE o.total > 100' AS definition")
def lineage_ctes(spark, sf):
    return _lineage(spark, "cte_info").select("cte_name", "definition")


def _document_queries(spark, sf: str) -> DataFrame:
    """All texts of documents that are or hold queries."""
    from schemaloom.lineage import may_select

    holds = may_select(spark, F.col("text")) & F.col("text").rlike(r"(?i)\bselect\b")
    return read(spark, sf, "documents").filter((F.col("source") == "query_history") | holds).select(F.col("text").alias("query"))


def _document_lineage(spark, sf: str, which: str) -> DataFrame:
    """Lineage of these texts; two-part names belong to one database."""
    import warnings

    from schemaloom.lineage import lineage_frames

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return lineage_frames(_document_queries(spark, sf), default_database="warehouse", default_schema="main", kinds=[which])[which]


def _document_counts(spark, sf: str, which: str, *least: str) -> DataFrame:
    import warnings

    from schemaloom.lineage import query_counts

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return query_counts(_document_queries(spark, sf), which, least=least, default_database="warehouse", default_schema="main")


@_query()
def lineage_document_tables(spark, sf):
    return _document_counts(spark, sf, "table_info", "table_name")


@_query()
def lineage_document_columns(spark, sf):
    return _document_lineage(spark, sf, "column_info").select("column_id").distinct()


@_query()
def lineage_document_joins(spark, sf):
    return _document_counts(spark, sf, "references_info")


@_query()
def lineage_document_ctes(spark, sf):
    return _document_lineage(spark, sf, "cte_info").select("query_id", "cte_name", "definition").distinct()


_MODEL = {
    "version": "0.1.1",
    "semantic_model": [
        {
            "name": "Retail Sales",
            "description": "Orders and who placed them",
            "ai_context": {"synonyms": ["shop"], "instructions": "none"},
            "datasets": [
                {"name": "orders", "source": "shop.sales.orders", "primary_key": ["id"], "unique_keys": [["number", "year"]], "ai_context": {"synonyms": ["purchases", "sales"]}, "fields": [{"name": "id"}, {"name": "customer_id", "description": "who", "expression": {"dialects": [{"dialect": "ANSI_SQL", "expression": "customer_id"}]}}, {"name": "placed_at", "dimension": {"is_time": True}, "label": "Placed"}]},
                {"name": "recent", "source": "SELECT * FROM shop.sales.orders WHERE placed_at > now()", "fields": [{"name": "id", "ai_context": "the same id"}]},
                {"name": "customers", "source": "shop.sales.customers", "fields": [{"name": "id"}], "custom_extensions": [{"vendor_name": "acme", "data": '{"tier": 1}'}]},
            ],
            "relationships": [{"name": "placed by", "from": "orders", "to": "customers", "from_columns": ["customer_id"], "to_columns": ["id"]}],
            "metrics": [{"name": "revenue", "expression": {"dialects": [{"dialect": "ANSI_SQL", "expression": "SUM(total)"}, {"dialect": "SPARK", "expression": "sum(total)"}]}, "ai_context": {"synonyms": ["turnover"]}}],
        }
    ],
}


@_query("""SELECT * FROM (VALUES ('dataset', 'customers', 1), ('dataset', 'orders', 3), ('dataset', 'recent', 1), ('relationship', 'placed by', 1), ('metric', 'revenue', 2), ('fix point', 'Retail Sales', 1)) t(kind, name, n)""")
def osi_roundtrip(spark, sf):
    from schemaloom.sources import osi
    from schemaloom.store import GraphStore

    docs = [_MODEL]
    for _ in range(2):
        g = GraphStore(spark)
        g.ingest(osi.model_batch(spark, docs[-1]))
        docs.append(osi.export(g, "Retail Sales"))
    m = docs[1]["semantic_model"][0]
    rows = [("dataset", d["name"], len(d["fields"])) for d in m["datasets"]] + [("relationship", r["name"], len(r["from_columns"])) for r in m["relationships"]]
    rows += [("metric", x["name"], len(x["expression"]["dialects"])) for x in m["metrics"]] + [("fix point", m["name"], int(docs[1] == docs[2]))]
    return spark.createDataFrame(rows, "kind string, name string, n bigint")


@_query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM documents WHERE text IS NOT NULL AND text <> ''")
def embedding_candidates(spark, sf):
    from schemaloom.enrichment import candidates

    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("description"), F.lit(None).cast("array<float>").alias("embedding"))
    return candidates(d).select("doc_id", F.size(tx.tokens("description")).cast("bigint").alias("n_words"))


@_query("""SELECT catalog_name || '.' || tbl AS table_id FROM (SELECT DISTINCT lower(replace(replace(json_extract_string(t, '$.catalog_name'), ' ', '_'), '-', '_')) AS catalog_name,
lower(replace(replace(json_extract_string(t, '$.schema_name') || '.' || json_extract_string(t, '$.name'), ' ', '_'), '-', '_')) AS tbl FROM (
SELECT unnest(CASE WHEN json_type(ts) = 'ARRAY' THEN json_extract(ts, '$[*]') WHEN json_type(ts) = 'OBJECT' THEN [ts] END) AS t FROM (
SELECT CASE WHEN json_type(ts) = 'VARCHAR' AND json_valid(json_extract_string(ts, '$')) THEN json_extract_string(ts, '$')::JSON ELSE ts END AS ts FROM (
SELECT json_extract(p, '$.tables') AS ts FROM (SELECT CASE WHEN json_type(payload::JSON) = 'VARCHAR' AND json_valid(json_extract_string(payload::JSON, '$')) THEN json_extract_string(payload::JSON, '$')::JSON ELSE payload::JSON END AS p
FROM unity_pages WHERE json_valid(payload))) WHERE ts IS NOT NULL) WHERE ts IS NOT NULL)) WHERE catalog_name || '.' || tbl IS NOT NULL""")
def unity_tables(spark, sf):
    from schemaloom.sources.catalog_json import unity_pages

    return unity_pages(read(spark, sf, "unity_pages")).nodes["Table"].select(F.col("id").alias("table_id"))
