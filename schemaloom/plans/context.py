"""Catalogue listings and nested contexts.

Correlated subqueries become: aggregate the children once, left-join the array,
fill what is missing with an empty array.  Arrays are sorted, so results are
deterministic.  Ids of the wanted nodes restrict every join from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.store import GraphStore

_EXPRESSION = "array<struct<dialect:string,expression:string>>"
_ASPECT = "array<struct<aspect_type:string,data:string,vendor_name:string>>"


def _empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind)).alias(column)


def key_type(primary: str = "is_primary_key", foreign: str = "is_foreign_key") -> Column:
    """Primary wins over foreign; flags that are NULL count as unset."""
    return F.when(F.col(primary), "primary").when(F.col(foreign), "foreign")


def aspect_type(labels: Column | str) -> Column:
    return F.when(F.array_contains(labels, "AiContext"), "ai_context").when(F.array_contains(labels, "CustomExtensions"), "custom_extensions").otherwise("unknown")


def _of(edges: DataFrame, wanted: DataFrame | None, end: str = "src_id") -> DataFrame:
    """The edges whose end is among the wanted ids; all if none are named."""
    return edges if wanted is None else edges.join(wanted.select(F.col("id").alias(end)), end, "left_semi")


def paired(left: Column | str, right: Column | str, names: tuple[str, str]) -> Column:
    """The entries of two arrays side by side; an error when read if they differ in length."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    pairs = F.arrays_zip(a.alias(names[0]), b.alias(names[1]))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(F.lit("paired lists differ in length")))


def collected_if(condition: Column, value: Column) -> Column:
    """Aggregate: the sorted distinct values of the rows that meet the condition."""
    return F.sort_array(F.collect_set(F.when(condition, value)))


def collected(edges: DataFrame, items: DataFrame, value: Column, name: str, *, distinct: bool = False) -> DataFrame:
    """(id, name): for every source of the edges the sorted values of its targets."""
    gather = F.collect_set if distinct else F.collect_list
    return edges.join(items, F.col("dst_id") == F.col("id")).groupBy("src_id").agg(F.sort_array(gather(value)).alias(name)).withColumnRenamed("src_id", "id")


def expressions(store: GraphStore, label: str, wanted: DataFrame | None = None) -> DataFrame:
    return collected(_of(store.edges(f"{label}-HAS_EXPRESSION-Expression"), wanted), store.nodes("Expression"), F.struct("dialect", "expression"), "expressions")


def aspects(store: GraphStore, label: str, wanted: DataFrame | None = None) -> DataFrame:
    return collected(_of(store.edges(f"{label}-HAS_ASPECT-Aspect"), wanted), store.nodes("Aspect"), F.struct(aspect_type("labels").alias("aspect_type"), "data", "vendor_name"), "aspects")


def examples(values: DataFrame, n: int = 5) -> DataFrame:
    """(id, examples): per column the n smallest distinct values; at most n of a column are gathered, and ranks are cut before the shuffle."""
    small = values.select("id", "value").withColumn("rn", F.dense_rank().over(Window.partitionBy("id").orderBy("value"))).filter(F.col("rn") <= n)
    return small.groupBy("id").agg(F.sort_array(F.collect_set("value")).alias("examples"))


def references(edges: DataFrame, columns: DataFrame, tables: DataFrame, has_column: DataFrame, *, directed: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(id, references): ``table.column`` names that a column refers to; without direction also those that refer to it, distinct."""
    both = _of(edges.select("src_id", "dst_id"), wanted)
    if not directed:
        both = both.unionByName(_of(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")), wanted))
    owner = has_column.select(F.col("src_id").alias("table_id"), F.col("dst_id").alias("column_id"))
    named = owner.join(columns.select(F.col("id").alias("column_id"), F.col("name").alias("c_")), "column_id").join(tables.select(F.col("id").alias("table_id"), F.col("name").alias("t_")), "table_id")
    text = F.concat("t_", F.lit("."), "c_")
    gather = F.collect_list if directed else F.collect_set
    return both.join(named, F.col("dst_id") == F.col("column_id")).groupBy("src_id").agg(F.sort_array(gather(text)).alias("references")).withColumnRenamed("src_id", "id")


def column_context(store: GraphStore, owned: DataFrame, *, directed: bool = False, some: bool = True) -> DataFrame:
    """(owner_id, columns) of ``owned`` (owner_id, id): the nested column records of each owner.

    ``some`` says that ``owned`` names a part of the columns, which then restricts every join before it aggregates.
    """
    wanted = owned.select("id").distinct() if some else None
    cols = store.nodes("Column") if wanted is None else store.nodes("Column").join(wanted, "id", "left_semi")
    values = _of(store.edges("Column-HAS_VALUE-Value"), wanted).join(store.nodes("Value").withColumnRenamed("id", "dst_id"), "dst_id").select(F.col("src_id").alias("id"), "value")
    refs = references(store.edges("Column-REFERENCES-Column"), store.nodes("Column"), store.nodes("Table"), store.edges("Table-HAS_COLUMN-Column"), directed=directed, wanted=wanted)
    full = cols.join(refs, "id", "left").join(examples(values), "id", "left")
    for part in (expressions(store, "Column", wanted), aspects(store, "Column", wanted)):
        full = full.join(part, "id", "left")
    record = F.struct(
        F.col("name").alias("column_name"), F.col("description").alias("column_description"), F.col("type").alias("data_type"), "nullable", _empty("examples", "array<string>"),
        key_type().alias("key_type"), "label", "is_time_dimension", _empty("references", "array<string>"), _empty("expressions", _EXPRESSION), _empty("aspects", _ASPECT),
    )
    return owned.join(full, "id").groupBy("owner_id").agg(F.sort_array(F.collect_list(record)).alias("columns"))


def placed_tables(store: GraphStore, wanted: DataFrame | None = None) -> DataFrame:
    """(table_id, …, schema_name, database_name): tables that have a schema and a database."""
    tables = store.nodes("Table") if wanted is None else store.nodes("Table").join(wanted.select("id").distinct(), "id", "left_semi")
    s, d = store.edges("Schema-HAS_TABLE-Table"), store.edges("Database-HAS_SCHEMA-Schema")
    up = s.select(F.col("src_id").alias("schema_id"), F.col("dst_id").alias("id")).join(d.select(F.col("src_id").alias("database_id"), F.col("dst_id").alias("schema_id")), "schema_id")
    names = up.join(store.nodes("Schema").select(F.col("id").alias("schema_id"), F.col("name").alias("schema_name")), "schema_id").join(store.nodes("Database").select(F.col("id").alias("database_id"), F.col("name").alias("database_name")), "database_id")
    return tables.join(names, "id").select(F.col("id").alias("table_id"), F.col("name").alias("table_name"), F.col("description").alias("table_description"), "database_name", "schema_name", _empty("primary_key", "array<string>"))


def table_context(store: GraphStore, scores: DataFrame | None, columns: DataFrame | None = None) -> DataFrame:
    """Full context of the tables in ``scores`` (id, …), or of all; ``columns`` (id) restricts to the columns found."""
    everything = scores is None
    scores = store.nodes("Table").select("id") if everything else scores
    owned = store.edges("Table-HAS_COLUMN-Column").select(F.col("src_id").alias("owner_id"), F.col("dst_id").alias("id"))
    if not everything:
        owned = owned.join(scores.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    if columns is not None:
        owned = owned.join(columns.select("id"), "id", "left_semi")
    cols = column_context(store, owned, some=not everything)
    about = aspects(store, "Table", None if everything else scores).withColumnRenamed("id", "table_id")
    whole = placed_tables(store, None if everything else scores).join(cols.withColumnRenamed("owner_id", "table_id"), "table_id").join(about, "table_id", "left").join(scores.withColumnRenamed("id", "table_id"), "table_id")
    return whole.withColumn("aspects", F.coalesce("aspects", F.array().cast(_ASPECT))).withColumn("num_columns", F.size("columns"))


def list_schemas(store: GraphStore) -> DataFrame:
    e = store.edges("Database-HAS_SCHEMA-Schema")
    s, d = store.nodes("Schema").select(F.col("id").alias("dst_id"), F.col("name").alias("schema_name")), store.nodes("Database").select(F.col("id").alias("src_id"), F.col("name").alias("database_name"))
    return e.join(s, "dst_id").join(d, "src_id").select("schema_name", "database_name")


def list_tables_by_schema(store: GraphStore, schema_name: str) -> DataFrame:
    """Grouped by schema name, so schemas of one name in two databases are one row; none without tables."""
    s = store.nodes("Schema").filter(F.col("name") == schema_name).select(F.col("id").alias("src_id"), F.col("name").alias("schema_name"))
    t = store.nodes("Table").select(F.col("id").alias("dst_id"), F.col("name").alias("table_name"))
    return s.join(store.edges("Schema-HAS_TABLE-Table"), "src_id").join(t, "dst_id").groupBy("schema_name").agg(F.sort_array(F.collect_list("table_name")).alias("table_names"))


def full_metadata(store: GraphStore) -> DataFrame:
    """Every table with all its columns, by name."""
    return table_context(store, None).orderBy("table_name", "table_id")


def _datasets(store: GraphStore) -> DataFrame:
    """(domain_id, id): tables and query-backed datasets of the domains."""
    parts = [store.edges(f"Domain-{e}") for e in ("HAS_TABLE-Table", "HAS_QUERY-Query")]
    return parts[0].unionByName(parts[1]).select(F.col("src_id").alias("domain_id"), F.col("dst_id").alias("id"))


def _dataset_columns(store: GraphStore) -> DataFrame:
    parts = [store.edges(f"{e}-Column") for e in ("Table-HAS_COLUMN", "Query-USES_COLUMN")]
    return parts[0].unionByName(parts[1]).select(F.col("src_id").alias("owner_id"), F.col("dst_id").alias("id"))


def _join_ends(store: GraphStore, kind: str) -> DataFrame:
    parts = [store.edges(f"Join-{kind}-{t}") for t in ("Table", "Query")]
    return parts[0].unionByName(parts[1]).select(F.col("src_id").alias("join_id"), F.col("dst_id").alias("end_id"))


def list_domains(store: GraphStore) -> DataFrame:
    """Each domain with its numbers of metrics, datasets, columns (paths) and distinct joins."""
    sets = _datasets(store)
    metrics = store.edges("Domain-HAS_METRIC-Metric").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("num_metrics"))
    tables = sets.groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("num_tables"))
    columns = sets.join(_dataset_columns(store).select(F.col("owner_id").alias("id"), F.col("id").alias("c")), "id").groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("num_columns"))
    joins = sets.join(_join_ends(store, "HAS_SOURCE_TABLE"), F.col("id") == F.col("end_id")).groupBy(F.col("domain_id").alias("d")).agg(F.count_distinct("join_id").alias("num_joins")).withColumnRenamed("d", "id")
    out = store.nodes("Domain").select("id", F.col("name").alias("domain_name"), F.col("description").alias("domain_description"))
    for part in (metrics, tables, columns, joins):
        out = out.join(part, "id", "left")
    return out.select("domain_name", "domain_description", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_metrics", "num_tables", "num_columns", "num_joins")]).orderBy("domain_name")


def list_metrics_by_domain(store: GraphStore, domain: str) -> DataFrame:
    d = store.nodes("Domain").filter(F.col("id") == ids.model_id(F.lit(domain))).select(F.col("id").alias("src_id"), F.col("name").alias("domain_name"))
    m = store.nodes("Metric").select(F.col("id").alias("dst_id"), F.col("name").alias("metric_name"), F.col("description").alias("metric_description"))
    return d.join(store.edges("Domain-HAS_METRIC-Metric"), "src_id").join(m, "dst_id").select("metric_name", "metric_description", "domain_name").orderBy("metric_name")


def metric_context(store: GraphStore, scores: DataFrame, *, domain: str | None = None) -> DataFrame:
    """Metrics in ``scores`` (id, …) with owner, expressions, synonyms and aspects."""
    owner = store.edges("Domain-HAS_METRIC-Metric").join(store.nodes("Domain").select(F.col("id").alias("src_id"), F.col("name").alias("domain_name")), "src_id")
    if domain is not None:
        owner = owner.filter(F.col("src_id") == ids.model_id(F.lit(domain)))
    owner = owner.select(F.col("dst_id").alias("id"), "domain_name")
    synonyms = collected(_of(store.edges("Metric-TAGGED_WITH-BusinessTerm"), scores), store.nodes("BusinessTerm"), F.col("name"), "synonyms")
    found = scores.join(store.nodes("Metric").select("id", F.col("name").alias("metric_name"), F.col("description").alias("metric_description")), "id").join(owner, "id")
    for part in (expressions(store, "Metric", scores), synonyms, aspects(store, "Metric", scores)):
        found = found.join(part, "id", "left")
    rest = [c for c in scores.columns if c != "id"]
    return found.select(F.col("id").alias("metric_id"), "metric_name", "metric_description", "domain_name", _empty("expressions", _EXPRESSION), _empty("synonyms", "array<string>"), _empty("aspects", _ASPECT), *rest)


def metric_expression(store: GraphStore, metric: str, *, domain: str | None = None, dialect: str | None = None) -> DataFrame:
    """Distinct expressions of the metrics of a name, filtered only by what is given."""
    m = store.nodes("Metric").filter(F.col("name") == metric).select("id", F.col("name").alias("metric_name"))
    owner = store.edges("Domain-HAS_METRIC-Metric").select(F.col("src_id").alias("d"), F.col("dst_id").alias("id")).join(store.nodes("Domain").select(F.col("id").alias("d"), F.col("name").alias("domain_name")), "d")
    if domain is not None:
        owner = owner.filter(F.col("d") == ids.model_id(F.lit(domain)))
    e = store.nodes("Expression").select(F.col("id").alias("dst_id"), "dialect", "expression")
    if dialect is not None:
        e = e.filter(F.col("dialect") == dialect)
    edges = store.edges("Metric-HAS_EXPRESSION-Expression").withColumnRenamed("src_id", "id")
    return m.join(owner, "id").join(edges, "id").join(e, "dst_id").select("metric_name", "domain_name", "dialect", "expression").distinct().orderBy("domain_name", "dialect", "expression")


def domain_context(store: GraphStore, domain: str) -> DataFrame:
    """One nested record of a domain; an unknown domain gives its name with empty collections."""
    spark = store.spark
    asked = spark.createDataFrame([(domain,)], "asked string").withColumn("id", ids.model_id("asked"))
    d = asked.join(store.nodes("Domain"), "id", "left").select("id", F.coalesce("name", "asked").alias("domain_name"), F.col("description").alias("domain_description"), "osi_version")
    sets = _datasets(store).join(asked.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    t = store.nodes("Table").select("id", "name", "description", "primary_key").unionByName(store.nodes("Query").select("id", "name", "description", F.lit(None).cast("array<string>").alias("primary_key")))
    owned = _dataset_columns(store).join(sets.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    counts = owned.groupBy("owner_id").agg(F.count("*").cast("int").alias("num_columns"))
    columns = column_context(store, owned, directed=True)
    places = placed_tables(store, sets).groupBy("table_id").agg(F.min(F.struct("schema_name", "database_name")).alias("p")).select(F.col("table_id").alias("id"), "p.database_name", "p.schema_name")
    column_kind = columns.schema["columns"].dataType.simpleString()
    about = aspects(store, "Table").unionByName(aspects(store, "Query"))
    full = sets.join(t, "id").join(places, "id", "left").join(columns.withColumnRenamed("owner_id", "id"), "id", "left").join(counts.withColumnRenamed("owner_id", "id"), "id", "left").join(about, "id", "left")
    table = F.struct(F.col("name").alias("table_name"), F.col("description").alias("table_description"), "database_name", "schema_name", _empty("primary_key", "array<string>"), F.coalesce("num_columns", F.lit(0)).alias("num_columns"), F.coalesce(F.col("columns"), F.array().cast(column_kind)).alias("columns"), _empty("aspects", _ASPECT))
    tables = full.groupBy(F.col("domain_id").alias("id")).agg(F.sort_array(F.collect_list(table)).alias("tables"))
    own = store.edges("Domain-HAS_METRIC-Metric").join(asked.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    m = metric_context(store, own.select(F.col("dst_id").alias("id")).distinct(), domain=domain)
    metrics = m.agg(F.sort_array(F.collect_list(F.struct(*[c for c in m.columns if c != "metric_id"]))).alias("metrics"))
    names = t.select(F.col("id").alias("end_id"), F.col("name").alias("end_name"))
    source = _join_ends(store, "HAS_SOURCE_TABLE").join(sets.select(F.col("id").alias("end_id"), "domain_id"), "end_id").join(names, "end_id").select("join_id", "domain_id", F.col("end_name").alias("from_table"))
    target = _join_ends(store, "HAS_TARGET_TABLE").join(names, "end_id").select("join_id", F.col("end_name").alias("to_table"))
    j = source.join(target, "join_id", "left").join(store.nodes("Join").select(F.col("id").alias("join_id"), F.col("name").alias("join_name"), "from_columns", "to_columns"), "join_id").join(aspects(store, "Join").withColumnRenamed("id", "join_id"), "join_id", "left")
    join = F.struct("join_name", "from_table", "to_table", _empty("from_columns", "array<string>"), _empty("to_columns", "array<string>"), _empty("aspects", _ASPECT))
    joins = j.groupBy(F.col("domain_id").alias("id")).agg(F.sort_array(F.collect_list(join)).alias("joins"))
    out = d.join(tables, "id", "left").join(joins, "id", "left").join(aspects(store, "Domain"), "id", "left")
    kinds = {"tables": tables, "joins": joins}
    filled = [F.coalesce(F.col(k), F.array().cast(v.schema[k].dataType)).alias(k) for k, v in kinds.items()]
    row = out.select("domain_name", "domain_description", "osi_version", *filled, _empty("aspects", _ASPECT), F.lit(1).alias("one"))
    return row.join(metrics.withColumn("one", F.lit(1)), "one", "left").drop("one")
