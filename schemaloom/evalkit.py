"""Scores of generated SQL and of retrieved context, over frames of many samples."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError
from schemaloom.lineage import can_be_analysed, parse
from schemaloom.materialize import materialize

# The gates of the report.
TOKEN_REDUCTION, RECALL_FLOOR, ACCURACY_DELTA = 0.50, 0.90, 0.05
# The kinds of questions a bank may hold.
ARCHETYPES = ("simple_lookup", "implicit_join", "business_term", "ambiguous_column", "cross_domain", "negative_space")


def question_bank(questions: DataFrame) -> DataFrame:
    """``questions`` (question, sql, archetype, ...) with their question_id; a row of an unknown kind is an error when read."""
    known = F.col("archetype").isin(*ARCHETYPES)
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("archetype")).otherwise(F.raise_error(F.concat(F.lit("unknown archetype: "), F.coalesce("archetype", F.lit("NULL")))).cast("string"))
    return questions.withColumns({"question_id": ids.question_id("question", "sql"), "archetype": checked})


def answer(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A gold query over the given frames; it names them in braces, and nothing is registered."""
    if unknown := set(re.findall(r"\{(\w+)\}", sql)) - set(tables):
        raise ConfigError(f"the query names tables that are not given: {sorted(unknown)}")
    return spark.sql(sql, **{t: df for t, df in tables.items() if "{" + t + "}" in sql})


def required_objects(spark: SparkSession, sql: str) -> dict:
    """Table, column, join and alias names of a query; CTE names count as tables here."""
    try:
        p = parse(spark, sql)
    except Exception as e:
        return {"tables": set(), "columns": set(), "joins": set(), "aliases": {}, "parse_error": type(e).__name__}
    return {"tables": {".".join(parts[-2:]) for parts, _ in p.tables}, "columns": {c for _, c in p.columns if c != "*"}, "joins": set(p.joins), "aliases": {a: ".".join(parts[-2:]) for parts, a in p.tables if a}}


def _one_line(sql: str) -> str:
    quoted = re.split(r"('(?:[^']|'')*')", sql.strip().rstrip(";"))
    return "".join(q if i % 2 else re.sub(r"\s*([(),=<>+*/-])\s*", r"\1", re.sub(r"\s+", " ", q)).lower() for i, q in enumerate(quoted)).strip()


def structural_equivalence(spark: SparkSession, generated: str, gold: str) -> dict:
    a, b = required_objects(spark, generated), required_objects(spark, gold)
    if error := a.get("parse_error") or b.get("parse_error"):
        return {"parse_error": error, "exact_match": False, "table_match": False, "column_match": False, "structural_match": False}
    same_t, same_c = a["tables"] == b["tables"], a["columns"] == b["columns"]
    diff = lambda k, x, y: sorted(x[k] - y[k])
    return {"exact_match": _one_line(generated) == _one_line(gold), "table_match": same_t, "column_match": same_c, "structural_match": same_t and same_c, "missing_tables": diff("tables", b, a), "extra_tables": diff("tables", a, b), "missing_columns": diff("columns", b, a), "extra_columns": diff("columns", a, b)}


def ratio(part: Column, whole: Column) -> Column:
    """size(part) / max(size(whole), 1)."""
    return F.size(part) / F.greatest(F.size(whole), F.lit(1))


def _lower(c: Column | str) -> Column:
    return F.array_distinct(F.transform(c, F.lower))


def retrieval_scores(samples: DataFrame, *, required: str = "required", retrieved: str = "retrieved", prefix: str = "") -> DataFrame:
    """Adds recall, precision, missing and extra of two name arrays, letter case apart.

    One canonical name per object; pass both short and qualified names to score the old way.
    """
    need, got = _lower(required), _lower(retrieved)
    both = F.array_intersect(need, got)
    return samples.withColumns({f"{prefix}recall": ratio(both, need), f"{prefix}precision": ratio(both, got), f"{prefix}missing": F.array_sort(F.array_except(need, got)), f"{prefix}extra": F.array_sort(F.array_except(got, need))})


def object_scores(samples: DataFrame, *, compat: bool = False) -> DataFrame:
    """Adds object_recall and object_precision over tables and columns together.

    ``samples`` has the name arrays required_tables, required_columns, retrieved_columns and retrieved (array of
    ``schema.table`` names).  A table counts by its short name if that is what is required; with ``compat`` each retrieved
    table counts under both its names, as it once did, so that a perfect hit has a table precision of one half.
    """
    need, need_columns, columns = _lower("required_tables"), _lower("required_columns"), _lower("retrieved_columns")
    short = _lower(F.transform("retrieved", lambda x: F.element_at(F.split(x, r"\."), -1)))
    both = F.array_distinct(F.concat(_lower("retrieved"), short))
    # the name a required object is known by, once per retrieved table
    one = F.array_distinct(F.transform(_lower("retrieved"), lambda x: F.when(F.array_contains(need, x), x).otherwise(F.element_at(F.split(x, r"\."), -1))))
    tables = both if compat else one
    hits = F.size(F.array_intersect(need, tables)) + F.size(F.array_intersect(need_columns, columns))
    most = lambda a, b: F.greatest(F.size(a) + F.size(b), F.lit(1))
    return samples.withColumns({"object_recall": hits / most(need, need_columns), "object_precision": hits / most(tables, columns)})


def faithfulness(samples: DataFrame, *, used: str = "used", context: str = "context") -> DataFrame:
    """Adds the share of used names that occur in the context text, and the ones that do not."""
    grounded = F.filter(F.col(used), lambda x: F.contains(F.lower(F.col(context)), F.lower(x)))
    return samples.withColumns({"faithfulness": ratio(grounded, F.col(used)), "hallucinated": F.array_sort(F.array_except(F.col(used), grounded))})


def utilization(used: Column, context: Column) -> Column:
    """The share of context objects that are used; 0 without context."""
    return F.when(F.size(context) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(used, context)) / F.size(context))


def execution_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two results are equal as multisets, their sizes and the shared rows.

    Rows are counted per value with map-side aggregation, so no result is sorted or collected.
    With other column names the values are compared by position.
    """
    if set(a.columns) == set(b.columns):
        b = b.select(*a.columns)
    if len(a.columns) != len(b.columns):
        return a.sparkSession.range(1).select(F.lit(False).alias("execution_match"), F.lit(0).cast("bigint").alias("shared_rows"))
    key = lambda d: F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(d.columns)]), {"ignoreNullFields": "false"})
    sides = a.select(key(a).alias("k"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(key(b).alias("k"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = sides.groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(True)).alias("execution_match"), total("x").alias("generated_rows"), total("y").alias("gold_rows"), total(F.least("x", "y")).alias("shared_rows"))


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with the place ``n`` of each row in the order: places within a partition plus the rows of those before it."""
    inner = F.monotonically_increasing_id()
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(inner, 33).alias("p_"), inner.bitwiseAND(F.lit((1 << 33) - 1)).alias("i_")), "ranged")
    before, total = {}, 0
    for r in ranged.groupBy("p_").count().orderBy("p_").collect():  # a row per partition
        before[r["p_"]], total = total, total + r["count"]
    starts = df.sparkSession.createDataFrame(list(before.items()), "p_ bigint, before_ bigint")
    return ranged.join(F.broadcast(starts), "p_").withColumn("n", F.col("before_") + F.col("i_")).drop("p_", "i_", "before_")


def positional_match(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """One row: the share of gold rows (``b``) equal to the row in the same place of ``a``.

    Places are by the given order, in which both results are sorted over many tasks.
    """
    row = lambda d: F.array(*[F.col(f"`{c}`").cast("string") for c in d.columns])
    x, y = (_placed(d, o).select("n", row(d).alias(name)) for d, o, name in ((a, order_a, "r"), (b, order_b, "g")))
    hit = F.col("r").eqNullSafe(F.col("g"))
    return y.join(x, "n", "left").agg(F.count("*").alias("gold_rows"), F.count_if(hit).alias("matching_rows"), F.when(F.count("*") == 0, F.lit(1.0)).otherwise(F.count_if(hit) / F.count("*")).alias("row_match_pct"))


def is_valid(spark: SparkSession, sql: str) -> bool:
    """Whether a query can be analysed; nothing runs."""
    return can_be_analysed(spark, sql)


def token_counts(samples: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """Adds the token counts of samples (chunks array<string>, full_schema, examples array<string>).

    ``count`` gives the tokens of a text as a column: any tokenizer, for instance a pandas UDF.  Chunks and examples
    are exploded, so that it is asked once per text.
    """
    keyed = materialize(samples.withColumn("sample_", F.monotonically_increasing_id()), "samples")
    counted = lambda c, name: keyed.select("sample_", F.explode(c).alias("t_")).filter("t_ is not null").select("sample_", count(F.col("t_")).alias("n_")).groupBy("sample_").agg(F.sum("n_").alias(name))
    out = keyed.withColumn("full_schema_tokens", F.coalesce(count(F.coalesce("full_schema", F.lit(""))), F.lit(0)))
    for c, name in (("chunks", "mcp_schema_tokens"), ("examples", "few_shot_tokens")):
        out = out.join(counted(c, name), "sample_", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    part, few, full = F.col("mcp_schema_tokens"), F.col("few_shot_tokens"), F.col("full_schema_tokens")
    return out.withColumns({"mcp_total_context_tokens": part + few, "full_schema_total_tokens": full + few, "token_reduction_absolute": full - part, "token_reduction_pct": token_reduction(part, full)}).drop("sample_")


def token_reduction(context: Column, full: Column) -> Column:
    return F.lit(1.0) - context / F.greatest(full, F.lit(1))


def deviation(c: Column | str) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0)


def report(samples: DataFrame, *by: str) -> DataFrame:
    """Means, deviations and gates of samples (semantic_match, full_match, token_reduction, object_recall, …) per group."""
    delta = F.avg("semantic_match") - F.avg("full_match")
    out = samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("semantic_match").alias("semantic_match"), F.avg("full_match").alias("full_match"), delta.alias("accuracy_delta"),
        F.avg("token_reduction").alias("token_reduction"), deviation("token_reduction").alias("token_reduction_stdev"), F.avg("object_recall").alias("object_recall"), deviation("object_recall").alias("object_recall_stdev"),
    )
    gates = {"token_gate": F.coalesce("token_reduction", F.lit(0.0)) >= TOKEN_REDUCTION, "recall_gate": F.coalesce("object_recall", F.lit(0.0)) >= RECALL_FLOOR, "accuracy_gate": F.abs(F.coalesce("accuracy_delta", F.lit(1.0))) <= ACCURACY_DELTA}
    return out.withColumns(gates).withColumn("all_gates", F.col("token_gate") & F.col("recall_gate") & F.col("accuracy_gate"))


def table_text(tables: DataFrame) -> DataFrame:
    """(table_id, text): table contexts as text, up to three examples per column.

    With a column ``joins`` (array<struct<table_name,column_names array<string>>>) these follow the columns.
    """
    # The words and marks of the text.
    def line(c: Column) -> Column:
        none = F.lit("")
        few = F.slice(c["examples"], 1, 3)
        return F.concat(
            F.lit("  - "), c["column_name"], F.lit(" ("), F.coalesce(c["data_type"], F.lit("None")), F.lit(")"),
            F.when(F.coalesce(c["column_description"], none) != "", F.concat(F.lit(": "), c["column_description"])).otherwise(none),
            F.when(c["key_type"].isNotNull(), F.concat(F.lit(" ["), c["key_type"], F.lit(" key]"))).otherwise(none),
            F.when(~F.coalesce(c["nullable"], F.lit(False)), F.lit(" [NOT NULL]")).otherwise(none),
            F.when(F.size(few) > 0, F.concat(F.lit(" (examples: "), F.array_join(few, ", "), F.lit(")"))).otherwise(none),
            F.array_join(F.transform(c["references"], lambda r: F.concat(F.lit("\n    -> references "), r)), ""),
        )

    head = F.concat(F.lit("Table: "), "schema_name", F.lit("."), "table_name", F.lit("\nDescription: "), F.coalesce("table_description", F.lit("None")), F.lit("\nColumns:\n"))
    body = F.concat(head, F.array_join(F.transform("columns", line), "\n"))
    if "joins" in tables.columns:
        lines = F.array_join(F.transform("joins", lambda j: F.concat(F.lit("\n  - "), j["table_name"], F.lit(" on "), F.array_join(j["column_names"], ", "))), "")
        body = F.concat(body, F.when(F.size("joins") > 0, F.concat(F.lit("\nJoins:"), lines)).otherwise(""))
    return tables.select("table_id", body.alias("text"))
