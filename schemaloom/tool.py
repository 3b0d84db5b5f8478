"""Command line: a command per retrieval with its results as JSON, and commands that fill a store or export from it.

    python -m schemaloom.tool STORE COMMAND [--text T] [--vector x,y,…] [--limit N] [--k N] [--name N] [--domain D] [--dialect D]
    python -m schemaloom.tool STORE ingest_KIND --source PATH [--database D] [--schema S] [--overwrite]
    python -m schemaloom.tool STORE export_model --name MODEL --output PATH

Warehouses are read from a folder with one Parquet table for each frame of their information schema.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import connectors
from schemaloom.errors import ConfigError
from schemaloom.functions.text import sanitize_text
from schemaloom.plans import context
from schemaloom.plans.search import GraphSearch, Request
from schemaloom.store import GraphStore

_WAYS = {f"{what}_by_{way}": (what, way) for what in ("table", "column", "metric") for way in ("vector", "text", "hybrid", "terms")}
COMMANDS = ["list_schemas", "list_tables", "full_metadata", "list_domains", "list_metrics", "domain_context", "metric_expression", "schema_by_vector", *_WAYS]
KINDS = ["csv", "bigquery", "snowflake", "databricks", "jdbc", "jdbc_catalog", "query_log", "model"]


def rows_as_json(df: DataFrame, name: str) -> str:
    """``{"tool_<name>": {"results": […]}}``."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return json.dumps({f"tool_{name}": {"results": rows}}, ensure_ascii=False)


def run(store: GraphStore, command: str, args: argparse.Namespace) -> DataFrame:
    if command in _WAYS or command == "schema_by_vector":
        what, way = _WAYS.get(command, ("schema", "vector"))
        if way != "vector" and sanitize_text(args.text) is None:
            raise SystemExit("the search text is empty")
        vector = [float(x) for x in args.vector.split(",")] if args.vector else None
        request = Request(text=args.text, vector=vector, limit=args.limit, k=args.k, domain=args.domain)
        s = GraphSearch(store)
        return s.tables_by_schemas(request) if what == "schema" else {"table": s.tables, "column": s.tables_by_columns, "metric": s.metrics}[what](way, request)
    return {
        "list_schemas": lambda: context.list_schemas(store),
        "list_tables": lambda: context.list_tables_by_schema(store, args.name),
        "full_metadata": lambda: context.full_metadata(store),
        "list_domains": lambda: context.list_domains(store),
        "list_metrics": lambda: context.list_metrics_by_domain(store, args.name),
        "domain_context": lambda: context.domain_context(store, args.name),
        "metric_expression": lambda: context.metric_expression(store, args.name, domain=args.domain, dialect=args.dialect),
    }[command]()


def open_store(spark: SparkSession, path: str) -> GraphStore:
    """The store at a path, an empty one if there is none yet."""
    return GraphStore.load(spark, path) if GraphStore(spark, path).exists() else GraphStore(spark, path)


def ingest(spark: SparkSession, kind: str, args: argparse.Namespace) -> str:
    """Fill the store from a source and write a snapshot; its folder."""
    if not args.source:
        raise ConfigError("an ingest needs a source")
    store = open_store(spark, args.store)
    read = lambda t: spark.read.parquet(f"{args.source}/{t}")
    source, options = {
        "csv": lambda: (connectors.csv(spark, args.source), {}),
        "bigquery": lambda: (connectors.bigquery_schema(read, args.database), {"dataset": args.schema}),
        "snowflake": lambda: (connectors.snowflake_schema(read, args.database), {"schema": args.schema}),
        "databricks": lambda: (connectors.databricks_schema(read, args.database), {"schema": args.schema}),
        "jdbc": lambda: (connectors.jdbc_schema(read, args.database), {"schemas": [args.schema] if args.schema else None}),
        "jdbc_catalog": lambda: (connectors.jdbc_catalog(spark, args.source, database=args.database), {"schemas": [args.schema] if args.schema else None}),
        "query_log": lambda: (connectors.query_log_file(spark), {"query_log_file": args.source}),
        "model": lambda: (connectors.semantic_model(spark), {"spec_source": args.source}),
    }[kind]()
    source.ingest(store, overwrite=args.overwrite, **options)
    return store.save()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="schemaloom")
    p.add_argument("store")
    p.add_argument("command", choices=[*COMMANDS, *[f"ingest_{k}" for k in KINDS], "export_model"])
    for o in ("text", "vector", "name", "domain", "dialect", "source", "database", "schema", "output"):
        p.add_argument(f"--{o}")
    for o in ("limit", "k"):
        p.add_argument(f"--{o}", type=int)
    p.add_argument("--overwrite", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command.startswith("ingest_"):
        print(json.dumps({"snapshot": ingest(spark, args.command.removeprefix("ingest_"), args)}))
        return 0
    if args.command == "export_model":
        model = connectors.semantic_model(spark, GraphStore.load(spark, args.store))
        print(json.dumps({"written": model.export(semantic_model_name=args.name, output_path=args.output)}))
        return 0
    print(rows_as_json(run(GraphStore.load(spark, args.store), args.command, args), args.command))
    return 0


if __name__ == "__main__":
    sys.exit(main())
