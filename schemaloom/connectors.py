"""Connectors: extract a source, load it into a store, in that order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from schemaloom.errors import ConfigError, StateError
from schemaloom.lineage import lineage_batch, lineage_frames
from schemaloom.sources import catalog_json, governance, osi, querylog, warehouses
from schemaloom.sources.csv_bundle import CsvBundle
from schemaloom.store import GraphBatch, GraphStore


class Connector:
    """A source behind ``extract``; frames are lazy, so nothing is read before the load.

    ``extract`` gives and keeps the batch, ``load`` merges it into a store, ``ingest`` does
    both.  Loading before extracting, or after ``close``, is an error.
    """

    def __init__(self, source: Callable[..., GraphBatch], *, export: Callable[..., str] | None = None):
        self._source, self._export, self._batch, self._closed = source, export, None, False

    def extract(self, **options) -> GraphBatch:
        if self._closed:
            raise StateError("the connector is closed")
        self._batch = self._source(**options)
        return self._batch

    def transform(self) -> GraphBatch:
        """The extracted batch; sources give graph rows, so there is nothing left to do."""
        if self._batch is None:
            raise StateError("extract comes before transform")
        return self._batch

    def load(self, store: GraphStore, *, overwrite: bool = False) -> None:
        store.ingest(self.transform(), overwrite=overwrite)

    def ingest(self, store: GraphStore, *, overwrite: bool = False, **options) -> GraphStore:
        self.extract(**options)
        self.load(store, overwrite=overwrite)
        return store

    def export(self, **options) -> str:
        if self._export is None:
            raise ConfigError("this connector does not export")
        return self._export(**options)

    def close(self) -> None:
        self._batch, self._closed = None, True

    def __enter__(self) -> Connector:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def csv(spark: SparkSession, folder: str, file_map: dict[str, str] | None = None) -> Connector:
    """``ingest(include_nodes=, include_relationships=)``."""
    return Connector(CsvBundle(spark, folder, file_map).extract)


def bigquery_schema(read: warehouses.Read, project: str, *, table=None) -> Connector:
    """``ingest(dataset=)``."""
    return Connector(lambda dataset, n=10: warehouses.bigquery(read, project, dataset, table=table, n=n))


def snowflake_schema(read: warehouses.Read, database: str, *, table=None, value_sample_limit: int = 10) -> Connector:
    """``ingest(schema=)``."""
    return Connector(lambda schema: warehouses.snowflake(read, database, schema, table=table, n=value_sample_limit))


def databricks_schema(read: warehouses.Read, catalog: str, *, table=None, value_sample_limit: int = 10) -> Connector:
    """``ingest(schema=)``."""
    return Connector(lambda schema: warehouses.databricks(read, catalog, schema, table=table, n=value_sample_limit))


def jdbc_catalog(spark: SparkSession, path: str, *, url: str | None = None, database: str | None = None, platform: str | None = None, service: str | None = None) -> Connector:
    """A crawled catalogue; ``ingest(schemas=)``."""
    name = database or catalog_json.database_of_url(url or "")
    return Connector(lambda schemas=None: catalog_json.relational_catalog(spark, path, name, schemas=schemas, platform=platform, service=service))


def jdbc_schema(read: warehouses.Read, database: str, *, table=None, value_sample_limit: int = 10, platform: str | None = None, service: str | None = None) -> Connector:
    """A database's own information schema; ``ingest(schemas=)``."""
    return Connector(lambda schemas=None: warehouses.jdbc(read, database, schemas, table=table, n=value_sample_limit, platform=platform, service=service))


def unity_catalog(pages: DataFrame) -> Connector:
    return Connector(lambda: catalog_json.unity_pages(pages))


def entry_catalog(entries: DataFrame) -> Connector:
    return Connector(lambda: catalog_json.entry_catalog(entries))


def entry_glossary(terms: DataFrame, links: DataFrame | None = None) -> Connector:
    """``ingest(include_entry_links=)``."""
    return Connector(lambda include_entry_links=True: governance.glossary_batch(terms, links if include_entry_links else None))


def governed_tags(policies: DataFrame, *, source: str | None = None, metastore: str | None = None, host: str | None = None) -> Connector:
    """``ingest(include_system_tags=)``."""
    name = governance.namespace(source, metastore, host)
    return Connector(lambda include_system_tags=False: governance.tag_batch(policies, name, include_system=include_system_tags))


def query_log_file(spark: SparkSession, *, source: str = "bigquery") -> Connector:
    """``ingest(query_log_file=)``."""

    def extract(query_log_file: str, **defaults) -> GraphBatch:
        return lineage_batch(lineage_frames(querylog.audit_file(spark, query_log_file, source=source), dialect=source, **defaults))

    return Connector(extract)


def job_log(jobs: DataFrame, project: str) -> Connector:
    """``ingest(dataset=, start=, end=, limit=, drop_failed=)``."""

    def extract(dataset: str, **options) -> GraphBatch:
        rows = querylog.recent_jobs(jobs, dataset=dataset, **options)
        return lineage_batch(lineage_frames(rows, dialect="bigquery", default_database=project, default_schema=dataset))

    return Connector(extract)


def statement_log(log: DataFrame, database: str) -> Connector:
    """``ingest(schema=, start=, end=, limit=, drop_failed=)``."""

    def extract(schema: str | None = None, **options) -> GraphBatch:
        rows = querylog.recent_statements(log, schema=schema, **options)
        return lineage_batch(lineage_frames(rows, text="query_text", dialect="snowflake", default_database=database, default_schema=schema))

    return Connector(extract)


def semantic_model(spark: SparkSession, store: GraphStore | None = None) -> Connector:
    """``ingest(spec_source=, version=)`` and ``export(semantic_model_name=, output_path=)``."""

    def extract(spec_source: str, version: str | None = None) -> GraphBatch:
        doc = osi.load(spec_source)
        osi.check_version(doc, version)
        return osi.model_batch(spark, doc)

    def export(semantic_model_name: str, output_path: str, from_store: GraphStore | None = None) -> str:
        text = osi.dump(osi.export(from_store or store, semantic_model_name))
        with open(output_path, "w", encoding="utf-8") as f:
            f.write(text)
        return output_path

    return Connector(extract, export=export)
