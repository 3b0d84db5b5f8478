"""Query logs: exported audit files and job tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError

_ENTRY = """protoPayload struct<serviceData:struct<jobQueryRequest:struct<projectId:string,query:string>,
jobQueryResponse:struct<job:struct<jobStatistics:struct<referencedTables:array<struct<projectId:string,datasetId:string,tableId:string>>>>>>>"""
# Statement types that count as queries in a job table.
QUERY_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE_TABLE_AS_SELECT")


def audit_file(spark: SparkSession, path: str, *, source: str = "bigquery", lines: bool = False) -> DataFrame:
    """(project, query, tables) of a file of audit entries; entries without a query request are skipped.

    A file is one JSON list, which one task reads; with ``lines`` it has an entry per line and is split.
    """
    if source != "bigquery":
        raise ConfigError(f"unknown log source {source!r}")
    service = "protoPayload.serviceData"
    rows = spark.read.schema(_ENTRY).option("multiLine", not lines).json(path).filter(F.col(f"{service}.jobQueryRequest").isNotNull())
    return rows.select(F.col(f"{service}.jobQueryRequest.projectId").alias("project"), F.col(f"{service}.jobQueryRequest.query").alias("query"), F.col(f"{service}.jobQueryResponse.job.jobStatistics.referencedTables").alias("tables"))


def time_range(column: str, start: dt.datetime | None, end: dt.datetime | None, *, now: dt.datetime | None = None, days: int = 30) -> Column:
    """Half-open range; without a start the last ``days`` before ``now``."""
    begin = F.lit(start) if start is not None else (F.lit(now) if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS")
    cond = F.col(column) >= begin
    return cond & (F.col(column) < F.lit(end)) if end is not None else cond


def referenced_tables(jobs: DataFrame, dataset: str) -> DataFrame:
    """One row per job and referenced table (``t``) of a dataset, its information schema apart."""
    return jobs.withColumn("t", F.explode("referenced_tables")).filter((F.col("t.dataset_id") == dataset) & ~F.col("t.table_id").like("INFORMATION_SCHEMA.%"))


def recent_jobs(jobs: DataFrame, *, dataset: str, time: str = "creation_time", start=None, end=None, now=None, limit: int = 100, drop_failed: bool = True) -> DataFrame:
    """One row per job and referenced table, the latest ``limit`` of them, failed jobs removed after the cut.

    ``jobs`` has (job_id, query, error, referenced_tables array<struct<dataset_id,table_id>>, time).
    """
    rows = referenced_tables(jobs.filter(time_range(time, start, end, now=now)), dataset)
    cut = rows.orderBy(F.desc(time), "job_id", "t.table_id").limit(limit)
    return cut.filter(F.col("error").isNull()) if drop_failed else cut


def recent_statements(log: DataFrame, *, schema: str | None = None, time: str = "start_time", start=None, end=None, now=None, limit: int = 100, drop_failed: bool = True, types: tuple[str, ...] = QUERY_TYPES) -> DataFrame:
    """Statements of a query history: the wanted types, not blank, the latest ``limit``, failed ones removed after the cut."""
    rows = log.filter(F.col("query_type").isin(*types) & time_range(time, start, end, now=now))
    if schema is not None:
        rows = rows.filter(F.col("schema_name") == schema)
    rows = rows.filter(F.col("query_text").isNotNull() & (F.trim("query_text") != ""))
    cut = rows.orderBy(F.desc(time), "query_id").limit(limit)
    return cut.filter(F.col("error_code").isNull()) if drop_failed else cut
