"""A folder of CSV files, each optional, as a graph batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError
from schemaloom.sources.rows import edges_of, hierarchy_batch, nodes_of, reference_edges, value_nodes
from schemaloom.store import GraphBatch

_PATH = ["database_name", "schema_name", "table_name", "column_name"]
_TERM = ["glossary_name", "category_name", "term_name"]
# File names and required columns of the bundle.
FILES: dict[str, tuple[str, list[str]]] = {
    "database": ("database_info.csv", _PATH[:1]),
    "schema": ("schema_info.csv", _PATH[:2]),
    "table": ("table_info.csv", _PATH[:3]),
    "column": ("column_info.csv", _PATH),
    "value": ("value_info.csv", [*_PATH, "value"]),
    "query": ("query_info.csv", ["query_id", "content"]),
    "query_table": ("query_table_info.csv", ["query_id", "table_id"]),
    "query_column": ("query_column_info.csv", ["query_id", "column_id"]),
    "glossary": ("glossary_info.csv", _TERM[:1]),
    "category": ("category_info.csv", _TERM[:2]),
    "business_term": ("business_term_info.csv", _TERM),
    "column_references": ("column_references_info.csv", [f"{s}_{c}" for s in ("source", "target") for c in _PATH]),
    "column_term": ("column_term_info.csv", [*_PATH, *_TERM]),
    "table_term": ("table_term_info.csv", [*_PATH[:3], *_TERM]),
}
NODE_FILES = {"Database": "database", "Schema": "schema", "Table": "table", "Column": "column", "Value": "value", "Query": "query", "Glossary": "glossary", "Category": "category", "BusinessTerm": "business_term"}
EDGE_FILES = {"HAS_SCHEMA": ["schema"], "HAS_TABLE": ["table"], "HAS_COLUMN": ["column"], "HAS_VALUE": ["value"], "HAS_CATEGORY": ["category"], "HAS_BUSINESS_TERM": ["business_term"], "REFERENCES": ["column_references"], "TAGGED_WITH": ["column_term", "table_term"], "USES_TABLE": ["query_table"], "USES_COLUMN": ["query_column"]}
# Texts that CSV readers take as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_BOOLEANS = ("is_nullable", "nullable", "is_primary_key", "is_foreign_key")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, the missing-value texts as NULL."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


class CsvBundle:
    """Reads only the files that the wanted nodes and relationships need."""

    def __init__(self, spark: SparkSession, folder: str, file_map: dict[str, str] | None = None):
        if unknown := set(file_map or {}) - set(FILES):
            raise ConfigError(f"unknown files {sorted(unknown)}")
        self.spark, self.folder, self.file_map = spark, folder.rstrip("/"), file_map or {}

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # an entity may also be a folder of part files
        return fs.exists(p) and (fs.getFileStatus(p).isDirectory() or fs.getFileStatus(p).getLen() > 0)

    def frame(self, entity: str) -> DataFrame | None:
        """The file's rows; None if it is missing or empty; an error if a required column is."""
        name, required = FILES[entity]
        path = f"{self.folder}/{self.file_map.get(entity, name)}"
        if not self._exists(path):
            return None
        df = read_csv(self.spark, path)
        if absent := [c for c in required if c not in df.columns]:
            raise ConfigError(f"{path} lacks the columns {absent}")
        return df

    def extract(self, include_nodes: list[str] | None = None, include_relationships: list[str] | None = None) -> GraphBatch:
        if unknown := (set(include_nodes or []) - set(NODE_FILES)) | (set(include_relationships or []) - set(EDGE_FILES)):
            raise ConfigError(f"unknown nodes or relationships {sorted(unknown)}")
        everything = include_nodes is None and include_relationships is None
        nodes = list(NODE_FILES) if everything else include_nodes or []
        edges = list(EDGE_FILES) if everything else include_relationships or []
        needed = {NODE_FILES[n] for n in nodes} | {f for e in edges for f in EDGE_FILES[e]}
        frames = {e: df for e in FILES if e in needed and (df := self.frame(e)) is not None}
        batch = self._hierarchy(frames)
        self._values_and_queries(frames, batch)
        self._glossary(frames, batch)
        wanted_edge = lambda k: k.split("-")[1] in edges
        return GraphBatch({k: v for k, v in batch.nodes.items() if k in nodes}, {k: v for k, v in batch.edges.items() if wanted_edge(k)})

    def _hierarchy(self, frames: dict[str, DataFrame]) -> GraphBatch:
        named = {}
        for e in ("database", "schema", "table", "column"):
            if e in frames:
                df = frames[e].withColumnsRenamed({c: c.removesuffix("_name") for c in _PATH})
                df = df.withColumnsRenamed({"data_type": "type", "is_nullable": "nullable"})
                named[e] = df.withColumns({c: F.col(c).cast("boolean") for c in _BOOLEANS if c in df.columns})
        batch = hierarchy_batch(named)
        if "column_references" in frames:
            df = frames["column_references"].withColumnsRenamed({f"{s}_{c}": f"{s}_{c.removesuffix('_name')}" for s in ("source", "target") for c in _PATH})
            batch.edges["Column-REFERENCES-Column"] = reference_edges(df)
        return batch

    def _values_and_queries(self, frames: dict[str, DataFrame], batch: GraphBatch) -> None:
        if "value" in frames:
            df = frames["value"].withColumnsRenamed({c: c.removesuffix("_name") for c in _PATH}).filter("value is not null")
            batch.nodes["Value"], batch.edges["Column-HAS_VALUE-Value"] = value_nodes(df)
        if "query" in frames:
            df = frames["query"]
            more = {c: c for c in ("name", "description") if c in df.columns}
            batch.nodes["Query"] = nodes_of(df, "Query", F.col("query_id"), content="content", **more)
        for entity, kind, other in (("query_table", "Query-USES_TABLE-Table", "table_id"), ("query_column", "Query-USES_COLUMN-Column", "column_id")):
            if entity in frames:
                batch.edges[kind] = edges_of(frames[entity], F.col("query_id"), F.col(other))

    def _glossary(self, frames: dict[str, DataFrame], batch: GraphBatch) -> None:
        for entity, label, depth in (("glossary", "Glossary", 1), ("category", "Category", 2), ("business_term", "BusinessTerm", 3)):
            if entity in frames:
                df = frames[entity]
                named = _TERM[depth - 1] if "name" not in df.columns else "name"
                more = {"description": "description"} if "description" in df.columns else {}
                batch.nodes[label] = nodes_of(df, label, ids.dotted(*_TERM[:depth]), name=named, **more)
                if depth > 1:
                    up, edge = (("Glossary", "HAS_CATEGORY"), ("Category", "HAS_BUSINESS_TERM"))[depth - 2]
                    batch.edges[f"{up}-{edge}-{label}"] = edges_of(df, ids.dotted(*_TERM[: depth - 1]), ids.dotted(*_TERM[:depth]))
        for entity, label, depth in (("column_term", "Column", 4), ("table_term", "Table", 3)):
            if entity in frames:
                batch.edges[f"{label}-TAGGED_WITH-BusinessTerm"] = edges_of(frames[entity], ids.dotted(*_PATH[:depth]), ids.term_id(*_TERM))
