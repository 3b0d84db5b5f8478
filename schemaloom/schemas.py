"""Node and edge schemas of the metadata graph, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.errors import ConfigError

_S, _B, _V = T.StringType(), T.BooleanType(), T.ArrayType(T.FloatType())
_LIST = T.ArrayType(_S)
_NAMED = {"name": _S, "description": _S}
_SEARCHED = {**_NAMED, "embedding": _V}


@dataclass(frozen=True)
class NodeKind:
    """A label: its properties besides ``id``, those that full-text search reads, its merge key."""

    label: str
    properties: dict[str, T.DataType]
    text: tuple[str, ...] = ()
    key: str = "id"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", _S), *[T.StructField(n, t) for n, t in self.properties.items()], T.StructField("labels", _LIST)])


@dataclass(frozen=True)
class EdgeKind:
    """An edge table between two labels."""

    source: str
    type: str
    target: str
    properties: dict[str, T.DataType] | None = None

    @property
    def name(self) -> str:
        return f"{self.source}-{self.type}-{self.target}"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("src_id", _S), T.StructField("dst_id", _S), *[T.StructField(n, t) for n, t in (self.properties or {}).items()]])


_TEXT = ("name", "description")
_COLUMN = {**_SEARCHED, "type": _S, "nullable": _B, "is_primary_key": _B, "is_foreign_key": _B, "label": _S, "is_time_dimension": _B}

NODES: dict[str, NodeKind] = {
    k.label: k
    for k in (
        NodeKind("Database", {**_SEARCHED, "platform": _S, "service": _S}, _TEXT),
        NodeKind("Schema", _SEARCHED, _TEXT),
        NodeKind("Table", {**_SEARCHED, "source": _S, "primary_key": _LIST, "unique_keys": T.ArrayType(_LIST)}, _TEXT),
        NodeKind("Column", _COLUMN, _TEXT),
        NodeKind("Value", {"value": _S}),
        NodeKind("Glossary", {**_NAMED, "resource_path": _S}),
        NodeKind("Category", {**_NAMED, "resource_path": _S}),
        NodeKind("BusinessTerm", {**_SEARCHED, "resource_path": _S}, _TEXT),
        NodeKind("GovernanceTagKey", _SEARCHED, _TEXT),
        NodeKind("GovernanceTagValue", _NAMED),
        NodeKind("GovernanceTag", {"key": _S, "value": _S}),
        NodeKind("Query", {**_SEARCHED, "content": _S}, _TEXT),
        NodeKind("CTE", {"name": _S, "definition": _S, "query_id": _S}),
        NodeKind("Domain", {**_SEARCHED, "osi_version": _S}, _TEXT),
        NodeKind("Metric", _SEARCHED, _TEXT),
        NodeKind("Aspect", {"data": _S, "vendor_name": _S}),
        NodeKind("Expression", {"dialect": _S, "expression": _S}),
        NodeKind("Join", {"name": _S, "from_columns": _LIST, "to_columns": _LIST}),
        NodeKind("Node", {"label": _S, "additional_labels": _LIST}),
        NodeKind("Relationship", {"type": _S}),
        NodeKind("Property", {"name": _S, "type": _S, "unique": _B, "nullable": _B, "indexed": _B, "existence": _B}),
        NodeKind("GraphInfo", {"initial_version": _S, "latest_version": _S, "create_date": T.TimestampType(), "last_updated": T.TimestampType()}),
    )
}

_HOLDERS = ("Domain", "Table", "Query", "Column", "Metric", "Join")
EDGES: dict[str, EdgeKind] = {
    k.name: k
    for k in (
        EdgeKind("Database", "HAS_SCHEMA", "Schema"),
        EdgeKind("Schema", "HAS_TABLE", "Table"),
        EdgeKind("Table", "HAS_COLUMN", "Column"),
        EdgeKind("Column", "REFERENCES", "Column", {"criteria": _S}),
        EdgeKind("Column", "HAS_VALUE", "Value"),
        EdgeKind("Glossary", "HAS_CATEGORY", "Category"),
        EdgeKind("Category", "HAS_BUSINESS_TERM", "BusinessTerm"),
        *[EdgeKind(s, "TAGGED_WITH", "BusinessTerm") for s in ("Column", "Table", "Schema", "Metric")],
        *[EdgeKind(s, "TAGGED_WITH", "GovernanceTag") for s in ("Column", "Table", "Schema")],
        EdgeKind("GovernanceTagKey", "HAS_VALUE_OPTION", "GovernanceTagValue"),
        EdgeKind("GovernanceTag", "HAS_DEFINITION", "GovernanceTagValue"),
        EdgeKind("Query", "USES_TABLE", "Table"),
        EdgeKind("Query", "USES_COLUMN", "Column"),
        EdgeKind("Query", "DEFINES", "CTE"),
        *[EdgeKind(s, "HAS_ASPECT", "Aspect") for s in _HOLDERS],
        *[EdgeKind(s, "HAS_EXPRESSION", "Expression") for s in ("Column", "Metric")],
        EdgeKind("Domain", "HAS_METRIC", "Metric"),
        EdgeKind("Domain", "HAS_TABLE", "Table"),
        EdgeKind("Domain", "HAS_QUERY", "Query"),
        *[EdgeKind("Join", e, t) for e in ("HAS_SOURCE_TABLE", "HAS_TARGET_TABLE") for t in ("Table", "Query")],
        EdgeKind("Column", "USED_IN_JOIN", "Join"),
        EdgeKind("Database", "HAS_NODE", "Node"),
        EdgeKind("Database", "HAS_RELATIONSHIP", "Relationship"),
        EdgeKind("Relationship", "HAS_SOURCE_NODE", "Node"),
        EdgeKind("Relationship", "HAS_TARGET_NODE", "Node"),
        EdgeKind("Node", "HAS_PROPERTY", "Property"),
        EdgeKind("Relationship", "HAS_PROPERTY", "Property"),
    )
}


def node_kind(label: str) -> NodeKind:
    if label not in NODES:
        raise ConfigError(f"unknown node label {label!r}")
    return NODES[label]


def edge_kind(name: str) -> EdgeKind:
    if name not in EDGES:
        raise ConfigError(f"unknown edge kind {name!r}")
    return EDGES[name]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the schema: cast what is there, NULL for what is not, drop the rest."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
