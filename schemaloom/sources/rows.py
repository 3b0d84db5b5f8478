"""From flat metadata rows to nodes and edges: one projection for all sources.

A flat frame has some of the columns database, schema, table, column (names) and
any properties.  Ids are built from the names unless the frame brings its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.operators.upsert import first_per_key
from schemaloom.schemas import NODES
from schemaloom.store import GraphBatch

LEVELS = (("Database", "database"), ("Schema", "schema"), ("Table", "table"), ("Column", "column"))


def without_nan(df: DataFrame) -> DataFrame:
    """Numbers that are NaN become NULL, as missing values of frames that know no NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def level_id(df: DataFrame, depth: int) -> Column:
    """Id of the node at a depth: the frame's own ``*_id`` column, else from the names."""
    own = f"{LEVELS[depth][1]}_id"
    return F.col(own).cast("string") if own in df.columns else ids.dotted(*[LEVELS[i][1] for i in range(depth + 1)])


def nodes_of(df: DataFrame, label: str, node_id: Column, **properties: Column | str) -> DataFrame:
    """(id, properties): distinct by id, rows without an id dropped."""
    kind = NODES[label]
    picked = df.select(node_id.alias("id"), *[(F.col(c) if isinstance(c, str) else c).cast(kind.properties[p]).alias(p) for p, c in properties.items()])
    return first_per_key(picked, ["id"])


def edges_of(df: DataFrame, source: Column, target: Column, **properties: Column | str) -> DataFrame:
    picked = df.select(source.alias("src_id"), target.alias("dst_id"), *[(F.col(c) if isinstance(c, str) else c).alias(p) for p, c in properties.items()])
    return first_per_key(picked, ["src_id", "dst_id"])


def hierarchy_batch(frames: dict[str, DataFrame], *, platform: str | None = None, service: str | None = None) -> GraphBatch:
    """Nodes and containment edges of frames named database, schema, table, column.

    Properties are the frame's columns that the label knows; a column that the source
    lacks is not written, so it never touches what is stored.
    """
    batch = GraphBatch()
    for depth, (label, name) in enumerate(LEVELS):
        if name not in frames:
            continue
        df = frames[name]
        known = {p: p for p in NODES[label].properties if p in df.columns and p not in ("name",)}
        if label == "Database":
            known |= {k: F.upper(F.lit(v)) for k, v in (("platform", platform), ("service", service)) if v} | {k: F.upper(F.col(k)) for k in ("platform", "service") if k in df.columns}
        batch.nodes[label] = nodes_of(df, label, level_id(df, depth), name=name, **known)
        if depth:
            up = LEVELS[depth - 1][0]
            edge = ("HAS_SCHEMA", "HAS_TABLE", "HAS_COLUMN")[depth - 1]
            batch.edges[f"{up}-{edge}-{label}"] = edges_of(df, level_id(df, depth - 1), level_id(df, depth))
    return batch


def reference_edges(df: DataFrame, criteria: bool = True) -> DataFrame:
    """Column references of a frame with source_* and target_* names; a column does not refer to itself."""
    ends = [ids.column_id(*[f"{s}_{p}" for p in ("database", "schema", "table", "column")]) for s in ("source", "target")]
    extra = {"criteria": F.col("criteria")} if criteria and "criteria" in df.columns else {"criteria": F.lit(None).cast("string")}
    return edges_of(df, *ends, **extra).filter("src_id <> dst_id")


def value_nodes(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Value nodes and their edges of samples (database, schema, table, column, value)."""
    names = ("database", "schema", "table", "column")
    v = ids.value_id(*names, "value")
    return nodes_of(samples, "Value", v, value=F.coalesce(F.col("value").cast("string"), F.lit(""))), edges_of(samples, ids.column_id(*names), v)
