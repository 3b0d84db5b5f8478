"""The metadata graph: one DataFrame per label and per edge kind, kept as Parquet snapshots."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError, LoadError, SchemaloomWarning
from schemaloom.functions.text import field_stats, postings
from schemaloom.operators.upsert import existing_endpoints, first_per_key, merge, merge_labels
from schemaloom.schemas import conform, edge_kind, node_kind


@dataclass
class GraphBatch:
    """What a source yields: rows per label and per edge kind."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    #: Labels that merge on another property than ``id``.
    keys: dict[str, str] = field(default_factory=dict)

    def restrict(self, nodes: list[str] | None = None, edges: list[str] | None = None) -> GraphBatch:
        """Only the named labels and relationship types; unknown names are an error."""
        for label in nodes or []:
            node_kind(label)
        types = {k.split("-")[1] for k in self.edges}
        if unknown := set(edges or []) - types - set(self.edges):
            raise ConfigError(f"unknown relationships {sorted(unknown)}")
        keep_edge = lambda k: edges is None or k in edges or k.split("-")[1] in edges
        return GraphBatch({k: v for k, v in self.nodes.items() if nodes is None or k in nodes}, {k: v for k, v in self.edges.items() if keep_edge(k)}, dict(self.keys))


class GraphStore:
    """Nodes and edges of a graph, with idempotent upserts.

    A snapshot is written to a new folder and then named in ``CURRENT``; no folder
    that is being read is ever overwritten.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self._nodes: dict[str, DataFrame] = {}
        self._edges: dict[str, DataFrame] = {}
        self._text: dict[str, tuple[DataFrame, DataFrame]] = {}

    def nodes(self, label: str) -> DataFrame:
        kind = node_kind(label)
        return self._nodes.get(label) if label in self._nodes else self.spark.createDataFrame([], kind.schema)

    def edges(self, name: str) -> DataFrame:
        kind = edge_kind(name)
        return self._edges.get(name) if name in self._edges else self.spark.createDataFrame([], kind.schema)

    def upsert_nodes(self, label: str, rows: DataFrame, *, overwrite: bool = False, properties: list[str] | None = None, labels: list[str] | None = None, key: str = "id") -> None:
        """Merge rows into a label.

        ``properties`` are the ones written (an unknown one is an error); ``labels`` are
        secondary labels, always applied; ``key`` may be ``name`` for terms that come without ids.
        """
        kind = node_kind(label)
        if unknown := set(properties or []) - set(kind.properties):
            raise ConfigError(f"{label} has no properties {sorted(unknown)}")
        written = [p for p in kind.properties if (p in rows.columns if properties is None else p in properties and p in rows.columns)]
        batch = rows.select("id", *[F.col(p).cast(kind.properties[p]).alias(p) for p in written])
        if labels or "labels" in rows.columns:
            batch = rows.select("id", *[F.col(p).cast(kind.properties[p]).alias(p) for p in written], (F.col("labels") if "labels" in rows.columns else F.array(*map(F.lit, labels))).cast("array<string>").alias("labels"))
        plain = batch.drop("labels")
        if label in self._nodes:
            merged = merge(self._nodes[label], plain, [key], overwrite=overwrite, kept=("id",))
        else:  # nothing stored yet: no join
            merged = conform(first_per_key(plain, [key]), kind.schema)
        if "labels" in batch.columns:
            merged = merge_labels(merged, batch, key)
        self._nodes[label] = merged
        self._text.pop(label, None)

    def upsert_edges(self, name: str, rows: DataFrame, *, overwrite: bool = False, target_key: str = "id") -> None:
        """Merge edges whose two ends exist; one edge per pair of ends."""
        kind = edge_kind(name)
        targets = self.nodes(kind.target)
        if target_key != "id":
            named = targets.select(F.col(target_key).alias("k_"), F.col("id").alias("i_"))
            rows = rows.join(named, F.col("dst_id") == F.col("k_")).withColumn("dst_id", F.col("i_")).drop("k_", "i_")
        rows = existing_endpoints(conform(rows, kind.schema), self.nodes(kind.source), targets)
        ends = ["src_id", "dst_id"]
        self._edges[name] = merge(self._edges[name], rows, ends, overwrite=overwrite) if name in self._edges else first_per_key(rows, ends)

    def ingest(self, batch: GraphBatch, *, overwrite: bool = False) -> None:
        """Merge a batch, nodes first; edges to a label that merges by another key find their end by it, so stored ids stay."""
        # an id of the batch stands for one name
        named = {label: first_per_key(batch.nodes[label], ["id"]) for label in batch.keys if label in batch.nodes}
        for label, rows in batch.nodes.items():
            self.upsert_nodes(label, named.get(label, rows), overwrite=overwrite, key=batch.keys.get(label, "id"))
        for name, rows in batch.edges.items():
            target = edge_kind(name).target
            key = batch.keys.get(target, "id")
            if target in named:
                rows = rows.join(named[target].select(F.col("id").alias("dst_id"), F.col(key).alias("named_")), "dst_id").withColumn("dst_id", F.col("named_")).drop("named_")
            self.upsert_edges(name, rows, overwrite=overwrite, target_key=key)

    def set_embeddings(self, label: str, vectors: DataFrame) -> None:
        """Write ``embedding`` by id and nothing else."""
        v = vectors.select(F.col("id").alias("v_"), F.col("embedding").cast("array<float>").alias("e_"))
        stored = self.nodes(label)
        self._nodes[label] = stored.join(v, stored.id == v.v_, "left").withColumn("embedding", F.coalesce("e_", "embedding")).select(*stored.columns)

    def stamp(self, version: str, now) -> None:
        """The singleton that names the versions; what was set first stays."""
        row = self.spark.createDataFrame([("graph", version, version, now, now)], "id string, initial_version string, latest_version string, create_date timestamp, last_updated timestamp")
        self.upsert_nodes("GraphInfo", row.drop("latest_version", "last_updated"))
        self.upsert_nodes("GraphInfo", row.drop("initial_version", "create_date"), overwrite=True)

    def has_terms(self) -> bool:
        """Whether there are business terms."""
        return not self.nodes("BusinessTerm").isEmpty()

    def has_models(self) -> bool:
        """Whether a semantic model was loaded: some domain bears its label."""
        return not self.nodes("Domain").filter(F.array_contains("labels", "SemanticModel")).isEmpty()

    def check_version(self, version: str) -> bool:
        """Whether the version that last wrote the graph is this one; warns if it is not or is unknown."""
        row = self.nodes("GraphInfo").select("latest_version").first()
        if row is not None and row.latest_version == version:
            return True
        said = "names no version" if row is None else f"was last written by version {row.latest_version}"
        warnings.warn(f"the graph {said}, this is version {version}", SchemaloomWarning, stacklevel=2)
        return False

    def check_unique(self) -> None:
        """Every label's ids are unique; one small aggregate per label.  No snapshot is switched to that breaks this."""
        for label, df in self._nodes.items():
            self._unique(label, df)

    @staticmethod
    def _unique(label: str, df: DataFrame) -> None:
        if not df.groupBy("id").count().filter("count > 1").isEmpty():
            raise LoadError(f"{label} has repeated ids")

    def indexes(self) -> set[tuple[str, str]]:
        """(label, VECTOR) where a label has embeddings, (label, FULLTEXT) where it has rows and text properties."""
        parts = []
        for label, df in self._nodes.items():
            kind = node_kind(label)
            vector = F.count_if(F.col("embedding").isNotNull()) > 0 if "embedding" in kind.properties else F.lit(False)
            parts.append(df.agg(vector.alias("VECTOR"), (F.lit(bool(kind.text)) & (F.count("*") > 0)).alias("FULLTEXT")).withColumn("label", F.lit(label)))
        if not parts:
            return set()
        rows = reduce(lambda a, b: a.unionByName(b), parts).collect()  # a row per label, one job
        return {(r.label, kind) for r in rows for kind in ("VECTOR", "FULLTEXT") if r[kind]}

    def text_index(self, label: str) -> tuple[DataFrame, DataFrame] | None:
        """(postings, field statistics) as of the last snapshot, None if the label has changed since or has no texts."""
        return self._text.get(label)

    def save(self) -> str:
        """Write a snapshot with its text indexes and switch to it; plans start from files again.

        Postings are clustered by word, so a search reads the row groups of its words only.
        """
        if not self.path:
            raise ConfigError("the store has no path")
        folder = f"{self.path}/snapshot-{uuid.uuid4().hex}"
        for what, frames in (("nodes", self._nodes), ("edges", self._edges)):
            for name, df in frames.items():
                df.write.parquet(f"{folder}/{what}/{name}")
        for label in self._nodes:
            self._unique(label, self.spark.read.parquet(f"{folder}/nodes/{label}"))
            fields = list(node_kind(label).text)
            if fields:
                rows = self.spark.read.parquet(f"{folder}/nodes/{label}")
                postings(rows, "id", fields).repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{folder}/postings/{label}")
                field_stats(rows, fields).write.parquet(f"{folder}/stats/{label}")
        self._fs_write(f"{self.path}/CURRENT", folder)
        for what, frames in (("nodes", self._nodes), ("edges", self._edges)):
            for name in frames:
                frames[name] = self.spark.read.parquet(f"{folder}/{what}/{name}")
        self._read_indexes(folder)
        return folder

    def _read_indexes(self, folder: str) -> None:
        self._text = {name: tuple(self.spark.read.parquet(f"{folder}/{what}/{name}") for what in ("postings", "stats")) for name in self._listed(f"{folder}/postings")}

    def exists(self) -> bool:
        """Whether a snapshot lies at the store's path."""
        fs, path = self._path(f"{self.path}/CURRENT")
        return fs.exists(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        store = cls(spark, path)
        folder = spark.read.text(f"{path}/CURRENT").first()[0]
        for what, frames in (("nodes", store._nodes), ("edges", store._edges)):
            for name in store._listed(f"{folder}/{what}"):
                frames[name] = spark.read.parquet(f"{folder}/{what}/{name}")
        store._read_indexes(folder)
        return store

    def _path(self, p: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _fs_write(self, p: str, text: str) -> None:
        fs, path = self._path(p)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _listed(self, p: str) -> list[str]:
        fs, path = self._path(p)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
