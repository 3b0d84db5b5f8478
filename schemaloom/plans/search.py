"""Retrieval as one pipeline: branches, normalise, merge, bridge, roll up, cut, expand.

Every function takes and gives small hit frames (id, score), so the retrieval
operators are compositions.  Hits are cut to the top k as early as the semantics
allow (``TakeOrderedAndProject``), ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError
from schemaloom.functions.text import bm25, bm25_from_postings, sanitize_text
from schemaloom.functions.vector import cosine_to, unit_score
from schemaloom.plans import context
from schemaloom.store import GraphStore

THRESHOLD = 0.5
RELATIVE = 0.2


def top(hits: DataFrame, n: int, *, score: str = "score", node: str = "id") -> DataFrame:
    return hits.orderBy(F.desc(score), node).limit(n)


def held(hits: DataFrame) -> DataFrame:
    """Hits as a local table: a search is cut to some candidates, and what follows names them several times."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def vector_hits(nodes: DataFrame, query: list[float], k: int, *, node: str = "id", vector: str = "embedding", threshold: float = THRESHOLD, scale: str = "unit") -> DataFrame:
    """The k nearest, and of these the ones above the threshold (the cut comes first)."""
    similarity = cosine_to(vector, query)
    scored = nodes.select(F.col(node).alias("id"), (unit_score(similarity) if scale == "unit" else similarity).alias("score")).filter("score is not null")
    return top(scored, k).filter(F.col("score") > threshold)


def text_hits(nodes: DataFrame, query: str | None, k: int, *, node: str = "id", fields: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """The k best by BM25; a query that is nothing but reserved characters finds nothing."""
    return top(bm25(nodes, node, list(fields), sanitize_text(query) or "").withColumnRenamed(node, "id"), k)


def by_maximum(hits: DataFrame) -> DataFrame:
    """Divide by the greatest score of the (small, already cut) branch."""
    return hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(F.lit(1))))


def merged(*branches: DataFrame) -> DataFrame:
    """One row per node with its best score over the branches."""
    whole = branches[0]
    for b in branches[1:]:
        whole = whole.unionByName(b)
    return whole.groupBy("id").agg(F.max("score").alias("score"))


def bridged(node_hits: DataFrame, term_hits: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes found that are tagged with a term found; the mean of the two scores, each by its maximum over the surviving pairs.

    The tag edges are joined with both sets of hits, which gives the pairs without their product.
    """
    pairs = tags.select("src_id", "dst_id").distinct().join(node_hits.select(F.col("id").alias("src_id"), F.col("score").alias("n_")), "src_id").join(term_hits.select(F.col("id").alias("dst_id"), F.col("score").alias("t_")), "dst_id")
    every = Window.partitionBy(F.lit(1))  # at most k * k pairs
    half = (F.col("n_") / F.max("n_").over(every) + F.col("t_") / F.max("t_").over(every)) / 2
    return pairs.select(F.col("src_id").alias("id"), half.alias("score")).groupBy("id").agg(F.max("score").alias("score"))


def rolled_up(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, score): the mean score of each parent's hits; ``parents`` has (src_id parent, dst_id child)."""
    return parents.join(hits, parents.dst_id == hits.id).groupBy(F.col("src_id").alias("id")).agg(F.avg("score").alias("score"))


def within_parent(parent_hits: DataFrame, edges: DataFrame, children: DataFrame, score: Column, *, slack: float = RELATIVE) -> DataFrame:
    """Children (id, score, parent, parent_score) of found parents whose own score is above the parent's less ``slack``."""
    p = parent_hits.select(F.col("id").alias("parent"), F.col("score").alias("parent_score"))
    scored = children.select("id", score.alias("score"))
    joined = edges.select(F.col("src_id").alias("parent"), F.col("dst_id").alias("id")).join(p, "parent").join(scored, "id")
    return joined.filter(F.col("score") > F.col("parent_score") - slack)


@dataclass
class Request:
    """A search: query vector and text, how many results, how many candidates per branch."""

    text: str | None = None
    vector: list[float] | None = None
    limit: int | None = None
    k: int | None = None
    domain: str | None = None


class GraphSearch:
    """The retrieval operators over a graph store."""

    # (results, candidates) by default
    SIZES = {("Column", "vector"): (5, 10), ("Table", "vector"): (10, 10), ("Schema", "vector"): (5, 5), ("Table", "text"): (10, 10), ("Column", "text"): (5, 10), ("Table", "hybrid"): (5, 10), ("Column", "hybrid"): (5, 10), ("Table", "terms"): (5, 10), ("Column", "terms"): (5, 10)}

    def __init__(self, store: GraphStore, *, scale: str = "unit"):
        if scale not in ("unit", "raw"):
            raise ConfigError(f"unknown score scale {scale!r}")
        self.store, self.scale = store, scale

    def _sizes(self, label: str, way: str, r: Request) -> tuple[int, int]:
        limit, k = self.SIZES.get((label, way), (10, 10))
        return r.limit or limit, r.k or k

    def _vector(self, label: str, r: Request, k: int) -> DataFrame:
        if not r.vector:
            raise ConfigError("the search needs a query vector")
        return vector_hits(self.store.nodes(label), r.vector, k, scale=self.scale)

    def _text(self, label: str, r: Request, k: int) -> DataFrame:
        """By the stored index if the label has one, else by a pass over its texts."""
        index = self.store.text_index(label)
        if index is None:
            return text_hits(self.store.nodes(label), r.text, k)
        return top(bm25_from_postings(*index, sanitize_text(r.text) or "").withColumnRenamed("node", "id"), k)

    def hits(self, label: str, way: str, r: Request, k: int) -> DataFrame:
        """(id, score) of nodes of the label by one of the four ways; at most 2 k rows, found at once."""
        if way == "vector":
            return held(self._vector(label, r, k))
        if way == "text":
            return held(self._text(label, r, k))
        if way == "hybrid":
            return held(merged(by_maximum(self._vector(label, r, k)), by_maximum(self._text(label, r, k))))
        if way == "terms":
            tags = self.store.edges(f"{label}-TAGGED_WITH-BusinessTerm")
            through = bridged(held(self._text(label, r, k)), held(self._text("BusinessTerm", r, k)), tags)
            return held(merged(by_maximum(self._vector(label, r, k)), through))
        raise ConfigError(f"unknown way of search {way!r}")

    def tables(self, way: str, r: Request) -> DataFrame:
        """Tables found by themselves, with all their columns."""
        limit, k = self._sizes("Table", way, r)
        hits = self.hits("Table", way, r, k)
        if way in ("hybrid", "terms"):
            hits = top(hits, limit)  # before expansion, which may drop tables
        found = context.table_context(self.store, hits.withColumnRenamed("score", "table_score"))
        return found.orderBy(F.desc("table_score"), "table_id").limit(limit)

    def tables_by_columns(self, way: str, r: Request) -> DataFrame:
        """Tables of the columns found, by mean score, with the found columns only."""
        limit, k = self._sizes("Column", way, r)
        hits = self.hits("Column", way, r, k)
        scores = held(rolled_up(hits, self.store.edges("Table-HAS_COLUMN-Column"))).withColumnRenamed("score", "column_avg_score")
        found = context.table_context(self.store, scores, columns=hits.select("id"))
        return found.orderBy(F.desc("column_avg_score"), "table_id").limit(limit)

    def tables_by_schemas(self, r: Request) -> DataFrame:
        """Tables of the schemas found that are nearly as similar as their schema."""
        limit, k = self._sizes("Schema", "vector", r)
        similarity = cosine_to("embedding", r.vector)
        score = unit_score(similarity) if self.scale == "unit" else similarity
        near = within_parent(held(self._vector("Schema", r, k)), self.store.edges("Schema-HAS_TABLE-Table"), self.store.nodes("Table"), score)
        found = context.table_context(self.store, near.select("id", F.col("score").alias("table_score"), F.col("parent_score").alias("schema_score")))
        return found.orderBy(F.desc("schema_score"), F.desc("table_score"), "table_id").limit(limit)

    def metrics(self, way: str, r: Request) -> DataFrame:
        """Metrics found; the domain filter comes after the candidates are cut and normalised."""
        limit, k = self._sizes("Metric", way, r)
        hits = self.hits("Metric", way, r, k)
        found = context.metric_context(self.store, hits.withColumnRenamed("score", "metric_score"), domain=r.domain)
        return found.orderBy(F.desc("metric_score"), "metric_id").limit(limit)

    def strategy(self, label: str) -> str | None:
        """The best way the graph allows: terms, hybrid, vector, text, or none."""
        have = self.store.indexes()
        vector, text = (label, "VECTOR") in have, (label, "FULLTEXT") in have
        if label not in ("Table", "Column", "Metric"):  # schemas are found by vector only
            return "vector" if vector else None
        tagged = vector and text and ("BusinessTerm", "FULLTEXT") in have
        return "terms" if tagged else "hybrid" if vector and text else "vector" if vector else "text" if text else None
