"""Idempotent upserts of nodes and edges.

MERGE on a key without a transactional table: a full outer join of what is stored
with the batch.  By default stored properties stay and only new keys are set
(set on create); with ``overwrite`` the batch's columns win wherever the key is in
it.  Within a batch the first row of a key holds, by the order column.

Defined results: a NULL key is no key, its row is dropped; columns that the batch
lacks are never touched; an empty batch or an empty store is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order`` (by all columns if none is given), by partial aggregation."""
    rest = [c for c in batch.columns if c not in keys]
    known = batch.filter(" and ".join(f"`{k}` is not null" for k in keys))
    if not rest:
        return known.distinct()
    by = order or rest
    row = F.min_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in by]))
    return known.groupBy(*keys).agg(row.alias("r_")).select(*keys, *[F.col(f"r_.{c}").alias(c) for c in rest])


def merge(stored: DataFrame, batch: DataFrame, keys: list[str], *, overwrite: bool = False, order: list[str] | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` after the batch; the columns of ``stored``.  ``kept`` columns are set on create only, whatever ``overwrite`` says."""
    order_only = [c for c in order or [] if c not in stored.columns]
    new = first_per_key(batch, keys, order).drop(*order_only).withColumn("new_", F.lit(True))
    old = stored.withColumn("old_", F.lit(True))
    n, o = new.alias("n"), old.alias("o")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, same, "full_outer")
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif overwrite and c not in kept:
            out.append(F.when(F.col("new_"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("old_"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*out)


def merge_labels(stored: DataFrame, batch: DataFrame, key: str, labels: str = "labels") -> DataFrame:
    """Secondary labels are added whether or not the node existed."""
    more = batch.select(F.col(key).alias("k_"), F.explode_outer(labels).alias("l_")).filter("l_ is not null").groupBy("k_").agg(F.collect_set("l_").alias("more_"))
    joined = stored.join(more, F.col(key) == F.col("k_"), "left")
    whole = F.array_sort(F.array_union(F.coalesce(labels, F.array().cast("array<string>")), F.coalesce("more_", F.array().cast("array<string>"))))
    return joined.withColumn(labels, whole).select(*stored.columns)


def existing_endpoints(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, source_key: str = "id", target_key: str = "id") -> DataFrame:
    """Edges whose two ends exist; the others are dropped."""
    s, t = sources.select(F.col(source_key).alias("s_")), targets.select(F.col(target_key).alias("t_"))
    return edges.join(s, F.col("src_id") == F.col("s_"), "left_semi").join(t, F.col("dst_id") == F.col("t_"), "left_semi")


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges that :func:`existing_endpoints` drops, with the side that is missing."""
    s, t = sources.select(F.col("id").alias("s_")).distinct(), targets.select(F.col("id").alias("t_")).distinct()
    joined = edges.join(s, F.col("src_id") == F.col("s_"), "left").join(t, F.col("dst_id") == F.col("t_"), "left")
    side = F.when(F.col("s_").isNull() & F.col("t_").isNull(), "both").when(F.col("s_").isNull(), "source").when(F.col("t_").isNull(), "target")
    return joined.withColumn("missing", side).filter("missing is not null").drop("s_", "t_")


def id_collisions(df: DataFrame, node_id: str, *raw: str) -> DataFrame:
    """Ids that stand for more than one raw name, since the id rule loses case, blanks and hyphens."""
    return df.groupBy(node_id).agg(F.count_distinct(F.struct(*raw)).alias("raw_names")).filter("raw_names > 1")
