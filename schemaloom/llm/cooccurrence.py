"""Items that appear together: a blocked Gram matrix over baskets.

Baskets are rows of a sparse binary matrix X.  The pair counts are the upper
triangle of X'X, summed over blocks of records: each block gives a sparse partial
Gram matrix in numpy, whose entries Spark adds up with map-side aggregation.
Records wider than ``PIECE`` items are cut into item pieces, and every pair of
pieces is a block of its own, so one record that names most items spreads over
many tasks instead of filling one.

Items are 64-bit hashes inside the computation; a dictionary gives the names back
and proves that no two names share a hash.  With a least lift the items that are
in more than n / lift records can be left out beforehand without losing a pair,
since n_ab <= min(n_a, n_b); there are fewer than lift * (mean width) of them.

Defined results: rows with a NULL record or item do not count; repeated rows count
once; an item makes no pair with itself; empty tables give no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.materialize import counted, materialize

#: Most items of a basket row; wider baskets become several pieces.
PIECE = 256
#: Pairs of one partial Gram matrix before its entries are summed and passed on.
BLOCK_PAIRS = 1_500_000


def baskets(df: DataFrame, record: str, item: str) -> DataFrame:
    """(record, pieces, piece, items): each record's distinct items as sorted hashes, cut into pieces.

    Records of more than ``PIECE`` rows are set apart first, by counts that aggregate before their shuffle; the
    others are then gathered with one shuffle, and no task holds a wide one whole.
    """
    rows = df.filter(F.col(item).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.xxhash64(F.col(item)).alias("h"))
    wide, n = counted(rows.groupBy("record").count().filter(F.col("count") > PIECE).select("record"), "wide")
    narrow = rows if not n else rows.join(wide, "record", "left_anti")
    items = F.array_sort(F.collect_list("h")).alias("items")
    whole = narrow.repartition("record").distinct().groupBy("record").agg(items)
    out = whole.select("record", F.lit(1).alias("pieces"), F.lit(0).alias("piece"), "items")
    if not n:
        return out
    # both sides of either join lie in files or are plain shuffles, so a record with a third of all rows is split
    pairs = materialize(rows.join(wide, "record", "left_semi").distinct(), "wide-pairs")
    widths = materialize(pairs.groupBy("record").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")), "widths")
    cut = pairs.join(widths, "record").withColumn("piece", F.pmod("h", "pieces").cast("int"))
    return out.unionByName(cut.groupBy("record", "pieces", "piece").agg(items))


def _sum_block(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    left, right = np.concatenate(a), np.concatenate(b)
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    keys, counts = np.unique(at[: len(left)] * len(names) + at[len(left) :], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names[keys // len(names)]), pa.array(names[keys % len(names)]), pa.array(counts)], ["a", "b", "c"])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _gram(left_out: np.ndarray):
    """Partial Gram matrices of whole baskets (one list column ``items``)."""

    def blocks(batches):
        a, b, held = [], [], 0
        for batch in batches:
            values, offsets = _lists(batch.column(0))
            kept = ~np.isin(values, left_out)
            before = np.concatenate([[0], np.cumsum(kept)])
            starts = before[offsets[:-1]]
            widths = before[offsets[1:]] - starts
            values = values[kept]
            for w in np.unique(widths[widths > 1]):
                i, j = np.triu_indices(w, 1)
                rows = starts[widths == w]
                step = max(1, BLOCK_PAIRS // len(i))
                for s in range(0, len(rows), step):
                    matrix = values[rows[s : s + step, None] + np.arange(w)]
                    a.append(matrix[:, i].ravel())
                    b.append(matrix[:, j].ravel())
                    held += a[-1].size
                    if held >= BLOCK_PAIRS:
                        yield _sum_block(a, b)
                        a, b, held = [], [], 0
        if held:
            yield _sum_block(a, b)

    return blocks


def _gram_of_pieces(left_out: np.ndarray):
    """Partial Gram matrices of pairs of pieces (``x``, ``y``); equal pieces give their own triangle."""

    def blocks(batches):
        a, b, held = [], [], 0
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in (x, y))
                x, y = x[~np.isin(x, left_out)], y[~np.isin(y, left_out)]
                i, j = np.triu_indices(len(x), 1) if np.array_equal(x, y) else (g.ravel() for g in np.indices((len(x), len(y))))
                if not len(i):
                    continue
                a.append(np.minimum(x[i], y[j]))
                b.append(np.maximum(x[i], y[j]))
                held += len(i)
                if held >= BLOCK_PAIRS:
                    yield _sum_block(a, b)
                    a, b, held = [], [], 0
        if held:
            yield _sum_block(a, b)

    return blocks


def cooccurrence(df: DataFrame, record: str, item: str, *, min_count: int = 1, min_lift: float | None = None) -> DataFrame:
    """Pairs (item_a < item_b) with n_ab, n_a, n_b, n and lift = n_ab * n / (n_a * n_b).

    Only pairs with n_ab >= ``min_count`` and, if given, lift >= ``min_lift`` come out.
    """
    bags = materialize(baskets(df, record, item), "baskets")
    n = bags.filter("pieces = 1").count() + bags.filter("pieces > 1").select("record").distinct().count()
    totals = bags.select(F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("n_item"))
    left_out = np.array([], np.int64)
    if min_lift is not None:
        left_out = np.array([r.h for r in totals.filter(F.col("n_item") * min_lift > n).select("h").collect()], np.int64)
    kind = "a bigint, b bigint, c bigint"
    narrow = bags.filter("pieces = 1").select("items").mapInArrow(_gram(left_out), kind)
    frequent = totals.filter(F.col("n_item") >= min_count).select("h")
    wide = bags.filter("pieces > 1").select("record", "piece", F.explode("items").alias("h")).join(frequent, "h").groupBy("record", "piece").agg(F.array_sort(F.collect_list("h")).alias("items"))
    x, y = wide.select("record", F.col("piece").alias("p"), F.col("items").alias("x")), wide.select("record", F.col("piece").alias("q"), F.col("items").alias("y"))
    blocks = x.join(y, "record").filter("p <= q").select("x", "y").repartition(F.xxhash64("x", "y"))
    pairs = narrow.unionByName(blocks.mapInArrow(_gram_of_pieces(left_out), kind))
    gram = pairs.groupBy("a", "b").agg(F.sum("c").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    named = df.select(F.xxhash64(F.col(item)).alias("h"), F.col(item).cast("string").alias("name")).filter("name is not null").groupBy("h").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two items share a hash: "), "name", F.lit(" and "), "other"))
    items = totals.join(named, "h").select("h", "n_item", F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(clash.cast("string")).alias("name"))
    one, two = (items.select(F.col("h").alias(k), F.col("n_item").alias(f"n_{k}"), F.col("name").alias(f"name_{k}")) for k in "ab")
    swapped = F.col("name_a") > F.col("name_b")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    out = gram.join(one, "a").join(two, "b")
    if min_lift is not None:
        out = out.filter(F.col("n_ab") * n >= min_lift * F.col("n_a") * F.col("n_b"))
    return out.select(
        pick("name_a", "name_b").alias("item_a"),
        pick("name_b", "name_a").alias("item_b"),
        "n_ab",
        pick("n_a", "n_b").alias("n_a"),
        pick("n_b", "n_a").alias("n_b"),
        F.lit(n).cast("bigint").alias("n"),
        (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
    )
