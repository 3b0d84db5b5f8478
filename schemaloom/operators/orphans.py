"""References to records that do not exist, at the time of the reference.

A reference (table, id, key, time) is an orphan if no parent row with its key is
alive at its time.  The plan has two parts:

1. the distinct non-null foreign keys are anti-joined against the distinct
   parent keys: what remains is ``missing`` at any time;
2. each other key gets its lifetime, the disjoint union of its rows' intervals,
   and the references are joined back once, on the key, to one row per key.

Both the distinct and the lifetimes pre-aggregate before their shuffle, so a key
that holds a third of all references is one row per map task in part 1.  For part 2
what is known of each key is written to files first: then both sides of the join are
plain shuffles, which is what lets adaptive execution split the hot key's references.

Defined results: a NULL key is no reference; a NULL reference time is alive in no
interval, so such a row is ``late`` (or ``missing``) with a NULL month; a parent
row with NULL start has always existed; rows that end at or before their start
are never alive but count as ended; repeated references each count, repeated
parent rows change nothing; empty tables give an empty result or all ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.materialize import materialize

_FIRST = "0001-01-01 00:00:00"


def _merge_intervals(intervals: Column) -> Column:
    """Sorted disjoint intervals of an array<struct<s,e>> (``e`` NULL: open)."""
    kind = "array<struct<s:timestamp_ntz,e:timestamp_ntz>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.when(last["e"].isNull() | x["e"].isNull(), None).otherwise(F.greatest(last["e"], x["e"])).alias("e"))
        touches = (F.size(acc) > 0) & (last["e"].isNull() | (x["s"] <= last["e"]))
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(intervals), F.array().cast(kind), add)


def lifetimes(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, life, first_end): per key its disjoint living intervals and its earliest end.

    Equal rows collapse before the shuffle; rows that start in the same month are
    merged first, so the last step sees a key's months, not its rows.
    """
    s = F.coalesce(F.col(start).cast("timestamp_ntz"), F.lit(_FIRST).cast("timestamp_ntz"))
    rows = parents.select(F.col(key).alias("key"), s.alias("s"), F.col(end).cast("timestamp_ntz").alias("e")).filter(F.col("key").isNotNull()).distinct()
    living = F.when(F.col("e").isNull() | (F.col("e") > F.col("s")), F.struct("s", "e"))
    month = rows.groupBy("key", F.date_trunc("month", "s").alias("m")).agg(_merge_intervals(F.collect_list(living)).alias("life"), F.min("e").alias("first_end"))
    return month.groupBy("key").agg(_merge_intervals(F.flatten(F.collect_list("life"))).alias("life"), F.min("first_end").alias("first_end"))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan rows (ref_table, ref_id, ref_month, orphan_kind).

    ``refs`` has (ref_table, ref_id, key, ref_time), ``parents`` (key, start, end).
    """
    refs = refs.select("ref_table", "ref_id", "key", F.col("ref_time").cast("timestamp_ntz").alias("ref_time")).filter(F.col("key").isNotNull())
    keys = refs.select("key").distinct()
    life = lifetimes(parents, "key", "start", "end")
    missing = keys.join(life, "key", "left_anti").select("key", F.lit(True).alias("missing"), F.lit(None).cast("array<struct<s:timestamp_ntz,e:timestamp_ntz>>").alias("life"), F.lit(None).cast("timestamp_ntz").alias("first_end"))
    known = life.join(keys, "key", "left_semi").select("key", F.lit(False).alias("missing"), "life", "first_end")
    t = F.col("ref_time")
    alive = F.exists("life", lambda x: (x["s"] <= t) & (x["e"].isNull() | (x["e"] > t)))
    kind = F.when(F.col("missing"), "missing").when(F.coalesce(F.col("first_end") <= t, F.lit(False)), "deleted").otherwise("late")
    joined = refs.join(materialize(missing.unionByName(known), "lifetimes"), "key")
    return joined.filter(F.col("missing") | ~F.coalesce(alive, F.lit(False))).select("ref_table", "ref_id", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), kind.alias("orphan_kind"))


def orphan_counts(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References, orphans by kind and share per table and month."""
    orphans = orphan_references(refs, parents).groupBy("ref_table", "ref_month").agg(*[F.count_if(F.col("orphan_kind") == k).alias(f"n_{k}") for k in ("missing", "deleted", "late")])
    month = F.date_format(F.col("ref_time").cast("timestamp_ntz"), "yyyy-MM").alias("ref_month")
    totals = refs.filter(F.col("key").isNotNull()).groupBy("ref_table", month).agg(F.count("*").alias("n_refs"))
    same = (totals.ref_table == orphans.ref_table) & totals.ref_month.eqNullSafe(orphans.ref_month)
    n = [F.coalesce(orphans[f"n_{k}"], F.lit(0)).alias(f"n_{k}") for k in ("missing", "deleted", "late")]
    return totals.join(orphans, same, "left").select(totals.ref_table, totals.ref_month, "n_refs", *n)
