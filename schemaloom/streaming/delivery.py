"""Exactly-once acceptance of a stream of deliveries.

The state of a producer is its disjoint ranges of seen numbers; an identifier that is
no sequence has a state of its own, a flag.  State is keyed by producer and bucket of
numbers, so a busy producer spreads over partitions.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.delivery import BUCKET, parse_identifiers


def cover(los: list[int], his: list[int], number: int) -> bool:
    """Add a number to sorted disjoint ranges in place; False if it was covered."""
    i = bisect_right(los, number)
    if i and his[i - 1] >= number:
        return False
    left, right = i > 0 and his[i - 1] == number - 1, i < len(los) and los[i] == number + 1
    if left and right:
        his[i - 1] = his[i]
        del los[i], his[i]
    elif left:
        his[i - 1] = number
    elif right:
        los[i] = number
    else:
        los.insert(i, number)
        his.insert(i, number)
    return True


def _accept(key, parts, state):
    los, his = state.get if state.exists else ([], [])
    los, his = list(los), list(his)
    for pdf in parts:
        pdf = pdf.sort_values("delivery_id")
        keep = [cover(los, his, int(n)) for n in pdf["number"]]
        yield pdf.loc[keep, ["delivery_id", "insert_id", "log_name"]]
    state.update((los, his))


def accept_stream(deliveries: DataFrame) -> DataFrame:
    """The accepted deliveries (delivery_id, insert_id, log_name) of a stream; rows without identity are left to the caller."""
    known = parse_identifiers(deliveries.filter("insert_id is not null and log_name is not null"))
    number = F.coalesce("number", F.lit(0))
    keyed = known.select("delivery_id", "insert_id", "log_name", F.coalesce("producer", F.concat(F.lit("="), "insert_id")).alias("producer"), number.alias("number"), F.floor(number / BUCKET).cast("bigint").alias("bucket"))
    out = "delivery_id bigint, insert_id string, log_name string"
    return keyed.groupBy("log_name", "producer", "bucket").applyInPandasWithState(_accept, out, "los array<bigint>, his array<bigint>", "append", "NoTimeout")


def ingest_stream(batches: DataFrame, load, checkpoint: str):
    """Run ``load(frame, batch_id)`` for every micro-batch, e.g. an upsert into a store; ends when the input is used up."""
    return batches.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

