"""Mixing sources to target weights with Pfair scheduling.

A source's draws form a stream of blocks of ``block_tokens`` tokens.  Block i of a
source with weight w may start at floor(i / w) and is due at ceil((i + 1) / w), in
slots of one block; the earliest deadline goes first.  At every slot each source
is then within one block of its exact share.

Weights are exact fractions.  The timeline is cut into frames of as many slots as their
common denominator, or of ``FRAME`` slots if that is less; the blocks of a source up to
the end of frame k are its exact share of the slots, rounded.  So every frame is a
schedule of its own, made by a task, and where it starts is arithmetic; the schedule
has a row per block and is never on the driver.  If the denominator is at most
``FRAME`` no share needs rounding, and each source stays within one block; else a source
with weight w among n is within 1.5 + w * n / 2 blocks at any slot, and what is drawn in
all is exact either way.

The total drawn is the largest at which no source has to repeat a document more
often than its cap.  The weights are the target shares over the sources that have
tokens; the report shows them beside the targets.

A document's place in its source's stream is a running sum of tokens in random
order, once per repetition.  The sum is taken in two steps, within buckets of
hashed ids and over the buckets' totals, so a source with a third of all rows is
spread over many tasks.

Defined results: documents without tokens or with a NULL source, or of a source
without a positive target or repeat count, are not drawn; a target without
documents is reported with share 0; targets named twice add up and keep the
smaller cap; repeated rows of one document are documents of their own; without any
usable source nothing is drawn.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.tokens import VOCABULARY, token_count
from schemaloom.materialize import materialize

#: Most slots of a frame.
FRAME = 10_000
BLOCK_TOKENS = 4096
#: Documents of a running-sum bucket, on average.
BUCKET = 5_000


def exact_weights(shares: list[float]) -> list[Fraction]:
    """The shares as fractions of their sum, each taken as the decimal number it is written as."""
    exact = [Fraction(str(s)) for s in shares]
    return [f / sum(exact) for f in exact]


def frame_slots(weights: list[Fraction], most: int = FRAME) -> int:
    """Slots of a frame: the weights' common denominator, or ``most``."""
    return min(most, lcm(*[w.denominator for w in weights]))


def blocks_before(weights: list[Fraction], frame: int, slots: int) -> list[int]:
    """Blocks of each source before a frame: the exact shares of the slots so far, rounded half up; never falls."""
    return [(2 * w.numerator * frame * slots + w.denominator) // (2 * w.denominator) for w in weights]


@lru_cache(maxsize=64)
def pfair_order(counts: tuple[int, ...]) -> list[tuple[int, int]]:
    """(source, block) by slot for a frame of so many blocks of each source: among the released ones the earliest deadline first."""
    total = sum(counts)
    done, out = [0] * len(counts), []
    for slot in range(total):
        released = [s for s, n in enumerate(counts) if done[s] < n and done[s] * total // n <= slot]
        s = min(released, key=lambda s: (-(-(done[s] + 1) * total // counts[s]), -counts[s], s))
        out.append((s, done[s]))
        done[s] += 1
    return out


def schedule(spark, sources: list[str], weights: list[Fraction], frames: int) -> DataFrame:
    """(source, block, slot) of the first ``frames`` frames."""
    slots = frame_slots(weights)

    def run(parts):
        for pdf in parts:
            for k in pdf["id"]:
                before = blocks_before(weights, int(k), slots)
                counts = tuple(b - a for a, b in zip(before, blocks_before(weights, int(k) + 1, slots), strict=True))
                order = pfair_order(counts)
                yield pd.DataFrame({"source": [sources[s] for s, _ in order], "block": [before[s] + i for s, i in order], "slot": range(sum(before), sum(before) + len(order))})

    return spark.range(frames).mapInPandas(run, "source string, block bigint, slot bigint")


def _plan(sized: DataFrame, targets: DataFrame):
    """Targets with supplies on the driver: one row per target source."""
    wanted = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    supply = sized.filter("n > 0").groupBy("source").agg(F.sum("n").alias("supply"))
    rows = wanted.join(supply, "source", "left").select("source", "share", "repeats", F.coalesce("supply", F.lit(0)).alias("supply")).orderBy("source").collect()
    usable = [r for r in rows if r.supply > 0 and (r.repeats or 0) > 0 and (r.share or 0) > 0]
    if not usable:
        return rows, [], [], 0
    weights = exact_weights([r.share for r in usable])
    total = min(r.supply * r.repeats / w for r, w in zip(usable, weights, strict=True))
    return rows, usable, weights, total


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n, at): tokens of every document, written once."""
    sized = documents.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n"))
    return materialize(sized, "sizes").withColumn("at", F.monotonically_increasing_id())


def mix(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """Draws (doc_id, source, repeat_no, n_tokens, slot, place): slot orders blocks, place orders the draws of a source."""
    return draw(sizes(documents, vocabulary), targets, block_tokens=block_tokens, seed=seed)


def draw(sized: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    spark = sized.sparkSession
    _, usable, weights, total = _plan(sized, targets)
    if not usable:
        return spark.createDataFrame([], "doc_id bigint, source string, repeat_no int, n_tokens bigint, slot bigint, place bigint")
    quota = spark.createDataFrame([(r.source, r.repeats, int(r.supply), int(total * w)) for r, w in zip(usable, weights, strict=True)], "source string, repeats int, supply bigint, quota bigint")
    frames = int(total / (block_tokens * frame_slots(weights))) + 2
    table = schedule(spark, [r.source for r in usable], weights, frames)
    buckets = max(1, -(-sized.count() // BUCKET))
    # a row per target
    docs = sized.filter("n > 0").join(F.broadcast(quota), "source")
    needed = F.least(F.col("repeats"), F.ceil(F.col("quota") / F.col("supply")).cast("int"))
    turns = docs.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), needed - 1))).withColumn("order", F.xxhash64("at", "repeat_no", F.lit(seed))).withColumn("bucket", F.shiftright("order", 16) % buckets)
    sums = turns.groupBy("source", "repeat_no", "bucket").agg(F.sum("n").alias("bucket_n"))
    over = Window.partitionBy("source", "repeat_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "repeat_no", "bucket", F.coalesce(F.sum("bucket_n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "repeat_no", "bucket").orderBy("order", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["source", "repeat_no", "bucket"])
    start = placed.withColumn("place", F.col("repeat_no") * F.col("supply") + F.col("before") + F.col("inner")).filter("place < quota")
    slotted = start.withColumn("block", F.floor(F.col("place") / block_tokens).cast("bigint")).join(table, ["source", "block"])
    return slotted.select("doc_id", "source", "repeat_no", F.col("n").alias("n_tokens"), "slot", "place")


def shares(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target source: target_share, weight among the usable sources, tokens and draws, actual_share, most repeats."""
    sized = sizes(documents, vocabulary)
    rows, usable, weights, _ = _plan(sized, targets)
    weight = {r.source: float(w) for r, w in zip(usable, weights, strict=True)}
    wanted = sized.sparkSession.createDataFrame([(r.source, r.share, weight.get(r.source, 0.0)) for r in rows], "source string, target_share double, weight double")
    drawn = draw(sized, targets, block_tokens=block_tokens, seed=seed).groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("draws"), (F.max("repeat_no") + 1).alias("most_repeats"))
    everything = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    return wanted.join(drawn, "source", "left").select(
        "source", "target_share", "weight", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("drawn_tokens", "draws", "most_repeats")], F.coalesce(F.col("drawn_tokens") / everything, F.lit(0.0)).alias("actual_share")
    )
