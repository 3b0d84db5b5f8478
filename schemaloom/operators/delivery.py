"""Messages delivered more than once.

An identifier that ends in digits is taken as a producer's sequence: the text before
the digits and their width name the producer, the digits are the number.  What is stored per producer is a set of
disjoint ranges of seen numbers, so a producer that counts without gaps costs one
row however many messages it sends.  A number is accepted once, if no range
covers it, and the ranges are merged.  All other identifiers are malformed and
resolved by exact keyed lookup.  (prefix, width, number) determines the identifier, so the
two ways agree with equality of identifiers.

Ranges are cut at multiples of ``BUCKET`` so that covering is an equi-join on the
bucket plus a comparison, and a busy producer spreads over many tasks.

:class:`Acceptance` walks the deliveries in order of arrival and keeps its state as
files: the ranges are written anew after each step, the keys are appended.  A whole
table is walked in ``STEPS`` steps of consecutive delivery ids, so batches stay
together and late batches meet what earlier ones left.

Defined results: a NULL in either part of the identifier is no identity, so the
row is always accepted and never stored; identifiers compare exactly, letter case
included; ties in arrival order do not occur since delivery ids are unique, a NULL
delivery id counts as the last; empty batches leave the state as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.materialize import discard, materialize

MAX_DIGITS = 18
BUCKET = 1 << 16
#: Steps in which a whole table is walked.
STEPS = 3
_SEQUENCE = rf"^((?s:.*?))([0-9]{{1,{MAX_DIGITS}}})$"
RANGES = "log_name string, producer string, bucket bigint, lo bigint, hi bigint"
SEEN = "log_name string, insert_id string"


def parse_identifiers(df: DataFrame) -> DataFrame:
    """Adds producer and number; both NULL where the identifier is no sequence."""
    head, digits = (F.regexp_extract("insert_id", _SEQUENCE, k) for k in (1, 2))
    sequence = F.length(digits) > 0
    return df.withColumns({"producer": F.when(sequence, F.concat_ws("#", head, F.length(digits))), "number": F.when(sequence, digits.cast("bigint"))})


def first_copies(batch: DataFrame) -> DataFrame:
    """Per identity the smallest delivery id and the number of copies; map tasks pre-aggregate, so a hot message is one row each."""
    keyed = batch.filter("insert_id is not null and log_name is not null")
    return parse_identifiers(keyed.groupBy("log_name", "insert_id").agg(F.min("delivery_id").alias("kept_id"), F.count("*").alias("copies")))


def merge_ranges(ranges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Disjoint maximal ranges of ``ranges`` and the single ``numbers``, per producer and bucket."""
    single = numbers.select("log_name", "producer", F.floor(F.col("number") / BUCKET).cast("bigint").alias("bucket"), F.col("number").alias("lo"), F.col("number").alias("hi"))
    w = Window.partitionBy("log_name", "producer", "bucket").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.unionByName(single).withColumn("opens", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int"))
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy("log_name", "producer", "bucket", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _known(firsts: DataFrame, ranges: DataFrame, seen: DataFrame) -> DataFrame:
    """``firsts`` with ``known``: whether a range covers the number, or the key of a malformed identifier was seen."""
    n = firsts.filter("producer is not null").alias("n")
    r = ranges.alias("r")
    covered = (F.col("n.log_name") == F.col("r.log_name")) & (F.col("n.producer") == F.col("r.producer")) & (F.col("n.bucket") == F.col("r.bucket")) & F.col("n.number").between(F.col("r.lo"), F.col("r.hi"))
    # ranges are disjoint, so a number meets at most one
    numbered = n.join(r, covered, "left").select("n.*", F.col("r.lo").isNotNull().alias("known"))
    keys = ["log_name", "insert_id"]
    plain = firsts.filter("producer is null").join(seen.withColumn("hit", F.lit(True)), keys, "left")
    return numbered.unionByName(plain.withColumn("known", F.coalesce("hit", F.lit(False))).drop("hit"))


def accept_batch(batch: DataFrame, ranges: DataFrame | None = None, seen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Decide one batch against the state, as plans.

    ``accepted`` (log_name, insert_id, kept_id, copies) are the messages seen for the first time,
    ``repeated`` those an earlier batch had; ``ranges`` and ``seen`` are the next state.
    :class:`Acceptance` does this with stored state.
    """
    spark = batch.sparkSession
    ranges = spark.createDataFrame([], RANGES) if ranges is None else ranges
    seen = spark.createDataFrame([], SEEN) if seen is None else seen
    decided = _known(_bucketed(batch), ranges, seen)
    new = decided.filter("not known")
    out = ["log_name", "insert_id", "kept_id", "copies"]
    return {
        "accepted": new.select(*out),
        "repeated": decided.filter("known").select(*out),
        "ranges": merge_ranges(ranges, new.filter("producer is not null")),
        "seen": seen.unionByName(new.filter("producer is null").select("log_name", "insert_id")),
    }


def _bucketed(batch: DataFrame) -> DataFrame:
    return first_copies(batch).withColumn("bucket", F.floor(F.col("number") / BUCKET).cast("bigint"))


class Acceptance:
    """Exactly-once acceptance of batches in order of arrival, its state in files.

    ``decided`` holds a frame per batch (log_name, insert_id, kept_id, copies, producer,
    number, bucket, known); ``ranges`` are the disjoint ranges of all batches so far.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.decided: list[DataFrame] = []
        self._ranges = spark.createDataFrame([], RANGES)
        self._stored, self._new = False, None

    @property
    def ranges(self) -> DataFrame:
        """The stored ranges, after merging in the numbers of the last batch."""
        if self._new is not None:
            merged = materialize(merge_ranges(self._ranges, self._new), "ranges")
            if self._stored:
                discard(self._ranges)
            self._ranges, self._stored, self._new = merged, True, None
        return self._ranges

    @property
    def seen(self) -> DataFrame:
        """The accepted malformed identifiers."""
        out = self._spark.createDataFrame([], SEEN)
        for d in self.decided:
            out = out.unionByName(d.filter("producer is null and not known").select("log_name", "insert_id"))
        return out

    def accept(self, batch: DataFrame) -> DataFrame:
        """Decide one batch and store what it adds; its row of ``decided``."""
        decided = materialize(_known(_bucketed(batch), self.ranges, self.seen), "decided")
        self._new = decided.filter("producer is not null and not known")
        self.decided.append(decided)
        return decided

    def walk(self, messages: DataFrame, steps: int = STEPS) -> Acceptance:
        """Accept a whole table in ``steps`` runs of consecutive delivery ids."""
        rows = messages.select("delivery_id", "insert_id", "log_name")
        low, high = rows.agg(F.min("delivery_id"), F.max("delivery_id")).first()
        if low is None:
            self.accept(rows)
            return self
        width = max(1, -(-(high - low + 1) // steps))
        starts = range(low, high + 1, width)
        for start in starts:
            part = F.col("delivery_id").between(start, start + width - 1)
            self.accept(rows.filter(part | F.col("delivery_id").isNull() if start == starts[-1] else part))
        return self

    def _all(self) -> DataFrame:
        out = self.decided[0]
        for d in self.decided[1:]:
            out = out.unionByName(d)
        return out

    def accepted(self) -> DataFrame:
        """(log_name, insert_id, kept_id, copies): each message once, with all its copies."""
        keys = ["log_name", "insert_id"]
        whole = self._all()
        again = whole.filter("known").groupBy(*keys).agg(F.sum("copies").alias("more"))
        return whole.filter("not known").join(again, keys, "left").select(*keys, "kept_id", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))

    def surplus(self, messages: DataFrame) -> DataFrame:
        """(kept_id, dropped_id): each accepted message with each of its other deliveries.

        Only messages with more than one copy are joined back.  Their keys lie in a file of
        one row per message, so a hot message is split under adaptive execution.
        """
        keys = ["log_name", "insert_id"]
        whole = self._all()
        several = whole.filter("known or copies > 1").select(*keys)
        kept = materialize(whole.filter("not known").join(several, keys, "left_semi").select(*keys, "kept_id"), "kept")
        return messages.select("delivery_id", *keys).join(kept, keys).filter("delivery_id > kept_id").select("kept_id", F.col("delivery_id").alias("dropped_id"))


def accepted_messages(messages: DataFrame, *, steps: int = STEPS) -> DataFrame:
    """(log_name, insert_id, kept_id, copies) of all messages of a table, walked in order of arrival."""
    return Acceptance(messages.sparkSession).walk(messages, steps).accepted()


def surplus_deliveries(messages: DataFrame, *, steps: int = STEPS) -> DataFrame:
    """(kept_id, dropped_id) of a table, walked in order of arrival."""
    return Acceptance(messages.sparkSession).walk(messages, steps).surplus(messages)
