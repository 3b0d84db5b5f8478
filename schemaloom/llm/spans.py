"""Long exact spans shared between records.

Units are hashed, digests grouped globally, the earliest occurrence kept, and the
rest removed with their offsets.  :func:`repeated_lines` does this for lines.  A
passage can begin and end inside a line, so for passages of at least ``length``
characters the units are cut by content instead:

* Each window of ``length`` characters owns the smallest hash of the ``GRAM``-long
  pieces in it (shorter ones for small lengths), its anchor.  Equal windows have equal anchors at equal offsets.
  Consecutive windows with one anchor form a unit, about one per 50 characters.
* Anchors that only one document has are dropped; most units go here.
* Units with equal anchor, digest and text in two documents are shared whole.
* What is left are units at the edges of shared passages: their single windows are
  compared with those of all units of the same anchor, by offset, digest and text.

Every shared window is found and only those.  Texts move once, and only those of documents with a shared anchor
(picked by a bitmap of fixed size; where it fills up, more texts move than need to).
No step pairs up the members of a group: groups are reduced to their smallest and
largest document, with map-side aggregation, and joined from files, so that
adaptive execution can split a hot anchor.  Anchors with more than ``HOT`` different
units are compared window by window in Spark instead of one task, there by two
digests of 64 bits beside anchor and offset.

Defined results: NULL texts and texts shorter than ``length`` share nothing; a
passage repeated only within one document is not shared; characters are code
points; rows with equal document ids are one document; empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.materialize import discard, materialize

GRAM = 64
#: Lengths of passages; offsets in a unit are kept in 16 bits.
MIN_LENGTH, MAX_LENGTH = 8, 60_000
#: Characters hashed at once; also the longest stretch of one text.
STRETCH = 1 << 20
#: Different units of an anchor that one task compares.
HOT = 20_000
_PLACE = np.uint64((1 << 24) - 1)
# Odd multipliers of public 64-bit mixing functions.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]), np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)])


def _prefix(points: np.ndarray, base: np.uint64 = _M1) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and inverse powers, for digests of any stretch in two steps."""
    n = len(points)
    power, inverse = _powers(int(base), 1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix((points.astype(np.uint64) + np.uint64(7)) * _M3) * power[:n], out=sums[1:])
    return sums, inverse


def _gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from each place on; the last places are void."""
    sums, inverse = _prefix(points)
    n = max(0, len(points) - size + 1)
    out = np.full(len(points), ~np.uint64(0))
    out[:n] = _mix((sums[size:] - sums[:n]) * inverse[:n])
    return out


def _digest(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, inverse = prefix
    return _mix((sums[end] - sums[start]) * inverse[start]).view(np.int64)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of the ``w`` values from each place on; the last places are void."""
    least, s = v[: len(v)], 1
    while 2 * s <= w:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if r := w - s:
        least = np.minimum(least[:-r], least[r:])
    out = v.copy()
    out[: len(least)] = least
    return out


def stretches(lengths: np.ndarray, length: int) -> list[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) of at most about ``STRETCH`` characters; parts of a long text overlap by a window less one."""
    out, held = [[]], 0
    for k, n in enumerate(lengths):
        for start in range(0, max(1, n - length + 1), STRETCH):
            end = min(n, start + STRETCH + length - 1)
            if end - start < length:
                continue
            if held and held + end - start > STRETCH:
                out.append([])
                held = 0
            out[-1].append((k, start, end))
            held += end - start
    return [b for b in out if b]


def units(texts: list[str], length: int):
    """Units of the texts by batch: (text, first window, windows, offset of the anchor in the first window, anchor)."""
    known = np.array([len(t) if t is not None else 0 for t in texts])
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    for batch in stretches(known, length):
        points = np.concatenate([_points(texts[k][a:b]) for k, a, b in batch])
        sizes = np.array([b - a for _, a, b in batch])
        ends = np.cumsum(sizes)
        hashes = _gram_hashes(points, gram)
        place = np.arange(len(points), dtype=np.uint64)
        anchor = (_sliding_min((hashes & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
        owner = np.repeat(np.arange(len(batch)), sizes)
        valid = place.astype(np.int64) + length <= ends[owner]
        change = np.ones(len(points) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[1:] | ~valid[:-1]
        first = np.flatnonzero(valid & change[:-1])
        last = np.flatnonzero(valid & change[1:])
        part = owner[first]
        shift = np.array([a for _, a, _ in batch])[part] - (ends - sizes)[part]
        yield np.array([k for k, _, _ in batch])[part], first + shift, last - first + 1, anchor[first] - first, hashes[anchor[first]].view(np.int64)


def _all_units(length: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for k, start, n, off, anchor in units(texts, length):
                packed = (start.astype(np.int64) << 32) | (n.astype(np.int64) << 16) | off
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[k].astype(np.int64)), pa.array(packed)], ["anchor", "doc", "unit"])

    return run


def _in_bitmap(bitmap, bits: int):
    def run(batches):
        seen = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            keep = (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = batch.filter(pa.array(keep.astype(bool)))
            yield out.select(out.schema.names[:-1])

    return run


def only_listed(texts: DataFrame, listed: DataFrame, key: str, *, bits: int = 25) -> DataFrame:
    """``texts`` without most rows whose key is not in ``listed``: a bitmap of 2**bits bits (4 MB) whatever the input."""
    spark = texts.sparkSession
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    bucket = listed.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("b")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("map")).collect()
    whole = bytearray(1 << (bits - 3))
    for r in bucket:
        whole[r.b << 12 : (r.b << 12) + len(r.map)] = r.map
    sent = spark.sparkContext.broadcast(bytes(whole))
    return texts.withColumn("at_", at).mapInArrow(_in_bitmap(sent, bits), texts.schema)


def _segments(length: int):
    """Digest and text of the listed units of each document."""

    def run(parts):
        for pdf in parts:
            rows: dict[str, list] = {c: [] for c in ("anchor", "seg", "doc", "start", "n", "off", "text")}
            for doc, text, listed in pdf.itertuples(index=False):
                anchor = np.fromiter((u["anchor"] for u in listed), np.int64, len(listed))
                packed = np.fromiter((u["unit"] for u in listed), np.int64, len(listed))
                start, n, off = packed >> 32, (packed >> 16) & 65535, packed & 65535
                fits = start + n + length - 1 <= len(text)
                anchor, start, n, off = anchor[fits], start[fits], n[fits], off[fits]
                low = int(start.min()) if len(start) else 0
                points = _points(text[low : int((start + n).max()) + length - 1] if len(start) else "")
                seg = _digest(_prefix(points), start - low, start - low + n + length - 1)
                rows["anchor"].extend(anchor)
                rows["seg"].extend(seg)
                rows["doc"].extend([doc] * len(start))
                rows["start"].extend(start)
                rows["n"].extend(n)
                rows["off"].extend(off)
                rows["text"].extend(text[s : s + m + length - 1] for s, m in zip(start, n, strict=True))
            yield pd.DataFrame(rows)

    return run


def _windows(pdf: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Every window of units (anchor, seg, low, high, n, off, text): place relative to the anchor, start and digest; and all characters."""
    points = _points("".join(pdf["text"]))
    n = pdf["n"].to_numpy(np.int64)
    at = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
    row = np.repeat(np.arange(len(pdf)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = at[row] + j
    return pd.DataFrame({"row": row, "j": j, "a": pdf["off"].to_numpy(np.int64)[row] - j, "start": start, "w": _digest(_prefix(points), start, start + length)}), points


def _unlike(points: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows from ``one`` on differ from those from ``two`` on."""
    out, reach = np.zeros(len(one), bool), np.arange(length)
    step = max(1, (1 << 21) // length)
    for s in range(0, len(one), step):
        out[s : s + step] = (points[one[s : s + step, None] + reach] != points[two[s : s + step, None] + reach]).any(1)
    return out


def _shared_windows(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """(anchor, seg, j): windows of single-document units that another document has; whole anchors only."""
    win, points = _windows(pdf, length)
    rows, start = win["row"].to_numpy(), win["start"].to_numpy()
    anchor = pdf["anchor"].to_numpy()[rows]
    low, high = pdf["low"].to_numpy()[rows], pdf["high"].to_numpy()[rows]
    order = np.lexsort((win["w"], win["a"], anchor))
    k = [x[order] for x in (anchor, win["a"].to_numpy(), win["w"].to_numpy())]
    new = np.ones(len(order), bool)
    new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return pd.DataFrame({"anchor": np.array([], np.int64), "seg": np.array([], np.int64), "j": np.array([], np.int64)})
    several = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
    size = np.diff(np.append(first, len(order)))
    group = np.repeat(np.arange(len(first)), size)
    inside = np.flatnonzero(several[group])
    # equal digests are only candidates: every text is compared with the first of its group
    unlike = inside[_unlike(points, start[order[inside]], start[order[first[group[inside]]]], length)]
    shared = several[group]
    for g in np.unique(group[unlike]):
        members = np.arange(first[g], first[g] + size[g])
        texts = [points[s : s + length].tobytes() for s in start[order[members]]]
        ends: dict[bytes, tuple[int, int]] = {}
        for t, i in zip(texts, order[members], strict=True):
            lo, hi = ends.get(t, (low[i], high[i]))
            ends[t] = min(lo, low[i]), max(hi, high[i])
        shared[members] = [ends[t][0] != ends[t][1] for t in texts]
    hit = order[shared]
    hit = hit[low[hit] == high[hit]]
    return pd.DataFrame({"anchor": anchor[hit], "seg": pdf["seg"].to_numpy()[rows[hit]], "j": win["j"].to_numpy()[hit]})


def _compare(length: int, rows: int = 8_000):
    """Streams over units sorted by anchor, some thousand at a time, never splitting an anchor."""

    def run(parts):
        held: list[pd.DataFrame] = []
        for pdf in parts:
            if not len(pdf):
                continue
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True) if sum(map(len, held)) >= rows else None
            if whole is None:
                continue
            closed = whole["anchor"].to_numpy() != whole["anchor"].iloc[-1]
            anchors = whole["anchor"].to_numpy()[closed]
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            at = 0
            while at < len(anchors):
                nxt = cuts[np.searchsorted(cuts, at + rows)] if len(cuts) and cuts[-1] >= at + rows else len(anchors)
                yield _shared_windows(whole.iloc[at:nxt].reset_index(drop=True), length)
                at = nxt
            held = [whole[~closed]]
        if held:
            yield _shared_windows(pd.concat(held, ignore_index=True), length)

    return run


def _hot_windows(length: int):
    def run(parts):
        for pdf in parts:
            for s in range(0, len(pdf), 4000):
                some = pdf.iloc[s : s + 4000].reset_index(drop=True)
                win, points = _windows(some, length)
                r = win["row"].to_numpy()
                second = _digest(_prefix(points, _M2), win["start"].to_numpy(), win["start"].to_numpy() + length)
                yield pd.DataFrame({"anchor": some["anchor"].to_numpy()[r], "seg": some["seg"].to_numpy()[r], "low": some["low"].to_numpy()[r], "high": some["high"].to_numpy()[r], "a": win["a"], "w": win["w"], "v": second, "j": win["j"]})

    return run


def _told_apart(found: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` and ``kinds`` with a ``seg`` that no two texts of an anchor share; nothing moves unless two do."""
    if kinds.groupBy("anchor", "seg").count().filter("count > 1").isEmpty():
        return found, kinds
    numbered = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    renamed = found.join(numbered.select("anchor", "seg", "text", "kind"), ["anchor", "seg", "text"]).drop("seg").withColumnRenamed("kind", "seg")
    return materialize(renamed, "segments"), numbered.drop("seg").withColumnRenamed("kind", "seg")


def shared_ranges(documents: DataFrame, *, length: int = 160, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, stop): character ranges made of windows that another document has; they may overlap."""
    if not MIN_LENGTH <= length <= MAX_LENGTH:
        raise ValueError(f"passages of {MIN_LENGTH} to {MAX_LENGTH} characters, not {length}")
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= length))
    all_units = materialize(docs.mapInArrow(_all_units(length), "anchor bigint, doc bigint, unit bigint"), "all-units")
    two = lambda low, high: F.col(low) != F.col(high)
    known = materialize(all_units.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter(two("low", "high")).select("anchor"), "anchors")
    listed = materialize(all_units.join(known, "anchor"), "units")
    discard(all_units)
    discard(known)
    per_doc = listed.groupBy("doc").agg(F.collect_list(F.struct("anchor", "unit")).alias("units"))
    texts = only_listed(docs, listed.select("doc"), "doc").join(per_doc, "doc").select("doc", "text", "units")
    found = materialize(texts.mapInPandas(_segments(length), "anchor bigint, seg bigint, doc bigint, start bigint, n int, off int, text string"), "segments")
    discard(listed)
    # grouped by the text itself, so that units are one kind only if they are equal
    kinds = found.groupBy("anchor", "seg", "n", "off", "text").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    found, kinds = _told_apart(found, materialize(kinds, "kinds"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("low") == F.col("high")).alias("single")).filter("single > 0 and kinds > 1")
    edges = kinds.join(materialize(mixed.select("anchor", "kinds"), "mixed"), "anchor")
    columns = ["anchor", "seg", "low", "high", "n", "off", "text"]
    usual = edges.filter(F.col("kinds") <= HOT).select(*columns).repartition("anchor").sortWithinPartitions("anchor")
    some = usual.mapInPandas(_compare(length), "anchor bigint, seg bigint, j bigint")
    windows = edges.filter(F.col("kinds") > HOT).select(*columns).mapInPandas(_hot_windows(length), "anchor bigint, seg bigint, low bigint, high bigint, a bigint, w bigint, v bigint, j bigint")
    several = windows.groupBy("anchor", "a", "w", "v").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter(two("l", "h")).select("anchor", "a", "w", "v")
    more = windows.filter("low = high").join(several, ["anchor", "a", "w", "v"], "left_semi").select("anchor", "seg", "j")
    edge = some.unionByName(more).groupBy("anchor", "seg").agg(F.collect_list("j").alias("js"))
    places = found.select("anchor", "seg", "doc", "start", "n")
    whole = places.join(kinds.filter(two("low", "high")).select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("doc", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    partial = places.join(edge, ["anchor", "seg"]).select("doc", "start", F.explode("js").alias("j")).select("doc", (F.col("start") + F.col("j")).alias("start"), (F.col("start") + F.col("j") + length).alias("stop"))
    return whole.unionByName(partial)


def _covered(pdfs):
    for pdf in pdfs:
        out = []
        for ranges in pdf["ranges"]:
            r = np.array([(x["start"], x["stop"]) for x in ranges], np.int64)
            r = r[np.argsort(r[:, 0], kind="stable")]
            reach = np.maximum.accumulate(r[:, 1])
            before = np.concatenate([[r[0, 0]], reach[:-1]])
            out.append(int(np.maximum(0, r[:, 1] - np.maximum(r[:, 0], before)).sum()))
        yield pd.DataFrame({"doc_id": pdf["doc"], "shared_chars": out})


def shared_characters(documents: DataFrame, *, length: int = 160, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shared_chars) of the documents that share a passage of at least ``length`` characters."""
    ranges = shared_ranges(documents, length=length, doc_id=doc_id, text=text)
    # a document has no more ranges than its own text has windows
    return ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).mapInPandas(_covered, "doc_id bigint, shared_chars bigint")


def _lines(batches):
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1).to_pylist()
        rows, at, start, lines = [], [], [], []
        for row, text in enumerate(texts):
            own = text.split("\n")
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            rows.append(np.full(len(own), row))
            at.append(np.arange(len(own), dtype=np.int32))
            start.append(np.concatenate([[0], ends[:-1]]).astype(np.int32))
            lines += own
        if rows:
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(at)), pa.array(np.concatenate(start)), pa.array(lines)], ["doc", "at", "start", "line"])


def line_units(documents: DataFrame, *, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, start, stop, digest): lines with their offsets; digests ignore case and white space around and between words."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    lines = docs.mapInArrow(_lines, "doc bigint, at int, start int, line string")
    normal = F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))
    return lines.select("doc", "at", "start", (F.col("start") + F.length("line")).alias("stop"), normal.alias("unit")).filter(F.length("unit") >= min_chars).select("doc", "at", "start", "stop", F.md5("unit").alias("digest"))


def repeated_lines(documents: DataFrame, *, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, start, stop, kept_doc_id, kept_line_no): lines to remove, since an earlier document or line has them."""
    lines = materialize(line_units(documents, min_chars=min_chars, doc_id=doc_id, text=text), "lines")
    first = lines.groupBy("digest").agg(F.min(F.struct("doc", "at")).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # from a file, so that the lines of a hot digest can be split
    again = lines.join(materialize(first, "first-lines"), "digest").filter(F.struct("doc", "at") > F.col("kept"))
    return again.select(F.col("doc").alias("doc_id"), F.col("at").alias("line_no"), "start", "stop", F.col("kept.doc").alias("kept_doc_id"), F.col("kept.at").alias("kept_line_no"))
