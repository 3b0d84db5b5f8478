"""Most similar vectors for every vector: cells of a coarse codebook, scanned by four-bit codes, then reranked exactly.

Vectors are compared by cosine, so they are scaled to length one and the search is
for the largest inner product.

* A coarse codebook (spherical k-means, in two steps) cuts the collection into cells of
  about ``CELL_ROWS`` rows; the number of cells grows with the collection.
* Each row has codes of four bits for every ``SUB`` numbers of its residual, fitted with
  the anisotropic loss: the part of the error parallel to the vector, which is what
  falsifies the largest inner products, counts ``ETA`` times the orthogonal part.
* A query scans the codes of the ``PROBES`` cells nearest to it.  A row is a candidate
  if its scanned score reaches the k-th best of the cell less ``MARGIN`` standard errors
  of that row's code.  There is no number of candidates: rows that the codes cannot tell
  apart, such as a thousand near-duplicates, all are candidates.
* Candidates get their exact similarity, and the best of them are the answer.
* A scan serves both sides: each scanned row also keeps its best queries, so a
  pair is found if either vector scans the other's cell.

The codebooks are fitted on at most ``SAMPLE`` rows, chosen by hash; every row is
indexed and every row is a query.  The centres are broadcast; ``CENTRE_BYTES`` bounds
them, which is reached beyond forty million vectors; from there on cells grow.  Rows of
a cell are dealt into blocks of ``BLOCK`` rows and so are the queries that scan it, so a
dense cell becomes many equal tasks.  Bit-identical directions are searched once and
expanded afterwards, so a third of all rows being one vector costs one row.

Defined results: NULL vectors, wrong lengths, NULL, NaN or infinite numbers and
zero vectors take no part on either side; similarities are rounded to 9 decimals,
ties go to the smaller id; fewer than k other vectors give fewer rows; an empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.materialize import materialize

#: Rows that codebooks are fitted on: ``PER_CENTRE`` for a centre, at least ``LEAST_SAMPLE``, at most ``SAMPLE``.
LEAST_SAMPLE, SAMPLE, PER_CENTRE = 20_000, 400_000, 8
CELL_ROWS = 160
#: Bytes of all centres together.
CENTRE_BYTES = 1 << 26
PROBES = 24
BLOCK = 4096
ETA = 3.0
#: Numbers that share one code of four bits.
SUB = 2
MARGIN = 2.0
#: Rows of the sample that the codewords are fitted on.
CODE_SAMPLE = 6_000


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, label, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), x[rng.choice(len(x), k)])
    return centres


def assign_codes(x: np.ndarray, residual: np.ndarray, words: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes of least anisotropic loss, one run of numbers at a time, the others fixed."""
    n, m = len(x), len(words)
    parts, xs = residual.reshape(n, m, SUB), x.reshape(n, m, SUB)
    codes = np.stack([((parts[:, j, None] - words[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    error = parts - words[np.arange(m), codes]
    along = (error * xs).sum(2)
    for _ in range(sweeps):
        for j in range(m):
            others = along.sum(1) - along[:, j]
            e = parts[:, j, None] - words[j]
            parallel = (e * xs[:, j, None]).sum(2)
            loss = (e**2).sum(2) + (ETA - 1) * (others[:, None] + parallel) ** 2
            codes[:, j] = loss.argmin(1)
            along[:, j] = np.take_along_axis(parallel, codes[:, j : j + 1], 1)[:, 0]
    return codes


def fit_words(x: np.ndarray, residual: np.ndarray, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Codewords that solve the anisotropic least squares for the current codes, in turn with the codes."""
    n, d = x.shape
    m = d // SUB
    parts = residual.reshape(n, m, SUB)
    words = np.stack([parts[rng.choice(n, 16, replace=n < 16), j] for j in range(m)])
    for _ in range(3):
        near = np.stack([((parts[:, j, None] - words[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
        for j in range(m):
            for c in range(16):
                if (near[:, j] == c).any():
                    words[j, c] = parts[near[:, j] == c, j].mean(0)
    for _ in range(rounds):
        codes = assign_codes(x, residual, words, 1)
        at = (np.arange(m) * 16 + codes)[:, :, None] * SUB + np.arange(SUB)
        z = np.zeros((n, m * 16 * SUB), np.float32)
        np.put_along_axis(z, at.reshape(n, -1), x.astype(np.float32), 1)
        count = np.bincount(at.ravel(), minlength=z.shape[1]).astype(np.float64)
        lhs = np.diag(count + 1e-6) + (ETA - 1) * (z.T @ z)
        rhs = np.bincount(at.ravel(), residual.ravel(), z.shape[1]) + (ETA - 1) * (z.T @ (x * residual).sum(1).astype(np.float32))
        words = np.linalg.solve(lhs, rhs).reshape(m, 16, SUB)
    return words


def cell_count(n: int, d: int) -> int:
    """Cells for ``n`` vectors of ``d`` numbers: in proportion, as far as ``CENTRE_BYTES`` go."""
    return int(max(1, min(n // CELL_ROWS, CENTRE_BYTES // (4 * d))))


def fit(x: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centres of about so many cells from a sample ``x`` of unit vectors: k-means of groups, then within them.

    Centres that (nearly) coincide are one.
    """
    rng = np.random.default_rng(seed)
    cells = min(cells, max(1, len(x) // PER_CENTRE))
    groups = spherical_kmeans(x, max(1, round(cells**0.5)), rng)
    label = (x @ groups.T).argmax(1)
    parts = []
    for g in range(len(groups)):
        own = x[label == g]
        if len(own):
            centres = spherical_kmeans(own, max(1, min(len(own), round(cells * len(own) / len(x)))), rng)
            parts.append(centres[~np.tril(centres @ centres.T >= 1 - 1e-6, -1).any(1)])
    return np.concatenate(parts).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte; an odd last one alone."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def unpack_codes(packed: np.ndarray, m: int) -> np.ndarray:
    codes = np.empty((len(packed), 2 * packed.shape[1]), np.intp)
    codes[:, ::2], codes[:, 1::2] = packed & 15, packed >> 4
    return codes[:, :m]


def decode(codes: np.ndarray, centre: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The coded rows: their centre plus a word for every code."""
    return centre + words[np.arange(len(words)), codes].reshape(len(codes), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _unit(raw: pd.Series, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, d).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or the least if there are fewer."""
    k = min(k, scores.shape[1])
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _first_k(owner: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each owner: by score, then the smaller id."""
    order = np.lexsort((other, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.array([], np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k]


def candidates(q: np.ndarray, x: np.ndarray, coded: np.ndarray, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places that the scan cannot rule out of either side's k best; ``same`` marks pairs of one vector.

    The product with the decoded rows is the sum of the table entries that a scan of
    codes looks up; a matrix product is the fast way to have them all.
    """
    scores = (q.astype(np.float32) @ coded.T.astype(np.float32)).astype(np.float32)
    scores[same] = -4
    # the error of a product with a unit vector, as far as its direction is not the error's
    margin = (MARGIN * np.linalg.norm(x - coded, axis=1) / np.sqrt(x.shape[1])).astype(np.float32)
    hit = scores >= _kth(scores, k)[:, None] - margin
    hit |= scores >= _kth(scores.T, k) - margin
    hit[same] = False
    return np.nonzero(hit)


def _search_block(d: int, k: int, books):
    empty = {"id": np.array([], np.int64), "other": np.array([], np.int64), "score": np.array([], np.float64)}

    def search(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame(empty)
        centres, words = books.value
        qi, xi = q["id"].to_numpy(), x["x_id"].to_numpy()
        qu, xu = _unit(q["raw"], d), _unit(x["x_raw"], d)
        packed = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), -1)
        coded = decode(unpack_codes(packed, len(words)), centres[key[0]], words)
        found = []
        step = max(1, 2_000_000 // len(x))
        for s in range(0, len(q), step):
            i, j = candidates(qu[s : s + step], xu, coded, k, qi[s : s + step, None] == xi)
            # one product of all costs less than one for each candidate
            found.append((i + s, j, np.rint((qu[s : s + step] @ xu.T)[i, j] * 1e9)))
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        asked, scanned = _first_k(qi[i], score, xi[j], k), _first_k(xi[j], score, qi[i], k)
        ids = np.concatenate([qi[i[asked]], xi[j[scanned]]])
        others = np.concatenate([xi[j[asked]], qi[i[scanned]]])
        return pd.DataFrame({"id": ids, "other": others, "score": np.concatenate([score[asked], score[scanned]]) / 1e9})

    return search


def _encode(d: int, books):
    def encode(parts):
        import hashlib

        centres, words = books.value
        probes = min(PROBES, len(centres))
        for pdf in parts:
            if not len(pdf):
                continue
            x = _unit(pdf["raw"], d)
            near = x.astype(np.float32) @ centres.T
            order = _best(near, probes)
            home = near.argmax(1)
            # among equally near centres the probes may be others
            order[~(order == home[:, None]).any(1), 0] = home[~(order == home[:, None]).any(1)]
            codes = pack_codes(assign_codes(x, x - centres[home], words))
            digest = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x + 0.0]
            yield pd.DataFrame({"id": pdf["id"], "raw": pdf["raw"], "codes": [c.tobytes() for c in codes], "digest": digest, "home": home.astype(np.int32), "probes": [sorted(int(c) for c in p) for p in order]})

    return encode


def usable(df: DataFrame, vec_id: str, embedding: str, d: int) -> DataFrame:
    """(id, raw): the vectors that take part, as little-endian float32 bytes."""
    v = F.col(embedding)
    fine = v.isNotNull() & (F.size(v) == d) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)

    def pack(parts):
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "raw": [np.asarray(e, np.float32).tobytes() for e in pdf["v"]]})

    return df.filter(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).mapInPandas(pack, "id bigint, raw binary")


def nearest(df: DataFrame, vec_id: str, embedding: str, *, k: int = 5, d: int = 64) -> DataFrame:
    """(id, other, score): the k most similar other vectors of every usable vector."""
    rows = materialize(usable(df, vec_id, embedding, d), "vectors")
    n = rows.count()
    nothing = df.sparkSession.createDataFrame([], "id bigint, other bigint, score double")
    if n < 2:
        return nothing
    wanted = min(SAMPLE, max(LEAST_SAMPLE, PER_CENTRE * cell_count(n, d)))
    share = min(1.0, wanted / n)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("id").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.orderBy("id").limit(1).toPandas()
    x = _unit(sample["raw"], d)
    centres = fit(x, cell_count(n, d))
    few = x[np.random.default_rng(1).permutation(len(x))[:CODE_SAMPLE]]
    words = fit_words(few, few - centres[(few.astype(np.float32) @ centres.T).argmax(1)], np.random.default_rng(0)).astype(np.float32)
    books = df.sparkSession.sparkContext.broadcast((centres, words))
    coded = materialize(rows.mapInPandas(_encode(d, books), "id bigint, raw binary, codes binary, digest binary, home int, probes array<int>"), "coded")
    first = Window.partitionBy("digest").orderBy("id")
    twins = coded.select("digest", "id", F.row_number().over(first).alias("rn")).filter(F.col("rn") <= k + 1).groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    lead = twins.select(F.element_at("ids", 1).alias("id"), "ids")
    leads = materialize(coded.join(lead, "id"), "leads")

    sizes = leads.groupBy(F.col("home").alias("cell")).count().withColumnRenamed("count", "x_rows")
    asked = leads.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.count("*").alias("q_rows"))
    # one row per cell, bounded as the centres are
    blocks = F.broadcast(sizes.join(asked, "cell").select("cell", F.ceil(F.col("x_rows") / BLOCK).cast("int").alias("xb"), F.ceil(F.col("q_rows") / BLOCK).cast("int").alias("qb")))
    deal = lambda b, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(b)).cast("int")
    x = leads.select(F.col("home").alias("cell"), "id", "raw", "codes").join(blocks, "cell").withColumn("x_block", deal("xb", 11)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    q = leads.select(F.explode("probes").alias("cell"), "id", "raw").join(blocks, "cell").withColumn("q_block", deal("qb", 13)).withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("xb") - 1)))
    keys = ["cell", "x_block", "q_block"]
    pairs = q.select(*keys, "id", "raw").groupBy(*keys).cogroup(x.select(*keys, F.col("id").alias("x_id"), F.col("raw").alias("x_raw"), "codes").groupBy(*keys)).applyInPandas(_search_block(d, k, books), "id bigint, other bigint, score double")

    # a pair may be found from both sides; each found direction stands for its k + 1 smallest ids, each asking direction for all its rows
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    once = pairs.repartition("id").groupBy("id", "other").agg(F.max("score").alias("score"))
    top = once.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")
    others = top.join(lead.select(F.col("id").alias("other"), "ids"), "other").select("id", F.explode("ids").alias("other"), "score")
    itself = lead.filter(F.size("ids") > 1).select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("score"))
    known = others.unionByName(itself).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    answers = known.groupBy("id").agg(F.collect_list(F.struct("other", "score")).alias("found"))
    members = coded.join(twins, "digest").select(F.col("id").alias("member"), F.element_at("ids", 1).alias("id"))
    told = members.join(answers, "id").select(F.col("member").alias("id"), F.explode("found").alias("f")).select("id", "f.other", "f.score").filter("id <> other")
    return told.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")


def exact_nearest(df: DataFrame, vec_id: str, embedding: str, queries: Column, *, k: int = 5, d: int = 64) -> DataFrame:
    """(id, other, score): the true answer for the rows that ``queries`` (a condition on ``id``) names, against all rows in blocks."""
    rows = materialize(usable(df, vec_id, embedding, d), "vectors")
    asking = rows.filter(queries)
    xb, qb = max(1, -(-rows.count() // BLOCK)), max(1, -(-asking.count() // BLOCK))
    deal = lambda b, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    q = asking.select("id", "raw", deal(qb, 13).alias("q_block"), every(xb).alias("x_block"))
    x = rows.select(F.col("id").alias("x_id"), F.col("raw").alias("x_raw"), deal(xb, 11).alias("x_block")).withColumn("q_block", every(qb))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        qi, xi = q["id"].to_numpy(), x["x_id"].to_numpy()
        found = []
        if len(q) and len(x):
            xu = _unit(x["x_raw"], d)
            for s in range(0, len(q), 256):
                score = np.rint(_unit(q["raw"].iloc[s : s + 256], d) @ xu.T * 1e9)
                score[qi[s : s + 256, None] == xi] = -4e9
                i, j = np.nonzero(score >= np.maximum(_kth(score, k), -3e9)[:, None])
                keep = _first_k(qi[s + i], score[i, j], xi[j], k)
                found.append(pd.DataFrame({"id": qi[s + i[keep]], "other": xi[j[keep]], "score": score[i[keep], j[keep]] / 1e9}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"id": np.array([], np.int64), "other": np.array([], np.int64), "score": np.array([], np.float64)})

    pairs = q.groupBy("q_block", "x_block").cogroup(x.groupBy("q_block", "x_block")).applyInPandas(compare, "id bigint, other bigint, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")


def recall(df: DataFrame, vec_id: str, embedding: str, queries: Column, *, k: int = 5, d: int = 64) -> DataFrame:
    """One row (queries, wanted, found): pairs of the true answer for the named queries, and those of them that :func:`nearest` has."""
    true = exact_nearest(df, vec_id, embedding, queries, k=k, d=d).select("id", "other")
    found = nearest(df, vec_id, embedding, k=k, d=d).filter(queries).select("id", "other", F.lit(1).alias("hit"))
    return true.join(found, ["id", "other"], "left").agg(F.count_distinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
