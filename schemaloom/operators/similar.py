"""The k most similar rows for many query vectors in one job, exactly.

Queries and rows are dealt into blocks of ``BLOCK`` by a hash of their ids, and every
block of queries meets every block of rows in a task of its own, which holds one
matrix product and passes on k rows per query; so a task's size is fixed and the
number of tasks grows with queries times rows.

Defined results: NULL vectors and those of another length, with NULL or with norm 0
take no part on either side; ties go to the smaller id; a row is no answer to itself
where query and row ids are equal; empty inputs give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _usable(df: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    v = F.col(vector)
    fine = (F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))


def most_similar(rows: DataFrame, queries: DataFrame, key: str, vector: str, *, k: int = 10, d: int = 64) -> DataFrame:
    """(id, other, score): for every query the k rows of greatest cosine, rounded to 9 decimals."""
    x, q = _usable(rows, key, vector, d), _usable(queries, key, vector, d)
    xb, qb = max(1, -(-x.count() // BLOCK)), max(1, -(-q.count() // BLOCK))
    deal = lambda b: F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    dealt = q.select("id", "v", deal(qb).alias("q"), every(xb).alias("x")), x.select(F.col("id").alias("other"), F.col("v").alias("w"), deal(xb).alias("x")).withColumn("q", every(qb))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        unit = lambda c: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(c.to_numpy()))
        out = []
        if len(q) and len(x):
            x = x.sort_values("other")
            others, w = x["other"].to_numpy(), unit(x["w"])
            for s in range(0, len(q), 256):
                ids = q["id"].to_numpy()[s : s + 256]
                score = np.round(unit(q["v"].iloc[s : s + 256]) @ w.T, 9)
                score[ids[:, None] == others] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                found = pd.DataFrame({"id": np.repeat(ids, best.shape[1]), "other": others[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
                out.append(found[np.isfinite(found["score"])])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": np.array([], np.int64), "other": np.array([], np.int64), "score": np.array([], float)})

    pairs = dealt[0].groupBy("q", "x").cogroup(dealt[1].groupBy("q", "x")).applyInPandas(compare, "id bigint, other bigint, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")
