"""Text search: sanitising queries, tokens, BM25 over several fields.

Scores follow BM25 (Robertson & Zaragoza 2009) with k1 = 1.2 and b = 0.75; a
document's score is the sum over its fields, query words are alternatives.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from schemaloom.materialize import materialize

# The characters that query syntax reserves; each becomes a blank.
RESERVED = '+-&|!(){}[]^"~*?:\\'
K1, B = 1.2, 0.75
_WORD = "[a-z0-9]+"


def sanitize(text: Column | str) -> Column:
    """Reserved characters become blanks, outer white space goes, nothing left is NULL."""
    c = F.col(text) if isinstance(text, str) else text
    blanked = F.regexp_replace(c, "[" + re.escape(RESERVED) + "]", " ")
    return F.nullif(F.regexp_replace(blanked, r"^\s+|\s+$", ""), F.lit(""))


def sanitize_text(text: str | None) -> str | None:
    """The same for one query on the driver."""
    cleaned = re.sub("[" + re.escape(RESERVED) + "]", " ", text or "").strip()
    return cleaned or None


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(f"({_WORD})"), 0)


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(_WORD, (query or "").lower())))


def bm25(nodes: DataFrame, node_id: str, fields: list[str], query: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, *keep, score) of the nodes that have a query word.

    One pass over the texts: it counts words, writes the rows that have a query word, and
    its statistics (documents, mean length, frequency per word) are observed on the way.
    The scores are a projection of the written rows.
    """
    words = query_words(query)
    if not words:
        return nodes.select(node_id, *keep, F.lit(0.0).alias("score")).limit(0)
    # a word must occur as a text before it is counted as a word
    lower = [F.col(f"x_{i}") for i in range(len(fields))]
    whole = lambda i, w: F.when(F.contains(lower[i], F.lit(w)), F.regexp_count(lower[i], F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))).otherwise(0)
    counted = nodes.select(node_id, *keep, *[F.lower(F.col(f)).alias(f"x_{i}") for i, f in enumerate(fields)]).select(
        node_id, *keep,
        *[F.regexp_count(x, F.lit(_WORD)).alias(f"l_{i}") for i, x in enumerate(lower)],
        *[F.when(lower[i].isNotNull(), whole(i, w)).alias(f"tf_{i}_{k}") for i in range(len(fields)) for k, w in enumerate(words)],
    )
    every = [(i, k) for i in range(len(fields)) for k in range(len(words))]
    seen = Observation()
    observed = counted.observe(
        seen,
        *[F.count(f"l_{i}").alias(f"n_{i}") for i in range(len(fields))],
        *[F.avg(f"l_{i}").alias(f"dl_{i}") for i in range(len(fields))],
        *[F.count_if(F.col(f"tf_{i}_{k}") > 0).alias(f"df_{i}_{k}") for i, k in every],
    )
    hits = materialize(observed.filter(F.greatest(F.lit(0), *[F.col(f"tf_{i}_{k}") for i, k in every]) > 0), "text-hits")
    stats = seen.get
    score = F.lit(0.0)
    for i, k in every:
        n, mean, df = stats[f"n_{i}"], stats[f"dl_{i}"] or 1.0, stats[f"df_{i}_{k}"]
        long = F.lit(1 - B) + F.col(f"l_{i}") * F.lit(B / mean)
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        c = F.col(f"tf_{i}_{k}")
        score = score + F.coalesce(F.when(c > 0, idf * c * (K1 + 1) / (c + F.lit(K1) * long)), F.lit(0.0))
    return hits.select(node_id, *keep, score.alias("score"))


def postings(nodes: DataFrame, node_id: str, fields: list[str]) -> DataFrame:
    """(word, field, node, tf, length): the text index, to be written once and clustered by word."""
    parts = [nodes.select(F.col(node_id).alias("node"), F.lit(f).alias("field"), tokens(f).alias("t")).filter("t is not null") for f in fields]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    each = whole.select("node", "field", F.size("t").alias("length"), F.explode("t").alias("word"))
    return each.groupBy("word", "field", "node", "length").agg(F.count("*").cast("int").alias("tf"))


def bm25_from_postings(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(node, score) from a written index; ``stats`` has (field, n, mean_length).

    The words' filter reaches the scan, so only their postings are read.
    """
    words = query_words(query)
    hits = index.filter(F.col("word").isin(words))
    df = hits.groupBy("word", "field").agg(F.count("*").alias("df"))
    joined = hits.join(df, ["word", "field"]).join(stats, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return joined.groupBy("node").agg(F.sum(part).alias("score"))


def field_stats(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, mean_length) for :func:`bm25_from_postings`; one pass."""
    row = nodes.agg(*[x for i, f in enumerate(fields) for x in (F.count(tokens(f)).alias(f"n_{i}"), F.avg(F.size(tokens(f))).alias(f"m_{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("mean_length")) for i, f in enumerate(fields)])).alias("s")).select("s.*")
