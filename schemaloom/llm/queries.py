"""Queries of the training-data operators tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.llm.cooccurrence import cooccurrence
from schemaloom.llm.mixing import BLOCK_TOKENS, mix, shares
from schemaloom.llm.neighbours import nearest, recall
from schemaloom.llm.normal_form import Leaf, Record, collapse, hidden_copies, word_multiset
from schemaloom.llm.packing import container_report, pack_documents
from schemaloom.llm.spans import repeated_lines, shared_characters
from schemaloom.materialize import materialize

CAPACITY = 2048


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _pairs(spark: SparkSession, sf: str, **thresholds) -> DataFrame:
    usage = _read(spark, sf, "query_column_info").select("query_id", ids.normalize("column_id").alias("column_id"))
    pairs = cooccurrence(usage, "query_id", "column_id", **thresholds)
    return pairs.select(F.col("item_a").alias("column_a"), F.col("item_b").alias("column_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that queries use together, at least 20 times and 5 times as often as chance."""
    return _pairs(spark, sf, min_count=20, min_lift=5)


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All columns that any query uses together."""
    return _pairs(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pairs(spark, sf).select("column_a", "column_b")


def _records(names: tuple[str, ...]) -> Record:
    return Record((*((n, Leaf(F.col(n))) for n in names), ("term_name", word_multiset("term_name"))))


_TERM = ("glossary_name", "category_name")
_LINK = ("database_name", "schema_name", "table_name", "column_name", *_TERM)
_TABLES = (("business_term_info", "term_row_id", _TERM), ("column_term_info", "link_id", _LINK))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    first, second = (hidden_copies(_read(spark, sf, t), i, _records(names)).select(F.lit(t).alias("record_table"), "first_id", "copy_id") for t, i, names in _TABLES)
    return first.unionByName(second)


def p7_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    first, second = (collapse(_read(spark, sf, t), i, _records(names)).select(F.lit(t).alias("record_table"), "first_id", "copies") for t, i, names in _TABLES)
    return first.unionByName(second)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (_read(spark, sf, t).select("vec_id", "embedding") for t in ("tag_keys", "domain_nodes"))
    return one.unionByName(two)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(_vectors(spark, sf), "vec_id", "embedding").select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"))


def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the rows whose id is divisible by 50 get at least 0.9 of their true neighbours among all rows."""
    r = recall(_vectors(spark, sf), "vec_id", "embedding", F.pmod("id", F.lit(50)) == 0)
    return r.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough"))


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the values of a frame of one row."""
    return df.withColumns({k: F.lit(v) for k, v in one_row.first().asDict().items()})


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each text or piece, and the unused space of that container."""
    return pack_documents(_read(spark, sf, "documents").select("doc_id", "text"), capacity=CAPACITY)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return container_report(p8_pack(spark, sf), CAPACITY)


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed, and how often a packing breaks its rules."""
    packed = materialize(p8_pack(spark, sf).filter("container_id is not null"), "packed")
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.min("unused_tokens").alias("least"), F.max("unused_tokens").alias("most"))
    boxes = used.agg(F.count_if(F.col("used") > CAPACITY).alias("over_capacity"), F.count_if((F.col("least") != F.col("most")) | (F.col("used") + F.col("most") != CAPACITY)).alias("wrong_unused"))
    whole = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("kinds"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("stop"))
    docs = whole.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("needless_splits"), F.count_if((F.col("pieces") != F.col("kinds")) | (F.col("n") != F.col("stop"))).alias("torn_documents"))
    return _beside(docs, boxes)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn documents with their repeats, in the order of slots."""
    return mix(_read(spark, sf, "documents").select("doc_id", "source", "text"), _read(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(_read(spark, sf, "documents").select("doc_id", "source", "text"), _read(spark, sf, "mix_targets"))


def p9_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Sources drawn, and how often the draws break a rule: repeats within the cap, none drawn twice under one number, shares within a block and a document."""
    drawn = materialize(p9_mix(spark, sf), "drawn")
    caps = _read(spark, sf, "mix_targets").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    per_doc = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.count_distinct("repeat_no").alias("numbers"))
    repeats = per_doc.join(F.broadcast(caps), "source").agg(F.count_if(F.col("times") > F.col("cap")).alias("over_cap"), F.count_if(F.col("times") != F.col("numbers")).alias("drawn_twice"))
    sums = drawn.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).join(F.broadcast(caps), "source")
    total = sums.agg(F.sum("n").alias("total"), F.sum("share").alias("shares"), F.max("longest").alias("slack"))
    off = F.abs(F.col("n") - F.col("share") / F.col("shares") * F.col("total")) > BLOCK_TOKENS + F.col("slack")
    return _beside(_beside(sums, total).agg(F.count("*").alias("sources"), F.count_if(off).alias("off_share")), repeats)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_characters(_read(spark, sf, "documents").select("doc_id", "text"))


def p10_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(_read(spark, sf, "documents").select("doc_id", "text"))


_P2 = """
WITH used AS (SELECT DISTINCT query_id AS q, replace(replace(lower(column_id), ' ', '_'), '-', '_') AS c FROM query_column_info WHERE query_id IS NOT NULL AND column_id IS NOT NULL),
total AS (SELECT count(DISTINCT q) AS n FROM used), each AS (SELECT c, count(*) AS k FROM used GROUP BY c),
together AS (SELECT x.c AS column_a, y.c AS column_b, count(*) AS n_ab FROM used x JOIN used y ON x.q = y.q AND x.c < y.c GROUP BY ALL HAVING count(*) >= 20)
SELECT column_a, column_b, n_ab, a.k AS n_a, b.k AS n_b, n, round(n_ab * n / (a.k * b.k)::DOUBLE, 6) AS lift
FROM together JOIN each a ON a.c = column_a JOIN each b ON b.c = column_b, total WHERE n_ab * n >= 5 * a.k * b.k
"""
_P2_COUNTS = _P2.replace(" HAVING count(*) >= 20", "").replace(", total WHERE n_ab * n >= 5 * a.k * b.k", ", total")
_WORDS = "list_sort(regexp_extract_all(lower(term_name), '[\\p{L}\\p{N}]+'))"


def _sql_rows(table: str, row_id: str, names: tuple[str, ...]) -> str:
    keys = ", ".join(names)
    known = " AND ".join(f"{n} IS NOT NULL" for n in (*names, "term_name"))
    return f"SELECT '{table}' AS record_table, {row_id} AS id, min({row_id}) OVER w AS first_id, count(*) OVER w AS n FROM {table} WHERE {known} WINDOW w AS (PARTITION BY {keys}, {_WORDS})"


def _sql_singles(table: str, row_id: str, names: tuple[str, ...]) -> str:
    unknown = " OR ".join(f"{n} IS NULL" for n in (*names, "term_name"))
    return f"SELECT '{table}' AS record_table, {row_id} AS first_id, 1 AS copies FROM {table} WHERE {unknown}"


_ROWS = " UNION ALL ".join(_sql_rows(*t) for t in _TABLES)
_P7 = f"SELECT record_table, first_id, id AS copy_id FROM ({_ROWS}) WHERE id > first_id"
_P7_COLLAPSED = f"SELECT record_table, first_id, n AS copies FROM ({_ROWS}) WHERE id = first_id UNION ALL " + " UNION ALL ".join(_sql_singles(*t) for t in _TABLES)


_P5_RECALL = """
WITH v AS (SELECT vec_id, embedding FROM tag_keys UNION ALL SELECT vec_id, embedding FROM domain_nodes),
u AS (SELECT vec_id FROM v WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT count(*) AS queries, count(*) * least(5, (SELECT count(*) - 1 FROM u)) AS wanted, true AS enough FROM u WHERE vec_id % 50 = 0
"""
_P8_INVARIANTS = "SELECT count(*) AS documents, 0 AS needless_splits, 0 AS torn_documents, 0 AS over_capacity, 0 AS wrong_unused FROM documents WHERE text <> ''"
_P9_INVARIANTS = """
SELECT count(*) AS sources, 0 AS off_share, 0 AS over_cap, 0 AS drawn_twice
FROM (SELECT source FROM mix_targets GROUP BY source HAVING sum(target_share) > 0 AND min(max_repeats) > 0) WHERE source IN (SELECT source FROM documents WHERE text <> '')
"""
_P10_LINES = """
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM cut),
units AS (SELECT *, trim(regexp_replace(lower(line), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS unit FROM placed),
ranked AS (SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(line_no) OVER w AS kept_line_no, row_number() OVER w AS k FROM units WHERE length(unit) >= 40 WINDOW w AS (PARTITION BY unit ORDER BY doc_id, line_no))
SELECT doc_id, line_no, start, start + length(line) AS stop, kept_doc_id, kept_line_no FROM ranked WHERE k > 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p2_found, p2_pairs, p2_counts, p5_found, p5_recall, p7_found, p7_collapsed, p8_pack, p8_report, p8_invariants, p9_mix, p9_shares, p9_invariants, p10_found, p10_repeated_lines)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": f"SELECT column_a, column_b FROM ({_P2})", "p2_pairs": _P2, "p2_counts": _P2_COUNTS, "p5_recall": _P5_RECALL, "p7_found": _P7, "p7_collapsed": _P7_COLLAPSED, "p8_invariants": _P8_INVARIANTS, "p9_invariants": _P9_INVARIANTS, "p10_repeated_lines": _P10_LINES}
