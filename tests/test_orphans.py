import datetime as dt

from pyspark.sql import functions as F

from schemaloom.operators.orphans import lifetimes, orphan_counts, orphan_references

T = [dt.datetime(2025, m, 1) for m in range(1, 13)]
REFS = "ref_table string, ref_id bigint, key string, ref_time timestamp_ntz, start string"
PARENTS = "key string, start timestamp_ntz, end timestamp_ntz, ref_id int"


def found(spark, refs, parents):
    r = spark.createDataFrame([("t", i, k, t, "clash") for i, (k, t) in enumerate(refs)], REFS)
    p = spark.createDataFrame([(k, s, e, 1) for k, s, e in parents], PARENTS)
    return sorted((x.ref_id, x.ref_month, x.orphan_kind) for x in orphan_references(r, p).collect())


def test_kinds(spark):
    parents = [("a", T[1], T[3]), ("a", T[5], None), ("a", T[5], None), ("b", T[2], T[2]), ("c", None, None), (None, T[0], None)]
    refs = [("a", T[0]), ("a", T[1]), ("a", T[3]), ("a", T[5]), ("b", T[2]), ("b", T[1]), ("x", T[4]), (None, T[4]), ("c", T[0]), ("x", None), ("a", None)]
    assert found(spark, refs, parents) == [(0, "2025-01", "late"), (2, "2025-04", "deleted"), (4, "2025-03", "deleted"), (5, "2025-02", "late"), (6, "2025-05", "missing"), (9, None, "missing"), (10, None, "late")]


def test_overlaps_merge(spark):
    rows = [("a", T[0], T[4]), ("a", T[2], T[6]), ("a", T[6], T[7]), ("a", T[9], T[10])]
    p = spark.createDataFrame([(k, s, e, 1) for k, s, e in rows], PARENTS)
    life = lifetimes(p, "key", "start", "end").first()
    assert [(x.s, x.e) for x in life.life] == [(T[0], T[7]), (T[9], T[10])] and life.first_end == T[4]


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pick = lambda: None if rng.random() < 0.1 else rng.choice(T)
    key = lambda: rng.choice(["hot"] * 5 + list("abcdef"))
    parents = [(key(), rng.choice(T), pick()) for _ in range(40)]
    refs = [(key(), rng.choice(T)) for _ in range(200)]
    want = []
    for i, (k, t) in enumerate(refs):
        own = [(s, e) for kk, s, e in parents if kk == k]
        if not any(s <= t and (e is None or e > t) for s, e in own):
            want.append((i, f"{t:%Y-%m}", "missing" if not own else "deleted" if any(e is not None and e <= t for _, e in own) else "late"))
    assert found(spark, refs, parents) == sorted(want)


def test_empty_and_counts(spark):
    assert found(spark, [], [("a", T[0], None)]) == []
    assert found(spark, [("a", T[0]), ("a", T[0])], []) == [(0, "2025-01", "missing"), (1, "2025-01", "missing")]
    r = spark.createDataFrame([("t", 1, "a", T[0], ""), ("t", 2, "b", T[0], ""), ("t", 3, "b", None, "")], REFS)
    p = spark.createDataFrame([("a", T[0], None, 1)], PARENTS)
    assert sorted((x.ref_month or "", x.n_refs, x.n_missing) for x in orphan_counts(r, p).collect()) == [("", 1, 1), ("2025-01", 2, 1)]


def test_terms_without_glossary_or_category_are_missing(spark, sf, tmp_path):
    import os

    import __spark_entry__ as entry

    for t in ("column_info", "column_references_info", "query_column_info", "business_term_info"):
        os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    links = spark.read.parquet(f"{sf}/column_term_info.parquet")
    time = dt.datetime(2025, 3, 1)
    rows = [(1, None, "c", "Some Term", time), (2, "g", None, "Some Term", time), (3, None, None, None, time)]
    links.unionByName(spark.createDataFrame(rows, "link_id bigint, glossary_name string, category_name string, term_name string, tagged_at timestamp").withColumn("link_id", F.col("link_id") + 10**9), allowMissingColumns=True).write.parquet(f"{tmp_path}/column_term_info.parquet")
    found = entry.queries()["p3_found"](spark, str(tmp_path)).filter(f"ref_id > {10**9}")
    assert sorted(map(tuple, found.collect())) == [("column_term_info", 10**9 + k, "2025-03", "missing") for k in (1, 2)]
