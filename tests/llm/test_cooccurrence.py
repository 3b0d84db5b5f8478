import random
from itertools import combinations

from schemaloom.llm import cooccurrence as co

COLS = "q string, c string, a int, h string, items string"


def frame(spark, rows):
    return spark.createDataFrame([(q, c, 1, "x", "y") for q, c in rows], COLS)


def brute(rows):
    bags = {}
    for q, c in rows:
        if q is not None and c is not None:
            bags.setdefault(q, set()).add(c)
    n, one, two = len(bags), {}, {}
    for b in bags.values():
        for c in b:
            one[c] = one.get(c, 0) + 1
        for p in combinations(sorted(b), 2):
            two[p] = two.get(p, 0) + 1
    return n, one, two


def sample(seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *(f"q{i}" for i in range(60))]), rng.choice([None, "hot", "hot", "", *(f"c{i}" for i in range(25))])) for _ in range(900)]
    return rows + rows[:50]


def test_counts(spark):
    rows = sample()
    n, one, two = brute(rows)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, round(r.lift, 9)) for r in co.cooccurrence(frame(spark, rows), "q", "c").collect()}
    assert got == {p: (k, one[p[0]], one[p[1]], n, round(k * n / (one[p[0]] * one[p[1]]), 9)) for p, k in two.items()}


def test_thresholds_lose_nothing(spark):
    rows = [(f"q{i}", c) for i in range(200) for c in (["hot"] + (["a", "b"] if i % 10 == 0 else []) + (["c"] if i % 7 == 0 else []))]
    n, one, two = brute(rows)
    got = {(r.item_a, r.item_b) for r in co.cooccurrence(frame(spark, rows), "q", "c", min_count=5, min_lift=3).collect()}
    assert got == {p for p, k in two.items() if k >= 5 and k * n >= 3 * one[p[0]] * one[p[1]]} == {("a", "b")}


def test_wide_records_are_cut(spark, monkeypatch):
    monkeypatch.setattr(co, "PIECE", 8)
    rows = sample(2) + [("wide", f"c{i}") for i in range(25)] + [("wide", "hot"), ("wide2", "hot")] + [("wide2", f"c{i}") for i in range(20)]
    _, _, two = brute(rows)
    got = {(r.item_a, r.item_b): r.n_ab for r in co.cooccurrence(frame(spark, rows), "q", "c").collect()}
    assert got == two


def test_empty(spark):
    assert co.cooccurrence(frame(spark, []), "q", "c", min_lift=5).count() == 0
    assert co.cooccurrence(frame(spark, [(None, "a"), ("q", None), ("q", "a")]), "q", "c").count() == 0


def test_query_of_all_pairs(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(f"q{i}", c) for i in range(30) for c in (["Hot"] + (["a b"] if i % 10 == 0 else []) + (["c"] if i == 7 else []))]
    spark.createDataFrame(rows, "query_id string, column_id string").write.parquet(f"{tmp_path}/query_column_info.parquet")
    got = sorted(map(tuple, entry.queries()["p2_counts"](spark, str(tmp_path)).collect()))
    assert got == [("a_b", "hot", 3, 3, 30, 30, 1.0), ("c", "hot", 1, 1, 30, 30, 1.0)]
