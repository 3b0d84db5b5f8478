from pyspark.sql import functions as F

from schemaloom.llm.normal_form import Each, Leaf, Multiset, Record, collapse, digest, folded, hidden_copies, map_entries, word_multiset

COLS = "id bigint, g string, t string, digest string, tree string"


def frame(spark, rows):
    return spark.createDataFrame([(i, g, t, "x", "y") for i, g, t in rows], COLS)


def node():
    return Record((("g", Leaf(F.col("g"))), ("t", word_multiset("t"))))


ROWS = [(3, "a", "Net Loss"), (1, "a", " loss, NET!"), (2, "b", "net loss"), (4, "a", None), (5, "a", None), (6, "a", "net net loss"), (7, "a", "„Net–Loss“"), (8, None, "net loss"), (9, None, "net loss"), (10, "a", ""), (11, "a", "--"), (12, "a", "netloss")]


def test_hidden_copies(spark):
    assert sorted(map(tuple, hidden_copies(frame(spark, ROWS), "id", node()).collect())) == [(1, 3), (1, 7), (10, 11)]


def test_collapse_counts_all(spark):
    got = dict(map(tuple, collapse(frame(spark, ROWS), "id", node()).collect()))
    assert got == {1: 3, 2: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 2, 12: 1}
    assert collapse(frame(spark, []), "id", node()).count() == 0 == hidden_copies(frame(spark, []), "id", node()).count()


def test_field_and_child_order(spark):
    df = spark.createDataFrame([(["x", "y"], "A. b", "c"), (["y", "x"], " a  B", "c"), (["x", "x", "y"], "a b", "c")], "l array<string>, s string, r string")
    one = Record((("l", Multiset(F.col("l"))), ("s", folded("s")), ("r", Leaf(F.col("r")))))
    two = Record((("r", Leaf(F.col("r"))), ("s", folded("s")), ("l", Multiset(F.col("l")))))
    rows = df.select(digest(one).alias("a"), digest(two).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[0].a == rows[1].a != rows[2].a


def test_hot_group_and_long_texts(spark):
    long = "word " * 50_000
    rows = [(i, "a", long if i % 3 == 0 else f"t{i}") for i in range(60)]
    got = hidden_copies(frame(spark, rows), "id", node()).collect()
    assert sorted(r.copy_id for r in got) == list(range(3, 60, 3)) and {r.first_id for r in got} == {0}


def test_nested_records_maps_and_order(spark):
    kind = "id bigint, items array<struct<n:string,tags:array<string>>>, m map<string,string>, steps array<string>"
    rows = [
        (1, [("A b", ["x", "Y"]), ("c", [])], {"k": "v", "l": "w"}, ["p", "q"]),
        (2, [("C", []), ("a  B.", ["y", "x"])], {"l": "W", "k": "v!"}, ["P", "q"]),
        (3, [("C", []), ("a  B.", ["y", "x"])], {"l": "W", "k": "v!"}, ["q", "p"]),
        (4, [("C", []), ("a  B.", ["y", "x", "x"])], {"l": "W", "k": "v!"}, ["p", "q"]),
        (5, [("C", []), (None, ["y"])], {"l": "W"}, ["p", "q"]),
        (6, [("C", []), (None, ["y"])], {"l": "W"}, ["p", "q"]),
        (7, None, {}, []),
        (8, [], {}, []),
        (9, [], {}, []),
        (10, [("c", [None])], {}, []),
        (11, [("c", [None])], {}, []),
    ]
    item = lambda x: Record((("n", folded(x["n"])), ("tags", Each(x["tags"], folded))))
    tree = Record((("items", Each(F.col("items"), item)), ("m", map_entries(F.col("m"), folded)), ("steps", Each(F.col("steps"), folded, ordered=True))))
    assert sorted(map(tuple, hidden_copies(spark.createDataFrame(rows, kind), "id", tree).collect())) == [(1, 2), (8, 9)]


def test_equal_digests_of_different_trees_are_told_apart(spark, monkeypatch):
    from schemaloom.llm import normal_form

    monkeypatch.setattr(normal_form, "digest", lambda node: F.lit("d"))
    assert sorted(map(tuple, hidden_copies(frame(spark, ROWS), "id", node()).collect())) == [(1, 3), (1, 7), (10, 11)]
    got = dict(map(tuple, collapse(frame(spark, ROWS), "id", node()).collect()))
    assert got == {1: 3, 2: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 2, 12: 1}
