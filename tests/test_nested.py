import json

from schemaloom.functions.type_text import member_paths
from schemaloom.operators.nested import flatten, nested_rows

AUDIT = "delivery_id bigint, proto_payload string, value string"
PAGES = "page_id bigint, payload string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_type_texts():
    assert member_paths("struct<a:int,b:struct<c:array<struct<d:date>>>>") == ("a", "b", "b.c", "b.c.d")
    assert member_paths("MAP<STRING, STRUCT<`x y`: decimal(10, 4), `a,b:c`: ARRAY<int>>>") == ("x y", "a,b:c")
    assert member_paths("STRUCT<a INT COMMENT 'x, y>' NOT NULL, b: varchar(40)>") == ("a", "b")
    assert member_paths("decimal(18,2)") == () and member_paths("") == ()
    assert member_paths("struct<a:struct<b:int") == ("a", "a.b")


def test_permissions_of_all_spellings(spark):
    entry = [{"permission": "a"}, None, {"other": 1}, {"permission": ""}, {"permission": "b"}]
    texts = [
        json.dumps({"authorizationInfo": entry}),
        json.dumps({"authorizationInfo": {"permission": "c"}}),
        json.dumps({"authorizationInfo": json.dumps(entry)}),
        json.dumps(json.dumps({"authorizationInfo": json.dumps({"permission": "d"})})),
        json.dumps({"authorizationInfo": entry})[:-4],
        json.dumps({"authorizationInfo": entry}) + " tail",
        None,
        "",
        json.dumps({"authorizationInfo": "no json"}),
        json.dumps({"authorizationinfo": entry}),
    ]
    audit = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], AUDIT)
    got = rows(nested_rows(audit, spark.createDataFrame([], PAGES)))
    want = [("permission", i, -1, p, v) for i, p, v in [(0, 0, "a"), (0, 4, "b"), (1, 0, "c"), (2, 0, "a"), (2, 4, "b"), (3, 0, "d")]]
    assert got == sorted(want)


def test_columns_and_fields(spark):
    page = {"tables": [{"columns": [{"name": "x", "type_text": "struct<a:int,b:array<struct<c:int>>>"}, {"type_text": "int"}]}, {"columns": {"name": "y", "type_text": None}}, 5, {"columns": json.dumps([{"name": "z"}])}]}
    pages = spark.createDataFrame([(1, json.dumps(page)), (1, json.dumps(page)), (2, json.dumps({"tables": json.dumps(page["tables"][1])}))], PAGES)
    got = rows(nested_rows(spark.createDataFrame([], AUDIT), pages))
    one = [("column", 1, 0, 0, "x"), ("field", 1, 0, 0, "x.a"), ("field", 1, 0, 0, "x.b"), ("field", 1, 0, 0, "x.b.c"), ("column", 1, 1, 0, "y"), ("column", 1, 3, 0, "z")]
    assert got == sorted([*one, *one, ("column", 2, 0, 0, "y")])


def test_flatten_infers_and_links(spark):
    docs = [{"a": 1, "items": [{"n": "x", "tags": [{"t": "p"}, {"t": "q"}]}, {"n": "y"}]}, {"a": 2, "o": {"deep": "v"}, "items": []}, {"id": 7}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id bigint, payload string")
    levels = flatten(df, "id", "payload")
    assert set(levels) == {"", "items", "items.tags"}
    root = levels[""].table()
    assert {"id", "a", "o.deep", "id_value"} <= set(root.columns)
    assert rows(levels["items"].table(members={"n": ("n",)}).drop("row_key")) == [(0, 0, "x"), (0, 1, "y")]
    assert rows(levels["items.tags"].table().drop("row_key")) == [(0, 0, 0, "p"), (0, 0, 1, "q")]


def test_wanted_paths_that_are_never_lists(spark):
    only = {"tables": {"columns": json.dumps({"name": "x", "type_text": "struct<a:int>"})}}
    pages = spark.createDataFrame([(1, json.dumps(only))], PAGES)
    audit = spark.createDataFrame([(1, json.dumps({"authorizationInfo": {"permission": "p"}}), ""), (2, json.dumps({"authorizationInfo": {"permission": "q"}}), "")], AUDIT)
    assert rows(nested_rows(audit, pages)) == [("column", 1, 0, 0, "x"), ("field", 1, 0, 0, "x.a"), ("permission", 1, -1, 0, "p"), ("permission", 2, -1, 0, "q")]


def tables(spark, *docs):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id bigint, payload string")
    return {p: x.table().drop("row_key") for p, x in flatten(df, "id", "payload").items()}


def test_texts_within_texts_are_opened_to_any_depth(spark):
    text = json.dumps({"items": [{"n": 1}]})
    for _ in range(6):
        text = json.dumps(text)
    escaped = '{"items": [{"n": 2}]}'
    for _ in range(9):
        escaped = '"' + escaped.replace("\\", "\\u005c").replace('"', "\\u0022") + '"'
    assert rows(tables(spark, text, escaped)["items"]) == [(0, 0, "1"), (1, 0, "2")]


def test_any_member_name(spark):
    doc = {"it's": {"x": [{"a": "1"}]}, 'sa"id': [{"b": "2"}], "it's \"both\"": [{"c": {"": "3"}}], "ba`ck": [{"b`": "7"}], "dot.ted": "4", "dot": {"ted": "5"}, "ID": "6"}
    got = tables(spark, doc)
    assert set(got) == {"", "it's.x", 'sa"id', "it's \"both\"", "ba`ck"} and rows(got["ba`ck"]) == [(0, 0, "7")]
    assert rows(got["it's.x"]) == [(0, 0, "1")] and rows(got['sa"id']) == [(0, 0, "2")] and rows(got["it's \"both\""]) == [(0, 0, "3")]
    assert sorted(got[""].first()[1:]) == ["4", "5", "6"]


def test_lists_of_scalars_of_lists_and_as_records(spark):
    got = tables(spark, {"tags": ["a", "b", None]}, {"grid": [[1, 2], [], [{"x": "y"}]]}, [{"k": "v"}, ["w"]])
    assert [tuple(r) for r in got["tags"].orderBy("pos_0").collect()] == [(0, 0, "a"), (0, 1, "b"), (0, 2, None)]
    assert sorted(map(tuple, got["grid.[]"].select("id", "pos_0", "pos_1", "x", "value").collect()), key=str) == [(1, 0, 0, None, "1"), (1, 0, 1, None, "2"), (1, 2, 0, "y", None)]
    assert [tuple(r) for r in got["[]"].select("id", "pos_0", "k").orderBy("pos_0").collect()] == [(2, 0, "v"), (2, 1, None)]
    assert [tuple(r) for r in got["[].[]"].collect()] == [(2, 1, 0, "w")]


def test_equal_records_have_keys_of_their_own(spark):
    doc = json.dumps({"items": [{"n": 1}]})
    df = spark.createDataFrame([(1, doc), (1, doc), (None, doc)], "id bigint, payload string")
    assert flatten(df, "id", "payload")["items"].table().select("row_key").distinct().count() == 3


def test_deep_types():
    n = 5000
    deep = "struct<a:" * n + "int" + ">" * n
    assert len(member_paths(deep)) == n
    assert member_paths("struct<>") == () and member_paths("struct<a:array<>,b:int,>") == ("a", "b")


def test_empty_tables(spark):
    out = nested_rows(spark.createDataFrame([], AUDIT), spark.createDataFrame([], PAGES))
    assert out.count() == 0 and out.columns == ["record_kind", "record_id", "parent_pos", "child_pos", "child_path"]
