import argparse
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from schemaloom import connectors, enrichment, evalkit, ids, lineage, tool
from schemaloom.errors import ConfigError, LoadError, StateError
from schemaloom.functions.text import sanitize_text
from schemaloom.functions.vector import cosine
from schemaloom.operators import upsert
from schemaloom.plans import context as cx
from schemaloom.plans import search as se
from schemaloom.sources import catalog_json, governance, infoschema, osi, querylog, warehouses
from schemaloom.store import GraphStore

FILES = {
    "database_info": "database_name,platform,description\nShop DB,gcp,The shop\n",
    "schema_info": "database_name,schema_name\nShop DB,Sales\nShop DB,HR\n",
    "table_info": "database_name,schema_name,table_name,description\nShop DB,Sales,Orders,All orders\nShop DB,Sales,Customers,NA\n",
    "column_info": "database_name,schema_name,table_name,column_name,data_type,is_nullable,is_primary_key,is_foreign_key\nShop DB,Sales,Orders,id,int,false,true,false\nShop DB,Sales,Orders,customer-id,int,true,false,true\nShop DB,Sales,Customers,id,int,false,true,\n",
    "column_references_info": ",".join(f"{s}_{c}_name" for s in ("source", "target") for c in ("database", "schema", "table", "column")) + ",criteria\nShop DB,Sales,Orders,customer-id,Shop DB,Sales,Customers,id,a = b\nShop DB,Sales,Orders,id,Shop DB,Sales,Orders,id,self\n",
    "value_info": "database_name,schema_name,table_name,column_name,value\n" + "".join(f"Shop DB,Sales,Orders,id,{i}\n" for i in range(8)),
    "business_term_info": "glossary_name,category_name,term_name\nG,C,Order\n",
    "column_term_info": "database_name,schema_name,table_name,column_name,glossary_name,category_name,term_name\nShop DB,Sales,Orders,id,G,C,Order\nShop DB,Sales,Orders,nope,G,C,Order\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("bundle")
    for name, text in FILES.items():
        (d / f"{name}.csv").write_text(text)
    (d / "query_info.csv").write_text("")
    return str(d)


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    s = GraphStore(spark, str(tmp_path_factory.mktemp("store")))
    with connectors.csv(spark, folder) as c:
        c.ingest(s)
    s.save()
    return s


def dump(store):
    frames = {**{k: v.drop("labels") for k, v in store._nodes.items()}, **store._edges}
    return {k: sorted(map(str, v.collect())) for k, v in frames.items()}


def test_bundle(store):
    assert {r.id: (r.name, r.platform) for r in store.nodes("Database").collect()} == {"shop_db": ("Shop DB", "GCP")}
    assert {r.id for r in store.nodes("Column").collect()} == {"shop_db.sales.orders.id", "shop_db.sales.orders.customer_id", "shop_db.sales.customers.id"}
    assert [tuple(r) for r in store.edges("Column-REFERENCES-Column").collect()] == [("shop_db.sales.orders.customer_id", "shop_db.sales.customers.id", "a = b")]
    assert store.edges("Column-TAGGED_WITH-BusinessTerm").count() == 1
    assert {r.name: r.description for r in store.nodes("Table").collect()} == {"Orders": "All orders", "Customers": None}
    store.check_unique()


def test_ingest_twice_changes_nothing_and_reload(spark, folder, store):
    again = GraphStore(spark, store.path)
    again.ingest(connectors.csv(spark, folder).extract())
    again.ingest(connectors.csv(spark, folder).extract())
    assert dump(again) == dump(store)
    assert dump(GraphStore.load(spark, store.path)) == dump(store)


def test_include_and_errors(spark, folder, tmp_path):
    b = connectors.csv(spark, folder).extract(include_nodes=["Table"], include_relationships=["HAS_COLUMN"])
    assert set(b.nodes) == {"Table"} and set(b.edges) == {"Table-HAS_COLUMN-Column"}
    with pytest.raises(ConfigError):
        connectors.csv(spark, folder).extract(include_nodes=["Nope"])
    (tmp_path / "table_info.csv").write_text("table_name\nx\n")
    with pytest.raises(ConfigError):
        connectors.csv(spark, str(tmp_path)).extract()
    c = connectors.csv(spark, folder)
    with pytest.raises(StateError):
        c.load(GraphStore(spark))
    c.close()
    with pytest.raises(StateError):
        c.extract()
    with pytest.raises(ConfigError):
        GraphStore(spark).upsert_nodes("Table", spark.createDataFrame([("a", 1)], "id string, x int"), properties=["x"])


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, v int, w string")
    new = spark.createDataFrame([("b", 9, 2), ("c", 3, 2), ("c", 4, 1), (None, 5, 1)], "id string, v int, seq int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(upsert.merge(old, new, ["id"], order=["seq"])) == [("a", 1, None), ("b", 2, "x"), ("c", 4, None)]
    assert rows(upsert.merge(old, new, ["id"], order=["seq"], overwrite=True)) == [("a", 1, None), ("b", 9, "x"), ("c", 4, None)]
    assert rows(upsert.merge(old.limit(0), new.limit(0), ["id"])) == []
    e = spark.createDataFrame([("a", "b"), ("a", "z"), ("y", "b"), ("y", "z")], "src_id string, dst_id string")
    assert rows(upsert.existing_endpoints(e, old, old)) == [("a", "b")]
    assert rows(upsert.dangling(e, old, old)) == [("a", "z", "target"), ("y", "b", "source"), ("y", "z", "both")]
    g = GraphStore(spark)
    g.upsert_nodes("BusinessTerm", spark.createDataFrame([("1", "Net")], "id string, name string"), labels=["X"])
    g.upsert_nodes("BusinessTerm", spark.createDataFrame([("2", "Net"), ("3", "Gross")], "id string, name string"), key="name", labels=["Y"])
    assert {(r.id, tuple(r.labels)) for r in g.nodes("BusinessTerm").collect()} == {("1", ("X", "Y")), ("3", ("Y",))}
    g.stamp("1", dt.datetime(2024, 1, 1))
    g.stamp("2", dt.datetime(2024, 2, 1))
    r = g.nodes("GraphInfo").first()
    assert (r.initial_version, r.latest_version, r.create_date.month, r.last_updated.month) == ("1", "2", 1, 2)
    g._nodes["Value"] = spark.createDataFrame([("a",), ("a",)], "id string")
    with pytest.raises(LoadError):
        g.check_unique()


def test_catalogue(store):
    assert sorted(map(tuple, cx.list_schemas(store).collect())) == [("HR", "Shop DB"), ("Sales", "Shop DB")]
    assert [tuple(r) for r in cx.list_tables_by_schema(store, "Sales").collect()] == [("Sales", ["Customers", "Orders"])]
    assert cx.list_tables_by_schema(store, "HR").count() == 0
    full = {r.table_name: r for r in cx.full_metadata(store).collect()}
    orders = {c.column_name: c for c in full["Orders"].columns}
    assert orders["id"].examples == ["0", "1", "2", "3", "4"] and orders["id"].key_type == "primary"
    assert orders["customer-id"].references == ["Customers.id"] and full["Customers"].columns[0].references == ["Orders.customer-id"]
    text = evalkit.table_text(cx.full_metadata(store)).filter("table_id like '%orders'").first().text
    assert "  - id (int) [primary key] [NOT NULL] (examples: 0, 1, 2)" in text and "-> references Customers.id" in text


def searchable(spark):
    g = GraphStore(spark)
    e = lambda *v: [float(x) for x in v]
    g.upsert_nodes("Database", spark.createDataFrame([("d", "d")], "id string, name string"))
    g.upsert_nodes("Schema", spark.createDataFrame([("s", "s", e(1, 0, 0, 0))], "id string, name string, embedding array<float>"))
    g.upsert_nodes("Table", spark.createDataFrame([("t1", "orders", "all orders", e(1, 0, 0, 0)), ("t2", "people", "all people", e(0, 1, 0, 0)), ("t3", "lost", "orders orders", e(1, 0, 0, 0)), ("t4", "none", None, None)], "id string, name string, description string, embedding array<float>"))
    g.upsert_nodes("Column", spark.createDataFrame([("c1", "total", "order total", e(1, 1, 0, 0)), ("c2", "note", None, e(-1, 0, 0, 0)), ("c3", "name", "person name", e(0, 1, 0, 0)), ("c4", "x", "y", None)], "id string, name string, description string, embedding array<float>"))
    g.upsert_nodes("BusinessTerm", spark.createDataFrame([("b1", "order"), ("b2", "person")], "id string, name string"))
    edge = lambda rows: spark.createDataFrame(rows, "src_id string, dst_id string")
    g.upsert_edges("Database-HAS_SCHEMA-Schema", edge([("d", "s")]))
    g.upsert_edges("Schema-HAS_TABLE-Table", edge([("s", "t1"), ("s", "t2"), ("s", "t4")]))
    g.upsert_edges("Table-HAS_COLUMN-Column", edge([("t1", "c1"), ("t1", "c2"), ("t2", "c3"), ("t3", "c4")]))
    g.upsert_edges("Table-TAGGED_WITH-BusinessTerm", edge([("t1", "b1")]))
    return g


def test_ranking(spark):
    g = searchable(spark)
    s = se.GraphSearch(g)
    q = se.Request(text="orders order", vector=[1.0, 0.0, 0.0, 0.0])
    found = [(r.table_name, round(r.table_score, 4), r.num_columns) for r in s.tables("vector", q).collect()]
    assert found == [("orders", 1.0, 2)]
    by_columns = [(r.table_name, round(r.column_avg_score, 4), r.num_columns) for r in s.tables_by_columns("vector", q).collect()]
    assert by_columns == [("orders", 0.8536, 1)]
    assert [r.table_name for r in s.tables("text", q).collect()] == ["orders"]
    assert [(r.table_name, round(r.table_score, 4)) for r in s.tables("hybrid", q).collect()] == [("orders", 1.0)]
    assert [(r.table_name, round(r.table_score, 4)) for r in s.tables("terms", q).collect()] == [("orders", 1.0)]
    assert [(r.table_name, r.schema_score) for r in s.tables_by_schemas(q).collect()] == [("orders", 1.0)]
    assert s.strategy("Table") == "terms" and s.strategy("Metric") is None and s.strategy("Schema") == "vector"
    assert s.tables("text", se.Request(text="()!")).count() == 0
    with pytest.raises(ConfigError):
        s.tables("vector", se.Request(text="x")).count()
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(cosine("a", "b")).collect()] == [0.0, None, None, None]


def test_enrichment(spark):
    g = searchable(spark)
    enrichment.enrich(g, ["Column"], enrichment.hashing_provider(4))
    got = {r.id: r.embedding for r in g.nodes("Column").collect()}
    assert got["c4"] and got["c2"] == [-1.0, 0.0, 0.0, 0.0] and got["c1"] == [1.0, 1.0, 0.0, 0.0]

    def broken(texts):
        raise RuntimeError

    assert [r.embedding for r in enrichment.embedded(g.nodes("Column").limit(1), broken).collect()] == [None]


def test_tool_output(spark):
    g = searchable(spark)
    args = argparse.Namespace(text="orders", vector="1,0,0,0", limit=None, k=None, domain=None, name=None, dialect=None)
    out = json.loads(tool.rows_as_json(tool.run(g, "table_by_vector", args), "table_by_vector"))
    assert out["tool_table_by_vector"]["results"][0]["table_name"] == "orders"
    args.text = "(!)"
    with pytest.raises(SystemExit):
        tool.run(g, "table_by_text", args)
    assert sanitize_text("a+b (c)") == "a b  c" and sanitize_text(" ") is None


def test_lineage(spark):
    sql = "WITH w AS (SELECT 1 AS a) SELECT o.id FROM p.d.orders o JOIN p.d.customers c ON o.cid = c.id AND o.k = c.k JOIN w ON true JOIN d.items USING (id), p.d.__meta__ WHERE EXISTS (SELECT l.x FROM p.d.lines l)"
    got = lineage.lineage(spark, sql, "q", default_database="P X")
    assert {t["table_id"] for t in got["table_info"]} == {"p.d.orders", "p.d.customers", "p_x.d.items", "p.d.lines"}
    assert {(r["left_column_id"], r["right_column_id"]) for r in got["references_info"]} == {("p.d.customers.id", "p.d.orders.cid"), ("p.d.customers.k", "p.d.orders.k")}
    assert lineage.lineage(spark, sql, "q", default_database="P X", mode="compat")["references_info"] == []
    one = "SELECT o.id FROM p.d.orders o JOIN p.d.customers c ON o.cid = c.id"
    assert len(lineage.lineage(spark, one, "q", mode="compat")["references_info"]) == 1
    with pytest.warns(UserWarning):
        assert lineage.lineage(spark, "SELECT * FROM t", "q") is None
    with pytest.raises(ConfigError):
        lineage.lineage(spark, one, "q", dialect="other")


def test_query_logs(spark, tmp_path):
    entry = lambda sql: {"protoPayload": {"serviceData": {"jobQueryRequest": {"projectId": "p", "query": sql}, "jobQueryResponse": {"job": {"jobStatistics": {"referencedTables": [{"datasetId": "d", "tableId": "t"}]}}}}}}
    one = "SELECT o.id FROM p.d.orders o"
    path = tmp_path / "log.json"
    path.write_text(json.dumps([entry(one), entry(one), {"protoPayload": {"serviceData": {}}}, {}]))
    g = connectors.query_log_file(spark).ingest(GraphStore(spark), query_log_file=str(path))
    assert g.nodes("Query").count() == 1 and g.edges("Query-USES_COLUMN-Column").count() == 1
    with pytest.raises(ConfigError):
        querylog.audit_file(spark, str(path), source="x")
    t = lambda d: dt.datetime(2024, 1, d)
    log = spark.createDataFrame([("1", "SELECT", "SELECT 1", None, "s", t(30)), ("2", "SELECT", " ", None, "s", t(29)), ("3", "SHOW", "x", None, "s", t(28)), ("4", "MERGE", "m", "e", "s", t(27)), ("5", "SELECT", "old", None, "s", dt.datetime(2023, 1, 1)), ("6", "SELECT", "b", None, "z", t(26))], "query_id string, query_type string, query_text string, error_code string, schema_name string, start_time timestamp")
    ids_ = lambda **k: [r.query_id for r in querylog.recent_statements(log, now=t(31), **k).collect()]
    assert ids_() == ["1", "6"] and ids_(limit=2) == ["1"] and ids_(schema="z") == ["6"] and ids_(drop_failed=False) == ["1", "4", "6"] and ids_(end=t(30)) == ["6"]


def test_governance(spark):
    p = spark.createDataFrame([("pii", "d", [("a",), ("b",), ("a",)]), ("free", "", None), ("", None, None), ("system.x", None, [("y",)])], "tag_key string, description string, values array<struct<name:string>>")
    g = connectors.governed_tags(p, metastore="M 1").ingest(GraphStore(spark))
    assert sorted((r.id, r.description) for r in g.nodes("GovernanceTagKey").collect()) == [("m_1.free", None), ("m_1.pii", "d")]
    assert g.edges("GovernanceTagKey-HAS_VALUE_OPTION-GovernanceTagValue").count() == 2
    with pytest.raises(ConfigError):
        governance.namespace(None, None, "")
    base = "projects/p/locations/l/glossaries/g"
    terms = spark.createDataFrame([(f"{base}/terms/t-1", "T One", None, "g", "G", f"{base}/categories/c-1"), (f"{base}/terms/t-2", "T", None, "g", "G", base)], "term_id string, term_name string, term_description string, glossary_id string, glossary_name string, category_id string")
    links = spark.createDataFrame([("a.b.c.d", "COLUMN", f"{base}/terms/t-1"), ("a.b.c.d", "COLUMN", "gone")], "entity_id string, entity_type string, term_id string")
    b = governance.glossary_batch(terms, links)
    assert [(r.id, r.name) for r in b.nodes["BusinessTerm"].collect()] == [("g.c_1.t_1", "T One")]
    assert [tuple(r) for r in b.edges["Column-TAGGED_WITH-BusinessTerm"].collect()] == [("a.b.c.d", "g.c_1.t_1")]
    e = spark.createDataFrame([("x/entries/b/projects/P/datasets/D/tables/T", "Schema.C"), ("x/entries/b/projects/P/datasets/D/tables/T", "")], "n string, p string")
    i, k = governance.linked_entity("n", "p")
    assert [tuple(r) for r in e.select(i, k).collect()] == [("p.d.t.c", "COLUMN"), ("p.d.t", "TABLE")]


def test_warehouses(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    bq = {
        "SCHEMATA_OPTIONS": f([], "option_name string, option_value string"),
        "TABLES": f([("p", "d", "t", "BASE TABLE"), ("p", "d", "v", "VIEW")], "table_catalog string, table_schema string, table_name string, table_type string"),
        "TABLE_OPTIONS": f([("p", "d", "t", "description", "about"), ("p", "d", "t", "other", "x")], "table_catalog string, table_schema string, table_name string, option_name string, option_value string"),
        "COLUMNS": f([("t", "id", "INT64", "NO"), ("t", "r", "STRUCT<a INT64>", "YES")], "table_name string, column_name string, data_type string, is_nullable string"),
        "COLUMN_FIELD_PATHS": f([("t", "id", "id", "key"), ("t", "r", "r.a", "deep")], "table_name string, column_name string, field_path string, description string"),
        "KEY_COLUMN_USAGE": f([("t.pk$", "t", "id"), ("t.fk_1", "t", "id")], "constraint_name string, table_name string, column_name string"),
        "TABLE_CONSTRAINTS": f([("t.pk$", "PRIMARY KEY"), ("t.fk_1", "FOREIGN KEY")], "constraint_name string, constraint_type string"),
        "CONSTRAINT_COLUMN_USAGE": f([("t.fk_1", "t", "r")], "constraint_name string, table_name string, column_name string"),
    }
    data = f([(3, 1), (1, 1), (None, 2)], "id int, r int")
    g = connectors.bigquery_schema(bq.__getitem__, "p", table=lambda n: data).ingest(GraphStore(spark), dataset="d")
    cols = {r.name: (r.type, r.nullable, r.is_primary_key, r.is_foreign_key, r.description) for r in g.nodes("Column").collect()}
    assert cols == {"id": ("INT64", False, True, True, "key"), "r": ("STRUCT<a INT64>", True, False, False, None)}
    assert [r.name for r in g.nodes("Table").collect()] == ["t"] and g.nodes("Schema").first().description is None
    assert sorted(r.value for r in g.nodes("Value").collect()) == ["1", "3"]
    assert [tuple(r)[:2] for r in g.edges("Column-REFERENCES-Column").collect()] == [("p.d.t.id", "p.d.t.r")]

    dbx = {
        "schemata": f([("c", "s", "about")], "catalog_name string, schema_name string, comment string"),
        "tables": f([("c", "s", "a", None), ("c", "s", "b", None), ("c", "z", "q", None)], "table_catalog string, table_schema string, table_name string, comment string"),
        "columns": f([("c", "s", t, n, "int", "YES", None) for t in "ab" for n in ("x", "y")], "table_catalog string, table_schema string, table_name string, column_name string, data_type string, is_nullable string, comment string"),
        "key_column_usage": f([("c", "s", "pk", "c", "s", "a", "x", 1, None), ("c", "s", "pk", "c", "s", "a", "y", 2, None), ("c", "s", "fk", "c", "s", "b", "y", 1, 2), ("c", "s", "fk", "c", "s", "b", "x", 2, 1)], "constraint_catalog string, constraint_schema string, constraint_name string, table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        "table_constraints": f([("c", "s", "pk", "PRIMARY KEY"), ("c", "s", "fk", "FOREIGN KEY")], "constraint_catalog string, constraint_schema string, constraint_name string, constraint_type string"),
        "referential_constraints": f([("fk", "pk")], "constraint_name string, unique_constraint_name string"),
    }
    b = warehouses.databricks(dbx.__getitem__, "c", "s")
    assert sorted(tuple(r)[:2] for r in b.edges["Column-REFERENCES-Column"].collect()) == [("c.s.b.x", "c.s.a.x"), ("c.s.b.y", "c.s.a.y")]
    assert b.nodes["Table"].count() == 2 and b.nodes["Column"].filter("is_primary_key").count() == 2
    with pytest.raises(ConfigError):
        warehouses.databricks(dbx.__getitem__, "c", "nope")
    types = f([("VARIANT",), ("VARIANT(1)",), ("variants",), ("ARRAY<INT>",), (None,)], "data_type string")
    assert [infoschema.sampleable(types, s).count() for s in ("snowflake", "databricks")] == [3, 1]


def test_documents_of_catalogues(spark, tmp_path):
    doc = {"product": "x", "schemas": [{"name": "s", "remarks": ""}, {"name": "z", "remarks": "Z"}], "tables": [{"schema": "s", "name": "t", "remarks": "T", "columns": [{"name": "a", "type": "int", "nullable": True, "remarks": "", "is_primary_key": True, "is_foreign_key": False}]}], "foreign_keys": [{"source_schema": "s", "source_table": "t", "source_column": "a", "target_schema": "s", "target_table": "t", "target_column": "a"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    b = connectors.jdbc_catalog(spark, str(path), url="jdbc:postgresql://h:1/My-DB?x=1").extract()
    assert [r.id for r in b.nodes["Column"].collect()] == ["my_db.s.t.a"] and b.edges["Column-REFERENCES-Column"].count() == 0
    with pytest.raises(ConfigError):
        catalog_json.database_of_url("jdbc:oracle:thin:@h:1521:sid")
    pages = spark.createDataFrame([(1, json.dumps({"tables": [{"catalog_name": "c", "schema_name": "s", "name": "t", "columns": {"name": "x", "type_text": "int", "nullable": False}}, {"name": "lost"}]}))], "page_id bigint, payload string")
    u = catalog_json.unity_pages(pages)
    assert [(r.id, r.type, r.nullable) for r in u.nodes["Column"].collect()] == [("c.s.t.x", "int", False)]
    e = spark.createDataFrame([("p", "d", "t", None, [("a", "STRING", "NULLABLE", None), ("b", "STRING", "REQUIRED", None)])], "database string, schema string, table string, description string, fields array<struct<name:string,type:string,mode:string,description:string>>")
    assert {r.name: r.nullable for r in catalog_json.entry_catalog(e).nodes["Column"].collect()} == {"a": True, "b": False}


def test_semantic_models(spark, tmp_path):
    from schemaloom.queries.graph import _MODEL

    path = tmp_path / "m.yaml"
    path.write_text(osi.dump(_MODEL))
    g = GraphStore(spark)
    c = connectors.semantic_model(spark, g)
    c.ingest(g, spec_source=str(path))
    assert {r.name for r in g.nodes("BusinessTerm").collect()} == {"purchases", "sales", "turnover"}
    assert {r.name: r.is_time_dimension for r in g.nodes("Column").collect()}["placed_at"] is True
    assert g.edges("Column-USED_IN_JOIN-Join").count() == 2 and g.edges("Domain-HAS_QUERY-Query").count() == 1
    d = cx.domain_context(g, "Retail Sales").first()
    assert [t.table_name for t in d.tables] == ["customers", "orders", "recent"] and [t.schema_name for t in d.tables] == ["sales", "sales", None]
    assert d.metrics[0].synonyms == ["turnover"] and d.joins[0].to_table == "customers" and d.aspects[0].aspect_type == "ai_context"
    empty = cx.domain_context(g, "unknown").first()
    assert empty.domain_name == "unknown" and empty.tables == [] and empty.metrics == []
    out = c.export(semantic_model_name="Retail Sales", output_path=str(tmp_path / "out.yaml"))
    again = osi.load(out)
    assert osi.export(connectors.semantic_model(spark).ingest(GraphStore(spark), spec_source=out), "Retail Sales") == again
    assert again["semantic_model"][0]["datasets"][1]["fields"][2]["dimension"] == {"is_time": True}
    for bad in ("", "a.b"):
        with pytest.raises(ConfigError):
            osi.classify(bad)
    with pytest.warns(UserWarning):
        osi.check_version({"version": "9"})


def test_scores(spark):
    s = spark.createDataFrame([(["A", "b"], ["a", "c"], "the a and B")], "required array<string>, retrieved array<string>, context string")
    r = evalkit.retrieval_scores(s).first()
    assert (r.recall, r["precision"], r.missing, r.extra) == (0.5, 0.5, ["b"], ["c"])
    f = evalkit.faithfulness(s.withColumnRenamed("required", "used").withColumn("used", F.array(F.lit("A"), F.lit("zz")))).first()
    assert (f.faithfulness, f.hallucinated) == (0.5, ["zz"])
    q = evalkit.structural_equivalence(spark, "select a.x from d.t a", "SELECT a.x  FROM d.t a")
    assert q["exact_match"] and q["structural_match"]
    assert evalkit.structural_equivalence(spark, "select y from d.t", "select x from d.t")["missing_columns"] == ["x"]
    assert evalkit.is_valid(spark, "SELECT 1") and not evalkit.is_valid(spark, "SELECT nope FROM nowhere")
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "p int, q string"), spark.createDataFrame([("x", 1), (None, 2), ("x", 1)], "q string, p int")
    assert tuple(evalkit.execution_match(a, b).first()) == (True, 3, 3, 3)
    assert tuple(evalkit.execution_match(a, b.limit(2)).first())[0] is False
    assert ids.normalize("a") is not None


def test_lineage_of_documents(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(lineage, "BATCH_ROWS", 1)
    one = "SELECT a.x FROM core.t AS a JOIN ops.u AS b ON a.k = b.k"
    two = f"-- first; note\n{one};\n\nWITH w AS (SELECT c.z FROM core.v AS c) SELECT w.z FROM w WHERE w.z <> ';';\nSELEC nothing"
    rows = [(1, one, "query_history"), (2, two, "query_history"), (3, two, "query_history"), (4, "Prose; " + one, "wiki"), (5, "no query", "tickets"), (6, None, "query_history")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: sorted(map(tuple, entry.queries()[f"lineage_document_{name}"](spark, str(tmp_path)).collect()))
    assert got("tables") == [("warehouse.core.t", "t", 3), ("warehouse.core.v", "v", 1), ("warehouse.ops.u", "u", 3)]
    assert got("columns") == [(f"warehouse.{c}",) for c in ("core.t.k", "core.t.x", "core.v.z", "ops.u.k")]
    assert got("joins") == [("warehouse.ops.u.k", "warehouse.core.t.k", 3)]
    assert [r[1:] for r in got("ctes")] == [("w", "SELECT c.z FROM core.v AS c")]


def test_both_ways_to_read_a_plan_agree(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("source = 'query_history' AND text IS NOT NULL").collect()]
    texts += ["SELECT a.x, sum(b.`y z`) FROM p.q.a JOIN q.b ON a.x = b.y AND a.z = b.w LEFT JOIN c AS d ON d.k = a.k OR d.j > b.j GROUP BY a.x", "SELECT x FROM a JOIN (SELECT b.y FROM b) AS s ON a.x = s.y"]
    read = 0
    for one in [s for t in texts for s in lineage.statements(t)]:
        try:
            walked = lineage.parse(spark, one, walk=True)
        except Exception:
            continue
        assert lineage.parse(spark, one) == walked
        read += 1
    assert read > 20


@pytest.mark.parametrize("name", ["tables", "columns", "joins", "ctes"])
def test_tasks_parse_documents(spark, tmp_path, monkeypatch, name):
    import __spark_entry__ as entry

    one = "WITH w AS (SELECT c.z::INT64 AS z, '\U0001f600;' AS s FROM core.`v w` AS c), x AS (SELECT w.z FROM w) SELECT a.k FROM core.t AS a JOIN ops.u b ON a.k = b.k AND SAFE_CAST(a.n AS INT64) = b.n LEFT JOIN x ON x.z = a.k"
    two = "SELECT d.y FROM ops.u AS d WHERE d.y IN (SELECT e.y FROM core.t e) AND EXISTS (SELECT f.q FROM f) UNION ALL SELECT max(g.r) FROM lake.core.t g JOIN (SELECT h.i FROM ops.u h) j ON g.i = j.i"
    rows = [(1, f"{one};\n{two};{two}", "query_history"), (2, f"{two}; not SQL;", "wiki"), (3, "please select one", "tickets")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lineage, "parse", None)  # the driver parses nothing
    want = {
        "tables": [("lake.core.t", "t", 2), ("warehouse.core.t", "t", 2), ("warehouse.core.v_w", "v w", 1), ("warehouse.main.f", "f", 2), ("warehouse.ops.u", "u", 2)],
        "columns": [(c,) for c in ("lake.core.t.i", "lake.core.t.r", "warehouse.core.t.k", "warehouse.core.t.n", "warehouse.core.t.y", "warehouse.core.v_w.z", "warehouse.main.f.q", "warehouse.ops.u.i", "warehouse.ops.u.k", "warehouse.ops.u.n", "warehouse.ops.u.y")],
        "joins": [("warehouse.ops.u.k", "warehouse.core.t.k", 1)],
        "ctes": [("w", "SELECT c.z::INT64 AS z, '\U0001f600;' AS s FROM core.`v w` AS c"), ("x", "SELECT w.z FROM w")],
    }
    got = [tuple(r) for r in entry.queries()[f"lineage_document_{name}"](spark, str(tmp_path)).collect()]
    assert sorted(r[-2:] if name == "ctes" else r for r in got) == want[name]


def test_unread_statements_are_counted(spark):
    texts = spark.createDataFrame([("SELECT a.x FROM d.t a; SELEC b",), ("SELEC c",), ("SELECT x FROM u",)], "query string")
    with pytest.warns(UserWarning) as said:
        got = lineage.lineage_frames(texts, default_database="p")
    assert sorted(str(w.message) for w in said if "could not be read" in str(w.message)) == ["1 statements could not be read (ConfigError); they are skipped", "2 statements could not be read (ParseException); they are skipped"]
    assert [tuple(r) for r in got["table_info"].collect()] == [("GCP", "BIGQUERY", "p.d.t", "t", "p.d", "d", "p", "a", got["query_info"].filter("content LIKE 'SELECT a%'").first().query_id)]


def test_only_the_wanted_kinds_are_read(spark):
    one = "WITH w AS (SELECT c.z FROM core.v AS c) SELECT a.x FROM core.t AS a JOIN w ON w.z = a.k"
    assert set(json.loads(lineage._reader(spark).of(False, False).call(one))) == {"tables", "ctes"}
    texts = spark.createDataFrame([(f"{one}; SELECT b.y FROM core.u b",), ("SELECT d.q FROM e",)], "query string")
    got = lineage.lineage_frames(texts, default_database="p", default_schema="m", kinds=["cte_info"])
    assert set(got) == {"cte_info", "query_info"} and got["query_info"].count() == 2
    assert [tuple(r)[1:3] for r in got["cte_info"].collect()] == [("w", "SELECT c.z FROM core.v AS c")]
    with pytest.raises(ConfigError):
        lineage.lineage_frames(texts, kinds=["ctes"])


def test_statements_of_one_form_are_parsed_once(spark):
    reader, parser = lineage._reader(spark).of(True, True), spark._jsparkSession.sessionState().sqlParser()
    for i in range(40):
        one = f"SELECT t{i}.a,\n  b.Col{i * 7} FROM core.t{i * i} AS t{i}\tLEFT JOIN ops.u{i} b ON t{i}.k{i} = b.k AND b.d >= '{'é;' * i}' WHERE b.n < {i * 99}"
        assert json.loads(reader.call(one)) == json.loads(reader.read(parser.parsePlan(one)))
    assert reader.parses() == 1


def test_form_and_parser_agree(spark, sf):
    texts = [
        "SELECT x_3 FROM x_9 AS x_1 JOIN x_0 ON x_1.x_7 = x_0.x_3", "SELECT X_3(a) FROM x_3(1) x_5", "SELECT a.x FROM t AS a (b, c)", "SELECT s.f(a) FROM d.t", "SELECT f(DISTINCT a.x), count(*) FROM a GROUP BY ALL",
        "SELECT DATE '2020-01-01', DATE 'no', x 'no' FROM t", "SELECT date'2020-01-01', r'a\\n', X'1F' FROM t", "SELECT 'a' 'b', 'a''b', 'it\\'s', '${x}', '\U0001f600' FROM t JOIN u ON t.a = u.b", "SELECT 'é', \"q\", `b``c`.d FROM t JOIN u ON t.a = u.b",
        "SELECT 1.5, .5, 1., 1e5, 5L, 1a, t.1a, t.5 FROM t", "SELECT 12345678901234567890123456789012345678901234567890 FROM t", "SELECT a-b.c, -1 FROM t-x", "SELECT a FROM t WHERE a<=>b.c AND a==c.d OR a!=e.f AND NOT a<>g.h", "SELECT !a, !!b FROM t", "SELECT a /* c */ FROM t -- x", "SELECT /*+ BROADCAST(t) */ a FROM t", "SELECT */a FROM t",
        "SELECT a.* FROM t a CROSS JOIN (SELECT b.x FROM u b) c", "SELECT a.x FROM (SELECT x FROM t) JOIN u ON u.x = a.x", "SELECT t.x FROM t JOIN u ON u.x = t.x JOIN c.v w ON (w.y = u.y AND w.z = t.z)", "SELECT x FROM a, b WHERE a.x IN (SELECT y FROM c JOIN d ON c.e = d.e) UNION ALL SELECT z FROM (f)", "SELECT x FROM t JOIN u USING (x)", "SELECT x FROM a.b.c.d e NATURAL JOIN f",
        "SELECT w.x FROM w JOIN v ON sum(w.x) = v.y HAVING max(w.x) > 3 ORDER BY w.x DESC, 2 ASC", "SELECT a FROM t LEFT", "SELECT a AS int, b AS key FROM full JOIN left ON a = b", "SELECT select FROM from", "SELECT a b c FROM t", "SELECT", "(SELECT a FROM t)", "(SELECT a FROM t JOIN u ON t.a = u.a) UNION SELECT b FROM v", "SELECT a FROM schemas JOIN temp ON temp.a = schemas.regexp", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT * FROM a", "SELECT a FROM t WINDOW w AS (ORDER BY a), w AS (ORDER BY b)", "SELECT a FROM t", "SELECT a\fFROM t", "SELECT wıth FROM t", f"SELECT {'a' * 200} FROM t", "SELECT CAST(a AS foo) FROM t", "SELECT a FROM t LATERAL VIEW explode(b) c AS d", "SELECT a.b.c, a.b FROM d.e.f AS a", "SELECT x.y FROM t x WHERE EXISTS (SELECT z.q FROM z WHERE z.q = x.y)", "SELECT a FROM t WHERE b IN () AND c LIKE 'x' ESCAPE 'yy'", "SELECT a FROM t WHERE a BETWEEN 1 AND 2 OR b IS NOT NULL",
    ]
    texts += [s for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").collect() for s in lineage.statements(r.text) if "select" in s.lower()]
    reader, parser = lineage._reader(spark).of(True, True), spark._jsparkSession.sessionState().sqlParser()
    asked = 0
    for one in [x for t in texts for x in (t, t.replace("a", "zz"), t.upper(), t + " ORDER")]:
        try:
            want = json.loads(reader.read(parser.parsePlan(one)))
        except Exception:
            want = None
        got, asked = json.loads(reader.call(one)), asked + 1
        assert (None if "error" in got else got) == want, one
    assert reader.parses() < asked


def test_references_read_by_form(spark):
    texts = spark.createDataFrame([(f"SELECT a.x{i} FROM core.t{i} AS a JOIN ops.u b ON a.k{i} =\n b.k{i * i} WHERE a.d >= 'é{i}'",) for i in range(30)], "query string")
    reader = lineage._reader(spark).of(False, True)
    found = [json.loads(reader.call(r["query"])) for r in texts.collect()]
    assert reader.parses() == 1 and {*found[0]} == {"tables", "equalities", "joins", "ctes"}
    got = lineage.lineage_frames(texts, default_database="p", kinds=["references_info"])["references_info"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted((f"p.ops.u.k{i * i}", f"p.core.t{i}.k{i}", f"a.k{i} =\n b.k{i * i}") for i in range(30))


def test_tables_alone_are_those_of_all_kinds(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").filter("source = 'query_history'").select(F.col("text").alias("query"))
    told = {"default_database": "p", "default_schema": "m"}
    every, alone = lineage.lineage_frames(texts, **told), lineage.lineage_frames(texts, kinds=["table_info"], **told)
    assert set(alone) == {"table_info", "query_info"}
    got = sorted(map(tuple, alone["table_info"].collect()))
    assert len(got) > 20 and got == sorted(map(tuple, every["table_info"].collect()))


_ODD_TEXTS = [
    "-- a; b\nSELECT a.x FROM core.t AS a JOIN ops.u b ON a.k = b.k AND b.n = a.n; SELECT a.x FROM core.t AS a JOIN ops.u b ON a.k = b.k AND b.n = a.n;;\x1f 　",
    "SELECT a.s FROM core.t AS a JOIN ops.u AS b ON a.k = b.k WHERE a.s = 'it''s; \\'' AND b.s = 'x;'' /* ; */ ; SELEC \"a;\\\"b\" ; `;` ; /* open ; -- ; \n 'open '' ; x",
    "select safe_cast(a.n as int64) from lake.core.t a join ops.u b on a.k::number = b.k and a.j::int64 = 1 and a.`x-Y z` = b.`Ünï` join v on v.i = b.i /* NUMBER */; SELECT float64 FROM bytes.x",
    "SELECT é.x FROM core.`Straße` AS `é` JOIN ops.`ΟΔΟΣ` b ON `é`.`Σ` = b.k; SELECT a.x FROM d.`\U0001f600;t` a JOIN d.u ON u.x = a.x AND u.s = '\U0001f600' WHERE a.y = '\U0001f600'; SELECT 'é' AS int64, CAST(x.y AS INT64) FROM d.x JOIN d.y ON x.k = y.k",
    "WITH w AS (SELECT c.z::INT64 FROM core.v c), t AS (SELECT 1) SELECT * FROM w JOIN t ON w.z = t.z JOIN __hidden__ h ON h.x = w.z JOIN q.`a.b` r ON r.z = w.z; SELECT a.x FROM t AS a JOIN t AS b ON a.x = b.x; SELECT x FROM ``",
    "Refresh takes long. SELECT a.x FROM d.t a; Ticket, 3; deputy is (SELECT a.x FROM d.t a); * note; ) x; # y; label: BEGIN SELECT 1; END; a.b; zz; x 'y'; -; 12 SELECT; Was ${x} SELECT; /* ; only */ -- ;",
]


@pytest.mark.parametrize("mode", ["resolved", "compat"])
def test_rows_of_texts_agree_with_statements(spark, sf, mode):
    texts = _ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL AND source = 'query_history'").limit(40).collect()]
    told = {"dialect": "bigquery", "default_database": "P x", "default_schema": None, "mode": mode}
    frames = spark.createDataFrame([(t,) for t in texts], "query string")
    with pytest.warns(UserWarning) as said:
        got = lineage.lineage_frames(frames, **told)
    want, errors = {k: [] for k in lineage._SHAPES}, {}
    for t in texts:
        q = frames.filter(F.col("query") == t).select(ids.query_id(F.col("query"))).first()[0]
        for x in dict.fromkeys(lineage.statements(t)):
            try:
                rows = lineage._named(lineage.parse(spark, x), q, *told.values())
            except Exception as e:
                errors[type(e).__name__] = errors.get(type(e).__name__, 0) + 1
                continue
            for k in want:
                want[k] += [tuple(r[c] for c in lineage._columns(k)) for r in rows[k]]
    for k in want:
        assert sorted(map(tuple, got[k].collect())) == sorted(want[k]), k
    assert {str(w.message) for w in said if "could not be read" in str(w.message)} == {f"{n} statements could not be read ({e}); they are skipped" for e, n in errors.items()}
    assert all(want.values()) and set(errors) == {"ParseException", "ConfigError"}


def test_texts_are_cut_as_in_python(spark):
    reader = lineage._reader(spark)
    pieces = ["'", '"', "`", "--", "/*", "*/", ";", "\\", "\n", "''", " ", "\x85", "x", "é", "\U0001f600", "/", "-"]
    texts = [*_ODD_TEXTS, "", ";", "".join(pieces)] + ["".join(pieces[(i * i * 7 + j * (i % 13 + 1) + j * j) % len(pieces)] for j in range(12)) for i in range(400)]
    for t in texts:
        assert list(reader.statements(t)) == list(dict.fromkeys(lineage.statements(t))), t


def test_statements_like_prose_are_not_parsed(spark, sf):
    firsts = ["zz", "zz.a", "Für", "zz.select.x", "12", "2024", "*", ",", "#", "Ticket", "label", "TEMP", "set", "values", "1a"]
    seconds = [" a", " select", "\n7", ", b", "(c", ") d", " = e", "-f", " - g", ".h", ": BEGIN SELECT 1; END", " as x", " table", " 'q'", ""]
    rows, parser = lineage._reader(spark).rows("table_info", "p", "m", False), spark._jsparkSession.sessionState().sqlParser()
    texts = [f + s + t for f in firsts for s in seconds for t in ("", " FROM x WHERE y", " TBLPROPERTIES") if ";" not in s]
    texts += [s for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").limit(30).collect() for s in lineage.statements(r.text)]
    for one in texts:
        try:
            parser.parsePlan(lineage._Text(one).plain)
            want = []
        except Exception as e:
            want = [type(e).__name__]
        got = rows.call("q", one)
        assert list(got.get(0)) == want or list(got.get(1)), one


def test_references_are_counted_by_text(spark):
    one, other = "SELECT a.x FROM core.t AS a JOIN ops.u b ON a.k = b.k", "SELECT b.y FROM core.t AS b JOIN ops.u c ON b.k = c.k AND b.i = c.i"
    texts = [(f"{one}; {other}",), (f"{one}; {other}",), (other,), (f"{one}; {one} ; SELEC",)]
    counts = lambda rows: sorted(map(tuple, lineage.query_counts(spark.createDataFrame(rows, "query string"), "references_info", default_database="p").collect()))
    assert counts(texts) == [("p.ops.u.i", "p.core.t.i", 2), ("p.ops.u.k", "p.core.t.k", 3)]
    # a statement that Python reads
    assert counts([*texts, (f"{one}; SELECT 'é', CAST(a.x AS INT64) FROM core.t a JOIN ops.u b ON a.k = b.k",)]) == [("p.ops.u.i", "p.core.t.i", 2), ("p.ops.u.k", "p.core.t.k", 4)]
    with pytest.raises(ConfigError):
        lineage.query_counts(spark.createDataFrame(texts, "query string"), "cte_info")


def test_tables_are_counted_by_text(spark):
    one = "SELECT a.x FROM core.`T u` AS a JOIN core.t_u b ON a.k = b.k; SELECT b.y FROM ops.v b"
    texts = [(f"{one}; SELEC",), (f"{one}; SELECT c.z FROM ops.v c",), ("SELECT b.y FROM core.`t-u` b; please note",)]
    counts = lambda rows: sorted(map(tuple, lineage.query_counts(spark.createDataFrame(rows, "query string"), "table_info", least=["table_name"], default_database="p").collect()))
    assert counts(texts) == [("p.core.t_u", "T u", 3), ("p.ops.v", "v", 2)]
    # statements that Python reads
    assert counts([*texts, (f"{one}; SELECT 'é' AS int64 FROM core.t_u",), ("SELECT 'é', CAST(x AS INT64) FROM ops.V",)]) == [("p.core.t_u", "T u", 4), ("p.ops.v", "V", 4)]


def test_documents_that_may_select(spark):
    texts = ["", "selec", "select", "xSeLeCt", "sselect", "selecselect", "SELECtselec", "é select", "sele\u0441t", "s e l e c t", None, "\u017felect", "SELECSELECSELECT ", "selecT\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.may for r in frame.select("text", lineage.may_select(spark, F.col("text")).alias("may")).collect()}
    assert got == {t: t is not None and "select" in "".join(c.lower() if c.isascii() else c for c in t) for t in texts}
