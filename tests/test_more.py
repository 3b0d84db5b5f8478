import argparse
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom import enrichment, evalkit, lineage, tool
from schemaloom.errors import ConfigError, LoadError, SchemaloomWarning
from schemaloom.functions import identifiers
from schemaloom.operators import similar
from schemaloom.sources import infoschema, rows
from schemaloom.store import GraphBatch, GraphStore


@pytest.mark.parametrize("block", [4096, 7])
def test_most_similar(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(1)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(40)}
    vectors |= {50: vectors[3], 51: [2 * x for x in vectors[3]], 60: None, 61: [0.0] * 4, 62: [1.0], 63: [None, 1.0, 1.0, 1.0], 64: [float("nan")] * 4}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec bigint, e array<double>, other string")
    got = {}
    for r in similar.most_similar(df, df.filter("vec % 5 = 0 or vec = 3"), "vec", "e", k=3, d=4).collect():
        got.setdefault(r.id, []).append((-r.score, r.other))
    fine = {i: np.array(v) for i, v in vectors.items() if i < 60}
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = {q: sorted((-cos(v, w), i) for i, w in fine.items() if i != q)[:3] for q, v in fine.items() if q % 5 == 0 or q == 3}
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert similar.most_similar(df.limit(0), df, "vec", "e", d=4).count() == 0 == similar.most_similar(df, df.limit(0), "vec", "e", d=4).count()


def test_identifiers(spark):
    names = {"abc": "ABC", "_a$1": "_A$1", '"Mixed Case"': "Mixed Case", '"a""b"': 'a"b'}
    bad = ["", "1a", "a-b", 'a"b', '"a"b"', '""', '"', "a b", "ä"]
    for name, stored in names.items():
        assert identifiers.fold_name(name) == stored
    for name in bad:
        with pytest.raises(ConfigError):
            identifiers.fold_name(name)
    df = spark.createDataFrame([(n,) for n in [*names, *bad]] + [(None,)], "n string").select("n", identifiers.folded("n").alias("f"), identifiers.literal(F.col("n")).alias("l"))
    assert {r.n: r.f for r in df.collect()} == names | dict.fromkeys([*bad, None])
    assert identifiers.quoted('a"b') == '"a""b"' and identifiers.back_quoted("a b") == "`a b`"
    assert identifiers.literal("it\'s \\\\n") == "'it\'\'s \\\\\\\\n'"
    with pytest.raises(ConfigError):
        identifiers.back_quoted("a`b")


def test_one_bad_text_costs_no_other_vector(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([(str(i), "bad" if i == 3 else "good") for i in range(6)], "id string, description string").coalesce(1)
    got = {r.id: r.embedding for r in enrichment.embedded(df, picky).collect()}
    assert got.pop("3") is None and set(map(tuple, got.values())) == {(1.0, 2.0)}
    assert enrichment.dimensions(picky) == 2
    with pytest.raises(ConfigError):
        enrichment.dimensions(lambda texts: [None])


def test_a_snapshot_with_repeated_ids_is_not_switched_to(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path))
    assert not g.exists()
    g.upsert_nodes("Schema", spark.createDataFrame([("a", "A")], "id string, name string"))
    g.save()
    g._nodes["Schema"] = g.nodes("Schema").unionByName(g.nodes("Schema"))
    with pytest.raises(LoadError):
        g.save()
    assert GraphStore.load(spark, str(tmp_path)).nodes("Schema").count() == 1 and g.exists()


def test_text_index_follows_the_label(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path))
    g.upsert_nodes("Schema", spark.createDataFrame([("a", "sales orders")], "id string, name string"))
    assert g.text_index("Schema") is None
    g.save()
    assert GraphStore.load(spark, str(tmp_path)).text_index("Schema") is not None and g.text_index("Schema")[0].count() == 2
    g.upsert_nodes("Schema", spark.createDataFrame([("b", "more")], "id string, name string"))
    assert g.text_index("Schema") is None


def test_terms_keep_their_ids_when_merged_by_name(spark):
    g = GraphStore(spark)
    term = "id string, name string"
    g.upsert_nodes("Metric", spark.createDataFrame([("m", "M")], term))
    g.upsert_nodes("BusinessTerm", spark.createDataFrame([("corp.sales.revenue", "Revenue")], term))
    tagged = spark.createDataFrame([("m", "osi.synonyms.revenue"), ("m", "osi.synonyms.turnover")], "src_id string, dst_id string")
    new = spark.createDataFrame([("osi.synonyms.revenue", "Revenue"), ("osi.synonyms.turnover", "Turnover")], term)
    for overwrite in (False, True):
        g.ingest(GraphBatch({"BusinessTerm": new}, {"Metric-TAGGED_WITH-BusinessTerm": tagged}, {"BusinessTerm": "name"}), overwrite=overwrite)
        assert {(r.id, r.name) for r in g.nodes("BusinessTerm").collect()} == {("corp.sales.revenue", "Revenue"), ("osi.synonyms.turnover", "Turnover")}
        assert {r.dst_id for r in g.edges("Metric-TAGGED_WITH-BusinessTerm").collect()} == {"corp.sales.revenue", "osi.synonyms.turnover"}


def test_commands_fill_a_store_and_export_from_it(spark, tmp_path, capsys):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "table_info.csv").write_text("database_name,schema_name,table_name\nShop,Sales,Orders\n")
    (tmp_path / "csv" / "schema_info.csv").write_text("database_name,schema_name\nShop,Sales\n")
    (tmp_path / "csv" / "database_info.csv").write_text("database_name\nShop\n")
    from schemaloom.queries.graph import _MODEL
    from schemaloom.sources import osi

    (tmp_path / "model.yaml").write_text(osi.dump(_MODEL))
    store = str(tmp_path / "store")
    said = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert tool.main([store, "ingest_csv", "--source", str(tmp_path / "csv")]) == 0 and said()["snapshot"]
    assert tool.main([store, "ingest_model", "--source", str(tmp_path / "model.yaml")]) == 0
    assert tool.main([store, "list_schemas"]) == 0 and len(said()["tool_list_schemas"]["results"]) == 1
    assert tool.main([store, "export_model", "--name", "Retail Sales", "--output", str(tmp_path / "out.yaml")]) == 0
    assert osi.load(str(tmp_path / "out.yaml"))["semantic_model"][0]["name"] == "Retail Sales"
    with pytest.raises(ConfigError):
        tool.ingest(spark, "csv", argparse.Namespace(source=None, store=store))


def test_question_bank_and_versions(spark):
    df = spark.createDataFrame([("q ", " SELECT 1\n", "other")], "question string, sql string, archetype string")
    with pytest.raises(Exception, match="unknown archetype"):
        evalkit.question_bank(df).collect()
    with pytest.warns(SchemaloomWarning):
        assert not GraphStore(spark).check_version("1")


def test_positional_match_over_partitions(spark):
    a = spark.range(500).repartition(7).select("id", (F.col("id") % 9).alias("v"))
    b = a.select("id", F.when(F.col("id") == 13, -1).otherwise(F.col("v")).alias("v"))
    r = evalkit.positional_match(a, b.filter("id < 400"), ["id"], ["id"]).first()
    assert (r.gold_rows, r.matching_rows) == (400, 399)
    assert evalkit.positional_match(a, b.limit(0), ["id"], ["id"]).first().row_match_pct == 1.0


def test_default_rows_and_missing_numbers(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "k string, v string")
    assert infoschema.with_default_row(df, {"k": "d"}).count() == 2
    assert [tuple(r) for r in infoschema.with_default_row(df.limit(0), {"k": "d"}).collect()] == [("d", None)]
    n = rows.without_nan(spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "n double, s string"))
    assert sorted((str(r.n), r.s) for r in n.collect()) == [("1.0", None), ("None", "x")]


def test_lineage_gives_source_texts(spark):
    sql = "WITH w AS (SELECT o.id::INT64 AS a, '\U0001f600' AS s FROM p.d.orders o) SELECT c.id FROM p.d.customers c JOIN w ON SAFE_CAST(c.id AS INT64) = w.a AND c.k = w.s"
    got = lineage.lineage(spark, sql, "q")
    assert got["cte_info"][0]["definition"] == "SELECT o.id::INT64 AS a, '\U0001f600' AS s FROM p.d.orders o"
    p = lineage.parse(spark, sql)
    assert p.joins == [("w", "SAFE_CAST(c.id AS INT64) = w.a AND c.k = w.s")]
    assert lineage.parse(spark, sql, walk=True) == p


def test_micro_batches_fill_a_store(spark, tmp_path):
    from schemaloom.streaming.delivery import ingest_stream

    for k in range(2):
        spark.createDataFrame([(f"s{k}", f"S{k}"), ("same", f"N{k}")], "id string, name string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    g = GraphStore(spark, f"{tmp_path}/store")

    def load(df, _):
        g.upsert_nodes("Schema", df)
        g.save()

    source = spark.readStream.schema("id string, name string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest_stream(source, load, f"{tmp_path}/cp").awaitTermination()
    assert {r.id for r in GraphStore.load(spark, f"{tmp_path}/store").nodes("Schema").collect()} == {"s0", "s1", "same"}
