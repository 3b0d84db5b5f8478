"""A third of all rows under one digest, anchor or line: adaptive execution splits the join that meets them."""

import pytest
from pyspark.sql import functions as F

from schemaloom.llm.normal_form import Leaf, Record, hidden_copies, word_multiset
from schemaloom.llm.spans import repeated_lines

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def test_hidden_copies(skewed):
    rows = skewed.range(30_000).repartition(6).selectExpr("id", "'g' as g", "if(id % 3 = 0, 'Hot Term', concat('t', cast(id div 2 as string))) as name")
    found = hidden_copies(rows, "id", Record((("g", Leaf(F.col("g"))), ("name", word_multiset("name")))))
    assert splits(found) and found.count() == 9_999 + 5_000


def test_repeated_lines(skewed):
    rows = skewed.range(30_000).repartition(6).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot', 20), repeat(cast(id div 2 as string), 40)) as text")
    found = repeated_lines(rows)
    assert splits(found) and found.count() == 9_999 + 5_000
