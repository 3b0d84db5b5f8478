"""A third of all rows on one key: adaptive execution splits the join that meets it."""

import datetime as dt

import pytest

from schemaloom.operators.delivery import surplus_deliveries
from schemaloom.operators.orphans import orphan_references

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


def test_orphans(skewed):
    day = dt.datetime(2025, 1, 1)
    refs = skewed.range(30_000).repartition(6).selectExpr("'t' as ref_table", "id as ref_id", "if(id % 3 = 0, 'hot', cast(id as string)) as key", "timestamp'2025-02-01' as ref_time")
    parents = skewed.createDataFrame([("hot", day, None)], "key string, start timestamp, end timestamp")
    found = orphan_references(refs, parents)
    assert splits(found) and found.count() == 20_000


def test_deliveries(skewed):
    rows = skewed.range(30_000).repartition(6).selectExpr("id as delivery_id", "if(id % 3 = 0, 'hot7', concat(cast(id div 2 as string), 'x')) as insert_id", "'l' as log_name")
    found = surplus_deliveries(rows, steps=2)
    assert splits(found) and found.count() == 9_999 + 10_000 // 2
