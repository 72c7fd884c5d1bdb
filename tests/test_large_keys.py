"""Flows of order keys that do not fit the packed 63-bit flow key."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from __spark_entry__ import queries
from flowlens.sources import adapters

SHIFT = 53_000_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The small tables with the order keys of 360 shifted copies."""
    d = str(tmp_path_factory.mktemp("far"))
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").withColumn(key, F.col(key) + SHIFT).write.parquet(f"{d}/{t}.parquet")
    return d


def test_keys_of_large_orders_are_distinct_and_steady(spark, far):
    keys = [r[0] for r in adapters.flows(spark, far).select("flow_key").collect()]
    lines = adapters.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    assert len(keys) == lines.count() and len(set(keys)) == lines.distinct().count()
    assert all(k >= 0 for k in keys)
    assert sorted(keys) == sorted(r[0] for r in adapters.predictions(spark, far).select("flow_key").collect())


def test_keys_that_fit_stay_packed_and_missing_ones_missing(spark):
    rows = [(1, 2, 3, 4), ((1 << 24) - 1, (1 << 21) - 1, (1 << 15) - 1, 7), (1 << 24, 0, 0, 1), (None, 1, 1, 1), (1 << 40, None, 1, 1)]
    l = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    got = [r[0] for r in l.select(adapters.flow_key_expr(l)).collect()]
    assert got[:2] == [((o * 2097152 + p) * 32768 + s) * 8 + n for o, p, s, n in rows[:2]]
    assert got[2] >= 0 and got[3:] == [None, None]


@pytest.mark.parametrize("name", ["corr_prune", "impute_median", "normalize_ae_score", "anomaly_flag", "src_csv_glob"])
def test_queries_take_large_orders(spark, far, name):
    """A query that does not show the key gives the rows it gives on small keys."""
    got, want = (queries()[name](spark, d).drop("flow_key") for d in (far, SF_SMALL))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
