"""Driver contract: entry smoke, registry consistency."""

from conftest import SF_SMALL


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) >= {"label", "n_flows"}


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 130
    # the text queries come from their own subpackage alone: all or none
    from flowlens.plans.catalog import QUERIES
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]
    text = set(q) - set(QUERIES)
    assert not text or (len(text) == 14 and "pipeline" in text)


def test_feature_summary_counts_every_flow(spark):
    from __spark_entry__ import queries
    df = queries()["feature_summary"](spark, SF_SMALL)
    n = sum(r.n_flows for r in df.collect())
    assert n == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
