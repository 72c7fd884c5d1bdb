"""Plan shape checks: pushdown and pruning reach the scan, newest-first
lists are top-k, broadcasts only where the side is bounded."""

from conftest import SF_SMALL

from __spark_entry__ import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_query_is_topk_with_pushdown(spark):
    p = _plan(queries()["q_by_type"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema" in p or "FileScan" in p


def test_feature_scan_prunes_columns(spark):
    df = queries()["f_flag_total"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # lineitem columns never needed by the flag total stay out of the scan
    assert "l_shipdate" not in p.split("FileScan parquet")[1].split("ReadSchema")[1].split("\n")[0]


def test_live_traffic_broadcasts_only_the_top_rows(spark):
    df = queries()["q_live_traffic"](spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 50" in p


def test_roc_prefix_is_bucketed(spark):
    # the running sums are partitioned by bucket, never a single global window
    df = queries()["roc_curve"](spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" in p


def test_wide_projections_compile_to_machine_code(spark):
    """HotSpot does not compile methods above 8,000 bytes: no generated stage
    of the flow features may stay whole above that."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    queries()["constant_prune"](spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_reports_join_the_flows_once(spark):
    """Ranges, decisions and metadata read written results: no join of
    lineitem and orders is left in the plan to run again."""
    for name in ("alert_log_rows", "decision_table", "join_metadata", "q_flow_summary", "q_live_traffic"):
        p = queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in p, name


def test_row_attribution_has_no_join(spark):
    """Rows that a Python step has multiplied are never broadcast; a key's
    copies are judged together and rows without a key have no class."""
    from flowlens.operators import explain as ex
    rows = [(1, 0, 0, 0.1, 0.5), (1, 0, 1, -0.3, 0.5), (1, 1, 0, 0.2, 0.4), (1, 1, 1, 0.1, 0.4), (2, 0, 0, 0.2, 0.5),
            (2, 1, 0, -0.2, 0.4), (None, 0, 0, 9.0, 0.5)]
    out = ex.row_attribution(spark.createDataFrame(rows, "k long, class int, feature int, phi double, base double"), "k")
    assert "Join" not in _plan(out)
    assert out.columns == ["k", "class", "feature", "phi", "base", "top_class", "top_base"]
    assert sorted(map(tuple, out.collect())) == [(*r, 0, 0.5) for r in rows[:-1]]


def test_thresholds_join_once(spark, monkeypatch):
    """The predictions behind the three thresholds are joined once."""
    from flowlens.plans import q_eval
    calls, real = [], q_eval.preds
    monkeypatch.setattr(q_eval, "preds", lambda *a: calls.append(a) or real(*a))
    p = _plan(queries()["eval_thresholds"](spark, SF_SMALL))
    assert len(calls) == 1 and "lineitem" not in p


def test_flow_csvs_are_written_compressed(spark):
    df = queries()["src_csv_glob"](spark, SF_SMALL)
    files = [f.removeprefix("file://") for f in df.inputFiles()]
    assert files and all(f.endswith(".csv.gz") for f in files)
