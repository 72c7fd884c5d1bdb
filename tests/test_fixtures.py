"""Hand fixtures: missing values, NaN / infinity, constant columns, zero
means, unknown labels, empty tables, and the formula checks quoted in the
survey for the two sample flows."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions.nulls import floor_at, row_sum
from flowlens.operators import alerts as al
from flowlens.operators import clean, evaluate as ev, features as fe, fusion as fu
from flowlens.sources import io


def test_enforce_numeric_bad_text_and_infinity(spark):
    df = spark.createDataFrame([("1.5", "x"), ("Infinity", "y"), ("abc", "z"), (None, "w"), ("-inf", "v")],
                               "flow_duration string, label string")
    out = [r.flow_duration for r in clean.enforce_numeric(df).collect()]
    assert out == [1.5, None, None, None, None]


def test_floor_keeps_missing_and_row_sum_skips_it(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, None), (5.0, 2.0)], "a double, b double")
    r = df.select(floor_at(F.col("a"), 1e-3).alias("f"), row_sum([F.col("a"), F.col("b")]).alias("s")).collect()
    assert [x.f for x in r] == [None, 1e-3, 5.0]
    assert [x.s for x in r] == [1.0, 0.0, 7.0]


def test_exact_median_interpolates(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,), (7.0,)], "x double")
    assert clean.fit_medians(df, ["x"]).first().x == 2.5


def test_scaler_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "c double, v double")
    out = clean.standard_scale(df, clean.fit_scaler(df, ["c", "v"]), ["c", "v"]).collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert [r.v for r in out] == [-1.0, 1.0]          # population std


def test_counts_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (None,)], "n double")
    assert [r.n for r in clean.counts_to_int(df, ["n"]).collect()] == [2, 4, 0]


def test_labels_trim_dash_unknown(spark):
    df = spark.createDataFrame([(" Web Attack – Brute Force",), ("Web Attack � XSS",), ("Nope",)], "label string")
    g = clean.group_labels(clean.clean_label_text(df, "label"), "label")
    assert [r.label for r in g.collect()] == ["BruteForce", "Web", None]
    um = clean.unmapped_labels(clean.clean_label_text(df, "label")).collect()
    assert [r.label for r in um] == ["Nope"]


def test_inf_nan_to_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (2.0,)], "x double")
    assert [r.x for r in clean.inf_to_null(df).collect()] == [None, None, None, 2.0]


def _sample_flow(spark):
    """First sample flow of the flow-meter output: 2 forward packets, 3
    backward, 1559 µs, forward lengths 7 and 0."""
    return spark.createDataFrame(
        [(1559.0, 2.0, 3.0, 7.0, 0.0, 3.5, 0.0, 4.949747468305833, 0.0, 0.0, 0.0, 6)],
        "flow_duration double, total_fwd_packets double, total_backward_packets double, "
        "fwd_packets_length_total double, bwd_packets_length_total double, fwd_packet_length_mean double, "
        "fwd_packet_length_min double, fwd_packet_length_std double, bwd_packet_length_mean double, "
        "bwd_packet_length_min double, bwd_packet_length_std double, protocol int")


def test_sample_flow_rate_and_entropy(spark):
    x = fe.row_features(clean.one_hot_protocol(_sample_flow(spark), ["6"])).first()
    # 5 packets (+eps) in 1559 µs
    assert x.packet_rate == pytest.approx(5.001 / 0.001559, rel=1e-12)
    assert round(5 / 0.001559, 2) == 3207.18
    # entropy of (std_fwd + 1e-9, std_bwd + 1e-9): almost all mass on one side
    p = (4.949747468305833 + 1e-9) / (4.949747468305833 + 2e-9)
    q = 1 - p
    assert x.packet_entropy == pytest.approx(-(p * math.log2(p) + q * math.log2(q)), rel=1e-6)
    assert x.tcp_behavior == 1559.0


def test_sample_std_of_lengths(spark):
    df = spark.createDataFrame([(0.0,), (7.0,)], "x double")
    assert round(df.agg(F.stddev_samp("x")).first()[0], 4) == 4.9497


def test_equal_stds_entropy_is_one(spark):
    df = spark.createDataFrame([(2.0, 2.0)], "a double, b double")
    assert df.select(fe.packet_entropy(F.col("a"), F.col("b")).alias("h")).first().h == pytest.approx(1.0)


def test_anomaly_index_constant_parts(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 1.0, 1.0)], "burst_ratio double, active_cv double, "
                               "flag_change_rate double")
    st = fe.fit_feature_stats(df)
    out = fe.apply_feature_stats(df, st).collect()
    assert [r.flow_anomaly_index for r in out] == [0.0, 0.0]


def test_severity_rules(spark):
    from flowlens.functions.rules import severity_infer, severity_normalize
    df = spark.createDataFrame([("DoS", 0.9, None), ("DoS", 0.8, None), ("Malware", 0.95, None),
                                ("Web", 0.1, None), ("Other", 0.5, None), ("Scan", 0.5, "None"),
                                ("Scan", 0.5, "high")], "t string, c double, g string")
    r = df.select(severity_normalize(F.col("g"), F.col("t"), F.col("c")).alias("s")).collect()
    assert [x.s for x in r] == ["HIGH", "MEDIUM", "CRITICAL", "MEDIUM", "MEDIUM", "LOW", "HIGH"]


def test_fusion_rules(spark):
    df = spark.createDataFrame(
        [(1, 2e7, 0.9, "DoS"), (2, 6e7, 0.9, "DoS"), (3, 6e7, 0.9, "Benign"), (4, 1.0, 0.0, "Scan"),
         (5, 2e7, 0.5, None)],
        "flow_key int, ae_score double, attack_score_supervised double, xgb_label string")
    d = {r.flow_key: r for r in fu.decide(df, decided_at=F.lit(None).cast("timestamp")).collect()}
    assert d[1].attack and d[1].reason == "Rule-based fusion triggered" and d[1].severity == "Medium"
    assert d[2].severity == "High"
    assert not d[3].attack and d[3].severity == "None" and d[3].attack_type == "None"
    assert not d[4].attack                    # confidence normalised to 0 -> below every threshold
    assert d[5].attack                        # a missing label is not "Benign"


def test_minmax_confidence_constant(spark):
    df = spark.createDataFrame([(0.3,), (0.3,)], "attack_score_supervised double")
    assert [r.xgb_confidence for r in fu.minmax_confidence(df).collect()] == [0.5, 0.5]


def test_results_safe_missing_path(spark, tmp_path):
    schema = "timestamp timestamp, src_ip string, combined_score double"
    df = io.read_results_safe(spark, str(tmp_path / "nothing"), spark.createDataFrame([], schema).schema)
    assert df.count() == 0 and df.columns == ["timestamp", "src_ip", "combined_score"]


def test_flow_csvs_error_when_none(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_flow_csvs(spark, str(tmp_path))


def test_default_explanation_blank_text(spark):
    df = spark.createDataFrame([("DoS", "  "), ("Zzz", None), ("Scan", "model says so")],
                               "attack_type string, explanation string")
    out = [r.explanation_text for r in al.default_explanation(df).collect()]
    assert out[0] == al.CANNED_EXPLANATIONS["DoS"]
    assert out[1] == al.GENERIC_EXPLANATION
    assert out[2] == "model says so"


def test_fp_bands_closed_both_ends(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "e double")
    out = {r.band: r for r in ev.fp_scenarios(df, "e", 99.0).collect()}
    assert out["edge"].tested == 2 and out["edge"].flagged == 2      # 99 and 100
    assert out["heavy"].flagged == 1                                   # 99 sits in both bands
    assert out["overall"].verdict == "PASS"


def test_roc_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    auc = ev.roc_auc(df, F.col("y") == 1, "s").first().roc_auc
    assert auc == pytest.approx(0.875)
    auc4 = ev.roc_auc(df, F.col("y") == 1, "s", ranges=3).first().roc_auc
    assert auc4 == pytest.approx(0.875)


def test_exact_quantiles_match_numpy(spark):
    from flowlens.operators.quantiles import exact_quantiles, exact_quantiles_multi
    import random
    import numpy as np
    rnd = random.Random(5)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 7 == 0 else rnd.gauss(0, 10) for i in range(5000)]
    df = spark.createDataFrame([(v, 4.0, None, float(i)) for i, v in enumerate(vals)] +
                               [(None, None, None, None), (float("nan"), 4.0, None, None)],
                               "x double, same double, none double, seq double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    want = [float(np.quantile(vals, q)) for q in qs]
    for accuracy in (100, 100_000):                       # wide brackets and narrow ones
        assert exact_quantiles(df, "x", qs, accuracy) == pytest.approx(want, abs=1e-12)
    same, none, seq = exact_quantiles_multi(df, ["same", "none", "seq"], qs, 50)
    assert same == [4.0] * 6 and none == [None] * 6
    assert seq == pytest.approx([float(np.quantile(np.arange(5000), q)) for q in qs])
    for n in (1, 2, 3):                                    # very few rows
        few = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        assert exact_quantiles(few, "x", [0.9]) == pytest.approx([float(np.quantile(np.arange(n), 0.9))])


def test_running_counts_over_ranges_and_missing_scores(spark):
    df = spark.createDataFrame([(i % 2, (i * 37 % 101) / 7) for i in range(1000)] + [(1, None)], "y int, s double")
    rows = ev.roc_points(df, F.col("y") == 1, "s", ranges=7).orderBy(F.desc("threshold")).collect()
    assert len(rows) == 101 and rows[-1].cum_pos == 500 and rows[-1].cum_neg == 500 and rows[0].P == 500
    pos = neg = 0
    for r in rows:
        pos, neg = pos + r.pos, neg + r.neg
        assert (r.cum_pos, r.cum_neg) == (pos, neg)


def test_flow_assembly_across_midnight_gap_and_fin(spark):
    import datetime as dt
    from flowlens.operators import assemble as asm
    t = dt.datetime(2024, 1, 1, 23, 0, 0)
    rows = [  # packet_id, src, ts, is_forward, length, fin
        (1, 7, t, False, 10.0, False),
        (2, 7, t + dt.timedelta(hours=1, minutes=30), True, 20.0, False),     # next day, same flow
        (3, 7, t + dt.timedelta(hours=9), True, 30.0, False),                 # 7.5 h idle -> new flow
        (4, 7, t + dt.timedelta(hours=9, minutes=10), False, 40.0, True),     # FIN ...
        (5, 7, t + dt.timedelta(hours=9, minutes=20), True, 50.0, False),     # ... closes: new flow
        (6, 8, t, True, 5.0, False),
    ]
    df = spark.createDataFrame(rows, "packet_id long, src long, ts timestamp_ntz, is_forward boolean, "
                                     "length double, fin boolean")
    # Conversation 7 goes between two hosts in both directions.
    user, server = F.concat(F.lit("10.0.0."), "src"), F.lit("1.1.1.1")
    df = (df.withColumn("src_ip", F.when(F.col("is_forward"), user).otherwise(server)).withColumn("dst_ip", F.when(F.col("is_forward"), server).otherwise(user))
          .withColumn("src_port", F.when(F.col("is_forward"), 4000).otherwise(80)).withColumn("dst_port", F.when(F.col("is_forward"), 80).otherwise(4000))
          .withColumn("protocol", F.lit(6)))
    a = {r.packet_id: r for r in asm.assemble_flows(df).collect()}
    assert [a[i].flow_no for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 1, 1, 2, 0]
    assert a[2].iat_us == 90 * 60 * 1_000_000
    assert a[1].direction == "fwd" and a[2].direction == "bwd"        # relative to the flow's first packet
    assert a[3].direction == "fwd" and a[4].direction == "bwd"
    assert a[4].dir_iat_us is None and a[3].iat_us is None             # first packet of a flow
    assert a[2].flow_id == "1.1.1.1-10.0.0.7-80-4000-6" and a[3].flow_id == "10.0.0.7-1.1.1.1-4000-80-6"
    m = {(int(r.flow_id.split("10.0.0.")[1][0]), r.flow_no): r for r in asm.flow_measures(asm.assemble_flows(df)).collect()}
    assert m[(7, 0)].n_packets == 2 and m[(7, 0)].duration_us == 90 * 60 * 1_000_000
    assert m[(7, 1)].fin_count == 1 and m[(7, 2)].n_packets == 1
    assert round(m[(7, 1)].len_std, 4) == round(((40 - 30) ** 2 / 2) ** 0.5, 4)


def test_running_sums_over_ranges(spark):
    import datetime as dt
    from flowlens.operators.drift import running_sums
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a" if i % 3 else "b", t0 + dt.timedelta(minutes=i * 7 % 50), i, i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "sensor string, ts timestamp, event_id int, v int")
    got = {r.event_id: (r["rank"], r.cum) for r in running_sums(df, "sensor", "ts", "event_id", "v", ranges=6).collect()}
    for sensor in "ab":
        cum = 0
        for rank, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == sensor), key=lambda r: (r[1], r[2]))):
            cum += v
            assert got[i] == (rank, cum)


def test_quantile_brackets_are_counted_not_sketched(spark):
    """No task holds a sketch of a column: brackets come from counted
    stretches, and each holds a wanted rank and few rows or one value."""
    import numpy as np
    from flowlens.operators import quantiles as qu
    rnd = np.random.default_rng(4)
    x = rnd.lognormal(3, 4, 20000).tolist()
    df = spark.createDataFrame([(v, float(k % 3), -v if k % 7 else None) for k, v in enumerate(x)],
                               "x0 double, x1 double, x2 double").repartition(5)
    size, spans = qu._brackets(df, [0.0, 0.25, 0.9, 1.0], 100_000)
    assert size == [20000, 20000, sum(k % 7 > 0 for k in range(20000))]
    assert spans[1] == [(0.0, 0.0), (2.0, 2.0)]
    x = np.sort(x)
    for lo, hi in spans[0]:
        assert lo == hi or ((x >= lo) & (x <= hi)).sum() <= 1000
    for k in (0, 4999, 5000, 17999, 18000, 19999):
        assert any(lo <= x[k] <= hi for lo, hi in spans[0])
