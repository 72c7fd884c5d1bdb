"""Property tests for the model-based (rows-checked) operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import clean, explain as ex, iforest, models as md, select as sl


def _emb(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features_arr"))


def test_class_weights_sum_to_n(spark):
    e = _emb(spark)
    w = md.class_weights(e, "label")
    tot = w.agg(F.sum("weight")).first()[0]
    assert tot == pytest.approx(e.count())


def test_split_shares_per_class(spark):
    e = _emb(spark)
    s = clean.stratified_split(e, key="vec_id", col="label")
    rows = s.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t"))
    for r in rows.collect():
        assert abs(r.t - round(r.n * 0.2)) <= 1


def test_forest_attributions_add_up(spark):
    e = _emb(spark).withColumn("features", md.array_to_vector(F.col("features_arr")))
    m = md.train_forest(e, "label", None, trees=5, depth=4, min_leaf=1)
    rf = m.stages[-1]
    nodes = ex.forest_nodes(rf, spark)
    rows = ex.attribution_rows(e.limit(20), nodes, "vec_id", "features_arr", 64, rf.numClasses)
    sums = rows.groupBy("vec_id", "class").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    pred = m.transform(e.limit(20)).select("vec_id", md.vector_to_array("probability").alias("p"))
    j = sums.join(pred, "vec_id").select("s", "b", F.col("p")[F.col("class")].alias("prob")).collect()
    assert j and all(abs(r.s + r.b - r.prob) < 1e-9 for r in j)


def test_attributions_equal_brute_force_shapley(spark):
    import math
    from itertools import combinations
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(120, 4)), 2)
    y = (X[:, 0] + X[:, 1] * X[:, 2] > 0).astype(int) + (X[:, 3] > 1)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(120)],
                               "id int, arr array<double>, label int")
    df = df.withColumn("features", md.array_to_vector(F.col("arr")))
    rf = md.train_forest(df, "label", None, trees=3, depth=5, min_leaf=1).stages[-1]
    nodes = ex.forest_nodes(rf, spark)
    got = {(r.id, r["class"], r.feature): r.phi
           for r in ex.attribution_rows(df.limit(8), nodes, "id", "arr", 4, 3).collect()}

    def value(tree, i, x, known):
        r = tree.loc[i]
        if r.leftChild not in tree.index:
            return np.asarray(r.impurityStats) / np.sum(r.impurityStats)
        le, ri = int(r.leftChild), int(r.rightChild)
        if int(r.featureIndex) in known:
            return value(tree, le if x[int(r.featureIndex)] <= r.leftCategoriesOrThreshold[0] else ri, x, known)
        wl, wr = (np.sum(tree.loc[k].impurityStats) for k in (le, ri))
        return (wl * value(tree, le, x, known) + wr * value(tree, ri, x, known)) / (wl + wr)

    trees = [t.set_index("id") for _, t in nodes.groupby("treeID")]
    for row in sorted({k[0] for k in got}):
        v = {s: np.mean([value(t, 0, X[row], s) for t in trees], axis=0)
             for m in range(5) for s in map(frozenset, combinations(range(4), m))}
        for f in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (v[s | {f}] - v[s])
                       for s in v if f not in s)
            for k in range(3):
                assert got[(row, k, f)] == pytest.approx(want[k], abs=1e-9)


def test_correlation_of_large_values_and_anova_by_numpy(spark):
    rng = np.random.default_rng(11)
    a = 1e9 + rng.normal(size=400)
    b = 1e9 + 0.5 * (a - 1e9) + 0.1 * rng.normal(size=400)
    y = rng.integers(0, 3, 400)
    rows = [(float(a[i]), float(b[i]) if i % 10 else None, 7e9, float(a[i] - 1e9 + y[i]), int(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, k double, s double, label int").repartition(3)
    r = {(x.i, x.j): x.r for x in sl.corr_pairs(df, ["a", "b", "k", "s"]).collect()}
    some = np.arange(400) % 10 > 0
    assert r[(0, 1)] == pytest.approx(abs(np.corrcoef(a[some], b[some])[0, 1]), abs=1e-6)
    assert r[(0, 2)] is None and r[(2, 3)] is None
    got = {x.feature: x.score for x in sl.anova_scores(df, ["a", "s"]).collect()}
    for name, v in (("a", a - 1e9), ("s", a - 1e9 + y)):
        g = [v[y == k] for k in range(3)]
        ssb = sum(len(q) * (q.mean() - v.mean()) ** 2 for q in g)
        ssw = sum(((q - q.mean()) ** 2).sum() for q in g)
        assert got[name] == pytest.approx((ssb / 2) / (ssw / 397), rel=1e-5)


def test_ovr_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1,)], "x int").select(
        md.array_to_vector(F.array(F.lit(1.0477), F.lit(-0.5), F.lit(0.2))).alias("rawPrediction"))
    p = md.ovr_probabilities(df).first().probability_vec
    assert sum(p) == pytest.approx(1.0)
    # margin 1.0477 <-> member probability 0.8905
    assert 1 / (1 + np.exp(-2 * 1.0477)) == pytest.approx(0.8905, abs=1e-4)


def test_pca_full_rank_reconstructs(spark):
    e = _emb(spark).withColumn("features", md.array_to_vector(F.col("features_arr")))
    m = md.train_reconstruction(e, 64)
    err = md.reconstruct(m, e.select("vec_id", "features_arr"), "features_arr")
    assert err.agg(F.max("recon_error")).first()[0] < 1e-12


def test_isolation_forest_planted_outlier(spark):
    rng = np.random.default_rng(1)
    pts = [(i, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(400)]
    pts.append((999, [12.0, -12.0, 12.0, -12.0]))
    df = spark.createDataFrame(pts, "row_id long, features_arr array<double>")
    nodes = iforest.fit(df, "features_arr", "row_id", trees=50, sample_size=128)
    s = iforest.score(df, nodes, "features_arr", sample_size=128)
    top = s.orderBy(F.col("iso_score").desc()).first()
    assert top.row_id == 999
    lo, hi = s.agg(F.min("iso_score"), F.max("iso_score")).first()
    assert 0 < lo < hi < 1


def test_corr_prune_detects_copies(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float((i * 7919) % 13), 1.0) for i in range(50)],
                               "a double, b double, c double, k double")
    out = {r.feature: r.dropped for r in sl.corr_prune(df, ["a", "b", "c", "k"]).collect()}
    assert out == {"a": False, "b": True, "c": False, "k": False}


def test_shadow_selection_rejects_noise(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, y, float(y * 5 + rng.normal()), float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "flow_key long, y int, good double, noise1 double, noise2 double")
    out = {r.feature: r.status for r in sl.boruta_select(df, ["good", "noise1", "noise2"], "y", "flow_key",
                                                           rounds=8, trees=20).collect()}
    assert out["good"] == "confirmed"
    assert out["noise1"] != "confirmed" and out["noise2"] != "confirmed"


def test_resample_sizes(spark):
    e = _emb(spark)
    s = sl.equal_class_resample(e.select("vec_id", "label"), "label", "vec_id", 1000)
    k = e.select("label").distinct().count()
    counts = [r[1] for r in s.groupBy("label").count().collect()]
    assert all(c == 1000 // k for c in counts)


def test_tabled_attributions_equal_those_row_by_row(spark, monkeypatch):
    """values looked up by pattern are those made for the row, missing
    values included; a table in one partition is spread over the cores."""
    import numpy as np
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(400, 7)).round(1)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] + x[:, 3] > 1)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, arr array<double>, label int").coalesce(1)
    rf = md.train_forest(md.array_features(df, "arr"), weight=None, trees=5, depth=6, min_leaf=2).stages[-1]
    nodes = ex.forest_nodes(rf, spark)
    trees = ex._tree_leaves(nodes)
    x[::9, 1], x[::13, 4] = np.nan, np.nan
    found, base = ex.shapley_attributions(x, trees, 4)
    monkeypatch.setattr(ex, "TABLED", -1)
    plain, again = ex.shapley_attributions(x, trees, 4)
    assert np.abs(plain).max() > 0.01 and np.allclose(found, plain, rtol=0, atol=1e-14) and np.array_equal(base, again)
    # Local accuracy, a missing value going right as in the forest's own scores.
    assert np.allclose(found.sum(axis=2)[:, :3] + base[:3], rf.probabilities(x), atol=1e-6) and not found[:, 3].any()
    out = ex.attribution_rows(df, nodes, "id", "arr", 7, 3)
    assert out.rdd.getNumPartitions() > 1 and out.count() == 400 * 7 * 3
