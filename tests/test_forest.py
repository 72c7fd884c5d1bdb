"""The forest: same trees however they are grown, and as good as MLlib's."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import explain as ex
from flowlens.operators import forest as fo
from flowlens.operators import models as md


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in a], int(b), 1.0 + i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, a array<double>, label int, weight double").repartition(parts)
    return df.withColumn("features", array_to_vector("a")).sortWithinPartitions("i")


def table(n=1500, seed=5):
    rnd = np.random.default_rng(seed)
    y = rnd.choice(4, n, p=[0.55, 0.25, 0.1, 0.1])
    x = rnd.normal(size=(n, 9))
    x[:, 2] += 2.5 * (y == 1)
    x[:, 4] += 3 * (y == 2)
    x[:, 5] -= 3 * (y == 3)
    return x, y


def test_subtrees_are_those_of_histograms_over_all_blocks(spark, monkeypatch):
    """Nodes split over several blocks, one by one, and grown whole in a task."""
    x, y = table()
    df = frame(spark, x, y)
    monkeypatch.setattr(fo, "BLOCK", 400)
    far = fo.fit(df, weight="weight", trees=7, depth=9, min_leaf=2, local=0)
    mid = fo.fit(df, weight="weight", trees=7, depth=9, min_leaf=2, local=200)
    near = fo.fit(df, weight="weight", trees=7, depth=9, min_leaf=2)
    assert sum(len(t[0]) for t in near.trees) > 300
    for other in (far, mid):
        for a, b in zip(other.trees, near.trees):
            assert len(a[0]) == len(b[0])
        assert np.allclose(other.probabilities(x), near.probabilities(x), atol=1e-6)


def test_tree_follows_its_rows(spark):
    """Every leaf holds the weights by class of the drawn rows that reach it,
    at least the smallest number of them, and siblings predict different classes."""
    x, y = table(600)
    df = frame(spark, x, y, 1)
    m = fo.fit(df, weight="weight", trees=5, depth=6, min_leaf=7)
    w = 1.0 + np.arange(len(y)) % 3
    first = df.select(F.monotonically_increasing_id().alias("n"), "i").collect()
    assert [r.i for r in first] == list(range(len(y)))
    key = fo._mix(np.uint64(0) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(y), dtype=np.uint64))
    for t, (feature, threshold, left, stats) in enumerate(m.trees):
        n = fo._bag(key, t, fo.K.SEED)
        at = fo._route(x, feature, threshold, left)
        leaf = np.cumsum(left == 0) - 1
        for i in np.flatnonzero(left == 0):
            here = at == i
            assert n[here].sum() >= 7
            assert np.allclose(stats[leaf[i]], np.bincount(y[here], (w * n)[here], 4))
        for i in np.flatnonzero(left):
            a = left[i]
            if not left[a] and not left[a + 1]:
                assert stats[leaf[a]].argmax() != stats[leaf[a + 1]].argmax()


def test_bag_is_poisson():
    n = fo._bag(fo._mix(np.arange(200_000, dtype=np.uint64)), 3, 42)
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.01


def test_as_good_as_mllib_and_reloads(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    x, y = table(2400)
    df = frame(spark, x, y)
    train, test = df.where("i % 4 > 0").cache(), df.where("i % 4 = 0").cache()
    mine = md.train_forest(train, "label", "weight", 40, 10, 5)
    theirs = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=40, maxDepth=10,
                                    minInstancesPerNode=5, seed=1).fit(train)
    p = [np.array([r.p for r in m.transform(test).select(vector_to_array("probability").alias("p")).collect()])
         for m in (mine, theirs)]
    label = np.array([r.label for r in test.select("label").collect()])
    right = [(v.argmax(axis=1) == label).mean() for v in p]
    assert right[0] > right[1] - 0.02 and right[0] > 0.85
    assert np.abs(p[0] - p[1]).mean() < 0.05
    mine.table(spark).write.parquet(f"{tmp_path}/m")
    again = fo.from_table(spark.read.parquet(f"{tmp_path}/m"))
    assert np.array_equal(again.probabilities(x), mine.probabilities(x))
    assert (again.getNumTrees, again.getMaxDepth(), again.getMinInstancesPerNode(), again.numClasses) == (40, 10, 5, 4)


def test_mllib_scores_a_small_forest_as_python_does(spark, monkeypatch):
    x, y = table(500)
    x[::7, 2] = np.nan
    df = frame(spark, x, y)
    m = md.train_forest(df, "label", None, 9, 8, 2)
    assert m.native(spark).numClasses == 4 and m.native(spark).getNumTrees == 9
    a = m.transform(df).orderBy("i").collect()
    monkeypatch.setattr(fo, "NATIVE", 0)
    b = m.transform(df).orderBy("i").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]
    assert np.allclose([r.probability.toArray() for r in a], [r.probability.toArray() for r in b], atol=1e-9)
    assert np.allclose(m.probabilities(x), [r.probability.toArray() for r in b], atol=1e-9)


def test_a_pass_over_a_table_of_one_row_group_is_spread(spark):
    from flowlens.plans.registry import materialize, spread
    one = spark.range(5000).coalesce(1)
    assert materialize(one).rdd.glom().map(len).filter(lambda n: n > 0).count() == 1
    parts = spread(one).rdd.glom().map(len).collect()
    assert len(parts) >= 8 and max(parts) < 2000 and sum(parts) == 5000


def test_deep_forest_takes_few_jobs(spark):
    """The number of jobs does not grow with the nodes of the trees."""
    x, y = table(3000, 8)
    df = frame(spark, np.round(x, 3), np.random.default_rng(1).permutation(y))       # nothing to learn: deep trees
    sc = spark.sparkContext
    sc.setJobGroup("forest", "deep")
    m = md.train_forest(df, "label", None, 40, 20, 1)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(t[0]) for t in m.stages[-1].trees) > 20_000
    assert len(sc.statusTracker().getJobIdsForGroup("forest")) < 15


def test_forest_edges(spark):
    """Missing and constant features, one class, one row; a missing label raises."""
    x = np.array([[1.0, np.nan if i % 3 else i, i % 2] for i in range(60)])
    df = frame(spark, x, np.arange(60) % 2)
    m = md.train_forest(df, "label", None, 5, 4, 1)
    got = m.transform(df).select("label", "prediction").collect()
    assert all(r.label == r.prediction for r in got)
    assert all(t[0].max() > 0 for t in m.trees)                # the constant is never split on
    one = md.train_forest(df.where("label = 0"), "label", None, 3, 4, 1)
    assert {r.prediction for r in one.transform(df).select("prediction").collect()} == {0.0}
    assert len(md.train_forest(df.limit(1), "label", None, 3, 4, 1).trees) == 3
    with pytest.raises(ValueError):
        md.train_forest(df.withColumn("label", F.expr("if(i < 40, label, null)")), "label", None, 5, 4, 1)


def test_edges_of_few_and_of_many_values():
    w = np.ones(6)
    assert fo._edges(np.array([0, 0, 0, 0, 1, 3.0]), w, 32).tolist() == [0.5, 2.0]
    assert fo._edges(np.array([2.0, 2, np.nan]), w[:3], 32).tolist() == []
    v = np.arange(1000.0)
    e = fo._edges(v, np.ones(1000), 32)
    assert len(e) == 31 and np.abs(np.diff(np.concatenate([[-.5], e, [999.5]])) - 31.25).max() <= 1


def test_node_table_has_mllib_columns(spark):
    x, y = table(300)
    m = md.train_forest(frame(spark, x, y), "label", None, 2, 3, 1)
    nodes = ex.forest_nodes(m.stages[-1], spark)
    for _, t in nodes.groupby("treeID"):
        t = t.set_index("id")
        for r in t.itertuples():
            if r.leftChild >= 0:
                assert np.allclose(r.impurityStats, t.loc[r.leftChild].impurityStats + t.loc[r.rightChild].impurityStats)
