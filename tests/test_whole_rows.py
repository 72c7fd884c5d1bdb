"""Rankings and models are fitted on all rows; forests over broadcast rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF_SMALL

from flowlens.operators import clean, forest, models as md, select as sl
from flowlens.plans import q_select, q_stream
from flowlens.plans.q_select import train_rows


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    return spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))],
                                 "flow_key long, y int, f0 double, f1 double, f2 double, f3 double, f4 double").repartition(3).checkpoint()


NAMES = [f"f{i}" for i in range(5)]


def _vectors(df):
    return df.withColumn("features", array_to_vector(F.array(*NAMES))).withColumn("weight", F.col("y") + 0.5)


@pytest.mark.parametrize("weight", [None, "weight"])
def test_shared_rows_grow_the_trees_of_the_blocks(rows, monkeypatch, weight):
    fit = lambda: forest.fit(_vectors(rows), label="y", weight=weight, trees=6, depth=6, local=300)
    shared = fit()
    monkeypatch.setattr(forest, "SHARED", 0)
    for a, b in zip(shared.trees, fit().trees, strict=True):
        for u, v in zip(a, b, strict=True):
            np.testing.assert_allclose(u, v, rtol=1e-6)


def test_importances_are_those_of_mllib(rows, monkeypatch):
    small = {r.feature: r.score for r in sl.rf_importance(rows, NAMES, "y", trees=40, depth=5).collect()}
    monkeypatch.setattr(sl, "SMALL", 1000)
    large = {r.feature: r.score for r in sl.rf_importance(rows, NAMES, "y", trees=40, depth=5).collect()}
    assert abs(sum(large.values()) - 1) < 1e-9
    assert all(abs(small[f] - large[f]) < 0.06 for f in NAMES)


def test_boruta_over_shared_rows(rows, monkeypatch):
    monkeypatch.setattr(sl, "SMALL", 1000)
    got = {r.feature: r for r in sl.boruta_select(rows, NAMES, "y", rounds=12, trees=10, depth=5).collect()}
    assert [got[f].status for f in NAMES[:2]] == ["confirmed"] * 2
    assert not any(got[f].selected for f in NAMES[2:])


def test_shadows_are_the_rows_that_a_round_pairs(spark):
    """The row after a row of class 0 0 1 1 0 0 1 1 ... says half of what the
    row itself says; a feature that says nothing does not beat its shadow."""
    ranked = spark.range(400).select(F.col("id").alias("rank"), (F.col("id") % 4 < 2).cast("int").alias("y"))
    x = ranked.select("*", F.col("y").cast("double").alias("f0"), F.lit(1.0).alias("f1"))
    assert forest.shadow_hits(x, ["f0", "f1"], "y", [(1, 1, 1), (401, 1, 2)], 8, 2) == [[1, 0], [1, 0]]


def test_boruta_query_looks_at_all_rows(spark, monkeypatch):
    """More rows than the 100,000 that it once drew."""
    seen = []
    x = spark.range(100_500).select(F.col("id").alias("flow_key"), F.concat(F.lit("c"), F.col("id") % 3).alias("label"), F.rand(1).alias("f"))
    monkeypatch.setattr(q_select, "_imputed", lambda *_: (x, ["f"]))
    monkeypatch.setattr(sl, "boruta_select", lambda df, *a, **k: seen.append((df.count(), df.select("flow_key").distinct().count())))
    q_select.boruta_select(spark, "")
    assert seen == [(100_500, 100_500)]


def _rankings(monkeypatch, seen):
    def rank(name, df, features):
        seen[name] = df.count()
        return [(f, 1.0) for f in features]
    monkeypatch.setattr(sl, "rf_importance", lambda df, features, *a, **k: df.sparkSession.createDataFrame(
        rank("forest", df, features), "feature string, score double"))
    monkeypatch.setattr(sl, "boruta_select", lambda df, features, *a, **k: df.sparkSession.createDataFrame(
        [(f, 20, "confirmed", True) for f, _ in rank("boruta", df, features)], "feature string, hits int, status string, selected boolean"))


def _train(spark) -> int:
    return clean.stratified_split(train_rows(spark, SF_SMALL), "flow_key", "label").where("split = 'train'").count()


def test_selection_ranks_all_training_rows(spark, monkeypatch):
    seen: dict = {}
    _rankings(monkeypatch, seen)
    q_select.select_features(spark, SF_SMALL)
    n = _train(spark)
    assert n > 2_000 and seen == {"forest": n, "boruta": n}


def test_artifacts_are_fitted_on_all_training_rows(spark, monkeypatch):
    seen: dict = {}
    _rankings(monkeypatch, seen)

    def logistic(df, *_):
        seen["logistic"] = df.count()

    def grown(df, *_):
        seen["rows"] = df.count()
        raise Stop
    monkeypatch.setattr(md, "train_logistic", logistic)
    monkeypatch.setattr(md, "train_forest", grown)
    monkeypatch.setattr(q_stream, "_ARTIFACTS", {})
    with pytest.raises(Stop):
        q_stream._artifacts(spark, SF_SMALL)
    n = _train(spark)
    rare = train_rows(spark, SF_SMALL).where(F.col("label") == "Rare").count()
    assert seen["forest"] == seen["boruta"] == n
    assert n - rare <= seen["rows"] == seen["logistic"] <= n and seen["rows"] > 1_000
