"""Registered model queries fit models of the operators' full size."""

from conftest import SF_SMALL

from __spark_entry__ import queries
from flowlens.operators import models as md


def test_scores_come_from_the_full_forest(spark, monkeypatch):
    made, fit = [], md.train_forest
    monkeypatch.setattr(md, "train_forest", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    rows = queries()["score_supervised"](spark, SF_SMALL).collect()
    forest = made[0].stages[-1]
    assert len(made) == 1 and forest.getNumTrees == 300 and forest.getMaxDepth() == 20
    assert forest.getMinInstancesPerNode() == 5
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
