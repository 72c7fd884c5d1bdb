"""Queries that SQL cannot repeat: shape and value rules at the small scale."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from __spark_entry__ import queries


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries()[name](spark, SF_SMALL).toPandas()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "label").toPandas()


@pytest.mark.parametrize("name", ["train_logistic", "train_forest"])
def test_hold_out_predictions(run, vectors, name):
    got = run(name)
    assert got["vec_id"].is_unique and 0.15 < len(got) / len(vectors) < 0.25
    assert got["predicted"].isin(vectors["label"].unique()).all()
    assert got["attack_probability"].between(0, 1).all() and got["attack_score_supervised"].between(0, 1).all()


def test_probabilities(run, vectors):
    got = run("score_supervised")
    assert len(got) == len(vectors)
    assert all(abs(sum(p) - 1) < 1e-9 for p in got["probability"])
    assert all(p[c] == max(p) for p, c in zip(got["probability"], got["predicted_code"]))


def test_isolation_flags_the_tail_of_benign_training_rows(run, vectors):
    got = run("train_isolation_forest")
    assert len(got) == len(vectors) and got["iso_score"].between(0, 1).all()
    own = got[(got["split"] == "train") & (got["label"] == 0)]
    assert 0 < own["flag"].mean() < 0.15


def test_reconstruction_is_best_on_the_rows_it_was_fitted_to(run):
    got = run("train_reconstruction")
    own = (got["split"] == "train") & (got["label"] == 0)
    assert (got["recon_error"] >= 0).all() and got[own]["recon_error"].mean() < got[~own]["recon_error"].mean()


def test_preview_shows_attacks(run):
    got = run("preview")
    assert len(got) == 5 and (got["label"] != "Benign").all()


def test_alert_stream_is_the_severe_part_of_the_log(spark, run):
    from flowlens.sources import adapters
    log = adapters.attack_log(spark, SF_SMALL).where(F.upper("severity").isin("HIGH", "CRITICAL"))
    want = sorted(r.id for r in log.select("id").collect())
    assert sorted(run("stream_alerts")["id"]) == want
