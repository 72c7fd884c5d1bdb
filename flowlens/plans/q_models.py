"""Registered queries: models on the ``embeddings`` feature
matrix (64 floats, label 0-9, 0 = benign)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from ..operators import iforest
from ..operators import models as md
from ..sources import adapters
from .registry import register, rounded
from .sql_common import any_sql

BOOST_ROUNDS = 300


def emb(spark, sf_dir) -> DataFrame:
    e = adapters.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features_arr"))


def split(spark, sf_dir) -> DataFrame:
    """Seeded stratified 80/20 split of the embeddings by label."""
    return clean.stratified_split(emb(spark, sf_dir), key="vec_id", col="label")


def train_test(spark, sf_dir):
    s = split(spark, sf_dir)
    s = s.withColumn("features", md.array_to_vector(F.col("features_arr")))
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


@register("class_weights", any_sql("""
SELECT vec_id, label, round((SELECT count(*) FROM embeddings) /
  ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)), 9) AS weight
FROM embeddings"""))
def class_weights(spark, sf_dir):
    """Balanced weight n / (k * n_c) per row."""
    e = emb(spark, sf_dir).select("vec_id", "label")
    return rounded(md.class_weights(e, "label", "weight").select("vec_id", "label", "weight"), 9)


def _holdout(pred: DataFrame) -> DataFrame:
    return pred.select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"),
                       "attack_score_supervised", "attack_probability")


@register("train_logistic")
def train_logistic(spark, sf_dir):
    """Multinomial logistic regression (balanced weights, <= 200 iterations);
    hold-out predictions."""
    tr, te = train_test(spark, sf_dir)
    m = md.train_logistic(md.class_weights(tr, "label"), "label", "weight", 200)
    return _holdout(md.score_supervised(m, te))


@register("train_forest")
def train_forest(spark, sf_dir):
    """Random forest (300 trees, depth 20, min leaf 5, balanced); hold-out predictions."""
    tr, te = train_test(spark, sf_dir)
    m = md.train_forest(md.class_weights(tr, "label"), "label", "weight", 300, 20, 5)
    return _holdout(md.score_supervised(m, te))


@register("train_boosted")
def train_boosted(spark, sf_dir):
    """Boosted trees over all classes (300 rounds, depth 6, rate 0.1, 0.8
    row/column share, balanced); hold-out predictions."""
    tr, te = train_test(spark, sf_dir)
    m = md.train_boosted(md.class_weights(tr, "label"), "label", "weight", BOOST_ROUNDS, 6, 0.1, 0.8)
    return _holdout(md.score_supervised(m, te))


@register("train_compare")
def train_compare(spark, sf_dir):
    """Logistic model, forest and boosted trees on the same split: macro-F1 on
    the hold-out and the winner."""
    tr, te = train_test(spark, sf_dir)
    w = md.class_weights(tr, "label").checkpoint()       # read by every fit
    models = {"logistic": md.train_logistic(w, "label", "weight", 200),
              "forest": md.train_forest(w, "label", "weight", 300, 20, 5),
              "boosted": md.train_boosted(w, "label", "weight", BOOST_ROUNDS, 6, 0.1, 0.8)}
    return md.choose_model(models, te, "label")


@register("score_supervised")
def score_supervised(spark, sf_dir):
    """Class, probability vector and the two attack scores for every row."""
    tr, _ = train_test(spark, sf_dir)
    m = md.train_forest(md.class_weights(tr, "label"), "label", "weight", 300, 20, 5)
    e = emb(spark, sf_dir).withColumn("features", md.array_to_vector(F.col("features_arr")))
    p = md.score_supervised(m, e)
    return p.select("vec_id", "predicted_code", md.vector_to_array(F.col("probability")).alias("probability"),
                    "attack_score_supervised", "attack_probability")


@register("train_isolation_forest")
def train_isolation_forest(spark, sf_dir):
    """Isolation forest (200 trees, 256-row samples) fitted on benign training
    rows; score for every row and the P95 threshold of the training scores."""
    s = split(spark, sf_dir)
    benign_train = s.filter((F.col("split") == "train") & (F.col("label") == 0))
    nodes = iforest.fit(benign_train, "features_arr", "vec_id", trees=200, sample_size=256)
    nodes = nodes.checkpoint()          # built once, read by two scoring passes
    scored = iforest.score(s.select("vec_id", "label", "split", "features_arr"), nodes, "features_arr")
    from ..operators.evaluate import percentile_threshold
    thr = percentile_threshold(scored.filter((F.col("split") == "train") & (F.col("label") == 0)), "iso_score", 0.95)
    out = scored.crossJoin(F.broadcast(thr)).select(
        "vec_id", "label", "split", "iso_score", (F.col("iso_score") >= F.col("threshold")).cast("int").alias("flag"))
    return out


@register("train_reconstruction")
def train_reconstruction(spark, sf_dir):
    """Linear autoencoder (PCA, 16 components) on standardised benign
    training rows; reconstruction error for every row."""
    z, zb = _standardised(spark, sf_dir)
    return md.reconstruct(md.train_reconstruction(zb, 16), z, "features_arr").select("vec_id", "label", "split", "recon_error")


@register("train_reconstruction_network")
def train_reconstruction_network(spark, sf_dir):
    """Autoencoder network (128, 64, 128; early stop on a held-out tenth) on
    standardised benign training rows; reconstruction error for every row."""
    z, zb = _standardised(spark, sf_dir)
    return md.reconstruct(md.train_network(zb), z, "features_arr").select("vec_id", "label", "split", "recon_error")


def _standardised(spark, sf_dir):
    """All rows scaled by the benign training rows, and these."""
    s = split(spark, sf_dir)
    d = 64
    cols = [f"x{i}" for i in range(d)]
    wide = s.select("vec_id", "label", "split", *[F.col("features_arr")[i].alias(cols[i]) for i in range(d)])
    benign = wide.filter((F.col("split") == "train") & (F.col("label") == 0))
    sc = clean.fit_scaler(benign, cols)
    z = clean.standard_scale(wide, sc, cols)
    z = z.select("vec_id", "label", "split", F.array(*cols).alias("features_arr"))
    zb = z.filter((F.col("split") == "train") & (F.col("label") == 0)).withColumn(
        "features", md.array_to_vector(F.col("features_arr")))
    return z, zb


@register("reconstruction_error", any_sql("""
SELECT vec_id, round(list_avg(list_transform(range(1, len(x) + 1), lambda i: (x[i] - xh[i]) * (x[i] - xh[i]))), 9)
  AS error
FROM (SELECT vec_id, cast(embedding AS DOUBLE[]) AS x,
  list_transform(cast(embedding AS DOUBLE[]), lambda v: round(v, 1)) AS xh FROM embeddings) t"""))
def reconstruction_error(spark, sf_dir):
    """Mean squared difference between a vector and its reconstruction
    (here: the vector rounded to one decimal)."""
    e = emb(spark, sf_dir)
    xh = F.transform(F.col("features_arr"), lambda v: F.round(v, 1))
    return e.select("vec_id", F.round(md.reconstruction_error(F.col("features_arr"), xh), 9).alias("error"))
