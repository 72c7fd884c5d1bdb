"""Models: class weights, classifiers, reconstruction (PCA or
a network) and model comparison.

Training is distributed: MLlib ``fit``, ``boosting``, ``forest`` and ``network``; scoring is ``transform``.  All the
surrounding bookkeeping (weights, codes, metrics) is DataFrame work.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c
from . import boosting, forest, network
from .boosting import BoostedTrees
from .forest import Forest


# ------------------------------------------------------------ weights ----

def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weight n / (k * n_c) per row: class counts (one row per
    class) are broadcast back."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = cnt.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = cnt.crossJoin(tot).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


# ------------------------------------------------------------ vectors ----

def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Feature columns -> one vector column (missing values must be imputed first)."""
    # positional aliases avoid trouble with names holding '/'
    tmp = [f"__v_{i}" for i in range(len(features))]
    x = df.select("*", *[c(f).cast("double").alias(t) for f, t in zip(features, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="keep").transform(x).drop(*tmp)


def array_features(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """array<float> column -> ML vector."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


# ------------------------------------------------------------- models ----

def train_logistic(df: DataFrame, label: str = "label", weight: str | None = "weight",
                   max_iter: int = 200) -> PipelineModel:
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter,
                            weightCol=weight or "")
    return Pipeline(stages=[lr]).fit(df)


def train_forest(df: DataFrame, label: str = "label", weight: str | None = "weight", trees: int = 300,
                 depth: int = 20, min_leaf: int = 5, seed: int = K.SEED) -> Forest:
    """Random forest; subtrees of few rows are grown in one task each (see ``forest``)."""
    return forest.fit(df, "features", label, weight, trees, depth, min_leaf, seed)


def train_boosted(df: DataFrame, label: str = "label", weight: str | None = "weight", rounds: int = 300,
                  depth: int = 6, rate: float = 0.1, share: float = 0.8, seed: int = K.SEED) -> BoostedTrees:
    """Multi-class boosted trees (softmax), all classes grown together."""
    return boosting.fit(df, "features", label, weight, rounds, depth, rate, share, seed)


def ovr_probabilities(pred: DataFrame, raw: str = "rawPrediction", out: str = "probability_vec") -> DataFrame:
    """One-vs-rest margins -> class probabilities: p_c = 1 / (1 + exp(-2 m_c)),
    normalised to sum 1 (GBT margins are half log-odds)."""
    m = vector_to_array(F.col(raw))
    p = F.transform(m, lambda x: 1 / (1 + F.exp(-2 * x)))
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return pred.withColumn(out, F.transform(p, lambda x: x / s))


def score_supervised(model: PipelineModel, df: DataFrame, class_index: int = 1,
                     benign_index: int = 0) -> DataFrame:
    """Class, probability vector, score = probability at ``class_index``
    (reference parity) and ``attack_probability`` = 1 - P(benign)."""
    p = model.transform(df)
    if "probability" in p.columns:
        arr = vector_to_array(F.col("probability"))
    else:
        p = ovr_probabilities(p)
        arr = F.col("probability_vec")
    return p.withColumn("attack_score_supervised", arr[class_index]) \
            .withColumn("attack_probability", 1 - arr[benign_index]) \
            .withColumn("predicted_code", F.col("prediction").cast("int"))


# ------------------------------------------------------ reconstruction ----

def train_reconstruction(benign: DataFrame, k: int, features: str = "features") -> PipelineModel:
    """Linear autoencoder: the mean of the benign rows, and PCA with k
    components of their deviations from it."""
    return Pipeline(stages=[
        StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__centred"),
        PCA(k=k, inputCol="__centred", outputCol="__pc")]).fit(benign)


def train_network(benign: DataFrame, features: str = "features", **options) -> network.AutoEncoder:
    """Non-linear autoencoder of the benign rows (see ``network.fit``)."""
    return network.fit(benign, features, **options)


def _reconstructor(model):
    """The model as a function from rows to their reconstructions."""
    if isinstance(model, network.AutoEncoder):
        return model.reconstruct
    mean, axes = model.stages[0].mean.toArray(), model.stages[-1].pc.toArray()
    return partial(_project, mean, axes @ axes.T)


def _project(mean, proj, x):
    return mean + (x - mean) @ proj


def reconstruct(model, df: DataFrame, features: str = "features_arr", out: str = "recon_error",
                keep_recon: bool = False) -> DataFrame:
    """Reconstruction x_hat of the fitted network, or m + (x - m) P P^T with
    the fitted mean and principal axes, and the mean squared error per row.
    The parameters (bounded by the feature count) are broadcast; each Arrow
    batch is one chain of matrix products."""
    import numpy as np
    shared = df.sparkSession.sparkContext.broadcast(_reconstructor(model))
    cols = df.columns
    extra = [F.lit(0.0).alias(out)] + ([F.array().cast("array<double>").alias("recon")] if keep_recon else [])
    schema = df.select("*", *extra).schema

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[features].to_numpy()).astype("float64")
            Xh = shared.value(X)
            pdf[out] = ((X - Xh) ** 2).mean(axis=1)
            if keep_recon:
                pdf["recon"] = list(Xh)
            yield pdf[cols + [out] + (["recon"] if keep_recon else [])]
    return df.mapInPandas(run, schema)


def reconstruction_error(x, xhat):
    """Mean squared difference of two equal-length arrays (native)."""
    sq = F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


# ----------------------------------------------------------- compare ----

def choose_model(models: dict[str, PipelineModel], holdout: DataFrame, label: str = "label") -> DataFrame:
    """``(model, macro_f1, best)``: each candidate's predictions of the
    hold-out rows, compared in one pass over their union."""
    preds = [m.transform(holdout).select(F.lit(n).alias("model"), F.col(label).cast("int").alias("actual"),
                                         F.col("prediction").cast("int").alias("predicted"))
             for n, m in models.items()]
    return compare_models(reduce(DataFrame.unionByName, preds))


def compare_models(preds: DataFrame, actual: str = "actual", predicted: str = "predicted",
                   model: str = "model") -> DataFrame:
    """Macro-F1 per candidate on the hold-out; ``best`` marks the winner
    (ties: model name).  One scan; the ranking runs over one row per model."""
    a, p = F.col(actual), F.col(predicted)
    rows = preds.select(model, F.explode(F.array(
        F.struct(a.cast("string").alias("cls"), F.lit(1).alias("sup"), F.lit(0).alias("np"),
                 (a == p).cast("int").alias("tp")),
        F.struct(p.cast("string").alias("cls"), F.lit(0).alias("sup"), F.lit(1).alias("np"),
                 F.lit(0).alias("tp")))).alias("r")).select(model, "r.*")
    cc = rows.groupBy(model, "cls").agg(F.sum("sup").alias("sup"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
    pr = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.lit(0.0))
    rc = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(F.lit(0.0))
    x = cc.select(model, pr.alias("p"), rc.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    m = x.groupBy(model).agg(F.avg(f1).alias("f1"))
    w = Window.orderBy(F.col("f1").desc(), F.col(model))
    return m.select(model, F.round("f1", 6).alias("macro_f1"), (F.rank().over(w) == 1).alias("best"))
