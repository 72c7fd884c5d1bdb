"""Training chain: flows -> clean -> features -> split -> select -> impute /
scale -> supervised candidates, the best of which is kept, reconstruction
and isolation forest -> artifacts.

Everything fitted is a small table or a model; ``save`` / ``load`` keep
published versions under one folder so the scorer (batch or stream) uses
exactly the same parameters.  Lineage is cut with a reliable checkpoint (shared
folder) after the split, before the many selection passes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import boosting, clean, explain as ex, features as fe, forest, fusion as fu, iforest, models as md, network, select as sl
from ..operators.evaluate import fit_score_norm
from ..operators.features import prepare_flows
from ..sources import io
from .registry import materialize, spread

CANDIDATES = ["flow_duration", "total_fwd_packets", "total_backward_packets", "fwd_packets_length_total",
              "bwd_packets_length_total", "fwd_packet_length_mean", "fwd_packet_length_min",
              "fwd_packet_length_std", "bwd_packet_length_mean", "bwd_packet_length_std", "fwd_iat_mean",
              "fwd_iat_std", "bwd_iat_mean", "bwd_iat_std", "flow_packets/s", "fwd_packets/s", "active_mean",
              "active_std", "idle_mean", "idle_std", "fin_flag_count", "syn_flag_count", "rst_flag_count",
              "psh_flag_count", "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count",
              "proto_0", "proto_6", "proto_17", "total_packets", "total_bytes", "packet_rate", "bytes_per_packet",
              "idle_cv", "active_cv", "tcp_behavior", "burst_ratio", "packet_entropy", "total_flag_count",
              "syn_fin_ratio", "psh_ack_ratio", "segment_ratio", "fwd_iat_cv", "bwd_iat_cv", "fwd_packet_skew",
              "bwd_packet_skew", "abnormal_flow_duration", "activity_period_ratio", "proto_0_flag_rate",
              "proto_6_flag_rate", "proto_17_flag_rate", "flag_change_rate", "flow_anomaly_index"]


@dataclass
class Artifacts:
    protocols: list[str]
    features: list[str]
    medians: DataFrame
    scaler: DataFrame
    codes: DataFrame
    model_codes: DataFrame
    stats: DataFrame                    # feature statistics of the training flows
    norm: DataFrame                     # p0, p99 of benign training errors
    ranges: DataFrame                   # ranges of both scores over the training rows
    deviation: DataFrame                # mean deviation per feature over the training rows
    comparison: DataFrame               # macro-F1 of each candidate on the hold-out
    isolation: DataFrame                # nodes of the isolation forest
    rankings: DataFrame                 # the four feature rankings
    classifier: PipelineModel | boosting.BoostedTrees | forest.Forest      # the best candidate
    recon: PipelineModel | network.AutoEncoder


#: Fitted tables that are saved beside the two models.
TABLES = ("medians", "scaler", "codes", "model_codes", "stats", "norm", "ranges", "deviation", "comparison", "isolation", "rankings")


def freeze(df: DataFrame) -> DataFrame:
    """A fitted parameter table (one row, or one row per class / feature) as
    a local relation: later plans embed its values instead of re-running the
    aggregation that produced it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def labelled_features(flows: DataFrame, protocols: list[str], stats: DataFrame) -> DataFrame:
    x = fe.engineer(prepare_flows(flows, protocols), stats=stats)
    x = x.withColumnRenamed("raw_label", "label")
    return clean.group_labels(clean.clean_label_text(x, "label"), "label").filter(F.col("label").isNotNull())


def train(spark: SparkSession, flows: DataFrame, trees: int = 300, depth: int = 20, min_leaf: int = 5,
          components: int = 8, rounds: int = 300, iterations: int = 200, isolation_trees: int = 200,
          candidates: tuple[str, ...] = ("logistic", "forest", "boosted"), reconstruction: str = "network",
          methods: tuple[str, ...] = ("anova", "mi", "forest", "boruta"), ranking: dict | None = None) -> Artifacts:
    """Fits everything the scorer needs on the training split.  Of the
    ``candidates`` the one with the best macro-F1 on the hold-out is kept.

    Everything is fitted on all its rows.  ``reconstruction`` is ``network`` or
    ``pca``; ``ranking`` has further options of ``select.run_selection``."""
    protocols = clean.fit_protocols(flows)
    stats = freeze(fe.fit_feature_stats(fe.row_features(prepare_flows(flows, protocols))))
    feats = labelled_features(flows, protocols, stats)
    split = materialize(spread(clean.stratified_split(feats, key="flow_key", col="label")))
    tr = split.filter(F.col("split") == "train")
    per_protocol = [n.format(p) for p in protocols for n in ("proto_{}", "proto_{}_flag_rate")]
    names = [c for c in dict.fromkeys(CANDIDATES + per_protocol) if c in split.columns]
    chosen = sl.run_selection(tr, names, methods=methods, **(ranking or {}))
    features = chosen.features
    lack = tr.agg(*[F.count_if(F.col(f"`{f}`").isNull()).alias(f) for f in features if f in split.columns]).first().asDict()
    medians = clean.fit_medians(tr, [f for f in features if lack.get(f)]).first().asDict() if any(lack.values()) else {}
    zero = {f: 0.0 for f in features if f not in split.columns}
    median = {f: medians.get(f, zero.get(f, 0.0)) for f in features}
    exact = [f for f in features if f in split.columns and f not in medians]
    if exact:                                   # a new batch may lack what the training rows have
        median.update(clean.fit_medians(tr, exact, exact=False).first().asDict())
    medians = spark.createDataFrame([tuple(median[f] for f in features)], ", ".join(f"`{f}` double" for f in features))
    imp = clean.impute_median(clean.align_features(split, features, ["flow_key", "label", "split"]), medians, features)
    scaler = freeze(clean.fit_scaler(imp.filter(F.col("split") == "train"), features))
    scaled = md.assemble(clean.standard_scale(imp, scaler, features), features).select(
        "flow_key", "label", "split", "features").checkpoint()       # feeds codes and all models
    known = scaled.filter(F.col("split") == "train")
    codes = freeze(clean.fit_label_codes(known))
    rows, model_codes = clean.filter_rare_reencode(known, codes)
    model_codes = freeze(model_codes)
    weighted = md.class_weights(rows, "model_code").checkpoint()      # read by every candidate
    fit = {"logistic": lambda: md.train_logistic(weighted, "model_code", "weight", iterations),
           "forest": lambda: md.train_forest(weighted, "model_code", "weight", trees, depth, min_leaf),
           "boosted": lambda: md.train_boosted(weighted, "model_code", "weight", rounds)}
    models = {n: fit[n]() for n in candidates}
    holdout = scaled.filter(F.col("split") == "test").join(
        F.broadcast(model_codes.select("label", "model_code")), "label")      # one row per class
    comparison = freeze(md.choose_model(models, holdout, "model_code"))
    classifier = models[comparison.filter("best").orderBy("model").first()["model"]]
    benign = known.filter(F.col("label") == K.BENIGN)
    recon = md.train_network(benign) if reconstruction == "network" else md.train_reconstruction(benign, min(components, len(features)))
    arrays = known.withColumn("features_arr", md.vector_to_array("features"))
    benign_arr = arrays.filter(F.col("label") == K.BENIGN)
    err = md.reconstruct(recon, benign_arr.select("features_arr"), "features_arr")
    norm = freeze(fit_score_norm(err, "recon_error"))
    # what the scorer would see of the training rows: frozen for streams
    seen = md.reconstruct(recon, md.score_supervised(classifier, arrays).select(
        "features_arr", "attack_score_supervised"), "features_arr", out="ae_score", keep_recon=True).checkpoint()
    ranges = freeze(fu.fit_score_range(seen, ["attack_score_supervised", "ae_score"]))
    deviation = freeze(ex.global_deviation(seen, "features_arr", "recon"))
    isolation = iforest.fit(benign_arr.select("flow_key", "features_arr"), "features_arr", "flow_key",
                            trees=isolation_trees).checkpoint()
    return Artifacts(protocols, features, medians, scaler, codes, model_codes, stats, norm, ranges, deviation,
                     comparison, isolation, chosen.rankings, classifier, recon)


def save(a: Artifacts, path: str) -> int:
    """Writes ``a`` to a folder of its own below ``path`` and publishes it when
    all of it is there; a reader sees the version before or this one, never a
    mixture.  Returns the version's number."""
    spark = a.medians.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    io.save_params(spark.createDataFrame([(i, p) for i, p in enumerate(a.protocols)], "position int, value string"),
                   f"{at}/protocols")
    io.save_params(spark.createDataFrame([(i, f) for i, f in enumerate(a.features)], "position int, feature string"),
                   f"{at}/features")
    for t in TABLES:
        io.save_params(getattr(a, t), f"{at}/{t}")
    kind = {boosting.BoostedTrees: "trees", forest.Forest: "forest", network.AutoEncoder: "network"}
    kinds = [(n, kind.get(type(m), "pipeline")) for n, m in (("classifier", a.classifier), ("recon", a.recon))]
    io.save_params(spark.createDataFrame(kinds, "name string, kind string"), f"{at}/models")
    io.save_model(a.classifier, f"{at}/classifier", spark)
    io.save_model(a.recon, f"{at}/recon", spark)
    return io.publish(spark, path, name)


def load(spark: SparkSession, path: str, version: int | None = None) -> Artifacts:
    """The newest published version below ``path``, or the one numbered
    ``version``."""
    found = [v for v in io.published(spark, path) if version in (None, v[0])]
    if not found:
        raise FileNotFoundError(f"no published artifacts {'' if version is None else f'number {version} '}in {path}")
    at = f"{path}/{found[-1][1]}"
    protocols = [r.value for r in spark.read.parquet(f"{at}/protocols").orderBy("position").collect()]
    features = [r.feature for r in spark.read.parquet(f"{at}/features").orderBy("position").collect()]
    tables = {n: spark.read.parquet(f"{at}/{n}") for n in TABLES}
    kinds = {r["name"]: r["kind"] for r in spark.read.parquet(f"{at}/models").collect()}
    read = {"trees": lambda p: boosting.from_table(spark.read.parquet(p)),
            "forest": lambda p: forest.from_table(spark.read.parquet(p)),
            "network": lambda p: network.from_table(spark.read.parquet(p)), "pipeline": io.load_model}
    return Artifacts(protocols, features, **tables, classifier=read[kinds["classifier"]](f"{at}/classifier"),
                     recon=read[kinds["recon"]](f"{at}/recon"))
