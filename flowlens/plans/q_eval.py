"""Registered queries: evaluation and score thresholds.

Input is the scored hold-out ``predictions`` (actual / predicted class
codes, a supervised score and a reconstruction error ``ae_score``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources import adapters
from .registry import freeze, materialize, register, rounded
from .sql_common import any_sql



def attack(col: str = "actual_code"):
    """Binary label: any class other than 0 (Benign) is an attack."""
    return F.col(col) != 0


def preds(spark, sf):
    return adapters.predictions(spark, sf)


def psql(body: str, extra: str = "") -> str:
    base = ("yb AS (SELECT *, CASE WHEN actual_code <> 0 THEN 1 ELSE 0 END AS y FROM predictions),\n"
            "g AS (SELECT ae_score AS score, sum(y) AS pos, sum(1 - y) AS neg FROM yb GROUP BY ae_score),\n"
            "roc AS (SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos,\n"
            "  sum(neg) OVER (ORDER BY score DESC) AS cum_neg, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g),\n"
            "pts AS (SELECT *, cum_pos / P AS tpr, cum_neg / N AS fpr FROM roc),\n"
            "thr AS (SELECT min(threshold) AS threshold FROM pts WHERE fpr < 0.02)")
    return any_sql(body, "predictions", extra=base + (",\n" + extra if extra else ""))


def fpr_budget(p):
    """The FPR-budget threshold of predictions as a one-row local table."""
    return freeze(ev.threshold_fpr_budget(p, attack(), "ae_score"))


# ------------------------------------------------------------ classes ----

@register("confusion_matrix", psql(
    "SELECT actual_code AS actual, predicted_code AS predicted, count(*) AS n FROM predictions GROUP BY 1, 2"))
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(preds(spark, sf_dir), "actual_code", "predicted_code")


CC_SQL = """cc AS (SELECT cls, sum(sup) AS support, sum(np) AS n_pred, sum(tp) AS tp FROM (
  SELECT cast(actual_code AS VARCHAR) AS cls, 1 AS sup, 0 AS np, CASE WHEN actual_code = predicted_code THEN 1 ELSE 0 END
    AS tp FROM predictions
  UNION ALL SELECT cast(predicted_code AS VARCHAR), 0, 1, 0 FROM predictions) u GROUP BY cls),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM (SELECT cls, support, tp, n_pred, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM cc) a)"""


@register("classification_report", psql("""
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  cast(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), cast(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  cast(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  cast(sum(support) AS BIGINT) FROM prf""", CC_SQL))
def classification_report(spark, sf_dir):
    return ev.classification_report(preds(spark, sf_dir), "actual_code", "predicted_code")


@register("fpr_per_class", psql("""
SELECT class, round(fpr, 9) AS fpr FROM (
  SELECT cls AS class, CASE WHEN n - support > 0 THEN (n_pred - tp) / (n - support) ELSE 0 END AS fpr
  FROM cc CROSS JOIN (SELECT sum(support) AS n FROM cc) t) p
UNION ALL SELECT 'macro', round(avg(CASE WHEN n - support > 0 THEN (n_pred - tp) / (n - support) ELSE 0 END), 9)
  FROM cc CROSS JOIN (SELECT sum(support) AS n FROM cc) t""", CC_SQL))
def fpr_per_class(spark, sf_dir):
    return ev.fpr_per_class(preds(spark, sf_dir), "actual_code", "predicted_code")


CLASSES = [0, 1, 2, 3, 4]


@register("pr_precision_floor", psql("""
SELECT c.cls AS class, m.threshold, round(m.recall, 9) AS recall FROM (SELECT DISTINCT cls FROM pc) c LEFT JOIN (
  SELECT cls, arg_min(score, score) AS threshold, arg_min(recall, score) AS recall FROM (
    SELECT cls, score, sum(pos) OVER w / sum(n) OVER w AS precision,
      CASE WHEN sum(pos) OVER (PARTITION BY cls) > 0 THEN sum(pos) OVER w / sum(pos) OVER (PARTITION BY cls)
        ELSE 0 END AS recall
    FROM pc WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a
  WHERE precision >= 0.9 GROUP BY cls) m ON c.cls = m.cls""",
    "pc AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS cls, CASE WHEN predicted_code = {k} THEN attack_score_supervised ELSE 0.0 END AS score, "
        f"sum(CASE WHEN actual_code = {k} THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM predictions GROUP BY 1, 2"
        for k in CLASSES) + ")"))
def pr_precision_floor(spark, sf_dir):
    out = ev.pr_precision_floor(preds(spark, sf_dir), CLASSES, "actual_code", "predicted_code",
                                "attack_score_supervised")
    return rounded(out, 9, only=["recall"])


# ---------------------------------------------------------------- ROC ----

@register("roc_curve", psql("SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM pts"))
def roc_curve(spark, sf_dir):
    """(threshold, TPR, FPR) at every distinct reconstruction error."""
    return rounded(ev.roc_curve(preds(spark, sf_dir), attack(), "ae_score"), 9, only=["tpr", "fpr"])


@register("roc_auc", psql(
    "SELECT round(sum((neg / N) * ((2 * cum_pos - pos) / (2 * P))), 9) AS roc_auc FROM pts"))
def roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(preds(spark, sf_dir), attack(), "ae_score"), 9)


@register("threshold_fpr_budget", psql("SELECT threshold FROM thr"))
def threshold_fpr_budget(spark, sf_dir):
    return fpr_budget(preds(spark, sf_dir))


@register("threshold_youden", psql(
    "SELECT threshold, round(tpr - fpr, 9) AS youden_j FROM pts ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1"))
def threshold_youden(spark, sf_dir):
    return rounded(ev.threshold_youden(preds(spark, sf_dir), attack(), "ae_score"), 9,
                   only=["youden_j"])


@register("eval_thresholds", psql("""
SELECT name, threshold, round(100.0 * avg(CASE WHEN y = 0 THEN (ae_score >= threshold)::INT END), 6) AS fpr_pct,
  round(100.0 * avg(CASE WHEN y = 1 THEN (ae_score >= threshold)::INT END), 6) AS tpr_pct
FROM yb CROSS JOIN (
  SELECT 'p99' AS name, (SELECT quantile_cont(ae_score, 0.99) FROM yb WHERE y = 0) AS threshold
  UNION ALL SELECT 'roc_optimal', (SELECT threshold FROM pts ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)
  UNION ALL SELECT 'fpr_budget', (SELECT threshold FROM thr)) t GROUP BY name, threshold"""))
def eval_thresholds(spark, sf_dir):
    """FPR % / TPR % at the benign P99, the ROC-optimal and the FPR-budget thresholds."""
    # many passes read these two columns: the join behind them runs once
    p = materialize(preds(spark, sf_dir).select("actual_code", "ae_score"))
    p99 = ev.percentile_threshold(p.filter(~attack()), "ae_score", 0.99).select(F.col("threshold").alias("p99"))
    yo = ev.threshold_youden(p, attack(), "ae_score").select(F.col("threshold").alias("roc_optimal"))
    fb = fpr_budget(p).select(F.col("threshold").alias("fpr_budget"))
    out = ev.eval_thresholds(p, attack(), "ae_score", freeze(p99.crossJoin(yo).crossJoin(fb)))
    return rounded(out, 6, only=["fpr_pct", "tpr_pct"])


@register("false_positive_count", psql("""
SELECT sum(CASE WHEN ae_score >= threshold THEN 1 ELSE 0 END)::BIGINT AS flagged,
  sum(CASE WHEN ae_score >= threshold AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS false_positives,
  sum(y)::BIGINT AS expected_anomalies FROM yb CROSS JOIN thr"""))
def false_positive_count(spark, sf_dir):
    return ev.false_positive_count(preds(spark, sf_dir), attack(), "ae_score", fpr_budget(preds(spark, sf_dir)))


@register("fp_scenarios", psql("""
SELECT band, tested, flagged, round(CASE WHEN tested > 0 THEN flagged * 100.0 / tested ELSE 0 END, 6) AS fp_rate_pct,
  CASE WHEN band = 'overall' THEN CASE WHEN (CASE WHEN tested > 0 THEN flagged * 100.0 / tested ELSE 0 END) < 5
    THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM (
  SELECT band, count(e) AS tested, coalesce(sum(CASE WHEN e >= t THEN 1 ELSE 0 END), 0)::BIGINT AS flagged
  FROM bands LEFT JOIN (SELECT ae_score AS e FROM yb WHERE y = 0) b ON e >= lo AND e <= hi
  CROSS JOIN (SELECT threshold AS t FROM thr) x GROUP BY band
  UNION ALL SELECT 'overall', count(e), coalesce(sum(CASE WHEN e >= t THEN 1 ELSE 0 END), 0)::BIGINT
  FROM bands JOIN (SELECT ae_score AS e FROM yb WHERE y = 0) b ON e >= lo AND e <= hi
  CROSS JOIN (SELECT threshold AS t FROM thr) x) r""",
    """q AS (SELECT quantile_cont(ae_score, [0.0, 0.25, 0.75, 0.99, 1.0]) AS q FROM yb WHERE y = 0),
bands AS (SELECT 'light' AS band, q[1] AS lo, q[2] AS hi FROM q UNION ALL SELECT 'normal', q[2], q[3] FROM q
  UNION ALL SELECT 'heavy', q[3], q[4] FROM q UNION ALL SELECT 'edge', q[4], q[5] FROM q)"""))
def fp_scenarios(spark, sf_dir):
    """Benign errors in percentile bands vs the FPR-budget threshold, PASS < 5 %."""
    p = preds(spark, sf_dir)
    return ev.fp_scenarios(p.filter(~attack()), "ae_score", fpr_budget(preds(spark, sf_dir)))


NORM_SQL = ("nrm AS (SELECT quantile_cont(ae_score, 0.0) AS p0, quantile_cont(ae_score, 0.99) AS p99 "
            "FROM yb WHERE y = 0)")


def _clip_sql(x: str) -> str:
    v = f"(({x}) - p0) / (p99 - p0)"
    return f"CASE WHEN {v} < 0 THEN 0.0 WHEN {v} > 1 THEN 1.0 ELSE {v} END"


@register("normalized_means", psql(f"""
SELECT round({_clip_sql('mb')}, 9) AS benign_mean, round({_clip_sql('ma')}, 9) AS attack_mean,
  round({_clip_sql('threshold')}, 9) AS threshold_score
FROM (SELECT avg(CASE WHEN y = 0 THEN ae_score END) AS mb, avg(CASE WHEN y = 1 THEN ae_score END) AS ma FROM yb) m
CROSS JOIN nrm CROSS JOIN thr""", NORM_SQL))
def normalized_means(spark, sf_dir):
    p = preds(spark, sf_dir)
    norm = freeze(ev.fit_score_norm(p.filter(~attack()), "ae_score"))
    return rounded(ev.normalized_means(p, attack(), "ae_score", norm, fpr_budget(preds(spark, sf_dir))), 9)


@register("ae_params_table", psql(f"""
SELECT p0, p99, t.threshold, round({_clip_sql('t.threshold')}, 9) AS normalized_threshold,
  (SELECT round(sum((neg / N) * ((2 * cum_pos - pos) / (2 * P))), 9) FROM pts) AS roc_auc,
  round((SELECT 100.0 * fpr FROM pts WHERE pts.threshold = t.threshold), 6) AS fpr_pct,
  round((SELECT 100.0 * tpr FROM pts WHERE pts.threshold = t.threshold), 6) AS tpr_pct
FROM nrm CROSS JOIN thr t""", NORM_SQL))
def ae_params_table(spark, sf_dir):
    """One row of score parameters: p0, p99, threshold, normalised threshold,
    ROC-AUC, FPR % and TPR % at the threshold."""
    p = preds(spark, sf_dir)
    pts = ev.roc_points(p, attack(), "ae_score")
    thr = pts.filter(F.col("fpr") < 0.02).agg(F.min(F.struct("threshold", "fpr", "tpr")).alias("m")).select(
        F.col("m.threshold").alias("threshold"), (F.col("m.fpr") * 100).alias("fpr_pct"),
        (F.col("m.tpr") * 100).alias("tpr_pct"))
    auc = ev.points_auc(pts)
    norm = ev.fit_score_norm(p.filter(~attack()), "ae_score")
    out = norm.crossJoin(thr).crossJoin(auc).select(
        "p0", "p99", "threshold",
        F.round(ev.normalize_score(F.col("threshold"), F.col("p0"), F.col("p99")), 9).alias("normalized_threshold"),
        F.round("roc_auc", 9).alias("roc_auc"), F.round("fpr_pct", 6).alias("fpr_pct"),
        F.round("tpr_pct", 6).alias("tpr_pct"))
    return out


# ------------------------------------------------------ model scores ----

@register("percentile_threshold", psql("""
SELECT (SELECT quantile_cont(attack_score_supervised, 0.95) FROM predictions) AS p95_supervised,
  (SELECT quantile_cont(ae_score, 0.99) FROM yb WHERE y = 0) AS p99_benign_error"""))
def percentile_threshold(spark, sf_dir):
    p = preds(spark, sf_dir)
    a = ev.percentile_threshold(p, "attack_score_supervised", 0.95).select(F.col("threshold").alias("p95_supervised"))
    b = ev.percentile_threshold(p.filter(~attack()), "ae_score", 0.99).select(F.col("threshold").alias("p99_benign_error"))
    return a.crossJoin(b)


@register("anomaly_flag", psql("""
SELECT flow_key, CASE WHEN ae_score >= (SELECT quantile_cont(ae_score, 0.99) FROM yb WHERE y = 0) THEN 1 ELSE 0 END
  AS anomaly FROM predictions"""))
def anomaly_flag(spark, sf_dir):
    p = preds(spark, sf_dir)
    t = ev.percentile_threshold(p.filter(~attack()), "ae_score", 0.99)
    return ev.anomaly_flag(p.select("flow_key", "ae_score"), "ae_score", t).select("flow_key", "anomaly")


@register("normalize_ae_score", psql(
    f"SELECT flow_key, round({_clip_sql('ae_score')}, 9) AS ae_score_norm FROM predictions CROSS JOIN nrm", NORM_SQL))
def normalize_ae_score(spark, sf_dir):
    p = preds(spark, sf_dir)
    norm = ev.fit_score_norm(p.filter(~attack()), "ae_score")
    x = p.select("flow_key", "ae_score").crossJoin(F.broadcast(norm))
    return x.select("flow_key", F.round(ev.normalize_score(F.col("ae_score"), F.col("p0"), F.col("p99")), 9)
                    .alias("ae_score_norm"))


@register("benign_only", psql("SELECT flow_key FROM predictions WHERE actual_code = 0"))
def benign_only(spark, sf_dir):
    return preds(spark, sf_dir).filter(F.col("actual_code") == 0).select("flow_key")


@register("combine_scores", psql(
    "SELECT flow_key, round(0.3::DOUBLE * attack_score_supervised + 0.7::DOUBLE * ae_score, 4) AS combined_score "
    "FROM predictions"))
def combine_scores(spark, sf_dir):
    from .. import constants as K
    p = preds(spark, sf_dir)
    return p.select("flow_key", F.round(F.lit(K.W_SUPERVISED) * F.col("attack_score_supervised") +
                                        F.lit(K.W_UNSUPERVISED) * F.col("ae_score"), 4).alias("combined_score"))


@register("compare_models", psql("""
SELECT model, round(avg(f1), 6) AS macro_f1, rank() OVER (ORDER BY avg(f1) DESC, model) = 1 AS best FROM (
  SELECT model, cls, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (
    SELECT model, cls, CASE WHEN sum(np) > 0 THEN sum(tp) / sum(np) ELSE 0 END AS p,
      CASE WHEN sum(sup) > 0 THEN sum(tp) / sum(sup) ELSE 0 END AS r FROM (
      SELECT model, cast(actual_code AS VARCHAR) AS cls, 1 AS sup, 0 AS np,
        CASE WHEN actual_code = predicted THEN 1 ELSE 0 END AS tp FROM mp
      UNION ALL SELECT model, cast(predicted AS VARCHAR), 0, 1, 0 FROM mp) u GROUP BY model, cls) a) b
GROUP BY model""",
    """mp AS (SELECT 'forest' AS model, actual_code, predicted_code AS predicted FROM predictions
  UNION ALL SELECT 'boosted', actual_code, CASE WHEN attack_score_supervised > 0.5 THEN actual_code
    ELSE predicted_code END FROM predictions)"""))
def compare_models(spark, sf_dir):
    """Macro-F1 of each candidate's hold-out predictions; the highest wins."""
    from ..operators.models import compare_models as cm
    p = preds(spark, sf_dir)
    a = p.select(F.lit("forest").alias("model"), "actual_code", F.col("predicted_code").alias("predicted"))
    b = p.select(F.lit("boosted").alias("model"), "actual_code",
                 F.when(F.col("attack_score_supervised") > 0.5, F.col("actual_code").cast("long"))
                 .otherwise(F.col("predicted_code")).alias("predicted"))
    return cm(a.unionByName(b), "actual_code", "predicted")
