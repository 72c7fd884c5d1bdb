"""Registered queries: fusion, severity, decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import fusion as fu
from ..sources import adapters
from .registry import materialize, register, rounded
from .sql_common import any_sql


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table with the decoded model label (``xgb_label``)."""
    r = adapters.results(spark, sf_dir)
    return r.withColumn("xgb_label", fu.model_label(F.col("predicted_label_encoded")))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored``, written once: the score ranges, the decisions and the reports
    each read it, and the join behind it shuffles all flows."""
    return materialize(scored(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.decide(scored(spark, sf_dir), decided_at=F.col("timestamp"))


def fused_attack_log(spark: SparkSession, sf_dir: str, results: DataFrame | None = None) -> DataFrame:
    """Attack-log rows of the fused decisions (flow time kept as ``ts``), of
    the ``written`` results if there are some already."""
    r = written(spark, sf_dir) if results is None else results
    return al.attack_log_rows(fu.decide(r, decided_at=F.col("timestamp")), logged_at=F.col("timestamp"))


DEC_CTES = f"""res AS (SELECT *, {adapters.model_label_sql('predicted_label_encoded')} AS xgb_label,
  attack_score_unsupervised AS ae_score FROM results),
rng AS (SELECT min(attack_score_supervised) AS s_lo, max(attack_score_supervised) AS s_hi,
  min(ae_score) AS a_lo, max(ae_score) AS a_hi FROM res),
conf AS (SELECT res.*, CASE WHEN s_hi > s_lo THEN (attack_score_supervised - s_lo) / (s_hi - s_lo) ELSE 0.5 END
  AS xgb_confidence, (ae_score - a_lo) / (a_hi - a_lo + 1e-9) AS ae_norm FROM res CROSS JOIN rng),
f1 AS (SELECT conf.*,
  coalesce(ae_score > 1e7 AND xgb_label IS DISTINCT FROM 'Benign' AND xgb_confidence >= 0.00001, false) AS r_att,
  0.0 * ae_norm + 1.0 * xgb_confidence AS fusion_score FROM conf),
f2 AS (SELECT f1.*, coalesce(xgb_label IS DISTINCT FROM 'Benign' AND fusion_score > 0.0000001, false) AS w_att
  FROM f1),
dec AS (SELECT f2.*, r_att OR w_att AS attack,
  CASE WHEN r_att THEN 'Rule-based fusion triggered' WHEN w_att THEN 'Weighted fusion triggered'
       ELSE 'No attack conditions met' END AS reason,
  CASE WHEN NOT (r_att OR w_att) THEN 'None'
       WHEN coalesce(ae_score > 5e7 AND xgb_confidence >= 0.8, false) THEN 'High'
       WHEN coalesce(ae_score > 1e7 AND xgb_confidence >= 0.00001, false) THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN r_att OR w_att THEN xgb_label ELSE 'None' END AS attack_type FROM f2),
fused AS (SELECT flow_key AS id, timestamp AS ts, attack_type, src_ip, dst_ip AS dest_ip, protocol,
  fusion_score AS confidence, CASE WHEN severity = 'None' THEN 'LOW' ELSE upper(severity) END AS severity,
  explanation, ae_score, xgb_confidence, fusion_score FROM dec WHERE attack)"""


def dec_sql(body: str, *extra_tables: str) -> str:
    return any_sql(body, "results", *extra_tables, extra=DEC_CTES)


@register("minmax_confidence", dec_sql("SELECT flow_key, round(xgb_confidence, 9) AS xgb_confidence FROM conf"))
def minmax_confidence(spark, sf_dir):
    """Batch min-max of the supervised score (0.5 when constant)."""
    r = adapters.results(spark, sf_dir).select("flow_key", "attack_score_supervised")
    return rounded(fu.minmax_confidence(r).select("flow_key", "xgb_confidence"), 9)


@register("minmax_ae", dec_sql("SELECT flow_key, round(ae_norm, 9) AS ae_norm FROM conf"))
def minmax_ae(spark, sf_dir):
    r = adapters.results(spark, sf_dir).select("flow_key", F.col("attack_score_unsupervised").alias("ae_score"))
    return rounded(fu.minmax_ae(r).select("flow_key", "ae_norm"), 9)


@register("ae_score_fallback", any_sql("""
SELECT flow_key, round(coalesce(CASE WHEN protocol = 'HOPOPT' THEN NULL ELSE attack_score_unsupervised END,
  combined_score), 4) AS ae_score FROM results""", "results"))
def ae_score_fallback(spark, sf_dir):
    """Unsupervised score, else the combined score (HOPOPT rows lack it here)."""
    r = adapters.results(spark, sf_dir)
    r = r.withColumn("attack_score_unsupervised", F.when(F.col("protocol") == "HOPOPT", F.lit(None).cast("double"))
                     .otherwise(F.col("attack_score_unsupervised")))
    return rounded(fu.ae_score_fallback(r).select("flow_key", "ae_score"), 4)


@register("fusion_decision", dec_sql(
    "SELECT flow_key, attack, round(fusion_score, 9) AS fusion_score, reason FROM dec"))
def fusion_decision(spark, sf_dir):
    return rounded(decisions(spark, sf_dir).select("flow_key", "attack", "fusion_score", "reason"), 9)


@register("severity_score", dec_sql("SELECT flow_key, severity FROM dec"))
def severity_score(spark, sf_dir):
    return decisions(spark, sf_dir).select("flow_key", "severity")


DECISION_COLS = ["flow_key", "attack", "attack_type", "ae_score", "xgb_confidence", "fusion_score", "severity",
                 "reason", "src_ip", "dst_ip", "protocol", "total_packets", "total_bytes", "timestamp",
                 "explanation", "predicted_label_encoded"]


@register("decision_table", dec_sql(
    "SELECT " + ", ".join(f"round({x}, 9) AS {x}" if x in ("xgb_confidence", "fusion_score") else x
                          for x in DECISION_COLS) + " FROM dec"))
def decision_table(spark, sf_dir):
    """Decision fields + the result metadata on the same row."""
    d = fu.decide(written(spark, sf_dir), decided_at=F.col("timestamp"))
    return rounded(d.select(*DECISION_COLS), 9, only=["xgb_confidence", "fusion_score"])


@register("join_metadata", dec_sql("SELECT flow_key, attack, severity, src_ip, dst_ip, timestamp FROM dec"))
def join_metadata(spark, sf_dir):
    """Decisions computed on the score columns only, then left-joined back to
    the result metadata by flow key (uniqueness checked)."""
    r = materialize(scored(spark, sf_dir).select("flow_key", "src_ip", "timestamp", "dst_ip", "attack_score_supervised",
                                                 "attack_score_unsupervised", "xgb_label"))
    key = ["flow_key", "src_ip", "timestamp"]      # flow_key alone can collide on small tables
    d = fu.decide(r.select(*key, "attack_score_supervised", "attack_score_unsupervised", "xgb_label"),
                  decided_at=F.lit(None).cast("timestamp"))
    j = fu.join_metadata(d.select(*key, "attack", "severity"), r.select(*key, "dst_ip"), key)
    return j.select("flow_key", "attack", "severity", "src_ip", "dst_ip", "timestamp")


@register("severity_summary", dec_sql("SELECT severity, count(*) AS n FROM dec GROUP BY severity"))
def severity_summary(spark, sf_dir):
    return fu.severity_summary(decisions(spark, sf_dir))


# ------------------------------------------------------- alert rows ----

@register("attack_log_rows", dec_sql(
    "SELECT id, ts, attack_type, src_ip, dest_ip, protocol, round(confidence, 9) AS confidence, severity, "
    "explanation FROM fused"))
def attack_log_rows(spark, sf_dir):
    """Attack decisions -> log rows (severity normalised, flow time kept)."""
    x = fused_attack_log(spark, sf_dir).select("id", "ts", "attack_type", "src_ip", "dest_ip", "protocol",
                                                 "confidence", "severity", "explanation")
    return rounded(x, 9, only=["confidence"])
