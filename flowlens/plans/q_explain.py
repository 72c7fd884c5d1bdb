"""Registered queries: explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as ex
from ..operators import models as md
from ..sources import adapters
from .q_models import emb, train_test
from .registry import register, rounded
from .sql_common import any_sql


def _attributions(spark, sf_dir):
    """Forest (100 trees, depth 10) on the training split; attributions for
    every row."""
    tr, _ = train_test(spark, sf_dir)
    model = md.train_forest(md.class_weights(tr, "label"), "label", "weight", 100, 10, 5)
    rf = model.stages[-1]
    nodes = ex.forest_nodes(rf, spark)
    return ex.attribution_rows(emb(spark, sf_dir), nodes, "vec_id", "features_arr", 64, rf.numClasses)


@register("global_attribution")
def global_attribution(spark, sf_dir):
    """Mean |attribution| per feature over all rows and classes, ranked."""
    return ex.global_attribution(_attributions(spark, sf_dir))


@register("row_attribution")
def row_attribution(spark, sf_dir):
    """Attribution per row x class x feature, with each row's dominant class
    and its base value."""
    return ex.row_attribution(_attributions(spark, sf_dir), "vec_id")


DEV_SQL = """dev AS (SELECT vec_id, cast(i - 1 AS INTEGER) AS feature, abs(x[i] - round(x[i], 1)) AS deviation,
  cast(row_number() OVER (PARTITION BY vec_id ORDER BY abs(x[i] - round(x[i], 1)) DESC, i) AS INTEGER) AS rank
  FROM (SELECT vec_id, cast(embedding AS DOUBLE[]) AS x FROM embeddings) t, range(1, 65) r(i))"""


def _rebuilt(spark, sf_dir):
    xh = F.transform(F.col("features_arr"), lambda v: F.round(v, 1))
    return emb(spark, sf_dir).withColumn("xh", xh)


@register("ae_deviation_top_k", any_sql(
    "SELECT vec_id, rank, feature, round(deviation, 9) AS deviation FROM dev WHERE rank <= 5", extra=DEV_SQL))
def ae_deviation_top_k(spark, sf_dir):
    """Five features with the largest |x - x_hat| per row (x_hat: the
    vector rounded to one decimal)."""
    return rounded(ex.deviation_top_k(_rebuilt(spark, sf_dir), "vec_id", "features_arr", "xh", 5), 9)


@register("explain_attacks", any_sql("""
SELECT a.vec_id, printf('%s traffic: model-wide drivers %s and %s; this flow stands out on %s and %s',
  'class ' || cast(a.label AS VARCHAR), 'f' || g1, 'f' || g2, 'f' || r1, 'f' || r2) AS explanation
FROM (SELECT vec_id, label FROM embeddings WHERE label <> 0) a
LEFT JOIN (SELECT vec_id, max(CASE WHEN rank = 1 THEN feature END) AS r1, max(CASE WHEN rank = 2 THEN feature END)
  AS r2 FROM dev WHERE rank <= 2 GROUP BY vec_id) r ON a.vec_id = r.vec_id
CROSS JOIN (SELECT max(CASE WHEN rk = 1 THEN feature END) AS g1, max(CASE WHEN rk = 2 THEN feature END) AS g2 FROM (
  SELECT feature, row_number() OVER (ORDER BY avg(deviation) DESC, feature) AS rk FROM dev GROUP BY feature) q) g""",
    extra=DEV_SQL))
def explain_attacks(spark, sf_dir):
    """Sentence for every attack row: label, the two features with the
    largest mean deviation overall and the row's own top two."""
    e = _rebuilt(spark, sf_dir)
    attacks = e.filter(F.col("label") != 0).withColumn("label_text", F.concat(F.lit("class "),
                                                                             F.col("label").cast("string")))
    return ex.explain_attacks(attacks, "label_text", "features_arr", "xh",
                              ex.global_deviation(e, "features_arr", "xh")).select("vec_id", "explanation")


@register("explanation_per_type", any_sql("""
SELECT attack_type, explanation FROM (
  SELECT attack_type, explanation, row_number() OVER (PARTITION BY attack_type ORDER BY ts DESC, id DESC) AS r FROM (
    SELECT * FROM attack_log ORDER BY ts DESC, id DESC LIMIT 50) l
  WHERE explanation IS NOT NULL AND trim(explanation) <> '') t WHERE r = 1""", "attack_log"))
def explanation_per_type(spark, sf_dir):
    return ex.explanation_per_type(adapters.attack_log(spark, sf_dir), 50)
