"""Score fusion, severity and the decision table.

Batch-relative statistics (min/max of a score) come from one aggregation
pass into a one-row table that is cross-joined back (broadcast, fixed size).
For streams, fit them once and pass the frozen row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c

MODEL_CLASSES = sorted({g for g in K.LABEL_GROUPS.values() if g != K.RARE_GROUP})


def model_label(code: Column) -> Column:
    """Model class code -> label text (alphabetical codes without Rare)."""
    return F.element_at(F.array(*[F.lit(x) for x in MODEL_CLASSES]), code.cast("int") + 1)


def fit_score_range(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: min and max of each score column."""
    aggs = []
    for n in cols:
        aggs += [F.min(c(n)).alias(f"min__{n}"), F.max(c(n)).alias(f"max__{n}")]
    return df.agg(*aggs)


def _unit(v: Column) -> Column:
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def minmax_confidence(df: DataFrame, col: str = "attack_score_supervised", out: str = "xgb_confidence",
                      rng: DataFrame | None = None) -> DataFrame:
    """Min-max of the supervised score over the batch, or over the frozen range
    ``rng`` with scores beyond it cut to 0 and 1; 0.5 when constant or absent."""
    if col not in df.columns:
        return df.withColumn(out, F.lit(K.CONSTANT_CONFIDENCE))
    rng = fit_score_range(df, [col]) if rng is None else rng
    j = df.crossJoin(F.broadcast(rng.select(f"min__{col}", f"max__{col}")))
    lo, hi = F.col(f"min__{col}"), F.col(f"max__{col}")
    v = F.when(hi > lo, _unit((c(col) - lo) / (hi - lo))).otherwise(F.lit(K.CONSTANT_CONFIDENCE))
    return j.withColumn(out, v).drop(f"min__{col}", f"max__{col}")


def minmax_ae(df: DataFrame, col: str = "ae_score", out: str = "ae_norm",
              rng: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-9); beyond a frozen range, 0 or 1."""
    rng = fit_score_range(df, [col]) if rng is None else rng
    j = df.crossJoin(F.broadcast(rng.select(f"min__{col}", f"max__{col}")))
    lo, hi = F.col(f"min__{col}"), F.col(f"max__{col}")
    return j.withColumn(out, _unit((c(col) - lo) / (hi - lo + K.MINMAX_GUARD))).drop(f"min__{col}", f"max__{col}")


def ae_score_fallback(df: DataFrame, unsup: str = "attack_score_unsupervised", combined: str = "combined_score",
                      out: str = "ae_score") -> DataFrame:
    """Unsupervised score, else the combined score."""
    if unsup in df.columns:
        v = F.coalesce(c(unsup), c(combined)) if combined in df.columns else c(unsup)
    else:
        v = c(combined)
    return df.withColumn(out, v)


def _not_benign(label: Column) -> Column:
    # a missing label is "not Benign" (a missing value never equals a text)
    return ~label.eqNullSafe(F.lit(K.BENIGN))


def fusion_columns(ae: Column, ae_norm: Column, conf: Column, label: Column,
                   cfg: dict | None = None) -> dict[str, Column]:
    """Rule + weighted fusion; returns attack, fusion_score, reason, severity."""
    k = dict(ae_rule=K.AE_THRESHOLD_RULE, conf_rule=K.CONF_THRESHOLD_RULE, w_ae=K.WEIGHT_AE, w_xgb=K.WEIGHT_XGB,
             fusion=K.FUSION_THRESHOLD, ae_high=K.AE_THRESHOLD_HIGH, conf_high=K.CONF_THRESHOLD_HIGH)
    k.update(cfg or {})
    nb = _not_benign(label)
    rule = F.coalesce((ae > k["ae_rule"]) & nb & (conf >= k["conf_rule"]), F.lit(False))
    score = F.lit(k["w_ae"]) * ae_norm + F.lit(k["w_xgb"]) * conf
    weighted = F.coalesce(nb & (score > k["fusion"]), F.lit(False))
    attack = rule | weighted
    reason = (F.when(rule, K.REASON_RULE).when(weighted, K.REASON_WEIGHTED).otherwise(K.REASON_NONE))
    sev = (F.when(F.coalesce((ae > k["ae_high"]) & (conf >= k["conf_high"]), F.lit(False)), "High")
           .when(F.coalesce((ae > k["ae_rule"]) & (conf >= k["conf_rule"]), F.lit(False)), "Medium")
           .otherwise("Low"))
    return {"attack": attack, "fusion_score": score, "reason": reason,
            "severity": F.when(attack, sev).otherwise(F.lit("None"))}


def decide(results: DataFrame, label_col: str = "xgb_label", cfg: dict | None = None,
           decided_at: Column | None = None, rng: DataFrame | None = None) -> DataFrame:
    """Results (scores + metadata) -> decision table with the metadata kept
    on the same row (no join needed: decisions are row-wise).  ``rng`` is the
    frozen row of score ranges; without it they are those of this batch."""
    x = ae_score_fallback(results) if "ae_score" not in results.columns else results
    # both batch ranges in one aggregation pass
    sup = "attack_score_supervised"
    if rng is None:
        rng = fit_score_range(x, [sup, "ae_score"] if sup in x.columns else ["ae_score"])
    x = minmax_confidence(x, rng=rng)
    x = minmax_ae(x, rng=rng)
    cols = fusion_columns(c("ae_score"), c("ae_norm"), c("xgb_confidence"), c(label_col), cfg)
    out = x.select("*", *[v.alias(n) for n, v in cols.items()])
    out = out.withColumn("attack_type", F.when(F.col("attack"), c(label_col)).otherwise(F.lit("None")))
    out = out.withColumn("decided_at", decided_at if decided_at is not None else F.current_timestamp())
    return out.drop("ae_norm")


def join_metadata(decisions: DataFrame, results: DataFrame, key: str | list[str] = "flow_key",
                  check: bool = True) -> DataFrame:
    """Decision rows left-joined to separately computed result rows by key.

    ``check`` verifies the key is unique on the results side (one job that
    stops at the first duplicate) — a one-to-one join or an error."""
    keys = [key] if isinstance(key, str) else list(key)
    if check and results.groupBy(*keys).count().filter("count > 1").limit(1).count() > 0:
        raise ValueError(f"{keys} is not unique in the result table")
    meta = [n for n in results.columns if n not in decisions.columns or n in keys]
    return decisions.join(results.select(*meta), keys, "left")


def severity_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
