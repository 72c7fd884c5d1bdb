"""Model evaluation as aggregations over prediction tables.

Cumulative curves (ROC, precision-recall) are grouped by distinct score
first.  The prefix sum over scores never runs in one task: the distinct
scores are range-partitioned, each range gets its offset from the totals of
the earlier ranges, and the running sum is a window *within* a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


# ------------------------------------------------------------ classes ----

def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Long form: (actual, predicted, n)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per class: support, predicted count, true positives; one scan (each row
    contributes to its actual and its predicted class), partial aggregation."""
    a, p = F.col(actual), F.col(predicted)
    hit = (a == p).cast("long")
    rows = df.select(F.explode(F.array(
        F.struct(a.cast("string").alias("cls"), F.lit(1).cast("long").alias("sup"), F.lit(0).cast("long").alias("np"),
                 hit.alias("tp")),
        F.struct(p.cast("string").alias("cls"), F.lit(0).cast("long").alias("sup"), F.lit(1).cast("long").alias("np"),
                 F.lit(0).cast("long").alias("tp")))).alias("r")).select("r.*")
    return rows.groupBy("cls").agg(F.sum("sup").alias("support"), F.sum("np").alias("n_pred"),
                                   F.sum("tp").alias("tp"))


def _prf(cc: DataFrame) -> DataFrame:
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    x = cc.select("cls", "support", "tp", "n_pred", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return x.withColumn("f1", f1)


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                          digits: int = 6) -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro avg
    and weighted avg rows (zero division -> 0)."""
    per = _prf(class_counts(df, actual, predicted))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp_all"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    cls = per.select(F.col("cls").alias("class"), "precision", "recall", "f1", "support")
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp_all") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                     F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    out = cls.unionByName(acc).unionByName(mac).unionByName(wei)
    return out.select("class", *[F.round(x, digits).alias(x) for x in ("precision", "recall", "f1")], "support")


def fpr_per_class(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One-vs-rest false-positive rate FP / (FP + TN) per class and macro mean."""
    cc = class_counts(df, actual, predicted)
    n = cc.agg(F.sum("support").alias("n"))
    x = cc.crossJoin(F.broadcast(n))
    fp = F.col("n_pred") - F.col("tp")
    tn = F.col("n") - F.col("support") - fp
    per = x.select(F.col("cls").alias("class"),
                   F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0)).alias("fpr"))
    mac = per.agg(F.lit("macro").alias("class"), F.avg("fpr").alias("fpr"))
    return per.unionByName(mac).select("class", F.round("fpr", 9).alias("fpr"))


# ------------------------------------------------------ prefix sums ----

def descending_prefix(g: DataFrame, score: str, sums: list[str], part: list[str] | None = None,
                      ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` ordered by ``score`` descending
    (per ``part`` when given).  Rows without a score are left out.

    ``g`` holds one row per (part, distinct score).  It is range-partitioned
    on (part, score) and written once, so that each range keeps its partition
    number; sums run inside a range and start at the totals of the earlier
    ranges (one row per part and range).  The number of ranges grows with the
    data (``ranges`` fixes it)."""
    part = part or []
    keys = [*part, F.col(score).desc()]
    x = g.filter(F.col(score).isNotNull())
    x = x.repartitionByRange(ranges, *keys) if ranges else x.repartitionByRange(*keys)
    x = x.checkpoint().withColumn("__b", F.spark_partition_id())
    tot = x.groupBy(*part, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    wb = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, "__b",
                     *[F.coalesce(F.sum(f"__t_{s}").over(wb), F.lit(0)).alias(f"__o_{s}") for s in sums])
    w = Window.partitionBy(*part, "__b").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(off, [*part, "__b"])
    return y.select(*[c for c in g.columns],
                    *[(F.sum(s).over(w) + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums])


# ---------------------------------------------------------------- ROC ----

def score_counts(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Distinct score -> (pos, neg) counts (partial aggregation); rows without
    a score are left out."""
    y = label.cast("long")
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_points(df: DataFrame, label: Column, score: str, ranges: int | None = None) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, plus pos/neg counts
    and the running counts."""
    g = score_counts(df, label, score)
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = descending_prefix(g, "score", ["pos", "neg"], ranges=ranges).crossJoin(F.broadcast(tot))
    return c.select(F.col("score").alias("threshold"), "pos", "neg", "cum_pos", "cum_neg", "P", "N",
                    (F.col("cum_pos") / F.col("P")).alias("tpr"), (F.col("cum_neg") / F.col("N")).alias("fpr"))


def roc_curve(df: DataFrame, label: Column, score: str, ranges: int | None = None) -> DataFrame:
    return roc_points(df, label, score, ranges).select("threshold", "tpr", "fpr")


def roc_auc(df: DataFrame, label: Column, score: str, ranges: int | None = None) -> DataFrame:
    """Trapezoid area under the ROC curve (ties counted half); each point
    knows its predecessor from its own running counts, so no lag is needed."""
    return points_auc(roc_points(df, label, score, ranges))


def points_auc(p: DataFrame) -> DataFrame:
    """The area under the curve given as ``roc_points``."""
    area = (F.col("neg") / F.col("N")) * ((2 * F.col("cum_pos") - F.col("pos")) / (2 * F.col("P")))
    return p.agg(F.sum(area).alias("roc_auc"))


def threshold_fpr_budget(df: DataFrame, label: Column, score: str, budget: float = K.FPR_BUDGET,
                         ranges: int | None = None) -> DataFrame:
    """Lowest threshold whose false-positive rate stays below the budget."""
    p = roc_points(df, label, score, ranges)
    return p.filter(F.col("fpr") < budget).agg(F.min("threshold").alias("threshold"))


def threshold_youden(df: DataFrame, label: Column, score: str, ranges: int | None = None) -> DataFrame:
    """Threshold maximising TPR - FPR (ties: the higher threshold)."""
    p = roc_points(df, label, score, ranges)
    best = p.agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.j").alias("youden_j"))


def pr_precision_floor(df: DataFrame, classes: list, actual: str, predicted: str, score: str,
                       floor: float = K.PRECISION_FLOOR, ranges: int | None = None) -> DataFrame:
    """Per class (one-vs-rest; the class score is ``score`` where the class is
    predicted, else 0): lowest threshold whose precision >= floor, with its
    recall.  No closing point: a class with no such threshold gets NULL."""
    # one scan: every row contributes one (class, class score, is-class) entry per class
    entries = F.array(*[F.struct(F.lit(str(cl)).alias("cls"),
                                 F.when(F.col(predicted) == cl, F.col(score)).otherwise(F.lit(0.0)).alias("score"),
                                 (F.col(actual) == cl).cast("long").alias("y")) for cl in classes])
    e = df.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("score").isNotNull())
    g = e.groupBy("cls", "score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    tot = g.groupBy("cls").agg(F.sum("pos").alias("P"))
    c = descending_prefix(g, "score", ["pos", "n"], ["cls"], ranges).join(F.broadcast(tot), "cls")
    c = c.select("cls", "score", F.col("cum_pos").alias("tp"), F.col("cum_n").alias("k"), "P")
    c = c.select("cls", "score", (F.col("tp") / F.col("k")).alias("precision"),
                 F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(0.0)).alias("recall"))
    ok = c.filter(F.col("precision") >= floor).groupBy("cls").agg(
        F.min(F.struct("score", "recall")).alias("m"))
    allc = g.select("cls").distinct()
    return allc.join(ok, "cls", "left").select(F.col("cls").alias("class"), F.col("m.score").alias("threshold"),
                                               F.col("m.recall").alias("recall"))


# --------------------------------------------------------- thresholds ----

def _thr(threshold) -> tuple[Column, DataFrame | None]:
    """A threshold given as a number or as a one-row table with column ``threshold``."""
    if isinstance(threshold, DataFrame):
        return F.col("__thr"), threshold.select(F.col("threshold").alias("__thr"))
    return F.lit(float(threshold)), None


def eval_thresholds(df: DataFrame, label: Column, score: str, thresholds: DataFrame) -> DataFrame:
    """FPR % and TPR % for each candidate threshold.  ``thresholds`` is one
    row with one column per candidate (cross-joined, broadcast); one
    aggregation pass computes every candidate."""
    names = thresholds.columns
    y = label.cast("boolean")
    j = df.crossJoin(F.broadcast(thresholds.select([F.col(n).alias(f"__t_{n}") for n in names])))
    aggs = []
    for n in names:
        hit = (F.col(score) >= F.col(f"__t_{n}")).cast("double")
        aggs += [F.first(f"__t_{n}").alias(f"t__{n}"), (F.avg(F.when(~y, hit)) * 100).alias(f"fpr__{n}"),
                 (F.avg(F.when(y, hit)) * 100).alias(f"tpr__{n}")]
    wide = j.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"t__{n}").alias("threshold"), F.col(f"fpr__{n}").alias("fpr_pct"),
                     F.col(f"tpr__{n}").alias("tpr_pct")) for n in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def false_positive_count(df: DataFrame, label: Column, score: str, threshold) -> DataFrame:
    """Flagged rows, flagged benign rows, and the expected anomaly count."""
    t, tdf = _thr(threshold)
    x = df.crossJoin(F.broadcast(tdf)) if tdf is not None else df
    flagged = F.col(score) >= t
    y = label.cast("boolean")
    return x.agg(F.sum(flagged.cast("long")).alias("flagged"),
                 F.sum((flagged & ~y).cast("long")).alias("false_positives"),
                 F.sum(y.cast("long")).alias("expected_anomalies"))


def anomaly_flag(df: DataFrame, score: str, threshold, out: str = "anomaly") -> DataFrame:
    """score >= threshold -> 1 else 0."""
    t, tdf = _thr(threshold)
    x = df.crossJoin(F.broadcast(tdf)) if tdf is not None else df
    r = x.withColumn(out, F.coalesce(F.col(score) >= t, F.lit(False)).cast("int"))
    return r.drop("__thr") if tdf is not None else r


def percentile_threshold(df: DataFrame, score: str, q: float) -> DataFrame:
    """One row: the interpolated ``q`` percentile of ``score`` (exact)."""
    from .quantiles import quantile_row
    return quantile_row(df.select(score), [score], q).select(F.col(score).alias("threshold"))


BANDS = [("light", 0.0, 0.25), ("normal", 0.25, 0.75), ("heavy", 0.75, 0.99), ("edge", 0.99, 1.0)]


def fp_scenarios(benign: DataFrame, score: str, threshold, limit_pct: float = K.FP_PASS_LIMIT_PCT,
                 bands=BANDS) -> DataFrame:
    """Benign scores cut into percentile bands (closed at both ends, so an
    edge value counts in both neighbours), flagged share per band, then the
    overall share and PASS/FAIL.

    The band table has four rows (broadcast); the range join is a broadcast
    nested-loop join against it."""
    from .quantiles import quantile_array
    levels = sorted({p for _, lo, hi in bands for p in (lo, hi)})
    pct = quantile_array(benign, score, levels)
    rows = [F.struct(F.lit(n).alias("band"), F.lit(i).alias("ord"), F.col("q")[levels.index(lo)].alias("lo"),
                     F.col("q")[levels.index(hi)].alias("hi")) for i, (n, lo, hi) in enumerate(bands)]
    tab = pct.select(F.explode(F.array(*rows)).alias("b")).select("b.*")
    t, tdf = _thr(threshold)
    e = benign.select(F.col(score).alias("e"))
    if tdf is not None:
        tab = tab.crossJoin(tdf)
    j = e.join(F.broadcast(tab), (F.col("e") >= F.col("lo")) & (F.col("e") <= F.col("hi")))
    per = j.groupBy("band", "ord").agg(F.count(F.lit(1)).alias("tested"),
                                       F.sum((F.col("e") >= t).cast("long")).alias("flagged"))
    per = tab.select("band", "ord").join(per, ["band", "ord"], "left").select(
        "band", "ord", F.coalesce("tested", F.lit(0)).alias("tested"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    allr = per.agg(F.lit("overall").alias("band"), F.lit(len(bands)).alias("ord"),
                   F.sum("tested").alias("tested"), F.sum("flagged").alias("flagged"))
    out = per.unionByName(allr)
    rate = F.when(F.col("tested") > 0, F.col("flagged") * 100.0 / F.col("tested")).otherwise(F.lit(0.0))
    return out.select("band", "tested", "flagged", F.round(rate, 6).alias("fp_rate_pct"),
                      F.when(F.col("band") == "overall", F.when(rate < limit_pct, "PASS").otherwise("FAIL"))
                      .alias("verdict"))


def normalize_score(x: Column, p0: Column, p99: Column) -> Column:
    """clip((e - p0) / (p99 - p0), 0, 1) keeping missing values missing."""
    v = (x - p0) / (p99 - p0)
    return F.when(v.isNull(), v).when(v < 0, F.lit(0.0)).when(v > 1, F.lit(1.0)).otherwise(v)


def fit_score_norm(benign_train: DataFrame, score: str) -> DataFrame:
    """One row: p0 and p99 of the benign training scores (interpolated, exact)."""
    from .quantiles import quantile_array
    q = quantile_array(benign_train, score, [0.0, 0.99])
    return q.select(F.col("q")[0].alias("p0"), F.col("q")[1].alias("p99"))


def normalized_means(test: DataFrame, label: Column, score: str, norm: DataFrame, threshold) -> DataFrame:
    """Normalised mean error of benign rows, of attack rows, and of the threshold."""
    y = label.cast("boolean")
    m = test.agg(F.avg(F.when(~y, F.col(score))).alias("mb"), F.avg(F.when(y, F.col(score))).alias("ma"))
    t, tdf = _thr(threshold)
    j = m.crossJoin(norm)
    if tdf is not None:
        j = j.crossJoin(tdf)
    return j.select(normalize_score(F.col("mb"), F.col("p0"), F.col("p99")).alias("benign_mean"),
                    normalize_score(F.col("ma"), F.col("p0"), F.col("p99")).alias("attack_mean"),
                    normalize_score(t, F.col("p0"), F.col("p99")).alias("threshold_score"))
