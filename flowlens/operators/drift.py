"""Drift monitoring of a reconstruction-error series.

Status rule: fewer than ``min_values`` values -> insufficient_data; else the
shift of the window mean against the baseline mean, in percent: below 5 ->
normal, below 15 -> gradual_drift, otherwise sudden_drift.

The rolling form needs, for every row, the mean of the last ``window``
values of its key.  It is computed from exact running sums: rows are ranked
inside (key, time range) and offset by earlier ranges (a small table), so
no task holds a whole key; the sum over the last ``window`` rows is
``cum[i] - cum[i - window]``, an equi-join on the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def status(shift: Column, n: Column, min_values: int = K.DRIFT_MIN_VALUES) -> Column:
    a = F.abs(shift)
    return (F.when(n < min_values, "insufficient_data").when(a < K.DRIFT_NORMAL_PCT, "normal")
            .when(a < K.DRIFT_GRADUAL_PCT, "gradual_drift").otherwise("sudden_drift"))


def drift_batch(baseline: DataFrame, monitored: DataFrame, value: str = "error", ts: str = "ts",
                order_id: str = "event_id", window: int = K.DRIFT_WINDOW) -> DataFrame:
    """One row: status, shift %, current mean, values used (newest ``window``)."""
    base = baseline.agg(F.avg(value).alias("baseline_mean"))
    last = monitored.orderBy(F.col(ts).desc(), F.col(order_id).desc()).limit(window)
    cur = last.agg(F.avg(value).alias("current_mean"), F.count(F.lit(1)).alias("n"))
    j = cur.crossJoin(base)
    shift = 100 * (F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_mean")
    return j.select(status(shift, F.col("n")).alias("status"),
                    F.when(F.col("n") >= K.DRIFT_MIN_VALUES, shift).alias("shift_pct"),
                    "current_mean", "baseline_mean", "n")


def running_sums(df: DataFrame, part: str, ts: str, order_id: str, value: str,
                 ranges: int | None = None) -> DataFrame:
    """Exact 0-based rank and inclusive running sum of ``value`` per ``part``
    in (ts, order_id) order, without a window over a whole part.

    The rows are range-partitioned on (part, ts, order_id) and written once, so
    that each range keeps its partition number; the number of ranges grows with
    the data (``ranges`` fixes it)."""
    keys = [part, ts, order_id]
    x = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    x = x.checkpoint().withColumn("__b", F.spark_partition_id())
    w = Window.partitionBy(part, "__b").orderBy(ts, order_id)
    x = x.withColumn("__r", F.row_number().over(w) - 1).withColumn(
        "__s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tot = x.groupBy(part, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__v"))
    wb = Window.partitionBy(part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(part, "__b", F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__on"),
                     F.coalesce(F.sum("__v").over(wb), F.lit(0).cast(dict(tot.dtypes)["__v"])).alias("__ov"))
    y = x.join(off, [part, "__b"])
    return y.withColumn("rank", F.col("__r") + F.col("__on")).withColumn("cum", F.col("__s") + F.col("__ov")).drop(
        "__b", "__r", "__s", "__on", "__ov")


def drift_rolling(baseline: DataFrame, monitored: DataFrame, part: str = "sensor", value: str = "error",
                  ts: str = "ts", order_id: str = "event_id", window: int = K.DRIFT_WINDOW,
                  ranges: int | None = None) -> DataFrame:
    """Per monitored row: mean of the key's last ``window`` values (itself
    included), shift against the key's baseline mean, status."""
    # running sums in exact decimal: cum[i] - cum[i - window] must not carry
    # the rounding error of thousands of float additions
    m = monitored.withColumn("__xv", F.col(value).cast("decimal(30,12)"))
    r = running_sums(m, part, ts, order_id, "__xv", ranges)
    back = r.select(part, (F.col("rank") + window).alias("rank"), F.col("cum").alias("cum_back"))
    j = r.join(back, [part, "rank"], "left")
    n = F.least(F.col("rank") + 1, F.lit(window))
    wsum = (F.col("cum") - F.coalesce(F.col("cum_back"), F.lit(0).cast("decimal(30,12)"))).cast("double")
    mean = wsum / n
    base = baseline.groupBy(part).agg(F.avg(value).alias("baseline_mean"))
    j = j.join(base, part, "left")  # one row per key: size grows with keys, AQE picks the join
    shift = 100 * (F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_mean")
    out = j.select(part, order_id, ts, n.alias("n_window"), wsum.alias("window_sum"), mean.alias("current_mean"),
                   "baseline_mean")
    return out.select("*", F.when(F.col("n_window") >= K.DRIFT_MIN_VALUES, shift).alias("shift_pct"),
                      status(shift, F.col("n_window")).alias("status"))
