"""Feature engineering.

Per-row features are native column expressions built in one wide
``select``.  The two table-relative features (duration z-score flag and the
min-max scaled anomaly index) need global statistics: they are fitted in a
single aggregation pass into a one-row parameter table and broadcast back
with a cross join (one row, so the broadcast size is fixed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c, floor_at, row_sum, zero_to

EPS, SMALL, TINY = K.EPS, K.SMALL, K.TINY
ANOMALY_PARTS = ["burst_ratio", "active_cv", "flag_change_rate"]


def _has(cols, *names) -> bool:
    return all(n in cols for n in names)


def packet_entropy(a: Column, b: Column) -> Column:
    """Base-2 entropy of the two-point distribution (a, b) normalised to sum 1."""
    s = a + b
    p, q = a / s, b / s
    term = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x * F.log2(x))
    return -(term(p) + term(q))


def row_features(df: DataFrame) -> DataFrame:
    """All per-row features, present-column aware, in one projection.

    Order of definition mirrors the scorer: duration floor first, then the
    features that read it."""
    cols = set(df.columns)
    base = {n: c(n) for n in df.columns}
    new: dict[str, Column] = {}

    if "flow_duration" in cols:
        base["flow_duration"] = floor_at(c("flow_duration"), EPS)
    dur = base.get("flow_duration")

    if dur is not None:
        if _has(cols, "total_fwd_packets", "total_backward_packets"):
            new["total_packets"] = c("total_fwd_packets") + c("total_backward_packets") + EPS
        if _has(cols, "fwd_packets_length_total", "bwd_packets_length_total"):
            new["total_bytes"] = c("fwd_packets_length_total") + c("bwd_packets_length_total") + EPS
        if "total_packets" in new:
            new["packet_rate"] = F.try_divide(new["total_packets"], dur / 1e6)
        if "total_bytes" in new and "total_packets" in new:
            new["bytes_per_packet"] = F.try_divide(new["total_bytes"], new["total_packets"])
    if _has(cols, "idle_mean", "idle_std"):
        new["idle_cv"] = F.try_divide(c("idle_std"), zero_to(c("idle_mean"), EPS))
    if _has(cols, "active_mean", "active_std"):
        new["active_cv"] = F.try_divide(c("active_std"), zero_to(c("active_mean"), EPS))
    if dur is not None:
        new["tcp_behavior"] = (c("proto_6") * dur) if "proto_6" in cols else F.lit(0.0)
    if _has(cols, "fwd_packets/s", "flow_packets/s"):
        new["burst_ratio"] = F.try_divide(c("fwd_packets/s"), c("flow_packets/s") + SMALL)
    if _has(cols, "fwd_packet_length_std", "bwd_packet_length_std"):
        new["packet_entropy"] = packet_entropy(c("fwd_packet_length_std") + TINY, c("bwd_packet_length_std") + TINY)
    if _has(cols, *K.FLAG_COLUMNS):
        new["total_flag_count"] = row_sum([c(f) for f in K.FLAG_COLUMNS])
        new["syn_fin_ratio"] = F.try_divide(c("syn_flag_count") + SMALL, c("fin_flag_count") + SMALL)
        new["psh_ack_ratio"] = F.try_divide(c("psh_flag_count") + SMALL, c("ack_flag_count") + SMALL)
    if _has(cols, "avg_fwd_segment_size", "avg_bwd_segment_size"):
        new["segment_ratio"] = F.try_divide(c("avg_fwd_segment_size") + SMALL, c("avg_bwd_segment_size") + SMALL)
    for d in ("fwd", "bwd"):
        if _has(cols, f"{d}_iat_std", f"{d}_iat_mean"):
            new[f"{d}_iat_cv"] = F.try_divide(c(f"{d}_iat_std") + SMALL, c(f"{d}_iat_mean") + SMALL)
    for d in ("fwd", "bwd"):
        m, mn, sd = f"{d}_packet_length_mean", f"{d}_packet_length_min", f"{d}_packet_length_std"
        if _has(cols, m, mn, sd):
            new[f"{d}_packet_skew"] = F.try_divide(c(m) - c(mn), c(sd) + SMALL)
    if dur is not None:
        new["log_flow_duration"] = F.log1p(dur)
    if _has(cols, "active_mean", "idle_mean"):
        new["activity_period_ratio"] = F.try_divide(c("active_mean") + EPS, c("idle_mean") + EPS)
    if "total_flag_count" in new and dur is not None:
        for p in sorted(n for n in df.columns if n.startswith("proto_")):
            new[f"{p}_flag_rate"] = F.try_divide(new["total_flag_count"] * c(p), dur / 1e6 + SMALL)
        new["flag_change_rate"] = F.try_divide(new["total_flag_count"], dur / 1e6 + EPS)

    return df.select([base[n].alias(n) for n in df.columns] + [v.alias(k) for k, v in new.items()])


def fit_feature_stats(rows: DataFrame, fill_missing_log: bool = True) -> DataFrame:
    """One-row table of the global statistics, one aggregation pass:
    mean / population std of log duration and min / max of each anomaly part
    (missing read as 0, as the scaler saw them)."""
    aggs = []
    if "log_flow_duration" in rows.columns:
        ld = F.coalesce(c("log_flow_duration"), F.lit(0.0)) if fill_missing_log else c("log_flow_duration")
        aggs += [F.avg(ld).alias("ld_mean"), F.stddev_pop(ld).alias("ld_std")]
    for p in ANOMALY_PARTS:
        if p in rows.columns:
            v = F.coalesce(c(p), F.lit(0.0))
            aggs += [F.min(v).alias(f"min__{p}"), F.max(v).alias(f"max__{p}")]
    return rows.agg(*aggs)


def _minmax(x: Column, lo: Column, hi: Column) -> Column:
    """MinMaxScaler on missing->0 data: constant column -> 0."""
    rng = hi - lo
    return F.when(rng == 0, F.lit(0.0)).otherwise((F.coalesce(x, F.lit(0.0)) - lo) / rng)


def apply_feature_stats(rows: DataFrame, stats: DataFrame, anomaly_mode: str = "scaled",
                        fill_missing_log: bool = True, keep_log: bool = False) -> DataFrame:
    """Add ``abnormal_flow_duration`` and ``flow_anomaly_index`` from the stats row."""
    j = rows.crossJoin(F.broadcast(stats))
    out = [c(n) for n in rows.columns if keep_log or n != "log_flow_duration"]
    if "log_flow_duration" in rows.columns:
        ld = F.coalesce(c("log_flow_duration"), F.lit(0.0)) if fill_missing_log else c("log_flow_duration")
        z = F.try_divide(ld - F.col("ld_mean"), F.col("ld_std"))
        out.append(F.coalesce(F.abs(z) > K.ZSCORE_LIMIT, F.lit(False)).cast("int").alias("abnormal_flow_duration"))
    parts = [p for p in ANOMALY_PARTS if p in rows.columns]
    if parts and "flag_change_rate" in rows.columns:
        if anomaly_mode == "scaled":
            terms = [_minmax(c(p), F.col(f"min__{p}"), F.col(f"max__{p}")) for p in parts]
        else:
            terms = [c(p) for p in parts]
        out.append(row_sum(terms).alias("flow_anomaly_index"))
    return j.select(out)


def engineer(df: DataFrame, stats: DataFrame | None = None, anomaly_mode: str = "scaled",
             fill_missing_log: bool = True) -> DataFrame:
    """Full feature set.  Without ``stats`` the statistics are fitted on this
    batch (reference behaviour); pass frozen stats for streams."""
    rows = row_features(df)
    if stats is None:
        stats = fit_feature_stats(rows, fill_missing_log)
    return apply_feature_stats(rows, stats, anomaly_mode, fill_missing_log)


def prepare_flows(df: DataFrame, protocols: list[str] | None = None) -> DataFrame:
    """Scorer-side cleaning of a flow table: numeric coercion, non-finite ->
    NULL, protocol one-hot (of the values in ``df`` unless those fitted on the
    training rows are given)."""
    from .clean import enforce_numeric, one_hot_protocol
    x = enforce_numeric(df, K.NUMERIC_PATTERNS_SCORE, skip=("label", "raw_label", "src_ip", "dst_ip",
                                                            "flow_key", "flow_ts"))
    return one_hot_protocol(x, list(protocols) if protocols is not None else None)
