"""Read-side queries over the attack log, the alert log and the result
table (SURVEY §2.8).

Newest-first lists are ``orderBy(...).limit(n)`` (top-k: each task keeps n
rows, never a global sort); ties always end with ``id``.  Several
groupings per answer use ``GROUPING SETS`` in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def _limit(n: int) -> int:
    if not 1 <= n <= K.QUERY_LIMIT_MAX:
        raise ValueError(f"limit must be within 1..{K.QUERY_LIMIT_MAX}")
    return n


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(_limit(n))


def q_attacks(log: DataFrame, limit: int = K.QUERY_LIMIT_DEFAULT, severity: str | None = None,
              attack_type: str | None = None) -> DataFrame:
    if severity:
        log = log.filter(F.col("severity") == severity.upper())
    if attack_type:
        log = log.filter(F.col("attack_type") == attack_type)
    return newest(log, limit)


def q_by_severity(log: DataFrame, severity: str, limit: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    return newest(log.filter(F.col("severity") == severity.upper()), limit)


def q_by_type(log: DataFrame, attack_type: str, limit: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    return newest(log.filter(F.col("attack_type") == attack_type), limit)


def q_high_confidence(log: DataFrame, min_confidence: float = K.HIGH_CONFIDENCE_DEFAULT,
                      limit: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    return (log.filter(F.col("confidence") >= min_confidence)
            .orderBy(F.col("confidence").desc(), F.col("id").desc()).limit(_limit(limit)))


def q_attack_stats(log: DataFrame) -> DataFrame:
    """Total, per severity, per type; mean confidence (4 digits), one pass."""
    g = log.groupingSets([["severity"], ["attack_type"], []], "severity", "attack_type").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"))
    dim = F.when(F.col("gid") == 1, "severity").when(F.col("gid") == 2, "attack_type").otherwise("total")
    key = F.when(F.col("gid") == 1, F.col("severity")).when(F.col("gid") == 2, F.col("attack_type"))
    return g.select(dim.alias("dimension"), key.alias("key"), "n", "avg_confidence")


def q_alerts(log: DataFrame, limit: int = K.QUERY_LIMIT_DEFAULT, status: str | None = None) -> DataFrame:
    if status:
        log = log.filter(F.col("status") == status.upper())
    return newest(log, limit)


def q_alert_failures(log: DataFrame, limit: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    return newest(log.filter(F.col("status") == "FAILED"), limit)


def q_alert_stats(log: DataFrame) -> DataFrame:
    """Total, per status, per method, share SENT in percent (2 digits)."""
    g = log.groupingSets([["status"], ["method"], []], "status", "method").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg((F.col("status") == "SENT").cast("double")) * 100, F.lit(0.0)), 2)
        .alias("success_rate"))
    dim = F.when(F.col("gid") == 1, "status").when(F.col("gid") == 2, "method").otherwise("total")
    key = F.when(F.col("gid") == 1, F.col("status")).when(F.col("gid") == 2, F.col("method"))
    return g.select(dim.alias("dimension"), key.alias("key"), "n",
                    F.when(F.col("gid") == 3, F.col("success_rate")).alias("success_rate"))


def _mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value (ties: larger value); one row, NULL when empty."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.max(F.struct("n", col)).alias("m")).select(F.col(f"m.{col}").alias(col))


def q_dashboard(attacks: DataFrame, alerts: DataFrame, recent: int = K.RECENT_N) -> DataFrame:
    """Totals, modal type and severity ("N/A" when empty), success rate,
    and the ids of the latest attacks."""
    at = attacks.agg(F.count(F.lit(1)).alias("total_attacks"))
    al = alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                    F.round(F.coalesce(F.avg((F.col("status") == "SENT").cast("double")) * 100, F.lit(0.0)), 2)
                    .alias("alert_success_rate"))
    mt = _mode(attacks, "attack_type")
    ms = _mode(attacks, "severity")
    latest = (newest(attacks, recent).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ts"), F.col("id"))), False),
                                 lambda s: s["id"].cast("string")), ",").alias("latest_ids")))
    return (at.crossJoin(al).crossJoin(mt).crossJoin(ms).crossJoin(latest).select(
        "total_attacks", "total_alerts", "alert_success_rate",
        F.coalesce("attack_type", F.lit("N/A")).alias("primary_attack_type"),
        F.coalesce("severity", F.lit("N/A")).alias("primary_severity"), "latest_ids"))


def q_table_counts(attacks: DataFrame, alerts: DataFrame) -> DataFrame:
    a = attacks.agg(F.lit("attack_log").alias("table_name"), F.count(F.lit(1)).alias("n"))
    b = alerts.agg(F.lit("alert_log").alias("table_name"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def _anomaly_index(results: DataFrame) -> DataFrame:
    """avg(log1p(s + u) / log1p(max)), max <= 0 -> 1; missing scores -> 0."""
    comb = F.coalesce(F.col("attack_score_supervised"), F.lit(0.0)) + \
        F.coalesce(F.col("attack_score_unsupervised"), F.lit(0.0))
    x = results.select(comb.alias("s"))
    mx = x.agg(F.max("s").alias("mx"))
    j = x.crossJoin(F.broadcast(mx))
    top = F.when(F.col("mx") > 0, F.col("mx")).otherwise(F.lit(1.0))
    return j.agg(F.round(F.coalesce(F.avg(F.log1p("s") / F.log1p(top)), F.lit(0.0)), 4).alias("avg_anomaly_index"))


def q_overview(results: DataFrame, attacks: DataFrame, parity: bool = True) -> DataFrame:
    """Flows, current attacks, logged attacks, detection rate, anomaly index.

    ``parity`` counts current attacks as non-blank explanations (the
    reference's rule); otherwise the ``attack`` flag of a decision table."""
    if parity:
        cur = F.sum((F.col("explanation").isNotNull() & (F.trim(F.col("explanation")) != "")).cast("long"))
    else:
        cur = F.sum(F.col("attack").cast("long"))
    r = results.agg(F.count(F.lit(1)).alias("total_flows"), F.coalesce(cur, F.lit(0)).alias("current_attacks"))
    a = attacks.agg(F.count(F.lit(1)).alias("total_attacks"))
    rate = F.round(F.when(F.col("total_flows") > 0, F.col("current_attacks") / F.col("total_flows"))
                   .otherwise(F.lit(0.0)), 4)
    return r.crossJoin(a).crossJoin(_anomaly_index(results)).select(
        "total_flows", "current_attacks", "total_attacks", rate.alias("detection_rate"), "avg_anomaly_index")


def q_live_traffic(results: DataFrame, attacks: DataFrame, limit: int = K.LIVE_TRAFFIC_DEFAULT) -> DataFrame:
    """Latest flows, each with its logged attack when (time, src, dst) match.

    The top-N side is bounded by ``limit`` (<= 100) and is broadcast; the
    first match per flow is picked with ``min_by`` (partial aggregation, so
    a hot (time, src, dst) key does not land in one task)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    last = (results.filter(F.col("timestamp").isNotNull())
            .orderBy(F.col("timestamp").desc(), F.col("flow_key").desc()).limit(limit))
    a = attacks.select(F.col("ts").alias("a_ts"), F.col("src_ip").alias("a_src"), F.col("dest_ip").alias("a_dst"),
                       F.struct(F.col("id"), F.col("attack_type"), F.col("severity"), F.col("fusion_score"))
                       .alias("hit"))
    j = F.broadcast(last).join(a, (F.col("timestamp") == F.col("a_ts")) & (F.col("src_ip") == F.col("a_src")) &
                               (F.col("dst_ip") == F.col("a_dst")), "inner")
    first = j.groupBy("flow_key").agg(F.min_by("hit", F.col("hit.id")).alias("hit"))
    out = last.join(first, "flow_key", "left")
    return out.select(
        "flow_key", "timestamp", "src_ip", "dst_ip", F.coalesce("protocol", F.lit("UNKNOWN")).alias("protocol"),
        F.coalesce("attack_score_supervised", F.lit(0.0)).alias("attack_score_supervised"),
        F.coalesce("attack_score_unsupervised", F.lit(0.0)).alias("attack_score_unsupervised"),
        F.coalesce("combined_score", F.lit(0.0)).alias("combined_score"),
        F.coalesce("predicted_label_encoded", F.lit(0)).alias("predicted_label"),
        F.col("hit").isNotNull().alias("is_confirmed_attack"),
        F.col("hit.attack_type").alias("attack_type"), F.col("hit.severity").alias("severity"),
        F.col("hit.fusion_score").alias("fusion_score"), "explanation")


def q_flow_summary(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """normal = flows - logged attacks (reference rule), attack count,
    anomaly index, and attacks per day; long form (metric, day, value)."""
    n = results.agg(F.count(F.lit(1)).alias("flows"))
    a = attacks.agg(F.count(F.lit(1)).alias("attacks"))
    head = n.crossJoin(a).crossJoin(_anomaly_index(results))
    rows = head.select(F.explode(F.array(
        F.struct(F.lit("normal").alias("metric"), (F.col("flows") - F.col("attacks")).cast("double").alias("value")),
        F.struct(F.lit("attack").alias("metric"), F.col("attacks").cast("double").alias("value")),
        F.struct(F.lit("avg_anomaly_index").alias("metric"), F.col("avg_anomaly_index").alias("value")))).alias("r"))
    rows = rows.select("r.metric", F.lit(None).cast("date").alias("day"), "r.value")
    per_day = attacks.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.unionByName(per_day.select(F.lit("attacks_on_day").alias("metric"), "day", "value"))


def q_log_tail(attacks: DataFrame, alerts: DataFrame, n: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    a = newest(attacks, n).select(F.lit("attack").alias("log"), "id", "ts", "attack_type", "severity")
    b = newest(alerts, n).select(F.lit("alert").alias("log"), "id", "ts", "attack_type", "severity")
    return a.unionByName(b)


def q_log_stats(attacks: DataFrame, alerts: DataFrame, window: int = K.STATS_WINDOW,
                recent: int = K.RECENT_N) -> DataFrame:
    """Over the latest ``window`` entries of each log: counts by severity and
    type (missing -> UNKNOWN), success %, and the latest ids; long form."""
    la, lb = newest(attacks, window), newest(alerts, window)
    sev = la.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("attacks_by_severity"))
    typ = la.groupBy(F.coalesce("attack_type", F.lit("UNKNOWN")).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("attacks_by_type"))
    tot = la.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("total_attacks_detected").alias("section"), F.lit(None).cast("string").alias("key"), "value")
    tal = lb.agg(F.count(F.lit(1)).cast("double").alias("value"),
                 F.round(F.coalesce(F.avg((F.col("status") == "SENT").cast("double")) * 100, F.lit(0.0)), 2)
                 .alias("rate"))
    t2 = tal.select(F.lit("total_alerts_sent").alias("section"), F.lit(None).cast("string").alias("key"), "value")
    t3 = tal.select(F.lit("alert_success_rate").alias("section"), F.lit(None).cast("string").alias("key"),
                    F.col("rate").alias("value"))
    ra = newest(attacks, recent).select(F.lit("recent_attacks").alias("section"), F.col("id").cast("string")
                                        .alias("key"), F.lit(None).cast("double").alias("value"))
    rb = newest(alerts, recent).select(F.lit("recent_alerts").alias("section"), F.col("id").cast("string")
                                       .alias("key"), F.lit(None).cast("double").alias("value"))
    cols = ["section", "key", "value"]
    return (sev.select(cols).unionByName(typ.select(cols)).unionByName(tot).unionByName(t2).unionByName(t3)
            .unionByName(ra).unionByName(rb))


def q_type_share(attacks: DataFrame) -> DataFrame:
    g = attacks.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("attack_type", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4)
                    .alias("pct"))


def q_high_count(attacks: DataFrame) -> DataFrame:
    return attacks.agg(F.count(F.when(F.upper(F.col("severity")) == "HIGH", 1)).alias("high_attacks"))


def q_traffic_stats(results: DataFrame, decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Packet, byte and flow totals, detection rate, alerts sent, last update."""
    r = results.agg(F.coalesce(F.sum("total_packets"), F.lit(0)).cast("long").alias("packet_count"),
                    F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("long").alias("byte_count"),
                    F.count(F.lit(1)).alias("flow_count"), F.max("timestamp").alias("last_update"))
    d = decisions.agg(F.round(F.coalesce(F.avg(F.col("attack").cast("double")), F.lit(0.0)), 6)
                      .alias("detection_rate"))
    s = alerts.agg(F.count(F.when(F.col("status") == "SENT", 1)).alias("alerts_sent"))
    return r.crossJoin(d).crossJoin(s)


def q_attack_distribution(decisions: DataFrame) -> DataFrame:
    """Benign vs malicious totals and the percent of each attack type."""
    kind = F.when(F.col("attack"), F.col("attack_type")).otherwise(F.lit(K.BENIGN))
    g = decisions.groupBy(kind.alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.select("attack_type", "n",
                    F.when(F.col("attack_type") == K.BENIGN, "benign").otherwise("malicious").alias("class"),
                    F.round(F.col("n") * 100.0 / F.sum("n").over(w), 4).alias("pct"))


def q_time_trends(packets: DataFrame, attacks: DataFrame, bucket: str = "15 minutes",
                  bucket_seconds: int = 900) -> DataFrame:
    """Packet rate, flow rate (distinct sources), bytes/s and attacks per bucket."""
    p = packets.groupBy(F.window("ts", bucket).start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n_packets"), F.sum("length").alias("n_bytes"),
        F.count_distinct("src").alias("n_sources"))
    a = attacks.groupBy(F.window("ts", bucket).start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("attacks"))
    j = p.join(a, "bucket_start", "full_outer")
    return j.select(
        F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"),
        F.round(F.coalesce("n_packets", F.lit(0)) / bucket_seconds, 6).alias("packet_rate"),
        F.round(F.coalesce("n_sources", F.lit(0)) / bucket_seconds, 6).alias("flow_rate"),
        F.round(F.coalesce("n_bytes", F.lit(0.0)) / bucket_seconds, 6).alias("bytes_per_sec"),
        F.coalesce("attacks", F.lit(0)).alias("attacks"))


def q_recent_packets(attacks: DataFrame, n: int = K.QUERY_LIMIT_DEFAULT) -> DataFrame:
    """Latest records as nested packet + prediction structs."""
    last = newest(attacks, n)
    packet = F.struct(F.col("id").alias("id"), F.col("src_ip").alias("src_ip"), F.col("dest_ip").alias("dest_ip"),
                      F.col("protocol").alias("protocol"),
                      (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"))
    pred = F.struct(F.lit("attack").alias("label"), F.col("confidence").alias("confidence"),
                    F.col("attack_type").alias("attack_type"),
                    F.when(F.col("explanation").isNotNull(),
                           F.create_map(F.lit("text"), F.col("explanation"))).alias("explanation"))
    return last.select("id", packet.alias("packet"), pred.alias("prediction"))
