"""Registered queries: alerts and log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import severity_normalize
from ..operators import alerts as al
from ..operators import reports as rp
from ..sources import adapters
from .q_fusion import dec_sql, decisions, fused_attack_log, written
from .registry import register, rounded
from .sql_common import any_sql

ATT_COLS = "id, ts, attack_type, src_ip, dest_ip, protocol, confidence, severity, explanation, fusion_score"
ALR_COLS = "id, ts, attack_type, severity, status, method, src_ip, dest_ip, recipients, error"


def att(spark, sf):
    return adapters.attack_log(spark, sf)


def alr(spark, sf):
    return adapters.alert_log(spark, sf)


def logs_sql(body: str) -> str:
    return any_sql(body, "attack_log", "alert_log")


# -------------------------------------------------------------- rows ----

@register("severity_normalize", logs_sql("""
SELECT id, CASE WHEN given IS NOT NULL AND given <> '' AND given = 'None' THEN 'LOW'
  WHEN given IS NOT NULL AND given <> '' THEN upper(given) ELSE """ + adapters.severity_infer_sql(
    "attack_type", "confidence") + """ END AS severity FROM (
  SELECT id, attack_type, confidence, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN 'high'
    ELSE 'Medium' END AS given FROM attack_log) t"""))
def severity_normalize_q(spark, sf_dir):
    """Given severity (upper-cased, 'None' -> LOW) else inferred from type
    and confidence by the rule table."""
    a = att(spark, sf_dir)
    given = (F.when(a.id % 4 == 0, F.lit(None).cast("string")).when(a.id % 4 == 1, "None")
             .when(a.id % 4 == 2, "high").otherwise("Medium"))
    return a.select("id", severity_normalize(given, F.col("attack_type"), F.col("confidence")).alias("severity"))


def _canned_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in al.CANNED_EXPLANATIONS.items())
    return f"coalesce(CASE {x} {cases} END, '{al.GENERIC_EXPLANATION}')"


@register("default_explanation", logs_sql(
    f"SELECT id, CASE WHEN explanation IS NOT NULL AND trim(explanation) <> '' THEN explanation "
    f"ELSE {_canned_sql('attack_type')} END AS explanation_text FROM attack_log"))
def default_explanation(spark, sf_dir):
    return al.default_explanation(att(spark, sf_dir)).select("id", "explanation_text")


@register("alert_log_rows", dec_sql("""
SELECT id, ts, attack_type, severity, CASE WHEN protocol = 'HOPOPT' THEN 'FAILED' ELSE 'SENT' END AS status,
  'EMAIL' AS method, src_ip, dest_ip, 'ops@example.test,sec@example.test' AS recipients,
  CASE WHEN protocol = 'HOPOPT' THEN 'delivery failed' END AS error FROM fused"""))
def alert_log_rows(spark, sf_dir):
    """Alert outcome per logged attack (here delivery fails for HOPOPT flows)."""
    a = fused_attack_log(spark, sf_dir)
    return al.alert_log_rows(a, "EMAIL", delivered=F.col("protocol") != "HOPOPT")


@register("alert_text", logs_sql(
    "SELECT id, printf('ALERT %s | severity %s | %s -> %s over %s | detected %s | confidence %.2f%% | %s', "
    "attack_type, severity, src_ip, dest_ip, protocol, strftime(ts, '%Y-%m-%d %H:%M:%S'), confidence * 100, "
    f"coalesce(explanation, {_canned_sql('attack_type')})) AS alert_text FROM attack_log"))
def alert_text(spark, sf_dir):
    return al.alert_text(att(spark, sf_dir))


@register("recipients_array", logs_sql("SELECT id, string_split(recipients, ',') AS recipients FROM alert_log"))
def recipients_array(spark, sf_dir):
    return al.recipients_array(alr(spark, sf_dir)).select("id", "recipients")


# ----------------------------------------------------------- queries ----

@register("q_attacks", logs_sql(
    f"SELECT {ATT_COLS} FROM attack_log WHERE severity = 'HIGH' ORDER BY ts DESC, id DESC LIMIT 100"))
def q_attacks(spark, sf_dir):
    """Newest 100 attacks of severity 'high' (case-folded)."""
    return rp.q_attacks(att(spark, sf_dir), 100, severity="high")


@register("q_attacks_by_type_limit", logs_sql(
    f"SELECT {ATT_COLS} FROM attack_log WHERE severity = 'MEDIUM' AND attack_type = 'DoS' "
    "ORDER BY ts DESC, id DESC LIMIT 1000"))
def q_attacks_filtered(spark, sf_dir):
    """Both filters and the maximum limit."""
    return rp.q_attacks(att(spark, sf_dir), 1000, severity="medium", attack_type="DoS")


@register("q_attack_stats", logs_sql("""
SELECT CASE grouping(severity, attack_type) WHEN 1 THEN 'severity' WHEN 2 THEN 'attack_type' ELSE 'total' END
    AS dimension,
  CASE grouping(severity, attack_type) WHEN 1 THEN severity WHEN 2 THEN attack_type END AS key,
  count(*) AS n, round(coalesce(avg(confidence), 0), 4) AS avg_confidence
FROM attack_log GROUP BY GROUPING SETS ((severity), (attack_type), ())"""))
def q_attack_stats(spark, sf_dir):
    return rp.q_attack_stats(att(spark, sf_dir))


@register("q_by_severity", logs_sql(
    f"SELECT {ATT_COLS} FROM attack_log WHERE severity = 'CRITICAL' ORDER BY ts DESC, id DESC LIMIT 100"))
def q_by_severity(spark, sf_dir):
    return rp.q_by_severity(att(spark, sf_dir), "critical")


@register("q_by_type", logs_sql(
    f"SELECT {ATT_COLS} FROM attack_log WHERE attack_type = 'Scan' ORDER BY ts DESC, id DESC LIMIT 100"))
def q_by_type(spark, sf_dir):
    return rp.q_by_type(att(spark, sf_dir), "Scan")


@register("q_high_confidence", logs_sql(
    f"SELECT {ATT_COLS} FROM attack_log WHERE confidence >= 0.8 ORDER BY confidence DESC, id DESC LIMIT 100"))
def q_high_confidence(spark, sf_dir):
    return rp.q_high_confidence(att(spark, sf_dir))


@register("q_alerts", logs_sql(
    f"SELECT {ALR_COLS} FROM alert_log WHERE status = 'LOGGED' ORDER BY ts DESC, id DESC LIMIT 100"))
def q_alerts(spark, sf_dir):
    return rp.q_alerts(alr(spark, sf_dir), 100, status="logged")


@register("q_alert_stats", logs_sql("""
SELECT CASE grouping(status, method) WHEN 1 THEN 'status' WHEN 2 THEN 'method' ELSE 'total' END AS dimension,
  CASE grouping(status, method) WHEN 1 THEN status WHEN 2 THEN method END AS key, count(*) AS n,
  CASE WHEN grouping(status, method) = 3 THEN round(coalesce(avg(CASE WHEN status = 'SENT' THEN 1.0 ELSE 0.0 END)
    * 100, 0), 2) END AS success_rate
FROM alert_log GROUP BY GROUPING SETS ((status), (method), ())"""))
def q_alert_stats(spark, sf_dir):
    return rp.q_alert_stats(alr(spark, sf_dir))


@register("q_alert_failures", logs_sql(
    f"SELECT {ALR_COLS} FROM alert_log WHERE status = 'FAILED' ORDER BY ts DESC, id DESC LIMIT 100"))
def q_alert_failures(spark, sf_dir):
    return rp.q_alert_failures(alr(spark, sf_dir))


@register("q_dashboard", logs_sql("""
SELECT (SELECT count(*) FROM attack_log) AS total_attacks, (SELECT count(*) FROM alert_log) AS total_alerts,
  (SELECT round(coalesce(avg(CASE WHEN status = 'SENT' THEN 1.0 ELSE 0.0 END) * 100, 0), 2) FROM alert_log)
    AS alert_success_rate,
  coalesce((SELECT attack_type FROM attack_log GROUP BY attack_type ORDER BY count(*) DESC, attack_type DESC LIMIT 1),
    'N/A') AS primary_attack_type,
  coalesce((SELECT severity FROM attack_log GROUP BY severity ORDER BY count(*) DESC, severity DESC LIMIT 1), 'N/A')
    AS primary_severity,
  (SELECT string_agg(cast(id AS VARCHAR), ',' ORDER BY ts DESC, id DESC) FROM
    (SELECT id, ts FROM attack_log ORDER BY ts DESC, id DESC LIMIT 10) t) AS latest_ids"""))
def q_dashboard(spark, sf_dir):
    return rp.q_dashboard(att(spark, sf_dir), alr(spark, sf_dir))


@register("q_table_counts", logs_sql("""
SELECT 'attack_log' AS table_name, count(*) AS n FROM attack_log
UNION ALL SELECT 'alert_log', count(*) FROM alert_log"""))
def q_table_counts(spark, sf_dir):
    return rp.q_table_counts(att(spark, sf_dir), alr(spark, sf_dir))


ANOMALY_SQL = """(SELECT round(coalesce(avg(ln(1 + s) / ln(1 + CASE WHEN mx > 0 THEN mx ELSE 1 END)), 0), 4) FROM
  (SELECT s, max(s) OVER () AS mx FROM (SELECT coalesce(attack_score_supervised, 0)
    + coalesce(attack_score_unsupervised, 0) AS s FROM results) a) b)"""


@register("q_overview", dec_sql(f"""
SELECT count(*) AS total_flows,
  sum(CASE WHEN explanation IS NOT NULL AND trim(explanation) <> '' THEN 1 ELSE 0 END)::BIGINT AS current_attacks,
  (SELECT count(*) FROM fused) AS total_attacks,
  round(sum(CASE WHEN explanation IS NOT NULL AND trim(explanation) <> '' THEN 1 ELSE 0 END) / count(*), 4)
    AS detection_rate,
  {ANOMALY_SQL} AS avg_anomaly_index
FROM results"""))
def q_overview(spark, sf_dir):
    r = written(spark, sf_dir)
    return rp.q_overview(r, fused_attack_log(spark, sf_dir, r))


LIVE_COLS = ("l.flow_key, l.timestamp, l.src_ip, l.dst_ip, coalesce(l.protocol, 'UNKNOWN') AS protocol, "
             "l.attack_score_supervised, l.attack_score_unsupervised, round(l.combined_score, 4) AS combined_score, "
             "l.predicted_label_encoded AS predicted_label")


@register("q_live_traffic", dec_sql(f"""
SELECT {LIVE_COLS}, h.id IS NOT NULL AS is_confirmed_attack, h.attack_type, h.severity, h.fusion_score,
  l.explanation
FROM (SELECT * FROM results WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, flow_key DESC LIMIT 50) l
LEFT JOIN (SELECT ts, src_ip AS a_src, dest_ip AS a_dst, min(id) AS id FROM fused GROUP BY ts, src_ip, dest_ip) m
  ON l.timestamp = m.ts AND l.src_ip = m.a_src AND l.dst_ip = m.a_dst
LEFT JOIN fused h ON h.id = m.id"""))
def q_live_traffic(spark, sf_dir):
    """Latest 50 flows, each with its fused attack-log entry when present."""
    r = written(spark, sf_dir)
    out = rp.q_live_traffic(r, fused_attack_log(spark, sf_dir, r), 50)
    return rounded(out, 4, only=["combined_score"])


@register("q_flow_summary", dec_sql(f"""
SELECT 'normal' AS metric, NULL::DATE AS day, cast((SELECT count(*) FROM results) - (SELECT count(*) FROM fused)
  AS DOUBLE) AS value
UNION ALL SELECT 'attack', NULL, cast((SELECT count(*) FROM fused) AS DOUBLE)
UNION ALL SELECT 'avg_anomaly_index', NULL, {ANOMALY_SQL}
UNION ALL SELECT 'attacks_on_day', cast(ts AS DATE), cast(count(*) AS DOUBLE) FROM fused GROUP BY cast(ts AS DATE)"""))
def q_flow_summary(spark, sf_dir):
    r = written(spark, sf_dir)
    return rp.q_flow_summary(r, fused_attack_log(spark, sf_dir, r))


@register("q_log_tail", logs_sql("""
(SELECT 'attack' AS log, id, ts, attack_type, severity FROM attack_log ORDER BY ts DESC, id DESC LIMIT 100)
UNION ALL
(SELECT 'alert', id, ts, attack_type, severity FROM alert_log ORDER BY ts DESC, id DESC LIMIT 100)"""))
def q_log_tail(spark, sf_dir):
    return rp.q_log_tail(att(spark, sf_dir), alr(spark, sf_dir), 100)


@register("q_log_stats", any_sql("""
SELECT 'attacks_by_severity' AS section, coalesce(severity, 'UNKNOWN') AS key, cast(count(*) AS DOUBLE) AS value
  FROM la GROUP BY 2
UNION ALL SELECT 'attacks_by_type', coalesce(attack_type, 'UNKNOWN'), cast(count(*) AS DOUBLE) FROM la GROUP BY 2
UNION ALL SELECT 'total_attacks_detected', NULL, cast(count(*) AS DOUBLE) FROM la
UNION ALL SELECT 'total_alerts_sent', NULL, cast(count(*) AS DOUBLE) FROM lb
UNION ALL SELECT 'alert_success_rate', NULL,
  round(coalesce(avg(CASE WHEN status = 'SENT' THEN 1.0 ELSE 0.0 END) * 100, 0), 2) FROM lb
UNION ALL (SELECT 'recent_attacks', cast(id AS VARCHAR), NULL FROM attack_log ORDER BY ts DESC, id DESC LIMIT 10)
UNION ALL (SELECT 'recent_alerts', cast(id AS VARCHAR), NULL FROM alert_log ORDER BY ts DESC, id DESC LIMIT 10)""",
    "attack_log", "alert_log", extra="la AS (SELECT * FROM attack_log ORDER BY ts DESC, id DESC LIMIT 1000),\n"
    "lb AS (SELECT * FROM alert_log ORDER BY ts DESC, id DESC LIMIT 1000)"))
def q_log_stats(spark, sf_dir):
    return rp.q_log_stats(att(spark, sf_dir), alr(spark, sf_dir))


@register("q_type_share", logs_sql(
    "SELECT attack_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct "
    "FROM attack_log GROUP BY attack_type"))
def q_type_share(spark, sf_dir):
    return rp.q_type_share(att(spark, sf_dir))


@register("q_high_count", logs_sql(
    "SELECT count(CASE WHEN upper(severity) = 'HIGH' THEN 1 END) AS high_attacks FROM attack_log"))
def q_high_count(spark, sf_dir):
    return rp.q_high_count(att(spark, sf_dir))


@register("q_traffic_stats", dec_sql("""
SELECT (SELECT cast(sum(total_packets) AS BIGINT) FROM results) AS packet_count,
  (SELECT cast(sum(total_bytes) AS BIGINT) FROM results) AS byte_count,
  (SELECT count(*) FROM results) AS flow_count, (SELECT max(timestamp) FROM results) AS last_update,
  (SELECT round(avg(CASE WHEN attack THEN 1.0 ELSE 0.0 END), 6) FROM dec) AS detection_rate,
  (SELECT count(*) FROM alert_log WHERE status = 'SENT') AS alerts_sent""", "attack_log", "alert_log"))
def q_traffic_stats(spark, sf_dir):
    return rp.q_traffic_stats(adapters.results(spark, sf_dir), decisions(spark, sf_dir), alr(spark, sf_dir))


@register("q_attack_distribution", dec_sql("""
SELECT attack_type, n, CASE WHEN attack_type = 'Benign' THEN 'benign' ELSE 'malicious' END AS class,
  round(n * 100.0 / sum(n) OVER (), 4) AS pct
FROM (SELECT CASE WHEN attack THEN attack_type ELSE 'Benign' END AS attack_type, count(*) AS n FROM dec GROUP BY 1) t"""))
def q_attack_distribution(spark, sf_dir):
    return rp.q_attack_distribution(decisions(spark, sf_dir))


@register("q_time_trends", any_sql("""
SELECT coalesce(p.b, a.b) AS bucket_start, round(coalesce(n_packets, 0) / 900, 6) AS packet_rate,
  round(coalesce(n_sources, 0) / 900, 6) AS flow_rate, round(coalesce(n_bytes, 0) / 900, 6) AS bytes_per_sec,
  coalesce(attacks, 0) AS attacks
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, count(*) AS n_packets, sum(length) AS n_bytes,
        count(DISTINCT src) AS n_sources FROM packets GROUP BY 1) p
FULL OUTER JOIN (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, count(*) AS attacks FROM attack_log GROUP BY 1) a
  ON p.b = a.b""", "packets", "attack_log"))
def q_time_trends(spark, sf_dir):
    return rp.q_time_trends(adapters.packets(spark, sf_dir), att(spark, sf_dir))


@register("q_recent_packets", logs_sql("""
SELECT id, {'id': id, 'src_ip': src_ip, 'dest_ip': dest_ip, 'protocol': protocol, 'timestamp': epoch_us(ts) / 1e6}
    AS packet,
  {'label': 'attack', 'confidence': confidence, 'attack_type': attack_type,
   'explanation': CASE WHEN explanation IS NOT NULL THEN MAP {'text': explanation} END} AS prediction
FROM attack_log ORDER BY ts DESC, id DESC LIMIT 100"""))
def q_recent_packets(spark, sf_dir):
    return rp.q_recent_packets(att(spark, sf_dir), 100)
