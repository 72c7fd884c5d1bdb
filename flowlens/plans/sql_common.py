"""SQL twins of the derived tables, for the DuckDB oracle.

Built from the adapter CTEs: ``prep`` (coerced flows + protocol one-hot),
``rowf`` (per-row features) and ``feat`` (with the table-relative ones).
"""

from __future__ import annotations

from ..sources.adapters import with_sql

FLAGS = ["fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
         "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count"]

PREP = """
SELECT flow_key, src_ip, dst_ip, flow_ts, raw_label,
  CASE WHEN flow_duration < 0.001 THEN 0.001 ELSE flow_duration END AS flow_duration,
  total_fwd_packets, total_backward_packets, fwd_packets_length_total, bwd_packets_length_total,
  fwd_packet_length_mean, fwd_packet_length_min, fwd_packet_length_std,
  bwd_packet_length_mean, bwd_packet_length_min, bwd_packet_length_std,
  fwd_iat_mean, fwd_iat_std, bwd_iat_mean, bwd_iat_std, "flow_packets/s", "fwd_packets/s",
  active_mean, active_std, idle_mean, idle_std, avg_fwd_segment_size, avg_bwd_segment_size,
  """ + ", ".join(f"cast({f} AS DOUBLE) AS {f}" for f in FLAGS) + """,
  CASE WHEN protocol = 0 THEN 1 ELSE 0 END AS proto_0,
  CASE WHEN protocol = 6 THEN 1 ELSE 0 END AS proto_6,
  CASE WHEN protocol = 17 THEN 1 ELSE 0 END AS proto_17
FROM flows
"""

ROWF = """
SELECT *,
  -((CASE WHEN ep = 0 THEN 0 ELSE ep * log2(ep) END) + (CASE WHEN eq = 0 THEN 0 ELSE eq * log2(eq) END))
    AS packet_entropy,
  total_flag_count * proto_0 / (flow_duration / 1e6 + 1e-5) AS proto_0_flag_rate,
  total_flag_count * proto_17 / (flow_duration / 1e6 + 1e-5) AS proto_17_flag_rate,
  total_flag_count * proto_6 / (flow_duration / 1e6 + 1e-5) AS proto_6_flag_rate,
  total_flag_count / (flow_duration / 1e6 + 0.001) AS flag_change_rate
FROM (
  SELECT *,
    total_packets / (flow_duration / 1e6) AS packet_rate,
    total_bytes / total_packets AS bytes_per_packet,
    (fwd_packet_length_std + 1e-9) / ((fwd_packet_length_std + 1e-9) + (bwd_packet_length_std + 1e-9)) AS ep,
    (bwd_packet_length_std + 1e-9) / ((fwd_packet_length_std + 1e-9) + (bwd_packet_length_std + 1e-9)) AS eq
  FROM (
    SELECT *,
      total_fwd_packets + total_backward_packets + 0.001 AS total_packets,
      fwd_packets_length_total + bwd_packets_length_total + 0.001 AS total_bytes,
      idle_std / (CASE WHEN idle_mean = 0 THEN 0.001 ELSE idle_mean END) AS idle_cv,
      active_std / (CASE WHEN active_mean = 0 THEN 0.001 ELSE active_mean END) AS active_cv,
      proto_6 * flow_duration AS tcp_behavior,
      "fwd_packets/s" / ("flow_packets/s" + 1e-5) AS burst_ratio,
      """ + " + ".join(f"coalesce({f}, 0)" for f in FLAGS) + """ AS total_flag_count,
      (syn_flag_count + 1e-5) / (fin_flag_count + 1e-5) AS syn_fin_ratio,
      (psh_flag_count + 1e-5) / (ack_flag_count + 1e-5) AS psh_ack_ratio,
      (avg_fwd_segment_size + 1e-5) / (avg_bwd_segment_size + 1e-5) AS segment_ratio,
      (fwd_iat_std + 1e-5) / (fwd_iat_mean + 1e-5) AS fwd_iat_cv,
      (bwd_iat_std + 1e-5) / (bwd_iat_mean + 1e-5) AS bwd_iat_cv,
      (fwd_packet_length_mean - fwd_packet_length_min) / (fwd_packet_length_std + 1e-5) AS fwd_packet_skew,
      (bwd_packet_length_mean - bwd_packet_length_min) / (bwd_packet_length_std + 1e-5) AS bwd_packet_skew,
      ln(1 + flow_duration) AS log_flow_duration,
      (active_mean + 0.001) / (idle_mean + 0.001) AS activity_period_ratio
    FROM prep) a) b
"""

STATS = """
SELECT avg(coalesce(log_flow_duration, 0)) AS ld_mean, stddev_pop(coalesce(log_flow_duration, 0)) AS ld_std,
  min(coalesce(burst_ratio, 0)) AS br_lo, max(coalesce(burst_ratio, 0)) AS br_hi,
  min(coalesce(active_cv, 0)) AS ac_lo, max(coalesce(active_cv, 0)) AS ac_hi,
  min(coalesce(flag_change_rate, 0)) AS fc_lo, max(coalesce(flag_change_rate, 0)) AS fc_hi
FROM rowf
"""


def _mm(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} - {lo} = 0 THEN 0 ELSE (coalesce({x}, 0) - {lo}) / ({hi} - {lo}) END)"


FEAT = f"""
SELECT rowf.*,
  CASE WHEN abs((coalesce(log_flow_duration, 0) - ld_mean) / NULLIF(ld_std, 0)) > 3 THEN 1 ELSE 0 END
    AS abnormal_flow_duration,
  {_mm('burst_ratio', 'br_lo', 'br_hi')} + {_mm('active_cv', 'ac_lo', 'ac_hi')}
    + {_mm('flag_change_rate', 'fc_lo', 'fc_hi')} AS flow_anomaly_index,
  coalesce(burst_ratio, 0) + coalesce(active_cv, 0) + coalesce(flag_change_rate, 0) AS flow_anomaly_index_raw
FROM rowf CROSS JOIN ({STATS}) s
"""


def feat_sql(body: str) -> str:
    """Query over the feature table ``feat`` (and ``prep``/``rowf``)."""
    inner = with_sql("SELECT 1", "flows")
    ctes = inner[len("WITH "):inner.rindex("\nSELECT 1")]
    return f"WITH {ctes},\nprep AS ({PREP}),\nrowf AS ({ROWF}),\nfeat AS ({FEAT})\n{body}"


def clean_label_sql(x: str) -> str:
    return f"replace(replace(trim({x}), '�', '-'), '–', '-')"


def group_label_sql(x: str) -> str:
    from .. import constants as K
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LABEL_GROUPS.items()) + " END"


LF = f"SELECT flows.*, {group_label_sql(clean_label_sql('raw_label'))} AS label FROM flows"


def flows_sql(body: str, extra: str = "") -> str:
    """Query over ``flows``, ``lf`` (labelled flows) and ``prep``."""
    inner = with_sql("SELECT 1", "flows")
    ctes = inner[len("WITH "):inner.rindex("\nSELECT 1")]
    more = f",\n{extra}" if extra else ""
    return f"WITH {ctes},\nlf AS ({LF}),\nprep AS ({PREP}){more}\n{body}"


def any_sql(body: str, *names: str, extra: str = "") -> str:
    if not names:
        return f"WITH {extra}\n{body}" if extra else body
    inner = with_sql("SELECT 1", *names)
    ctes = inner[len("WITH "):inner.rindex("\nSELECT 1")]
    more = f",\n{extra}" if extra else ""
    return f"WITH {ctes}{more}\n{body}"
