"""Registered queries: feature engineering and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import clean
from ..operators.features import engineer, prepare_flows, row_features
from ..sources import adapters
from .registry import register, rounded
from .sql_common import feat_sql

TCP = ("6",)


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the cleaned, grouped label in ``label``."""
    f = adapters.flows(spark, sf_dir).withColumnRenamed("raw_label", "label")
    return clean.group_labels(clean.clean_label_text(f, "label"), "label")


def feature_table(spark: SparkSession, sf_dir: str, anomaly_mode: str = "scaled") -> DataFrame:
    """All features but those of single protocols."""
    return engineer(prepare_flows(adapters.flows(spark, sf_dir), ()), anomaly_mode=anomaly_mode)


def _feature_query(name: str, cols: list[str], digits: int = 6):
    quoted = ", ".join(f'round({x}, {digits}) AS {x}' if x != "abnormal_flow_duration" else x for x in cols)
    sql = feat_sql(f"SELECT flow_key, {quoted} FROM feat")

    @register(name, sql)
    def q(spark, sf_dir, _cols=cols):
        # features of a row alone need no statistics of the table, and only
        # those of a protocol its values
        x = row_features(prepare_flows(adapters.flows(spark, sf_dir), TCP if "tcp_behavior" in _cols else ()))
        if not set(_cols) <= set(x.columns):
            x = feature_table(spark, sf_dir)
        return rounded(x.select("flow_key", *_cols), digits)
    return q


_feature_query("f_clip_duration", ["flow_duration"])
_feature_query("f_totals", ["total_packets", "total_bytes"])
_feature_query("f_rates", ["packet_rate", "bytes_per_packet"], 3)
_feature_query("f_idle_active_cv", ["idle_cv", "active_cv"])
_feature_query("f_tcp_behavior", ["tcp_behavior"])
_feature_query("f_burst_ratio", ["burst_ratio"])
_feature_query("f_packet_entropy", ["packet_entropy"])
_feature_query("f_flag_total", ["total_flag_count"])
_feature_query("f_flag_ratios", ["syn_fin_ratio", "psh_ack_ratio"], 3)
_feature_query("f_segment_ratio", ["segment_ratio"], 3)
_feature_query("f_iat_cv", ["fwd_iat_cv", "bwd_iat_cv"])
_feature_query("f_packet_skew", ["fwd_packet_skew", "bwd_packet_skew"], 3)
_feature_query("f_abnormal_duration", ["abnormal_flow_duration"])
_feature_query("f_activity_ratio", ["activity_period_ratio"])

@register("f_proto_flag_rate", feat_sql("SELECT flow_key, " + ", ".join(
    f"round(proto_{p}_flag_rate, 3) AS proto_{p}_flag_rate" for p in (0, 6, 17)) + " FROM feat"))
def f_proto_flag_rate(spark, sf_dir):
    """Flags per packet of each protocol that the table holds."""
    flows = adapters.flows(spark, sf_dir)
    protocols = clean.fit_protocols(flows)
    x = row_features(prepare_flows(flows, protocols))
    return rounded(x.select("flow_key", *[f"proto_{p}_flag_rate" for p in protocols]), 3)


_feature_query("f_flag_change_rate", ["flag_change_rate"], 3)
_feature_query("f_anomaly_index", ["flow_anomaly_index"])


@register("f_anomaly_index_raw", feat_sql(
    "SELECT flow_key, round(flow_anomaly_index_raw, 3) AS flow_anomaly_index FROM feat"))
def f_anomaly_index_raw(spark, sf_dir):
    """Script variant: the three parts summed unscaled."""
    return rounded(feature_table(spark, sf_dir, "raw").select("flow_key", "flow_anomaly_index"), 3)


# ------------------------------------------------------------ flagship ----

FLAGSHIP_SQL = feat_sql("""
SELECT label, count(*) AS n_flows,
  cast(sum(abnormal_flow_duration) AS BIGINT) AS n_abnormal_duration,
  round(sum(total_flag_count), 1) AS total_flags,
  round(avg(bytes_per_packet), 4) AS avg_bytes_per_packet,
  round(max(packet_rate), 2) AS max_packet_rate,
  round(avg(flow_anomaly_index), 6) AS avg_anomaly_index
FROM (SELECT feat.*, CASE replace(replace(trim(raw_label), '�', '-'), '–', '-')
  """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LABEL_GROUPS.items()) + """ END AS label FROM feat) t
GROUP BY label
""")


@register("feature_summary", FLAGSHIP_SQL)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label group: flows, abnormal durations, flags, bytes/packet,
    peak packet rate, mean anomaly index."""
    x = feature_table(spark, sf_dir)
    x = clean.group_labels(clean.clean_label_text(x.withColumnRenamed("raw_label", "label"), "label"), "label")
    return (x.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum("abnormal_flow_duration").cast("long").alias("n_abnormal_duration"),
        F.round(F.sum("total_flag_count"), 1).alias("total_flags"),
        F.round(F.avg("bytes_per_packet"), 4).alias("avg_bytes_per_packet"),
        F.round(F.max("packet_rate"), 2).alias("max_packet_rate"),
        F.round(F.avg("flow_anomaly_index"), 6).alias("avg_anomaly_index")))
