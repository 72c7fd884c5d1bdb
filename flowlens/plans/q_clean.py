"""Registered queries: cleaning, projection, labels, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c
from ..operators import clean
from ..operators.features import prepare_flows, row_features
from ..sources import adapters
from .q_features import labelled_flows
from .registry import register, rounded
from .sql_common import clean_label_sql, feat_sql, flows_sql

HASH_SQL = "((flow_key % 1000003) * 7919 + 42) % 1000003"


# ------------------------------------------------------------- names ----

@register("normalize_columns", flows_sql("""
SELECT flow_key AS flow_id, flow_duration, total_fwd_packets AS tot_fwd_pkts, "flow_packets/s" AS "flow_pkts/s",
       fin_flag_count AS fin_flag_cnt, cwe_flag_count, raw_label AS label FROM flows"""))
def normalize_columns(spark, sf_dir):
    """Flow-meter headers -> lower case with underscores."""
    n = clean.normalize_columns(adapters.raw_flows(spark, sf_dir))
    return n.select("flow_id", "flow_duration", "tot_fwd_pkts", c("flow_pkts/s"), "fin_flag_cnt",
                    "cwe_flag_count", "label")


@register("rename_aliases", flows_sql("""
SELECT flow_key AS flow_id, total_fwd_packets, total_backward_packets, fwd_packets_length_total,
       "flow_packets/s", "fwd_packets/s", fin_flag_count, avg_fwd_segment_size, raw_label AS label FROM flows"""))
def rename_aliases(spark, sf_dir):
    """Normalised short names -> long feature names (present columns only)."""
    n = clean.rename_aliases(clean.normalize_columns(adapters.raw_flows(spark, sf_dir)))
    return n.select("flow_id", "total_fwd_packets", "total_backward_packets", "fwd_packets_length_total",
                    c("flow_packets/s"), c("fwd_packets/s"), "fin_flag_count", "avg_fwd_segment_size", "label")


# ------------------------------------------------------------ labels ----

@register("clean_label_text", flows_sql(f"SELECT flow_key, {clean_label_sql('raw_label')} AS label FROM flows"))
def clean_label_text(spark, sf_dir):
    f = adapters.flows(spark, sf_dir).select("flow_key", F.col("raw_label").alias("label"))
    return clean.clean_label_text(f, "label")


@register("group_labels", flows_sql("SELECT flow_key, label FROM lf"))
def group_labels(spark, sf_dir):
    return labelled_flows(spark, sf_dir).select("flow_key", "label")


@register("unmapped_labels", flows_sql(
    f"SELECT DISTINCT {clean_label_sql('raw_label')} AS label FROM lf WHERE label IS NULL"))
def unmapped_labels(spark, sf_dir):
    f = adapters.flows(spark, sf_dir).select(F.col("raw_label").alias("label"))
    return clean.unmapped_labels(clean.clean_label_text(f, "label"))


# ------------------------------------------------------------ numeric ----

def _text_measures(spark, sf_dir) -> DataFrame:
    """Measures as text with junk: 'n/a' for missing, 'Infinity' for 1-packet flows."""
    f = adapters.flows(spark, sf_dir)
    txt = (F.when(F.col("fwd_iat_mean").isNull(), F.lit("n/a"))
           .when(F.col("total_fwd_packets") == 1, F.lit("Infinity"))
           .otherwise(F.col("fwd_iat_mean").cast("string")))
    return f.select("flow_key", F.col("raw_label").alias("label"), "src_ip", txt.alias("fwd_iat_mean"),
                    F.col("flow_duration").cast("string").alias("flow_duration"))


TEXT_SQL = """text_m AS (SELECT flow_key, raw_label AS label, src_ip,
  CASE WHEN fwd_iat_mean IS NULL THEN 'n/a' WHEN total_fwd_packets = 1 THEN 'Infinity'
       ELSE cast(fwd_iat_mean AS VARCHAR) END AS fwd_iat_mean,
  cast(flow_duration AS VARCHAR) AS flow_duration FROM flows)"""


def _num_sql(x: str) -> str:
    return (f"CASE WHEN isinf(try_cast({x} AS DOUBLE)) OR isnan(try_cast({x} AS DOUBLE)) THEN NULL "
            f"ELSE try_cast({x} AS DOUBLE) END")


@register("enforce_numeric", flows_sql(
    f"SELECT flow_key, label, src_ip, {_num_sql('fwd_iat_mean')} AS fwd_iat_mean, "
    f"{_num_sql('flow_duration')} AS flow_duration FROM text_m", TEXT_SQL))
def enforce_numeric(spark, sf_dir):
    """Columns named like measures -> double; bad text / infinity -> NULL."""
    return clean.enforce_numeric(_text_measures(spark, sf_dir), K.NUMERIC_PATTERNS_TRAIN)


@register("coerce_all_numeric", flows_sql(
    f"SELECT cast(flow_key AS DOUBLE) AS flow_key, label, {_num_sql('src_ip')} AS src_ip, "
    f"{_num_sql('fwd_iat_mean')} AS fwd_iat_mean, {_num_sql('flow_duration')} AS flow_duration FROM text_m",
    TEXT_SQL))
def coerce_all_numeric(spark, sf_dir):
    """Every column except the label -> double."""
    return clean.coerce_all_numeric(_text_measures(spark, sf_dir), exclude=("label",))


@register("inf_to_null", flows_sql("""
SELECT flow_key, CASE WHEN isinf(x) OR isnan(x) THEN NULL ELSE x END AS x FROM (
  SELECT flow_key, CASE WHEN total_fwd_packets = 13 THEN 'inf'::DOUBLE WHEN total_fwd_packets = 14 THEN '-inf'::DOUBLE
    WHEN total_fwd_packets = 15 THEN 'nan'::DOUBLE ELSE fwd_packet_length_mean END AS x FROM flows) t"""))
def inf_to_null(spark, sf_dir):
    f = adapters.flows(spark, sf_dir)
    q = F.col("total_fwd_packets")
    x = (F.when(q == 13, F.lit(float("inf"))).when(q == 14, F.lit(float("-inf")))
         .when(q == 15, F.lit(float("nan"))).otherwise(F.col("fwd_packet_length_mean")))
    return clean.inf_to_null(f.select("flow_key", x.alias("x")))


# ----------------------------------------------------------- protocol ----

@register("one_hot_protocol", flows_sql("SELECT flow_key, proto_0, proto_6, proto_17 FROM prep"))
def one_hot_protocol(spark, sf_dir):
    """Protocol values are fitted (distinct) from the data, then one-hot."""
    f = adapters.flows(spark, sf_dir).select("flow_key", "protocol")
    return clean.one_hot_protocol(f)


@register("decode_protocol", flows_sql("""
SELECT flow_key, CASE WHEN proto_6 = 1 THEN 'TCP' WHEN proto_17 = 1 THEN 'UDP' WHEN proto_0 = 1 THEN 'HOPOPT'
  ELSE 'UNKNOWN' END AS protocol_name FROM prep"""))
def decode_protocol(spark, sf_dir):
    f = clean.one_hot_protocol(adapters.flows(spark, sf_dir).select("flow_key", "protocol"), ["0", "6", "17"])
    return clean.decode_protocol(f).select("flow_key", "protocol_name")


# ------------------------------------------------------ audits, dedup ----

_AUDIT_COLS = ["flow_duration", "fwd_iat_mean", "urg_flag_count", "fin_flag_count", "raw_label", "flow_ts"]


@register("null_audit", flows_sql(
    " UNION ALL ".join(f"SELECT '{n}' AS column_name, count(*) - count({n}) AS null_count FROM prep"
                       for n in _AUDIT_COLS)
    + " UNION ALL SELECT '__total__', cast((" + " + ".join(f"count(*) - count({n})" for n in _AUDIT_COLS)
    + ") AS BIGINT) FROM prep"))
def null_audit(spark, sf_dir):
    return clean.null_audit(prepare_flows(adapters.flows(spark, sf_dir)), _AUDIT_COLS)


@register("drop_null_rows", flows_sql(
    "SELECT flow_key, raw_label FROM prep WHERE fwd_iat_mean IS NOT NULL AND urg_flag_count IS NOT NULL"))
def drop_null_rows(spark, sf_dir):
    p = prepare_flows(adapters.flows(spark, sf_dir))
    return clean.drop_null_rows(p, True).select("flow_key", "raw_label")


def _stacked(spark, sf_dir) -> DataFrame:
    """Flows stacked with their TCP slice: every TCP flow appears twice."""
    f = adapters.flows(spark, sf_dir)
    return f.unionByName(f.filter(F.col("protocol") == 6))


STACK_SQL = "stacked AS (SELECT * FROM flows UNION ALL SELECT * FROM flows WHERE protocol = 6)"


@register("duplicate_count", flows_sql(
    "SELECT (SELECT count(*) FROM stacked) - (SELECT count(*) FROM (SELECT DISTINCT * FROM stacked) d) "
    "AS duplicate_rows", STACK_SQL))
def duplicate_count(spark, sf_dir):
    return clean.duplicate_count(_stacked(spark, sf_dir))


@register("drop_duplicates", flows_sql("SELECT flow_key, raw_label FROM (SELECT DISTINCT * FROM stacked) d",
                                       STACK_SQL))
def drop_duplicates(spark, sf_dir):
    return clean.drop_duplicates(_stacked(spark, sf_dir)).select("flow_key", "raw_label")


# ------------------------------------------------------------ encoding ----

CODES_SQL = """codes AS (SELECT label, cast(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT label FROM lf WHERE label IS NOT NULL) d),
model_codes AS (SELECT label, code, cast(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS model_code
  FROM codes WHERE label <> 'Rare')"""


@register("encode_labels", flows_sql(
    "SELECT flow_key, lf.label, code AS label_encoded FROM lf LEFT JOIN codes ON lf.label = codes.label",
    CODES_SQL))
def encode_labels(spark, sf_dir):
    lf = labelled_flows(spark, sf_dir).select("flow_key", "label")
    return clean.encode_labels(lf, clean.fit_label_codes(lf))


@register("filter_rare_reencode", flows_sql(
    "SELECT flow_key, lf.label, model_code FROM lf JOIN model_codes m ON lf.label = m.label", CODES_SQL))
def filter_rare_reencode(spark, sf_dir):
    lf = labelled_flows(spark, sf_dir).select("flow_key", "label")
    rows, _ = clean.filter_rare_reencode(lf, clean.fit_label_codes(lf))
    return rows


@register("decode_predictions", flows_sql("""
SELECT p.flow_key, p.predicted_code, m.code AS original_code, m.label AS predicted_label
FROM predictions p LEFT JOIN model_codes m ON p.predicted_code = m.model_code""",
    "predictions AS (" + adapters.PREDICTIONS_SQL + "),\n" + CODES_SQL))
def decode_predictions(spark, sf_dir):
    """Model code -> original code -> text, with code tables fitted on the flows."""
    lf = labelled_flows(spark, sf_dir).select("flow_key", "label")
    _, model_codes = clean.filter_rare_reencode(lf, clean.fit_label_codes(lf))
    p = adapters.predictions(spark, sf_dir).select("flow_key", "predicted_code")
    return clean.decode_predictions(p, model_codes)


# ------------------------------------------------------------ sampling ----

SAMPLE_N = K.BENIGN_SAMPLE


@register("downsample_benign", flows_sql(
    f"SELECT flow_key, label FROM lf WHERE label = 'Benign' ORDER BY {HASH_SQL}, flow_key LIMIT {SAMPLE_N}"))
def downsample_benign(spark, sf_dir):
    """Exactly SAMPLE_N benign flows by seeded hash (a sampling operator)."""
    return clean.downsample_benign(labelled_flows(spark, sf_dir).select("flow_key", "label"), SAMPLE_N)


@register("balanced_union", flows_sql(f"""
SELECT label, count(*) AS n FROM (
  (SELECT flow_key, label FROM lf WHERE label = 'Benign' ORDER BY {HASH_SQL}, flow_key LIMIT {SAMPLE_N})
  UNION ALL SELECT flow_key, label FROM lf WHERE label <> 'Benign' OR label IS NULL) u GROUP BY label"""))
def balanced_union(spark, sf_dir):
    b = clean.balanced_union(labelled_flows(spark, sf_dir).select("flow_key", "label"), SAMPLE_N)
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("class_distribution", flows_sql(
    "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM lf GROUP BY label"))
def class_distribution(spark, sf_dir):
    return rounded(clean.class_distribution(labelled_flows(spark, sf_dir)), 6)


@register("preview")
def preview(spark, sf_dir):
    """First rows of the attack flows (a peek; row-count check only)."""
    return clean.preview(labelled_flows(spark, sf_dir), 5, attacks_only=True)


@register("stratified_split", flows_sql(f"""
SELECT flow_key, label, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT flow_key, label, row_number() OVER (PARTITION BY label ORDER BY {HASH_SQL}, flow_key) AS r,
         count(*) OVER (PARTITION BY label) AS n FROM lf) t"""))
def stratified_split(spark, sf_dir):
    return clean.stratified_split(labelled_flows(spark, sf_dir).select("flow_key", "label"))


# ------------------------------------------------------- align, impute ----

ALIGN = ["flow_duration", "packet_rate", "not_a_column", "proto_6"]


@register("align_features", feat_sql(
    "SELECT flow_key, flow_duration, round(packet_rate, 3) AS packet_rate, 0.0::DOUBLE AS not_a_column, "
    "cast(proto_6 AS DOUBLE) AS proto_6 FROM feat"))
def align_features(spark, sf_dir):
    """Stored feature order; a feature the batch lacks becomes 0.0."""
    f = row_features(prepare_flows(adapters.flows(spark, sf_dir)))
    return rounded(clean.align_features(f, ALIGN, keep=["flow_key"]), 3, only=["packet_rate"])


IMPUTE = ["fwd_iat_mean", "urg_flag_count", "flow_duration"]
RAWM_SQL = ("rawm AS (SELECT flow_key, fwd_iat_mean, cast(urg_flag_count AS DOUBLE) AS urg_flag_count, flow_duration, "
            "cast(cwe_flag_count AS DOUBLE) AS cwe_flag_count FROM flows)")


@register("impute_median", flows_sql(
    "SELECT flow_key, " + ", ".join(f"round(coalesce({x}, (SELECT median({x}) FROM prep)), 6) AS {x}"
                                    for x in IMPUTE).replace("FROM prep", "FROM rawm") + " FROM rawm", RAWM_SQL))
def impute_median(spark, sf_dir):
    p = prepare_flows(adapters.flows(spark, sf_dir)).select("flow_key", *IMPUTE)
    return rounded(clean.impute_median(p, clean.fit_medians(p, IMPUTE), IMPUTE), 6)


SCALE = ["flow_duration", "fwd_iat_mean", "cwe_flag_count"]


@register("standard_scale", flows_sql(
    "SELECT flow_key, " + ", ".join(
        f"round(({x} - (SELECT avg({x}) FROM prep)) / (SELECT CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({x}) "
        f"IS NULL THEN 1 ELSE stddev_pop({x}) END FROM rawm), 6) AS {x}" for x in SCALE).replace("FROM prep", "FROM rawm")
    + " FROM rawm", RAWM_SQL))
def standard_scale(spark, sf_dir):
    p = prepare_flows(adapters.flows(spark, sf_dir)).select("flow_key", *SCALE)
    return rounded(clean.standard_scale(p, clean.fit_scaler(p, SCALE), SCALE), 6)


@register("counts_to_int", feat_sql(
    "SELECT flow_key, cast(round_even(coalesce(total_packets, 0), 0) AS BIGINT) AS total_packets, "
    "cast(round_even(coalesce(total_bytes, 0), 0) AS BIGINT) AS total_bytes FROM feat"))
def counts_to_int(spark, sf_dir):
    f = row_features(prepare_flows(adapters.flows(spark, sf_dir))).select("flow_key", "total_packets", "total_bytes")
    return clean.counts_to_int(f, ["total_packets", "total_bytes"])


# --------------------------------------------------------------- time ----

@register("parse_flow_time", flows_sql("""
SELECT flow_key, txt, coalesce(try_strptime(txt, '%d/%m/%Y %I:%M:%S %p'), try_strptime(txt, '%d/%m/%Y %H:%M:%S'))
  AS flow_time FROM (
  SELECT flow_key, CASE protocol WHEN 6 THEN strftime(flow_ts + INTERVAL 13 HOUR, '%d/%m/%Y %I:%M:%S %p')
    WHEN 17 THEN strftime(flow_ts + INTERVAL 13 HOUR, '%d/%m/%Y %H:%M:%S') ELSE 'n/a' END AS txt FROM flows) t"""))
def parse_flow_time(spark, sf_dir):
    """Flow-meter text, 12 h and 24 h forms plus junk -> timestamp."""
    f = adapters.flows(spark, sf_dir)
    t = F.col("flow_ts") + F.expr("INTERVAL 13 HOURS")
    txt = (F.when(F.col("protocol") == 6, F.date_format(t, "dd/MM/yyyy hh:mm:ss a"))
           .when(F.col("protocol") == 17, F.date_format(t, "dd/MM/yyyy HH:mm:ss")).otherwise(F.lit("n/a")))
    x = f.select("flow_key", txt.alias("txt"))
    return x.select("flow_key", "txt", clean.parse_flow_time(F.col("txt")).cast("timestamp_ntz").alias("flow_time"))


@register("parse_detect_time", flows_sql("""
SELECT flow_key, txt, cast(coalesce(to_timestamp(try_cast(txt AS DOUBLE)), try_cast(txt AS TIMESTAMP)) AS TIMESTAMP)
  AS detected_time FROM (
  SELECT flow_key, CASE WHEN protocol = 6 THEN cast(cast(epoch(flow_ts) AS BIGINT) AS VARCHAR)
    ELSE strftime(flow_ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM flows) t"""))
def parse_detect_time(spark, sf_dir):
    """Epoch seconds or ISO text -> timestamp (the 'now' fallback is not fed)."""
    f = adapters.flows(spark, sf_dir)
    txt = (F.when(F.col("protocol") == 6, F.unix_seconds(F.col("flow_ts").cast("timestamp")).cast("string"))
           .otherwise(F.date_format(F.col("flow_ts"), "yyyy-MM-dd HH:mm:ss")))
    x = f.select("flow_key", txt.alias("txt"))
    return x.select("flow_key", "txt", clean.parse_detect_time(F.col("txt")).cast("timestamp_ntz")
                    .alias("detected_time"))
