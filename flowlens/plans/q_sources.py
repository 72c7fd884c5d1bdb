"""Registered queries: sources and sinks.

Each sink query writes a table derived from the driver tables into the
shared scratch folder (under ``spark.checkpoint.dir``) and reads it back, so
the round trip itself is what gets checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..session import scratch_path
from ..sources import adapters
from ..sources import io
from .q_fusion import dec_sql, decisions
from .q_models import emb
from .registry import register, rounded
from .sql_common import any_sql, flows_sql


@register("src_parquet_glob", any_sql("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1, 2"""))
def src_parquet_glob(spark, sf_dir):
    """Every parquet file matching a glob, schemas merged by name."""
    li = io.read_parquet_glob(spark, f"{sf_dir.rstrip('/')}/lineitem*.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"),
                                                          F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@register("src_csv_glob", flows_sql(f"""
SELECT label, count(*) AS n, round(sum(flow_duration), 2) AS total_duration,
  round(sum("flow_packets/s"), 2) AS total_packet_rate FROM lf GROUP BY label"""))
def src_csv_glob(spark, sf_dir):
    """Flow-meter CSVs (written from the flow table in several files) read
    back as text, normalised, renamed, coerced and labelled."""
    path = scratch_path(spark, "flowcsv")
    raw = adapters.raw_flows(spark, sf_dir)
    raw.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)
    df = io.read_flow_csvs(spark, path, raw.columns, "part-*.csv.gz")
    df = clean.rename_aliases(clean.normalize_columns(df))
    df = clean.enforce_numeric(df, skip=("label",))
    df = clean.group_labels(clean.clean_label_text(df, "label"), "label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("flow_duration"), 2).alias("total_duration"),
                                   F.round(F.sum(F.col("`flow_packets/s`")), 2).alias("total_packet_rate"))


@register("union_by_name", flows_sql("""
SELECT protocol, count(*) AS n, count(*) - count(fwd_iat_std) AS missing_fwd_iat_std FROM (
  SELECT protocol, fwd_iat_std FROM flows WHERE protocol = 6
  UNION ALL SELECT protocol, NULL FROM flows WHERE protocol <> 6) u GROUP BY protocol"""))
def union_by_name(spark, sf_dir):
    """TCP flows and the other flows (which lack one column) stacked by name."""
    f = adapters.flows(spark, sf_dir)
    a = f.filter(F.col("protocol") == 6)
    b = f.filter(F.col("protocol") != 6).drop("fwd_iat_std")
    u = io.union_by_name([a.select("protocol", "fwd_iat_std"), b.select("protocol")])
    return u.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col("fwd_iat_std").isNull()).alias("missing_fwd_iat_std"))


@register("src_results_safe", any_sql("""
SELECT protocol, count(*) AS n, sum(total_packets)::BIGINT AS packets FROM results GROUP BY protocol""", "results"))
def src_results_safe(spark, sf_dir):
    """Result table written, then read with the safe reader (absent path ->
    empty table of the same schema; checked in the tests)."""
    r = adapters.results(spark, sf_dir)
    path = scratch_path(spark, "results")
    io.write_results(r, path)
    back = io.read_results_safe(spark, path, r.schema)
    return back.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("total_packets").alias("packets"))


@register("sink_results", dec_sql("SELECT severity, attack, count(*) AS n FROM dec GROUP BY 1, 2"))
def sink_results(spark, sf_dir):
    """Decision table written as parquet and read back."""
    d = decisions(spark, sf_dir).drop("decided_at")
    path = scratch_path(spark, "decisions")
    io.write_results(d, path)
    back = spark.read.parquet(path)
    return back.groupBy("severity", "attack").agg(F.count(F.lit(1)).alias("n"))


SPLIT_SQL = """SELECT split, label, count(*) AS n FROM (
  SELECT label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY ((vec_id % 1000003) * 7919 + 42) % 1000003,
    vec_id) <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM embeddings) s GROUP BY 1, 2"""


@register("sink_split_tables", any_sql(SPLIT_SQL))
def sink_split_tables(spark, sf_dir):
    """Train/test rows written partitioned by split; counts of the written table."""
    s = clean.stratified_split(emb(spark, sf_dir), key="vec_id", col="label")
    path = scratch_path(spark, "split")
    io.write_split_tables(s, path)
    return spark.read.parquet(path).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("src_split_tables", any_sql(SPLIT_SQL.replace("GROUP BY 1, 2", "WHERE split = 'test' GROUP BY 1, 2")))
def src_split_tables(spark, sf_dir):
    """Reading the split table back: the test half only (partition pruning)."""
    s = clean.stratified_split(emb(spark, sf_dir), key="vec_id", col="label")
    path = scratch_path(spark, "split")
    io.write_split_tables(s, path)
    t = io.read_split_tables(spark, path).filter(F.col("split") == "test")
    return t.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("sink_log_append", any_sql(
    "SELECT cast(ts AS DATE) AS date, count(*) AS n, count(explanation) AS explained FROM attack_log GROUP BY 1",
    "attack_log"))
def sink_log_append(spark, sf_dir):
    """Attack log appended in two batches to a day-partitioned table."""
    a = adapters.attack_log(spark, sf_dir)
    path = scratch_path(spark, "attack_log")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    io.append_log(a.filter(F.col("ts") < cut), path)
    io.append_log(a.filter(F.col("ts") >= cut), path)
    back = spark.read.parquet(path)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("explanation").alias("explained"))


ATTACK_JSON_SCHEMA = ("id long, ts timestamp_ntz, attack_type string, src_ip string, dest_ip string, "
                      "protocol string, confidence double, severity string, explanation string, fusion_score double")


@register("src_json_log_tail", any_sql(
    "SELECT id, ts, attack_type, severity, round(confidence, 9) AS confidence FROM attack_log "
    "ORDER BY ts DESC, id DESC LIMIT 100", "attack_log"))
def src_json_log_tail(spark, sf_dir):
    """Newest 100 entries of the JSON-lines attack log."""
    a = adapters.attack_log(spark, sf_dir)
    path = scratch_path(spark, "attack_json")
    io.write_json_log(a, path, "overwrite")
    t = io.read_json_log_tail(spark, path, 100, ATTACK_JSON_SCHEMA)
    return rounded(t.select("id", "ts", "attack_type", "severity", "confidence"), 9)
