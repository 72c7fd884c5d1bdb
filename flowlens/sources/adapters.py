"""Derive the engine's input shapes from the driver tables.

``flows`` (lineitem joined to orders) stands for a flow-meter table,
``predictions`` for a scored hold-out, ``attack_log`` / ``alert_log`` for
the two log tables, ``packets`` for packet headers and ``errors`` for a
reconstruction-error stream.  Every adapter is lazy and reads only the
columns it needs (column pruning reaches the parquet scan).

Each adapter has a twin SQL text (``*_SQL``) so DuckDB can check answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- flows ----

def _label_case(l, o) -> F.Column:
    pr, st = o["o_orderpriority"], o["o_orderstatus"]
    return (F.when((l.l_linenumber == 7) & (l.l_quantity == 50), "Unlisted")
            .when((pr == "1-URGENT") & (st == "F"), "DoS Hulk")
            .when((pr == "1-URGENT") & (st == "O"), "DDoS")
            .when(pr == "1-URGENT", "DoS slowloris")
            .when((pr == "2-HIGH") & (st == "F"), "FTP-Patator")
            .when((pr == "2-HIGH") & (st == "O"), "SSH-Patator")
            .when(pr == "2-HIGH", " Web Attack – Brute Force")
            .when((pr == "3-MEDIUM") & (st == "F"), "PortScan")
            .when((pr == "4-NOT SPECIFIED") & (st == "F"), "Bot")
            .when((pr == "4-NOT SPECIFIED") & (st == "O"), "Web Attack – XSS")
            .when(pr == "4-NOT SPECIFIED", "Heartbleed")
            .otherwise("Benign"))


def flow_key_expr(l) -> F.Column:
    """The four keys side by side: orders below 2**24, parts below 2**21 and
    suppliers below 2**15 (scale factor 3) fit 63 bits.  Where a larger order
    does not, the key is 63 bits of their hash."""
    keys = [l[k] for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    order, part, supplier, line = keys
    packed = F.try_add(F.try_multiply(order, F.lit(2097152)), part)
    packed = F.try_add(F.try_multiply(packed, F.lit(32768)), supplier)
    packed = F.try_add(F.try_multiply(packed, F.lit(8)), line)
    hashed = F.shiftrightunsigned(F.xxhash64(*[k.cast("long") for k in keys]), 1)
    known = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return F.coalesce(packed, F.when(known, hashed))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-meter style table, one row per lineitem (FIXTURES B1)."""
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    q, ln, ep, d, t = l.l_quantity, l.l_linenumber, l.l_extendedprice, l.l_discount, l.l_tax
    return j.select(
        flow_key_expr(l).alias("flow_key"),
        F.concat(F.lit("c"), o.o_custkey.cast("string")).alias("src_ip"),
        F.concat(F.lit("s"), l.l_suppkey.cast("string")).alias("dst_ip"),
        l.l_shipdate.alias("flow_ts"),
        F.when(ln % 3 == 0, 0).when(ln % 3 == 1, 6).otherwise(17).alias("protocol"),
        F.when((ln == 7) & (d == 0), F.lit(0.0)).otherwise(q * ln * 1000).alias("flow_duration"),
        q.alias("total_fwd_packets"),
        ln.cast("double").alias("total_backward_packets"),
        ep.alias("fwd_packets_length_total"),
        (ep * d).alias("bwd_packets_length_total"),
        (ep / q).alias("fwd_packet_length_mean"),
        (ep / q * (1 - d)).alias("fwd_packet_length_min"),
        (ep / q * t).alias("fwd_packet_length_std"),
        (ep * d / ln).alias("bwd_packet_length_mean"),
        F.lit(0.0).alias("bwd_packet_length_min"),
        (ep * d * t / ln).alias("bwd_packet_length_std"),
        F.when(q == 13, F.lit(None).cast("double")).otherwise(q * 10).alias("fwd_iat_mean"),
        (q * t * 10).alias("fwd_iat_std"),
        (ln * 10).cast("double").alias("bwd_iat_mean"),
        (ln * d * 10).alias("bwd_iat_std"),
        (q + ln).alias("flow_packets/s"),
        q.alias("fwd_packets/s"),
        (t * 1000).alias("active_mean"),
        (d * 100).alias("active_std"),
        (d * 1000).alias("idle_mean"),
        (t * 100).alias("idle_std"),
        (ep / q).alias("avg_fwd_segment_size"),
        (ep * d / ln).alias("avg_bwd_segment_size"),
        F.when(l.l_linestatus == "F", 1).otherwise(0).alias("fin_flag_count"),
        F.when(l.l_returnflag == "R", 1).otherwise(0).alias("syn_flag_count"),
        F.when(l.l_returnflag == "A", 1).otherwise(0).alias("rst_flag_count"),
        (ln % 2).alias("psh_flag_count"),
        (ln % 4).alias("ack_flag_count"),
        F.when(q == 50, F.lit(None).cast("int")).otherwise(0).alias("urg_flag_count"),
        F.lit(0).alias("cwe_flag_count"),
        F.lit(0).alias("ece_flag_count"),
        _label_case(l, o).alias("raw_label"),
    )


FLOW_KEY_SQL = "((l_orderkey * 2097152 + l_partkey) * 32768 + l_suppkey) * 8 + l_linenumber"

FLOWS_SQL = f"""
SELECT {FLOW_KEY_SQL} AS flow_key,
  concat('c', cast(o_custkey AS VARCHAR)) AS src_ip,
  concat('s', cast(l_suppkey AS VARCHAR)) AS dst_ip,
  l_shipdate AS flow_ts,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 6 ELSE 17 END AS protocol,
  CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN 0.0 ELSE l_quantity * l_linenumber * 1000 END AS flow_duration,
  l_quantity AS total_fwd_packets,
  cast(l_linenumber AS DOUBLE) AS total_backward_packets,
  l_extendedprice AS fwd_packets_length_total,
  l_extendedprice * l_discount AS bwd_packets_length_total,
  l_extendedprice / l_quantity AS fwd_packet_length_mean,
  l_extendedprice / l_quantity * (1 - l_discount) AS fwd_packet_length_min,
  l_extendedprice / l_quantity * l_tax AS fwd_packet_length_std,
  l_extendedprice * l_discount / l_linenumber AS bwd_packet_length_mean,
  cast(0 AS DOUBLE) AS bwd_packet_length_min,
  l_extendedprice * l_discount * l_tax / l_linenumber AS bwd_packet_length_std,
  CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity * 10 END AS fwd_iat_mean,
  l_quantity * l_tax * 10 AS fwd_iat_std,
  cast(l_linenumber * 10 AS DOUBLE) AS bwd_iat_mean,
  l_linenumber * l_discount * 10 AS bwd_iat_std,
  l_quantity + l_linenumber AS "flow_packets/s",
  l_quantity AS "fwd_packets/s",
  l_tax * 1000 AS active_mean,
  l_discount * 100 AS active_std,
  l_discount * 1000 AS idle_mean,
  l_tax * 100 AS idle_std,
  l_extendedprice / l_quantity AS avg_fwd_segment_size,
  l_extendedprice * l_discount / l_linenumber AS avg_bwd_segment_size,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS fin_flag_count,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS syn_flag_count,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS rst_flag_count,
  l_linenumber % 2 AS psh_flag_count,
  l_linenumber % 4 AS ack_flag_count,
  CASE WHEN l_quantity = 50 THEN NULL ELSE 0 END AS urg_flag_count,
  0 AS cwe_flag_count,
  0 AS ece_flag_count,
  CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN 'Unlisted'
       WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'DoS Hulk'
       WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'DDoS'
       WHEN o_orderpriority = '1-URGENT' THEN 'DoS slowloris'
       WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'FTP-Patator'
       WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'SSH-Patator'
       WHEN o_orderpriority = '2-HIGH' THEN ' Web Attack – Brute Force'
       WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'PortScan'
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'Bot'
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'Web Attack – XSS'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Heartbleed'
       ELSE 'Benign' END AS raw_label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


# Adapter column -> flow-meter CSV header, to rebuild a raw-looking table.
RAW_HEADERS = {
    "flow_key": "Flow ID", "src_ip": "Src IP", "dst_ip": "Dst IP", "protocol": "Protocol",
    "flow_ts": "Timestamp", "flow_duration": "Flow Duration", "total_fwd_packets": "Tot Fwd Pkts",
    "total_backward_packets": "Tot Bwd Pkts", "fwd_packets_length_total": "TotLen Fwd Pkts",
    "bwd_packets_length_total": "TotLen Bwd Pkts", "fwd_packet_length_mean": "Fwd Pkt Len Mean",
    "fwd_packet_length_min": "Fwd Pkt Len Min", "fwd_packet_length_std": "Fwd Pkt Len Std",
    "bwd_packet_length_mean": "Bwd Pkt Len Mean", "bwd_packet_length_min": "Bwd Pkt Len Min",
    "bwd_packet_length_std": "Bwd Pkt Len Std", "fwd_iat_mean": "Fwd IAT Mean", "fwd_iat_std": "Fwd IAT Std",
    "bwd_iat_mean": "Bwd IAT Mean", "bwd_iat_std": "Bwd IAT Std", "flow_packets/s": "Flow Pkts/s",
    "fwd_packets/s": "Fwd Pkts/s", "active_mean": "Active Mean", "active_std": "Active Std",
    "idle_mean": "Idle Mean", "idle_std": "Idle Std", "avg_fwd_segment_size": "Fwd Seg Size Avg",
    "avg_bwd_segment_size": "Bwd Seg Size Avg", "fin_flag_count": "FIN Flag Cnt",
    "syn_flag_count": "SYN Flag Cnt", "rst_flag_count": "RST Flag Cnt", "psh_flag_count": "PSH Flag Cnt",
    "ack_flag_count": "ACK Flag Cnt", "urg_flag_count": "URG Flag Cnt", "cwe_flag_count": "CWE Flag Count",
    "ece_flag_count": "ECE Flag Cnt", "raw_label": "Label",
}


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table under flow-meter CSV headers."""
    f = flows(spark, sf_dir)
    return f.select([F.col(f"`{n}`").alias(RAW_HEADERS.get(n, n)) for n in f.columns])


# ---------------------------------------------------------- predictions ----

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hold-out: actual / predicted class code, two scores (FIXTURES B2)."""
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    actual = (F.when(o.o_orderpriority == "5-LOW", 0).when(o.o_orderpriority == "2-HIGH", 1)
              .when(o.o_orderpriority == "1-URGENT", 2).when(o.o_orderpriority == "4-NOT SPECIFIED", 3)
              .otherwise(4))
    shift = F.when(l.l_partkey % 10 < 8, F.lit(0).cast("long")).otherwise(l.l_partkey % 5)
    return j.select(
        flow_key_expr(l).alias("flow_key"),
        actual.alias("actual_code"),
        ((actual + shift) % 5).alias("predicted_code"),
        (((l.l_partkey * 7919 + l.l_suppkey * 31 + l.l_linenumber) % 1009).cast("double") / 1009.0)
        .alias("attack_score_supervised"),
        (l.l_extendedprice * l.l_quantity * 20).alias("ae_score"),
    )


PREDICTIONS_SQL = f"""
SELECT flow_key, actual_code, cast((actual_code + shift) % 5 AS BIGINT) AS predicted_code,
       attack_score_supervised, ae_score
FROM (
  SELECT {FLOW_KEY_SQL} AS flow_key,
    CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2
         WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS actual_code,
    CASE WHEN l_partkey % 10 < 8 THEN 0 ELSE l_partkey % 5 END AS shift,
    cast((l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % 1009 AS DOUBLE) / 1009.0 AS attack_score_supervised,
    l_extendedprice * l_quantity * 20 AS ae_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p
"""


# -------------------------------------------------------------- results ----

def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table of a scoring run (A3): scores + flow metadata, one join.

    Scores come from ``predictions``; metadata from the same lineitem row."""
    from ..operators.fusion import model_label
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    actual = (F.when(o.o_orderpriority == "5-LOW", 0).when(o.o_orderpriority == "2-HIGH", 1)
              .when(o.o_orderpriority == "1-URGENT", 2).when(o.o_orderpriority == "4-NOT SPECIFIED", 3)
              .otherwise(4))
    shift = F.when(l.l_partkey % 10 < 8, F.lit(0).cast("long")).otherwise(l.l_partkey % 5)
    pred = ((actual + shift) % 5).cast("int")
    s = ((l.l_partkey * 7919 + l.l_suppkey * 31 + l.l_linenumber) % 1009).cast("double") / 1009.0
    u = l.l_extendedprice * l.l_quantity * 20
    ln = l.l_linenumber
    proto = F.when(ln % 3 == 0, "HOPOPT").when(ln % 3 == 1, "TCP").otherwise("UDP")
    return j.select(
        flow_key_expr(l).alias("flow_key"),
        l.l_shipdate.alias("timestamp"),
        F.concat(F.lit("c"), o.o_custkey.cast("string")).alias("src_ip"),
        F.concat(F.lit("s"), l.l_suppkey.cast("string")).alias("dst_ip"),
        proto.alias("protocol"),
        F.bround(l.l_quantity + ln + K.EPS, 0).cast("long").alias("total_packets"),
        F.bround(l.l_extendedprice + l.l_extendedprice * l.l_discount + K.EPS, 0).cast("long").alias("total_bytes"),
        s.alias("attack_score_supervised"),
        u.alias("attack_score_unsupervised"),
        (F.lit(K.W_SUPERVISED) * s + F.lit(K.W_UNSUPERVISED) * u).alias("combined_score"),
        pred.alias("predicted_label_encoded"),
        F.when(pred != 0, F.concat(F.lit("predicted "), model_label(pred))).alias("explanation"),
    )


def model_label_sql(x: str) -> str:
    from ..operators.fusion import MODEL_CLASSES
    return "CASE " + x + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MODEL_CLASSES)) + " END"


RESULTS_SQL = f"""
SELECT flow_key, timestamp, src_ip, dst_ip, protocol, total_packets, total_bytes,
  attack_score_supervised, attack_score_unsupervised,
  0.3::DOUBLE * attack_score_supervised + 0.7::DOUBLE * attack_score_unsupervised AS combined_score,
  predicted_label_encoded,
  CASE WHEN predicted_label_encoded <> 0 THEN concat('predicted ', {model_label_sql('predicted_label_encoded')})
  END AS explanation
FROM (
  SELECT {FLOW_KEY_SQL} AS flow_key, l_shipdate AS timestamp,
    concat('c', cast(o_custkey AS VARCHAR)) AS src_ip, concat('s', cast(l_suppkey AS VARCHAR)) AS dst_ip,
    CASE l_linenumber % 3 WHEN 0 THEN 'HOPOPT' WHEN 1 THEN 'TCP' ELSE 'UDP' END AS protocol,
    cast(round_even(l_quantity + l_linenumber + 0.001, 0) AS BIGINT) AS total_packets,
    cast(round_even(l_extendedprice + l_extendedprice * l_discount + 0.001, 0) AS BIGINT) AS total_bytes,
    cast((l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % 1009 AS DOUBLE) / 1009.0 AS attack_score_supervised,
    l_extendedprice * l_quantity * 20 AS attack_score_unsupervised,
    cast(((CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2
         WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END) + (CASE WHEN l_partkey % 10 < 8 THEN 0 ELSE l_partkey % 5 END)) % 5
      AS INTEGER) AS predicted_label_encoded
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r
"""


# ------------------------------------------------------------ log tables ----

def _severity_infer(attack_type: F.Column, confidence: F.Column) -> F.Column:
    from ..functions.rules import severity_infer
    return severity_infer(attack_type, confidence)


def _attack_type(e) -> F.Column:
    return (F.when(e.event_type == "error", "DoS").when(e.event_type == "click", "Scan")
            .when(e.event_type == "view", "Web").when(e.event_type == "signup", "BruteForce")
            .otherwise("Malware"))


def attack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack log rows derived from events (FIXTURES B3)."""
    e = table(spark, sf_dir, "events")
    at = _attack_type(e)
    conf = F.least(e.value / 250, F.lit(1.0))
    return e.select(
        e.event_id.alias("id"),
        e.ts.alias("ts"),
        at.alias("attack_type"),
        F.concat(F.lit("u"), e.user_id.cast("string")).alias("src_ip"),
        F.concat(F.lit("h"), (e.user_id % 20).cast("string")).alias("dest_ip"),
        F.when(e.event_id % 3 == 0, "TCP").when(e.event_id % 3 == 1, "UDP").otherwise("UNKNOWN").alias("protocol"),
        conf.alias("confidence"),
        _severity_infer(at, conf).alias("severity"),
        F.when(e.event_id % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("event "), e.event_type)).alias("explanation"),
        (e.value / 500).alias("fusion_score"),
    )


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert outcome rows derived from events (FIXTURES B3)."""
    a = attack_log(spark, sf_dir)
    m = a.id % 10
    return a.select(
        "id", "ts", "attack_type", "severity",
        F.when(m < 8, "SENT").when(m == 8, "LOGGED").otherwise("FAILED").alias("status"),
        F.when(m == 8, "STDOUT").otherwise("EMAIL").alias("method"),
        "src_ip", "dest_ip",
        F.lit("ops@example.test,sec@example.test").alias("recipients"),
        F.when(m == 9, F.lit("delivery failed")).otherwise(F.lit(None).cast("string")).alias("error"),
    )


ATTACK_TYPE_SQL = ("CASE event_type WHEN 'error' THEN 'DoS' WHEN 'click' THEN 'Scan' WHEN 'view' THEN 'Web' "
                   "WHEN 'signup' THEN 'BruteForce' ELSE 'Malware' END")


def severity_infer_sql(t: str, conf: str) -> str:
    parts = []
    for name, thr, above, below in K.SEVERITY_RULES:
        if thr is None:
            parts.append(f"WHEN {t} = '{name}' THEN '{above}'")
        else:
            parts.append(f"WHEN {t} = '{name}' THEN CASE WHEN {conf} > {thr} THEN '{above}' ELSE '{below}' END")
    return "CASE " + " ".join(parts) + f" ELSE '{K.SEVERITY_DEFAULT}' END"


ATTACK_LOG_SQL = f"""
SELECT id, ts, attack_type, src_ip, dest_ip, protocol, confidence,
       {severity_infer_sql('attack_type', 'confidence')} AS severity, explanation, fusion_score
FROM (
  SELECT event_id AS id, ts, {ATTACK_TYPE_SQL} AS attack_type,
    concat('u', cast(user_id AS VARCHAR)) AS src_ip,
    concat('h', cast(user_id % 20 AS VARCHAR)) AS dest_ip,
    CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'UNKNOWN' END AS protocol,
    least(value / 250, 1.0) AS confidence,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('event ', event_type) END AS explanation,
    value / 500 AS fusion_score
  FROM events) e
"""

ALERT_LOG_SQL = """
SELECT id, ts, attack_type, severity,
  CASE WHEN id % 10 < 8 THEN 'SENT' WHEN id % 10 = 8 THEN 'LOGGED' ELSE 'FAILED' END AS status,
  CASE WHEN id % 10 = 8 THEN 'STDOUT' ELSE 'EMAIL' END AS method,
  src_ip, dest_ip, 'ops@example.test,sec@example.test' AS recipients,
  CASE WHEN id % 10 = 9 THEN 'delivery failed' ELSE NULL END AS error
FROM attack_log
"""


# -------------------------------------------------------------- packets ----

def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet headers derived from events (FIXTURES B4): each user talks to one
    server port, in both directions."""
    e = table(spark, sf_dir, "events")
    u = e.user_id
    sent = e.event_type.isin("click", "view", "signup")
    user_ip = F.concat_ws(".", F.lit("10"), F.expr("user_id div 65536 % 256"), F.expr("user_id div 256 % 256"), u % 256)
    user_port = (u % 20000 + 40000).cast("int")
    server_ip = F.concat(F.when(u % 2 == 0, "192.168.0.").otherwise("1.2.3."), (u % 7 + 1).cast("string"))
    server_port = F.when(u % 3 == 0, 443).otherwise(80).cast("int")
    return e.select(
        e.event_id.alias("packet_id"),
        u.alias("src"),
        e.ts.alias("ts"),
        sent.alias("is_forward"),
        e.value.alias("length"),
        (e.event_type == "purchase").alias("fin"),
        F.when(sent, user_ip).otherwise(server_ip).alias("src_ip"),
        F.when(sent, user_port).otherwise(server_port).alias("src_port"),
        F.when(sent, server_ip).otherwise(user_ip).alias("dst_ip"),
        F.when(sent, server_port).otherwise(user_port).alias("dst_port"),
        F.when(u % 5 == 4, 17).otherwise(6).cast("int").alias("protocol"),
    )


PACKETS_SQL = """
SELECT packet_id, src, ts, is_forward, length, fin, protocol,
       CASE WHEN is_forward THEN user_ip ELSE server_ip END AS src_ip, CASE WHEN is_forward THEN user_port ELSE server_port END AS src_port,
       CASE WHEN is_forward THEN server_ip ELSE user_ip END AS dst_ip, CASE WHEN is_forward THEN server_port ELSE user_port END AS dst_port
FROM (SELECT event_id AS packet_id, user_id AS src, ts, event_type IN ('click', 'view', 'signup') AS is_forward,
       value AS length, event_type = 'purchase' AS fin, CASE WHEN user_id % 5 = 4 THEN 17 ELSE 6 END AS protocol,
       concat('10.', user_id // 65536 % 256, '.', user_id // 256 % 256, '.', user_id % 256) AS user_ip,
       user_id % 20000 + 40000 AS user_port,
       concat(CASE WHEN user_id % 2 = 0 THEN '192.168.0.' ELSE '1.2.3.' END, user_id % 7 + 1) AS server_ip,
       CASE WHEN user_id % 3 = 0 THEN 443 ELSE 80 END AS server_port FROM events)
"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction-error stream from events (FIXTURES B5)."""
    e = table(spark, sf_dir, "events")
    return e.select(e.event_id, e.ts, (e.user_id % 4).alias("sensor"), e.value.alias("error"))


ERRORS_SQL = "SELECT event_id, ts, user_id % 4 AS sensor, value AS error FROM events"


def with_sql(body: str, *names: str) -> str:
    """Prefix a query with the CTEs of the named adapters."""
    defs = {"flows": FLOWS_SQL, "predictions": PREDICTIONS_SQL, "results": RESULTS_SQL, "attack_log": ATTACK_LOG_SQL,
            "alert_log": ALERT_LOG_SQL, "packets": PACKETS_SQL, "errors": ERRORS_SQL}
    need = list(names)
    if "alert_log" in need and "attack_log" not in need:
        need.insert(need.index("alert_log"), "attack_log")
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in need)
    return f"WITH {ctes}\n{body}"
