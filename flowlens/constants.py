"""Values that must equal the behaviour being reproduced.

Everything below the FIXED VALUES marker is data, not logic: label groups,
the flow-meter column alias map, coercion name patterns, fusion/severity
thresholds and the severity rule table.  Code elsewhere turns these into
small broadcast tables or ``when`` chains.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; keep in natural order)
# ---------------------------------------------------------------------------

# Raw label -> label group.  Unknown labels map to NULL.
LABEL_GROUPS = {
    "Benign": "Benign",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DDoS": "DoS",
    "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce",
    "Web Attack - Brute Force": "BruteForce",
    "Web Attack - XSS": "Web",
    "Web Attack - Sql Injection": "Web",
    "PortScan": "Scan",
    "Bot": "Malware",
    "Infiltration": "Rare",
    "Heartbleed": "Rare",
}

# Characters that stand for a dash in raw label text.
LABEL_DASH_CHARS = ["�", "–"]

# Label group that the supervised model leaves out.
RARE_GROUP = "Rare"
BENIGN = "Benign"

# Flow-meter CSV header (84 columns, in file order).
RAW_FLOW_COLUMNS = [
    "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp",
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
    "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt", "Down/Up Ratio", "Pkt Size Avg",
    "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Fwd Byts/b Avg", "Fwd Pkts/b Avg",
    "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
    "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts",
    "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]

# Normalised short flow-meter names -> long feature names.  Only names that
# actually change are listed; identical pairs need no rename.
COLUMN_ALIASES = {
    "tot_fwd_pkts": "total_fwd_packets",
    "tot_bwd_pkts": "total_backward_packets",
    "totlen_fwd_pkts": "fwd_packets_length_total",
    "totlen_bwd_pkts": "bwd_packets_length_total",
    "fwd_pkt_len_max": "fwd_packet_length_max",
    "fwd_pkt_len_min": "fwd_packet_length_min",
    "fwd_pkt_len_mean": "fwd_packet_length_mean",
    "fwd_pkt_len_std": "fwd_packet_length_std",
    "bwd_pkt_len_max": "bwd_packet_length_max",
    "bwd_pkt_len_min": "bwd_packet_length_min",
    "bwd_pkt_len_mean": "bwd_packet_length_mean",
    "bwd_pkt_len_std": "bwd_packet_length_std",
    "flow_byts/s": "flow_bytes/s",
    "flow_pkts/s": "flow_packets/s",
    "fwd_iat_tot": "fwd_iat_total",
    "bwd_iat_tot": "bwd_iat_total",
    "fwd_header_len": "fwd_header_length",
    "bwd_header_len": "bwd_header_length",
    "fwd_pkts/s": "fwd_packets/s",
    "bwd_pkts/s": "bwd_packets/s",
    "pkt_len_min": "packet_length_min",
    "pkt_len_max": "packet_length_max",
    "pkt_len_mean": "packet_length_mean",
    "pkt_len_std": "packet_length_std",
    "pkt_len_var": "packet_length_variance",
    "fin_flag_cnt": "fin_flag_count",
    "syn_flag_cnt": "syn_flag_count",
    "rst_flag_cnt": "rst_flag_count",
    "psh_flag_cnt": "psh_flag_count",
    "ack_flag_cnt": "ack_flag_count",
    "urg_flag_cnt": "urg_flag_count",
    "ece_flag_cnt": "ece_flag_count",
    "pkt_size_avg": "avg_packet_size",
    "fwd_seg_size_avg": "avg_fwd_segment_size",
    "bwd_seg_size_avg": "avg_bwd_segment_size",
    "fwd_byts/b_avg": "fwd_avg_bytes/bulk",
    "fwd_pkts/b_avg": "fwd_avg_packets/bulk",
    "fwd_blk_rate_avg": "fwd_avg_bulk_rate",
    "bwd_byts/b_avg": "bwd_avg_bytes/bulk",
    "bwd_pkts/b_avg": "bwd_avg_packets/bulk",
    "bwd_blk_rate_avg": "bwd_avg_bulk_rate",
    "subflow_fwd_pkts": "subflow_fwd_packets",
    "subflow_fwd_byts": "subflow_fwd_bytes",
    "subflow_bwd_pkts": "subflow_bwd_packets",
    "subflow_bwd_byts": "subflow_bwd_bytes",
    "init_fwd_win_byts": "init_fwd_win_bytes",
    "init_bwd_win_byts": "init_bwd_win_bytes",
    "fwd_act_data_pkts": "fwd_act_data_packets",
}

# Name fragments that mark a column as numeric.
NUMERIC_PATTERNS_TRAIN = ["count", "packet", "bytes", "length", "duration",
                          "rate", "mean", "std", "max", "min"]
NUMERIC_PATTERNS_SCORE = ["count", "packet", "packets", "bytes", "length", "duration",
                          "rate", "mean", "std", "max", "min", "iat", "segment"]

# The eight TCP flag counters.
FLAG_COLUMNS = ["fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
                "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count"]

# Feature-engineering constants.
EPS = 1e-3
SMALL = 1e-5
TINY = 1e-9
ZSCORE_LIMIT = 3.0

# Protocol number -> name for decoding one-hot columns, checked in this order.
PROTOCOL_NAMES = [("6", "TCP"), ("17", "UDP"), ("0", "HOPOPT")]
UNKNOWN_PROTOCOL = "UNKNOWN"

# Features left out of the real-time feature set, and features always kept.
NON_REALTIME_FEATURES = [
    "active_mean", "active_std", "active_min", "active_max", "idle_mean", "idle_min", "idle_max",
    "idle_std", "fwd_avg_packets/bulk", "fwd_avg_bytes/bulk", "fwd_avg_bulk_rate",
    "bwd_avg_bytes/bulk", "bwd_avg_packets/bulk", "bwd_avg_bulk_rate", "flow_anomaly_index",
]
MANDATORY_FEATURES = ["proto_0", "proto_6"]

# Score combination weights (supervised, unsupervised).
W_SUPERVISED = 0.3
W_UNSUPERVISED = 0.7

# Fusion and severity thresholds.
AE_THRESHOLD_RULE = 1e7
CONF_THRESHOLD_RULE = 0.00001
WEIGHT_AE = 0.0
WEIGHT_XGB = 1.0
FUSION_THRESHOLD = 0.0000001
AE_THRESHOLD_HIGH = 5e7
CONF_THRESHOLD_HIGH = 0.8
MINMAX_GUARD = 1e-9
CONSTANT_CONFIDENCE = 0.5

# Reason texts of the fusion decision.
REASON_RULE = "Rule-based fusion triggered"
REASON_WEIGHTED = "Weighted fusion triggered"
REASON_NONE = "No attack conditions met"

# Severity inference when no severity is given:
# (attack_type, confidence must be strictly above, severity above, severity otherwise).
SEVERITY_RULES = [
    ("DDoS", 0.8, "HIGH", "MEDIUM"),
    ("DoS", 0.8, "HIGH", "MEDIUM"),
    ("PortScan", 0.7, "MEDIUM", "LOW"),
    ("Scan", 0.7, "MEDIUM", "LOW"),
    ("Malware", 0.9, "CRITICAL", "HIGH"),
    ("BruteForce", 0.8, "HIGH", "MEDIUM"),
    ("SQLInjection", 0.85, "CRITICAL", "HIGH"),
    ("Web", None, "MEDIUM", "MEDIUM"),
    ("Benign", None, "LOW", "LOW"),
]
SEVERITY_DEFAULT = "MEDIUM"

# Attack types that have a canned explanation text.
EXPLAINED_TYPES = ["DDoS", "DoS", "PortScan", "Scan", "Malware", "BruteForce",
                   "SQLInjection", "Web"]

# Drift monitor.
DRIFT_WINDOW = 1000
DRIFT_MIN_VALUES = 100
DRIFT_NORMAL_PCT = 5.0
DRIFT_GRADUAL_PCT = 15.0

# Query limits.
QUERY_LIMIT_DEFAULT = 100
QUERY_LIMIT_MAX = 1000
HIGH_CONFIDENCE_DEFAULT = 0.8
LIVE_TRAFFIC_DEFAULT = 50
STATS_WINDOW = 1000
RECENT_N = 10

# Model-selection and training defaults.
CORR_LIMIT = 0.95
TOP_K = 30
BENIGN_SAMPLE = 250000
TEST_SHARE = 0.2
SEED = 42
FP_PASS_LIMIT_PCT = 5.0
FPR_BUDGET = 0.02
PRECISION_FLOOR = 0.90
