"""Column contracts shared by every job."""

from pyspark.sql import types as T

# The eleven features in contract order, and the corpus column each comes from.
CORPUS_COLUMNS = {
    "flow_duration": "flow_duration",
    "protocol": "protocol",
    "dst_port": "destination_port",
    "total_fwd_packets": "forward_packet_count",
    "total_bwd_packets": "backward_packet_count",
    "total_fwd_bytes": "forward_bytes",
    "total_bwd_bytes": "backward_bytes",
    "packets_per_second": "packets_per_second",
    "syn_count": "syn_count",
    "ack_count": "ack_count",
    "rst_count": "rst_count",
}
FEATURES = list(CORPUS_COLUMNS)

# The two classes, in the (alphabetical) order of the probability vector.
ANOMALY = "ANOMALY"
BENIGN = "BENIGN"
CLASSES = [ANOMALY, BENIGN]

FRAMES = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("iface", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("frame", T.BinaryType()),
])

PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("size", T.LongType()),
])

FLOW_FIELDS = [
    ("protocol", "int"), ("src_ip", "string"), ("dst_ip", "string"),
    ("src_port", "int"), ("dst_port", "int"), ("start_us", "bigint"), ("last_us", "bigint"),
    ("fwd_packets", "bigint"), ("bwd_packets", "bigint"),
    ("fwd_bytes", "bigint"), ("bwd_bytes", "bigint"),
    ("syn_count", "bigint"), ("ack_count", "bigint"), ("fin_count", "bigint"), ("rst_count", "bigint"),
]

FEATURE_ROW = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])

CORPUS = T.StructType(
    [T.StructField(name, T.StringType()) for name in CORPUS_COLUMNS.values()]
    + [T.StructField("Label", T.StringType())])

# One wide, nullable record for every kind of event-log line.
FLOW_RECORD = ("struct<protocol:int,src_ip:string,dst_ip:string,src_port:int,dst_port:int,"
               "start_ts:double,last_ts:double,duration:double,fwd_packets:bigint,bwd_packets:bigint,"
               "fwd_bytes:bigint,bwd_bytes:bigint,syn_count:bigint,ack_count:bigint,"
               "fin_count:bigint,rst_count:bigint,honeypot:string>")
FEATURE_RECORD = "struct<" + ",".join(f"{name}:double" for name in FEATURES) + ">"
EVENT = (f"layer string, type string, ts double, flow {FLOW_RECORD}, features {FEATURE_RECORD}, "
         "label string, confidence double, novelty boolean, anomaly_score double, action string, "
         "attacker_ip string, reason string, source string, explanation string, ip string, port int, "
         "flow_id bigint")
