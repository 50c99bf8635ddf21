"""Queries over bytes and models: MQTT payloads, decoded frames, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mqtt
from ..operators import features, ml
from ..schemas import MODEL_FEATURES
from ..sources import frames
from . import views as V
from .packets import E, _r, rounded

#: A valid CONNECT, a valid PUBLISH, one to a wildcard, one that is cut short, no MQTT, and the third and first together.
PAYLOADS = ("100e00044d5154540402003c00026964", "30060003612f6278", "3003000123", "30056162", "0001", "3003000123100e00044d5154540402003c00026964")
_ETHERNET = "020000000002020000000001"
_IPV4 = "450000280000000040{:02x}00000a0000010a000002"
#: TCP, UDP, an unknown protocol, ARP, LLC, LLDP, a TCP header and a frame that are cut short.
FRAMES = (
    _ETHERNET + "0800" + _IPV4.format(6) + "03e800500000000000000000501200000000" + "0000", _ETHERNET + "0800" + _IPV4.format(17) + "03e8003500080000", _ETHERNET + "0800" + _IPV4.format(99),
    _ETHERNET + "0806" + "0001080006040001" + "0200000000010a000001" + "0000000000000a000002", _ETHERNET + "0003424203", _ETHERNET + "88cc", _ETHERNET + "0800" + _IPV4.format(6) + "03e8", "0200",
)
NAMES = ("tcp", "udp", "ip_proto_99", "arp", "llc", "lldp", "ipv4", "ethernet")
KINDS = ("ok", "ok", "unsupported", "ok", "ok", "unsupported", "partial", "malformed")


def _chosen(values: tuple[str, ...], key: str) -> F.Column:
    return F.unhex(F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int")))


def with_payloads(spark, d) -> DataFrame:
    return V.event_packets(spark, d).withColumn("tcp_payload", _chosen(PAYLOADS, "event_id"))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("parse_status", "protocol_name", "src_ip")]))
def decode_frames(frame: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([frames.decode(bytes(f), 0, 0.0, frames.ETHERNET) for f in frame])[["parse_status", "protocol_name", "src_ip"]]


def decoded(spark, d) -> DataFrame:
    own = V.read(spark, d, "events").select("user_id", decode_frames(_chosen(FRAMES, "event_id")).alias("p"))
    return own.groupBy("user_id", "p.parse_status", "p.protocol_name", "p.src_ip").agg(F.count(F.lit(1)).alias("n"))


def model_scores(spark, d) -> DataFrame:
    table = features.base_features(V.event_packets(spark, d), V.SLOW).withColumn("y", F.expr("cast(cast(pcap_id as int) % 2 as int)"))
    table = ml.assembled(table, MODEL_FEATURES)
    return rounded(ml.scored(ml.build("logistic_regression", maxIter=20).fit(table), table).select("pcap_id", "window_index", "y", "score"))


def _case(values: tuple[object, ...], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


_COUNTS = {"control": (1, 1, 1, 1, 0, 2), "valid": (1, 1, 0, 0, 0, 1), "invalid": (0, 0, 1, 0, 0, 1), "incomplete": (0, 0, 0, 1, 0, 0), "publish": (0, 1, 1, 1, 0, 1), "connect": (1, 0, 0, 0, 0, 1), "wildcard": (0, 0, 1, 0, 0, 1), "frames": (1, 1, 1, 1, 0, 1)}
_GATE = "CASE WHEN is_tcp AND coalesce(dst_port = 1883 OR src_port = 1883, false) THEN {} ELSE 0 END"
_SUMS = ", ".join(f"sum({_GATE.format(_case(v, 'event_id'))})::BIGINT AS {n}" for n, v in _COUNTS.items())
_ZERO = ("mqtt_invalid_fixed_header_count", "mqtt_invalid_remaining_length_count", "mqtt_invalid_publish_qos_count", "mqtt_invalid_publish_topic_count", "mqtt_invalid_connect_count")
_MQTT_SQL = (
    f"{E}, {V.windows_sql(V.SLOW)}, m AS (SELECT pcap_id, segment_index, window_index, min(packet_index) AS packet_index_start, max(packet_index) AS packet_index_end, {_SUMS} FROM w GROUP BY pcap_id, segment_index, window_index) "
    "SELECT pcap_id, segment_index, window_index, packet_index_start, packet_index_end, control AS mqtt_control_packet_count, " + _r("control / 25", "mqtt_control_packets_per_frame") + ", frames AS mqtt_frame_count, " + _r("frames / 25", "mqtt_frame_ratio")
    + ", valid AS mqtt_valid_count, invalid AS mqtt_invalid_count, incomplete AS mqtt_incomplete_count, " + _r("coalesce(invalid / nullif(control, 0), 0)", "mqtt_invalid_ratio") + ", " + _r("coalesce(incomplete / nullif(control, 0), 0)", "mqtt_incomplete_ratio")
    + ", publish AS mqtt_publish_count, connect AS mqtt_connect_count, wildcard AS mqtt_publish_wildcard_topic_count, " + ", ".join(f"0::BIGINT AS {n}" for n in _ZERO) + " FROM m"
)
_STATUS = ("VALID", "VALID", "INVALID", "INCOMPLETE", "NOT_MQTT", "INVALID")

QUERIES = {
    "mqtt_parse": (lambda s, d: with_payloads(s, d).select("pcap_id", mqtt.control_packets("tcp_payload").alias("p")).groupBy("pcap_id", mqtt.first_status(F.col("p")).alias("status"), F.size("p").alias("packets")).agg(F.count(F.lit(1)).alias("n")), f"{E} SELECT pcap_id, {_case(_STATUS, 'event_id')} AS status, CASE WHEN event_id % 6 = 5 THEN 2 ELSE 1 END AS packets, count(*) AS n FROM p GROUP BY ALL"),
    "mqtt_window_features": (lambda s, d: rounded(features.mqtt_features(with_payloads(s, d), V.SLOW)), _MQTT_SQL),
    "frame_decode": (decoded, f"SELECT user_id, {_case(KINDS, 'event_id')} AS parse_status, {_case(NAMES, 'event_id')} AS protocol_name, CASE WHEN event_id % 8 IN (0, 1, 2, 3, 6) THEN '10.0.0.1' END AS src_ip, count(*) AS n FROM events GROUP BY ALL"),
    "model_scores": (model_scores, None),
}
