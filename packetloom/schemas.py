"""Schemas, feature orders and fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType())}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in columns.split(","))])


#: Parse statuses; the last two are failures. Fixed values.
STATUSES = ("ok", "partial", "unsupported", "malformed", "error")
FAILURES = ("malformed", "error")

PACKET = struct(
    "pcap_id string, packet_index bigint, timestamp double, frame_length bigint, linktype int, parse_status string, parse_detail string, "
    "ethernet_type_or_length int, is_ethernet_ii boolean, ethertype int, vlan_ids array<int>, is_llc boolean, is_arp boolean, is_ipv4 boolean, is_ipv6 boolean, "
    "is_tcp boolean, is_udp boolean, is_icmp boolean, is_icmpv6 boolean, is_igmp boolean, ip_version int, ip_protocol int, src_ip string, dst_ip string, "
    "src_port int, dst_port int, tcp_flags int, tcp_flag_syn boolean, tcp_flag_ack boolean, tcp_flag_fin boolean, tcp_flag_rst boolean, tcp_flag_psh boolean, "
    "tcp_flag_urg boolean, tcp_payload binary, protocol_name string, src_mac string, dst_mac string, arp_op int, arp_sha string, arp_tha string, "
    "llc_dsap int, llc_ssap int, llc_ctrl int, ipv6_first_next_header int"
)
#: What a scan without decoding yields.
TIMESTAMPS = struct("pcap_id string, packet_index bigint, timestamp double, frame_length bigint, linktype int")

# Feature orders are part of the storage contract. Fixed values.
BASE_FEATURES = (
    "window_span_seconds", "iat_mean_seconds", "iat_std_seconds", "iat_p50_seconds", "iat_p95_seconds",
    "frame_length_mean", "frame_length_std", "frame_length_min", "frame_length_max",
    "ipv4_ratio", "ipv6_ratio", "arp_ratio", "llc_ratio", "other_protocol_ratio",
    "tcp_ratio", "udp_ratio", "icmp_ratio", "icmpv6_ratio", "igmp_ratio",
    "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio", "tcp_rst_ratio", "tcp_psh_ratio", "tcp_urg_ratio",
    "unique_ip_count", "unique_port_count",
)
TIME_FEATURES = BASE_FEATURES[:5]
#: What models read: everything but the five time features.
MODEL_FEATURES = BASE_FEATURES[5:]
ARP_FEATURES = (
    "arp_request_ratio", "arp_reply_ratio", "arp_probe_ratio", "arp_gratuitous_ratio", "arp_sender_ip_conflict_count", "arp_sender_ip_conflict_ratio",
    "arp_max_macs_per_sender_ip", "arp_mapping_change_count", "arp_eth_src_sha_mismatch_ratio", "arp_unique_sender_ip_count", "arp_unique_sender_mac_count",
)
MQTT_FEATURES = (
    "mqtt_control_packet_count", "mqtt_control_packets_per_frame", "mqtt_frame_count", "mqtt_frame_ratio", "mqtt_valid_count", "mqtt_invalid_count",
    "mqtt_incomplete_count", "mqtt_invalid_ratio", "mqtt_incomplete_ratio", "mqtt_invalid_fixed_header_count", "mqtt_invalid_remaining_length_count",
    "mqtt_publish_count", "mqtt_invalid_publish_qos_count", "mqtt_publish_wildcard_topic_count", "mqtt_invalid_publish_topic_count", "mqtt_connect_count",
    "mqtt_invalid_connect_count",
)

WINDOW_KEYS = ("pcap_id", "binary_label", "segment_index", "window_index", "packet_index_start", "packet_index_end")
FEATURE_TABLE = T.StructType(
    [T.StructField(n, T.StringType() if n in ("pcap_id", "binary_label") else T.LongType(), False) for n in WINDOW_KEYS]
    + [T.StructField(n, T.LongType() if n.endswith("_count") else T.DoubleType(), False) for n in BASE_FEATURES]
)
INVENTORY = struct("pcap_path string, filename string, dataset_scope string, source string, split string, binary_label string, attack_family string, attack_type string, profiling_type string, profiling_variant string, device string, capture_session string, file_size bigint, grouping_key string, unresolved_reason string")
SPLIT = struct("pcap_path string, source string, grouping_key string, split string, split_origin string, strategy_version string, seed int")
#: Columns that must never reach a model. Fixed values.
METADATA = frozenset("pcap_id pcap_path binary_label attack_family attack_type profiling_type device segment_index window_index packet_index_start packet_index_end split modeling_split modeling_group_key source filename".split())


def assert_model_input(columns: list[str], wanted: tuple[str, ...] = MODEL_FEATURES) -> None:
    """Exact feature order, and no metadata among the columns."""
    leaked = METADATA & set(columns)
    if leaked:
        raise ValueError(f"metadata among the features: {sorted(leaked)}")
    if tuple(columns) != tuple(wanted):
        raise ValueError("features are not in their order")
