"""Aggregates of one window: 27 base, 11 ARP and 17 MQTT features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ARP_FEATURES, BASE_FEATURES, MQTT_FEATURES
from .windows import FROZEN, WindowPolicy, numbered, window_table, with_windows


def base_aggregates(size: int = 25) -> dict[str, Column]:
    iat = F.when(F.col("offset") > 0, F.greatest("delta", F.lit(0.0)))
    length = F.col("frame_length").cast("double")
    share = lambda c: F.count_if(c) / float(size)
    l3 = S.l3_category()
    n_tcp = F.count_if("is_tcp")
    out = {
        "window_span_seconds": F.max("timestamp") - F.min("timestamp"),
        "iat_mean_seconds": F.coalesce(F.avg(iat), F.lit(0.0)),
        "iat_std_seconds": F.coalesce(F.stddev_pop(iat), F.lit(0.0)),
        "iat_p50_seconds": F.coalesce(F.percentile(iat, 0.5), F.lit(0.0)),
        "iat_p95_seconds": F.coalesce(F.percentile(iat, 0.95), F.lit(0.0)),
        "frame_length_mean": F.avg(length),
        "frame_length_std": F.stddev_pop(length),
        "frame_length_min": F.min(length),
        "frame_length_max": F.max(length),
    }
    out |= {f"{x}_ratio": share(l3 == x) for x in ("ipv4", "ipv6", "arp", "llc")} | {"other_protocol_ratio": share(l3 == "other")}
    out |= {f"{x}_ratio": share(F.col(f"is_{x}")) for x in ("tcp", "udp", "icmp", "icmpv6", "igmp")}
    out |= {f"tcp_{x}_ratio": S.ratio0(F.count_if(F.col("is_tcp") & F.col(f"tcp_flag_{x}")), n_tcp) for x in ("syn", "ack", "fin", "rst", "psh", "urg")}
    out |= {f"unique_{x}_count": F.size(F.array_union(F.collect_set(f"src_{x}"), F.collect_set(f"dst_{x}"))).cast("bigint") for x in ("ip", "port")}
    return {k: out[k] for k in BASE_FEATURES}


def base_features(packets: DataFrame, policy: WindowPolicy = FROZEN, max_windows: int | None = None) -> DataFrame:
    """One row of 27 features for each full window."""
    return window_table(packets, base_aggregates(policy.window_size), policy, max_windows)


def arp_features(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """11 ARP features of each full window, all 0 without ARP. Sender pairs are first grouped by (window, sender), which stays within the capture."""
    own = with_windows(packets, policy)
    key = ["pcap_id", "segment_index", "window_in_segment"]
    ident, arp = S.is_arp_identity(), F.coalesce("is_arp", F.lit(False))
    mac = F.coalesce(F.col("src_mac"), F.lit("")) != ""
    by_sender = own.groupBy(*key, F.when(ident, F.col("src_ip")).alias("spa")).agg(
        F.count(F.lit(1)).alias("n"), F.min("packet_index").alias("first"), F.max("packet_index").alias("last"), F.count_if(arp).alias("arp"),
        F.count_if(arp & (F.col("arp_op") == S.ARP_REQUEST)).alias("request"), F.count_if(arp & (F.col("arp_op") == S.ARP_REPLY)).alias("reply"),
        F.count_if(arp & S.is_arp_probe()).alias("probe"), F.count_if(arp & S.is_gratuitous_arp()).alias("gratuitous"),
        F.count_if(ident).alias("ident"), F.collect_set(F.when(ident, F.col("arp_sha"))).alias("shas"),
        F.count_if(ident & mac).alias("with_mac"), F.count_if(ident & mac & (F.col("src_mac") != F.col("arp_sha"))).alias("mismatch"),
    )
    macs = F.size("shas")
    known = F.col("spa").isNotNull()
    out = by_sender.groupBy(*key).agg(
        F.sum("n").alias("_n"), F.min("first").alias("packet_index_start"), F.max("last").alias("packet_index_end"),
        S.ratio0(F.sum("request"), F.sum("arp")).alias("arp_request_ratio"), S.ratio0(F.sum("reply"), F.sum("arp")).alias("arp_reply_ratio"),
        S.ratio0(F.sum("probe"), F.sum("arp")).alias("arp_probe_ratio"), S.ratio0(F.sum("gratuitous"), F.sum("arp")).alias("arp_gratuitous_ratio"),
        F.count_if(known & (macs > 1)).alias("arp_sender_ip_conflict_count"),
        S.ratio0(F.coalesce(F.sum(F.when(known & (macs > 1), F.col("ident"))), F.lit(0)), F.sum("ident")).alias("arp_sender_ip_conflict_ratio"),
        F.coalesce(F.max(F.when(known, macs)), F.lit(0)).cast("bigint").alias("arp_max_macs_per_sender_ip"),
        F.coalesce(F.sum(F.when(known, macs - 1)), F.lit(0)).cast("bigint").alias("arp_mapping_change_count"),
        S.ratio0(F.sum("mismatch"), F.sum("with_mac")).alias("arp_eth_src_sha_mismatch_ratio"),
        F.count_if(known).alias("arp_unique_sender_ip_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("shas")))).cast("bigint").alias("arp_unique_sender_mac_count"),
    )
    out = numbered(out.where(F.col("_n") == policy.window_size))
    return out.select("pcap_id", "segment_index", "window_index", "packet_index_start", "packet_index_end", *ARP_FEATURES)


def mqtt_features(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """17 MQTT features of each full window. Payloads are parsed before the shuffle, which then carries no payload."""
    from ..functions.mqtt import PARSED, parse_payloads

    gate = F.col("is_tcp") & S.is_mqtt_port() & F.col("tcp_payload").isNotNull()
    parsed = parse_payloads(F.when(gate, F.col("tcp_payload")))
    slim = packets.select("pcap_id", "packet_index", "timestamp", parsed.alias("_r"))
    counted = slim.select("pcap_id", "packet_index", "timestamp", "_r.*")
    total = {name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint") for name in PARSED}
    n = float(policy.window_size)
    counts = {
        "mqtt_control_packet_count": total["control"], "mqtt_control_packets_per_frame": total["control"] / n, "mqtt_frame_count": F.count_if(F.col("control") > 0), "mqtt_frame_ratio": F.count_if(F.col("control") > 0) / n,
        "mqtt_valid_count": total["valid"], "mqtt_invalid_count": total["invalid"], "mqtt_incomplete_count": total["incomplete"],
        "mqtt_invalid_ratio": S.ratio0(total["invalid"], total["control"]), "mqtt_incomplete_ratio": S.ratio0(total["incomplete"], total["control"]),
        "mqtt_invalid_fixed_header_count": total["invalid_fixed_header"], "mqtt_invalid_remaining_length_count": total["invalid_remaining_length"],
        "mqtt_publish_count": total["publish"], "mqtt_invalid_publish_qos_count": total["invalid_publish_qos"], "mqtt_publish_wildcard_topic_count": total["publish_topic_contains_wildcard"],
        "mqtt_invalid_publish_topic_count": total["invalid_publish_topic"], "mqtt_connect_count": total["connect"], "mqtt_invalid_connect_count": total["invalid_connect_structure"],
    }
    return window_table(counted, {k: counts[k] for k in MQTT_FEATURES}, policy)
