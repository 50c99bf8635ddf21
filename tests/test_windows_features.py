import math
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.functions import mqtt
from packetloom.operators import features, quality, stats, windows
from packetloom.schemas import ARP_FEATURES, BASE_FEATURES, MQTT_FEATURES

from .builders import packet, packets, timed


def counts(df):
    row = windows.accounting(df).first()
    return row.segments, row.full_windows, row.dropped_packets


@pytest.mark.parametrize(("delta", "segments"), [(5.0, 1), (5.01, 2), (-1.0, 1), (-1.01, 2), (0.0, 1)])
def test_cuts_are_strict(spark, delta, segments):
    assert windows.segment_table(timed(spark, [100.0, 100.0 + delta])).count() == segments


@pytest.mark.parametrize(("n", "full"), [(0, None), (24, 0), (25, 1), (26, 1), (50, 2), (51, 2)])
def test_windows_have_25_packets(spark, n, full):
    row = windows.accounting(timed(spark, range(n))).first()
    assert (row.full_windows if row else None) == full
    if n:
        assert windows.window_counts(timed(spark, range(n))).first().full_windows == full
        assert features.base_features(timed(spark, range(n))).count() == full


def test_windows_are_numbered_over_full_ones_only(spark):
    times = [float(i) for i in range(10)] + [100.0 + i for i in range(30)] + [200.0 + i for i in range(25)]
    rows = features.base_features(timed(spark, times)).orderBy("window_index").collect()
    assert [(r.segment_index, r.window_index, r.packet_index_start, r.packet_index_end) for r in rows] == [(1, 0, 10, 34), (2, 1, 40, 64)]
    assert counts(timed(spark, times)) == (3, 2, 15)


def test_order_is_packet_index(spark):
    df = timed(spark, [10.0, 10.0, 9.0, 12.0])
    row = stats.integrity(df.orderBy(F.col("timestamp").desc())).first()
    assert (row.capture_order_duration, row.capture_timestamp_span, row.duplicate_timestamp_count, row.negative_delta_count, row.non_monotonic_count) == (2.0, 3.0, 1, 1, 2)


def test_error_ends_a_capture_and_nothing_else_does(spark):
    good = [packet(i, float(i), "good", parse_status=("malformed", "partial", "unsupported", "ok")[i % 4]) for i in range(25)]
    bad = [packet(i, float(i), "bad", parse_status="error" if i == 24 else "ok") for i in range(25)]
    sound, failed = windows.without_failed_captures(packets(spark, good + bad))
    assert [r.pcap_id for r in features.base_features(sound).collect()] == ["good"]
    assert [(r.pcap_id, r.first_error_index) for r in failed.collect()] == [("bad", 24)]
    with pytest.raises(Exception, match="status error"):
        windows.strict(packets(spark, bad)).collect()


def test_base_features_by_hand(spark):
    times = [0.0, 0.5, 0.4, *[0.4 + 0.1 * i for i in range(1, 23)]]
    rows = []
    for i, t in enumerate(times):
        rows.append(packet(i, t, frame_length=60 + i, is_ipv4=i % 2 == 0, is_arp=i % 5 == 0, is_tcp=i % 2 == 0, tcp_flag_syn=i % 4 == 0, src_ip=f"10.0.0.{i % 3}", dst_ip=None if i % 7 == 0 else "10.0.0.1", src_port=i % 4, dst_port=80))
    r = features.base_features(packets(spark, rows)).first()
    iat = [max(b - a, 0) for a, b in zip(times, times[1:])]
    order = sorted(iat)
    at = lambda q: order[math.floor(23 * q)] + (order[math.ceil(23 * q)] - order[math.floor(23 * q)]) * (23 * q - math.floor(23 * q))
    expected = {
        "window_span_seconds": max(times) - min(times), "iat_mean_seconds": statistics.fmean(iat), "iat_std_seconds": statistics.pstdev(iat), "iat_p50_seconds": at(0.5), "iat_p95_seconds": at(0.95),
        "frame_length_mean": 72.0, "frame_length_std": statistics.pstdev(range(25)), "frame_length_min": 60, "frame_length_max": 84,
        "ipv4_ratio": 13 / 25, "arp_ratio": 2 / 25, "other_protocol_ratio": 10 / 25, "tcp_ratio": 13 / 25, "tcp_syn_ratio": 7 / 13, "tcp_urg_ratio": 0.0, "unique_ip_count": 3, "unique_port_count": 5,
    }
    for k, v in expected.items():
        assert r[k] == pytest.approx(v, abs=1e-12), k
    assert [c for c in r.asDict()][5:] == list(BASE_FEATURES)
    assert quality.window_violations(features.base_features(packets(spark, rows))).count() == 0


def test_equal_times_and_no_tcp(spark):
    r = features.base_features(timed(spark, [7.0] * 25)).first()
    assert r.window_span_seconds == r.iat_mean_seconds == r.iat_std_seconds == r.iat_p50_seconds == r.tcp_syn_ratio == 0.0


def test_chunks_cut_like_the_whole(spark):
    times = [float((i * 7919) % 50) + i * 0.2 for i in range(500)]
    df = timed(spark, times)
    policy = windows.WindowPolicy(10, 20.0, 15.0)
    whole = windows.with_segments(df, policy).select("packet_index", "segment_index", "position").orderBy("packet_index").collect()
    for chunk in (7, 100, 1000):
        assert windows.chunked_segments(df, policy, chunk).select("packet_index", "segment_index", "position").orderBy("packet_index").collect() == whole


def test_policy_checks_and_names():
    assert windows.FROZEN.id == "w25_gap5_bw1" and len(windows.candidate_policies()) == 6
    with pytest.raises(ValueError):
        windows.WindowPolicy(0)


def test_one_shuffle(spark):
    plan = features.base_features(timed(spark, range(30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def arp_rows(*rows):
    out = [packet(i, float(i), is_arp=True, arp_op=op, src_ip=spa, dst_ip=tpa, arp_sha=sha, src_mac=mac) for i, (op, spa, tpa, sha, mac) in enumerate(rows)]
    return out + [packet(i, float(i)) for i in range(len(rows), 25)]


def test_arp_features(spark):
    rows = arp_rows((1, "10.0.0.1", "10.0.0.9", "m1", "m1"), (2, "10.0.0.1", "10.0.0.9", "m2", "m1"), (2, "10.0.0.1", "10.0.0.9", "m1", None), (1, "0.0.0.0", "10.0.0.5", "m3", "m3"), (1, "10.0.0.2", "10.0.0.2", "m2", "m2"), (1, "10.0.0.3", None, None, "m2"))
    r = features.arp_features(packets(spark, rows)).first()
    assert tuple(r[f] for f in ARP_FEATURES) == pytest.approx((4 / 6, 2 / 6, 1 / 6, 1 / 6, 1, 3 / 4, 2, 1, 1 / 3, 2, 2))
    none = features.arp_features(timed(spark, range(25))).first()
    assert all(none[f] == 0 for f in ARP_FEATURES)
    c = stats.arp_capture_stats(packets(spark, rows)).first()
    assert (c.valid_identity_obs, c.conflict_ip_count, c.conflict_obs_count, c.novel_mac_claim_count, c.mapping_transition_count, c.first_conflict_event_count) == (4, 1, 3, 1, 2, 1)
    assert [(r.packets_to, r.seconds_to) for r in stats.arp_distances(packets(spark, rows)).collect()] == [(1.0, 1.0)]


def text(x):
    return len(x).to_bytes(2, "big") + x


CONNECT = text(b"MQTT") + b"\4\2\0\x3c" + text(b"id")


def framed(first, body):
    return bytes((first, len(body))) + body


@pytest.mark.parametrize(
    ("payload", "status", "kind", "violations"),
    [
        (framed(0x10, CONNECT), "VALID", 1, set()), (framed(0x30, text(b"a/b") + b"x"), "VALID", 3, set()), (framed(0x32, text(b"a/b") + b"\0\1x"), "VALID", 3, set()),
        (framed(0x36, text(b"a/b") + b"\0\1x"), "INVALID", 3, {"invalid_publish_qos"}), (framed(0x30, text(b"a/#")), "INVALID", 3, {"publish_topic_contains_wildcard"}), (framed(0x30, text(b"a/+")), "INVALID", 3, {"publish_topic_contains_wildcard"}),
        (framed(0x32, text(b"a")), "INVALID", 3, {"invalid_publish_topic"}), (framed(0x30, text(b"")), "INVALID", 3, {"invalid_publish_topic"}), (framed(0x30, b"\0\5ab"), "INVALID", 3, {"invalid_publish_topic"}),
        (framed(0x30, text(b"a\0")), "INVALID", 3, {"invalid_publish_topic"}), (framed(0x11, CONNECT), "INVALID", 1, {"invalid_fixed_header"}), (framed(0x10, text(b"NOPE") + b"\4\2\0\0"), "INVALID", 1, {"invalid_connect_structure"}),
        (framed(0x62, b"\0\1"), "VALID", 6, set()), (framed(0x60, b"\0\1"), "INVALID", 6, {"invalid_fixed_header"}),
        (b"\x30\xff\xff\xff\xff", "INVALID", 3, {"invalid_remaining_length"}), (b"\x30\xff", "INCOMPLETE", 3, set()), (b"\x30\x05ab", "INCOMPLETE", 3, set()), (b"\x00\x01", "NOT_MQTT", None, set()), (b"\xf0\x00", "NOT_MQTT", None, set()), (b"", "NOT_MQTT", None, set()),
    ],
)
def test_mqtt_grammar(payload, status, kind, violations):
    p = mqtt.classify(payload)
    assert (p.status, p.type, p.violations) == (status, kind, violations)


def test_mqtt_lists_and_windows(spark):
    good, bad = framed(0x10, CONNECT), framed(0x30, text(b"#"))
    assert [p.status for p in mqtt.parse_all(bad + good + b"\x30")] == ["INVALID", "VALID", "INCOMPLETE"]
    payloads = [good, bad + good, b"junk", None, b"\x30\x09a"]
    rows = [packet(i, float(i), is_tcp=True, src_port=5, dst_port=1883 if i != 6 else 80, tcp_payload=payloads[i] if i < 5 else good if i == 6 else b"") for i in range(25)]
    r = features.mqtt_features(packets(spark, rows)).first().asDict()
    # b"junk" begins like a SUBSCRIBE-ACK that is cut short.
    junk = mqtt.classify(b"junk").status
    assert junk == "INCOMPLETE"
    expected = dict.fromkeys(MQTT_FEATURES, 0) | {
        "mqtt_control_packet_count": 5, "mqtt_control_packets_per_frame": 0.2, "mqtt_frame_count": 4, "mqtt_frame_ratio": 0.16, "mqtt_valid_count": 2, "mqtt_invalid_count": 1, "mqtt_incomplete_count": 2,
        "mqtt_invalid_ratio": 0.2, "mqtt_incomplete_ratio": 0.4, "mqtt_publish_count": 2, "mqtt_publish_wildcard_topic_count": 1, "mqtt_connect_count": 2,
    }
    assert {k: r[k] for k in MQTT_FEATURES} == pytest.approx(expected)
    listed = packets(spark, rows[:2]).select(mqtt.control_packets("tcp_payload").alias("p")).select(mqtt.first_status(F.col("p")).alias("s"), F.size("p").alias("n")).collect()
    assert [(x.s, x.n) for x in listed] == [("VALID", 1), ("INVALID", 2)]


def test_capped_distinct(spark):
    df = packets(spark, [packet(i, float(i), src_ip=f"10.0.0.{i % 3}") for i in range(9)])
    r = stats.characterization(df, ip_cap=2).first()
    assert (r.unique_src_ips, r.unique_src_ips_capped, r.unique_dst_ips, r.tcp_syn_ratio) == (2, True, 0, None)


def test_file_observations(spark):
    rows = [packet(i, 1.0, parse_status="malformed" if i < 9 else "ok") for i in range(10)]
    found = {(r.issue_code, r.severity) for r in quality.file_observations(stats.integrity(packets(spark, rows))).collect()}
    assert found == {("file:malformed_catastrophic", "hard_failure"), ("file:timestamp_duplicate", "warning"), ("file:zero_timestamp_span", "warning")}
