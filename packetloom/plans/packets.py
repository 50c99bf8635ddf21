"""Queries over packets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, stats, windows
from ..schemas import ARP_FEATURES, BASE_FEATURES
from . import views as V

E = "WITH " + V.EVENTS_SQL
L = "WITH " + V.LINEITEM_SQL


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: two engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 6) AS {name}"


_AGG = {
    "window_span_seconds": "max(timestamp) - min(timestamp)",
    "iat_mean_seconds": "coalesce(avg(CASE WHEN off > 0 THEN greatest(delta, 0) END), 0)",
    "iat_std_seconds": "coalesce(stddev_pop(CASE WHEN off > 0 THEN greatest(delta, 0) END), 0)",
    "iat_p50_seconds": "coalesce(quantile_cont(CASE WHEN off > 0 THEN greatest(delta, 0) END, 0.5), 0)",
    "iat_p95_seconds": "coalesce(quantile_cont(CASE WHEN off > 0 THEN greatest(delta, 0) END, 0.95), 0)",
    "frame_length_mean": "avg(frame_length)", "frame_length_std": "stddev_pop(frame_length)", "frame_length_min": "min(frame_length)", "frame_length_max": "max(frame_length)",
    "ipv4_ratio": "count_if(is_ipv4) / 25", "ipv6_ratio": "count_if(is_ipv6 AND NOT is_ipv4) / 25", "arp_ratio": "count_if(is_arp AND NOT is_ipv4 AND NOT is_ipv6) / 25", "llc_ratio": "count_if(is_llc AND NOT is_ipv4 AND NOT is_ipv6 AND NOT is_arp) / 25",
    "other_protocol_ratio": "count_if(NOT is_ipv4 AND NOT is_ipv6 AND NOT is_arp AND NOT is_llc) / 25",
    **{f"{x}_ratio": f"count_if(is_{x}) / 25" for x in ("tcp", "udp", "icmp", "icmpv6", "igmp")},
    **{f"tcp_{x}_ratio": f"coalesce(count_if(is_tcp AND tcp_flag_{x}) / nullif(count_if(is_tcp), 0), 0)" for x in ("syn", "ack", "fin", "rst", "psh", "urg")},
}
_DISTINCT = {f"unique_{x}_count": f"len(list_distinct(list_concat(coalesce(list(src_{x}) FILTER (WHERE src_{x} IS NOT NULL), []), coalesce(list(dst_{x}) FILTER (WHERE dst_{x} IS NOT NULL), []))))::BIGINT" for x in ("ip", "port")}
_FEATURES = ", ".join(_r(x, n) for n, x in _AGG.items()) + ", " + ", ".join(f"{x} AS {n}" for n, x in _DISTINCT.items())
_KEYS = "pcap_id, segment_index, window_index, min(packet_index) AS packet_index_start, max(packet_index) AS packet_index_end"
FEATURES_SQL = f"{E}, {V.windows_sql(V.SLOW)} SELECT {_KEYS}, {_FEATURES} FROM w GROUP BY pcap_id, segment_index, window_index"
_INTEGRITY = (
    "count(*) AS packet_count, " + ", ".join(f"count_if(parse_status = '{s}') AS {s}_count" for s in ("ok", "partial", "unsupported", "malformed", "error")) + ", "
    + ", ".join(f"count_if(is_{x}) AS {x}_count" for x in stats.PROTOCOLS)
    + ", min(frame_length) AS min_frame_length, max(frame_length) AS max_frame_length, sum(frame_length)::BIGINT AS total_bytes, " + _r("avg(frame_length)", "mean_frame_length") + ", " + _r("arg_min(timestamp, packet_index)", "first_timestamp") + ", " + _r("arg_max(timestamp, packet_index)", "last_timestamp") + ", " + _r("min(timestamp)", "min_timestamp") + ", " + _r("max(timestamp)", "max_timestamp")
    + ", " + _r("arg_max(timestamp, packet_index) - arg_min(timestamp, packet_index)", "capture_order_duration") + ", " + _r("max(timestamp) - min(timestamp)", "capture_timestamp_span")
    + ", count_if(delta = 0) AS duplicate_timestamp_count, count_if(delta < 0) AS negative_delta_count, count_if(delta <= 0) AS non_monotonic_count, " + _r("count_if(parse_status = 'malformed') / count(*)", "malformed_rate") + ", 1 AS linktype"
)
_ISSUE = """CASE WHEN parse_status = 'unsupported' THEN CASE WHEN protocol_name = 'lldp' OR contains(parse_detail, '0x88cc') THEN 'unsupported:lldp' ELSE 'unsupported:' || protocol_name END
 WHEN parse_status = 'partial' THEN CASE WHEN contains(parse_detail, 'tcp') THEN 'partial:tcp_truncated' WHEN contains(parse_detail, 'arp') THEN 'partial:arp' ELSE 'partial:other' END
 WHEN parse_status = 'malformed' THEN CASE WHEN contains(parse_detail, 'ethernet') THEN 'malformed:ethernet' WHEN contains(parse_detail, 'ipv4') THEN 'malformed:ipv4' ELSE 'malformed:other' END END"""
_CHAR = (
    "count(*) AS packet_count, " + _r("CASE WHEN max(timestamp) > min(timestamp) THEN count(*) / (max(timestamp) - min(timestamp)) END", "packets_per_second") + ", " + _r("CASE WHEN max(timestamp) > min(timestamp) THEN sum(frame_length) / (max(timestamp) - min(timestamp)) END", "bytes_per_second") + ", "
    + ", ".join(_r(f"count_if(is_{x}) / count(*)", f"{x}_ratio") for x in stats.PROTOCOLS) + ", "
    + ", ".join(f"count_if(tcp_flag_{f}) AS tcp_{f}_count, " + _r(f"count_if(is_tcp AND tcp_flag_{f}) / nullif(count_if(is_tcp), 0)", f"tcp_{f}_ratio") for f in ("syn", "ack", "fin", "rst", "psh", "urg")) + ", "
    + ", ".join(f"least(count(DISTINCT {c}), {cap}) AS unique_{c}s, count(DISTINCT {c}) > {cap} AS unique_{c}s_capped" for c, cap in (("src_ip", 20), ("dst_ip", 20), ("src_port", 10), ("dst_port", 10)))
)
_PROBE = (
    "count(*) AS packet_count, count_if(delta > 0) AS positive_count, count_if(delta = 0) AS duplicate_count, count_if(delta < 0) AS negative_count, " + _r("count_if(delta < 0) / nullif(count(delta), 0)", "negative_ratio") + ", " + _r("count_if(delta = 0) / nullif(count(delta), 0)", "duplicate_ratio") + ", "
    + ", ".join(_r(f"{f}(CASE WHEN delta < 0 THEN -delta END)", f"reversal_{n}") for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + ", " + ", ".join(_r(f"quantile_cont(CASE WHEN delta < 0 THEN -delta END, {q})", f"reversal_p{n}") for q, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
)
_RUNS = f"{V.DELTA_SQL}, i AS (SELECT *, rn - row_number() OVER (PARTITION BY pcap_id ORDER BY packet_index) AS island FROM d WHERE delta < 0), r AS (SELECT pcap_id, min(packet_index) AS first_index, count(*) AS run_length FROM i GROUP BY pcap_id, island)"
_ARP = "b AS (SELECT *, is_arp AND src_ip <> '0.0.0.0' AND src_ip IS NOT NULL AND coalesce(arp_sha, '') <> '' AS ident FROM {src})"
_SENDER = """q AS (SELECT {key}, CASE WHEN ident THEN src_ip END AS spa, count(*) AS n, min(packet_index) AS first, max(packet_index) AS last, count_if(is_arp) AS arp, count_if(is_arp AND arp_op = 1) AS request, count_if(is_arp AND arp_op = 2) AS reply,
 count_if(is_arp AND arp_op = 1 AND src_ip = '0.0.0.0') AS probe, count_if(is_arp AND src_ip = dst_ip AND src_ip <> '0.0.0.0') AS gratuitous, count_if(ident) AS nident, count(DISTINCT CASE WHEN ident THEN arp_sha END) AS macs,
 count_if(ident AND src_mac IS NOT NULL) AS with_mac, count_if(ident AND src_mac <> arp_sha) AS mismatch, list(DISTINCT arp_sha) FILTER (WHERE ident) AS shas FROM b GROUP BY {key}, CASE WHEN ident THEN src_ip END)"""
ARP_SQL = (
    f"{E}, {V.windows_sql(V.SLOW)}, {_ARP.format(src='w')}, {_SENDER.format(key='pcap_id, segment_index, window_index')} SELECT pcap_id, segment_index, window_index, min(first) AS packet_index_start, max(last) AS packet_index_end, "
    + ", ".join(_r(f"coalesce(sum({x}) / nullif(sum(arp), 0), 0)", f"arp_{x}_ratio") for x in ("request", "reply", "probe", "gratuitous"))
    + ", count_if(spa IS NOT NULL AND macs > 1) AS arp_sender_ip_conflict_count, " + _r("coalesce(sum(CASE WHEN spa IS NOT NULL AND macs > 1 THEN nident ELSE 0 END) / nullif(sum(nident), 0), 0)", "arp_sender_ip_conflict_ratio")
    + ", coalesce(max(CASE WHEN spa IS NOT NULL THEN macs END), 0)::BIGINT AS arp_max_macs_per_sender_ip, coalesce(sum(CASE WHEN spa IS NOT NULL THEN macs - 1 END), 0)::BIGINT AS arp_mapping_change_count, " + _r("coalesce(sum(mismatch) / nullif(sum(with_mac), 0), 0)", "arp_eth_src_sha_mismatch_ratio")
    + ", count(spa) AS arp_unique_sender_ip_count, len(list_distinct(flatten(coalesce(list(shas) FILTER (WHERE shas IS NOT NULL), []))))::BIGINT AS arp_unique_sender_mac_count FROM q GROUP BY pcap_id, segment_index, window_index"
)
_ARP_BY = """b2 AS (SELECT *, lag(arp_sha) OVER o AS before, first_value(arp_sha) OVER o AS first_sha FROM b WHERE ident WINDOW o AS (PARTITION BY pcap_id, src_ip ORDER BY packet_index)),
 q AS (SELECT pcap_id, src_ip AS spa, count(*) AS n, count(DISTINCT arp_sha) AS macs, list(DISTINCT arp_sha) AS shas, count_if(arp_sha <> before) AS moves, min(packet_index) FILTER (WHERE arp_sha <> first_sha) - min(packet_index) AS packets_to, arg_min(timestamp, packet_index) FILTER (WHERE arp_sha <> first_sha) - arg_min(timestamp, packet_index) AS seconds_to FROM b2 GROUP BY pcap_id, src_ip)"""
ARP_CAPTURE_SQL = (
    f"{E}, {_ARP.format(src='p')}, {_ARP_BY}, st AS (SELECT pcap_id, sum(n)::BIGINT AS valid_identity_obs, count(*) AS unique_sender_ip_count, len(list_distinct(flatten(list(shas))))::BIGINT AS unique_sender_mac_count, count_if(macs > 1) AS conflict_ip_count, sum(CASE WHEN macs > 1 THEN n ELSE 0 END)::BIGINT AS conflict_obs_count, sum(macs - 1)::BIGINT AS novel_mac_claim_count, sum(moves)::BIGINT AS mapping_transition_count, count(packets_to) AS first_conflict_event_count, max(macs)::BIGINT AS max_macs_per_sender_ip FROM q GROUP BY pcap_id) "
    "SELECT pcap_id, count(*) AS packet_count, count_if(is_arp) AS arp_packet_count, " + ", ".join(f"coalesce(any_value({c}), 0)::BIGINT AS {c}" for c in ("valid_identity_obs", "unique_sender_ip_count", "unique_sender_mac_count", "conflict_ip_count", "conflict_obs_count", "novel_mac_claim_count", "mapping_transition_count", "first_conflict_event_count", "max_macs_per_sender_ip")) + ", " + _r("coalesce(any_value(conflict_obs_count) / any_value(valid_identity_obs), 0)", "conflict_obs_ratio") + " FROM p LEFT JOIN st USING (pcap_id) GROUP BY pcap_id"
)
_GRID = " UNION ALL ".join(f"SELECT '{p.id}' AS policy, {p.window_size} AS size, {p.inactivity_s}::DOUBLE AS gap, {p.backward_s}::DOUBLE AS back" for p in (V.CUTTING, V.SLOW, windows.WindowPolicy(10, 43_200.0, 86_400.0)))
GRID_SQL = (
    f"{L}, {V.DELTA_SQL}, pol AS ({_GRID}), x AS (SELECT *, coalesce(delta > gap, false) AS late, coalesce(delta < -back, false) AS early FROM d, pol), x1 AS (SELECT *, sum((late OR early)::INT) OVER (PARTITION BY pcap_id, policy ORDER BY packet_index ROWS UNBOUNDED PRECEDING) AS seg FROM x), "
    "x2 AS (SELECT *, (row_number() OVER (PARTITION BY pcap_id, policy, seg ORDER BY packet_index) - 1) // size AS w FROM x1), x3 AS (SELECT pcap_id, policy, size, seg, w, count(*) AS k, max(timestamp) - min(timestamp) AS span, count_if(late) AS late, count_if(early) AS early FROM x2 GROUP BY ALL) "
    "SELECT pcap_id, policy, sum(k)::BIGINT AS packets, sum(late)::BIGINT AS positive_gap_cuts, sum(early)::BIGINT AS backward_cuts, count(DISTINCT seg) AS segments, count_if(k = size) AS full_windows, coalesce(sum(CASE WHEN k <> size THEN k END), 0)::BIGINT AS dropped_packets, count_if(k = size AND span = 0) AS zero_span_windows, "
    + _r("avg(CASE WHEN k = size THEN span END)", "span_mean") + ", " + _r("quantile_cont(CASE WHEN k = size THEN span END, 0.5)", "span_p50") + ", " + _r("quantile_cont(CASE WHEN k = size THEN span END, 0.95)", "span_p95") + ", " + _r("count_if(k = size) * any_value(size) / sum(k)", "retention") + " FROM x3 GROUP BY pcap_id, policy"
)


def grid(spark, d):
    return stats.windowing_grid(V.lineitem_packets(spark, d), [V.CUTTING, V.SLOW, windows.WindowPolicy(10, 43_200.0, 86_400.0)])


def arp_capture(spark, d):
    return stats.arp_capture_stats(V.event_packets(spark, d))


def issue_examples(packets: DataFrame, most: int = 5) -> DataFrame:
    """The first packets of each (capture, code)."""
    from pyspark.sql import Window

    own = packets.withColumn("issue_code", S.issue_code()).where("issue_code IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("pcap_id", "issue_code").orderBy("packet_index"))
    return own.withColumn("rank", rank).where(F.col("rank") <= most).select("pcap_id", "issue_code", "packet_index", "rank")


QUERIES = {
    "segments": (lambda s, d: windows.segment_table(V.event_packets(s, d), V.CUTTING), f"{E}, {V.segments_sql(V.CUTTING)} SELECT pcap_id, segment_index, count(*) AS packets, min(packet_index) AS first_packet, max(packet_index) AS last_packet, count(*) // 5 AS full_windows FROM g GROUP BY pcap_id, segment_index"),
    "count_windows": (lambda s, d: windows.window_table(V.lineitem_packets(s, d), {"bytes": F.sum("frame_length")}, V.CUTTING), f"{L}, {V.windows_sql(V.CUTTING)} SELECT {_KEYS}, sum(frame_length)::BIGINT AS bytes FROM w GROUP BY pcap_id, segment_index, window_index"),
    "window_prefix": (lambda s, d: windows.window_table(V.event_packets(s, d), {"bytes": F.sum("frame_length")}, V.SLOW, max_windows=1), f"{E}, {V.windows_sql(V.SLOW)} SELECT {_KEYS}, sum(frame_length)::BIGINT AS bytes FROM w WHERE window_index < 1 GROUP BY pcap_id, segment_index, window_index"),
    "window_accounting": (lambda s, d: windows.accounting(V.event_packets(s, d), V.CUTTING), f"{E}, {V.segments_sql(V.CUTTING)}, z AS (SELECT pcap_id, segment_index, count(*) AS n, " + ", ".join(f"count_if(parse_status = '{x}') AS {x}" for x in ("ok", "partial", "unsupported", "malformed")) + " FROM g GROUP BY ALL) SELECT pcap_id, sum(n)::BIGINT AS packets, count(*) AS segments, sum(n // 5)::BIGINT AS full_windows, count_if(n % 5 > 0) AS dropped_partial_windows, sum(n % 5)::BIGINT AS dropped_packets, " + ", ".join(f"sum({x})::BIGINT AS {x}_packets" for x in ("ok", "partial", "unsupported", "malformed")) + " FROM z GROUP BY pcap_id"),
    "window_count_only": (lambda s, d: windows.window_counts(V.lineitem_packets(s, d), V.CUTTING), f"{L}, {V.segments_sql(V.CUTTING)}, z AS (SELECT pcap_id, segment_index, count(*) // 5 AS n FROM g GROUP BY ALL) SELECT pcap_id, sum(n)::BIGINT AS full_windows FROM z GROUP BY pcap_id"),
    "chunked_segments": (lambda s, d: windows.chunked_segments(V.lineitem_packets(s, d), V.CUTTING, 100).select("pcap_id", "packet_index", "segment_index", "position"), f"{L}, {V.segments_sql(V.CUTTING)} SELECT pcap_id, packet_index, segment_index, position FROM g"),
    "features27": (lambda s, d: rounded(features.base_features(V.event_packets(s, d), V.SLOW)), FEATURES_SQL),
    "arp_window_features": (lambda s, d: rounded(features.arp_features(V.event_packets(s, d), V.SLOW)), ARP_SQL),
    "read_stats": (lambda s, d: rounded(stats.read_stats(V.event_packets(s, d)).drop("linktype")), f"{E} SELECT pcap_id, count(*) AS packet_count, " + ", ".join(f"count_if(parse_status = '{x}') AS {x}_count" for x in ("ok", "partial", "unsupported", "malformed", "error")) + ", " + _r("arg_min(timestamp, packet_index)", "first_timestamp") + ", " + _r("arg_max(timestamp, packet_index)", "last_timestamp") + " FROM p GROUP BY pcap_id"),
    "protocol_counts": (lambda s, d: stats.protocol_counts(V.event_packets(s, d)), f"{E} SELECT pcap_id, protocol_name, count(*) AS packets FROM p GROUP BY ALL"),
    "integrity_stats": (lambda s, d: rounded(stats.integrity(V.event_packets(s, d))), f"{E}, {V.DELTA_SQL} SELECT pcap_id, {_INTEGRITY} FROM d GROUP BY pcap_id"),
    "train_characterization": (lambda s, d: rounded(stats.characterization(V.event_packets(s, d), 20, 10)), f"{E} SELECT pcap_id, {_CHAR} FROM p GROUP BY pcap_id"),
    "timestamp_probe": (lambda s, d: rounded(stats.timestamp_probe(V.lineitem_packets(s, d))), f"{L}, {_RUNS}, rr AS (SELECT pcap_id, count(*) AS run_count, max(run_length) AS run_max, {_r('avg(run_length)', 'run_mean')} FROM r GROUP BY pcap_id), q AS (SELECT pcap_id, {_PROBE} FROM d GROUP BY pcap_id) SELECT q.*, coalesce(run_count, 0) AS run_count, coalesce(run_max, 0) AS run_max, run_mean FROM q LEFT JOIN rr USING (pcap_id)"),
    "reversal_runs": (lambda s, d: stats.reversal_runs(V.lineitem_packets(s, d)), f"{L}, {_RUNS} SELECT * FROM r"),
    "first_n_reversals": (lambda s, d: rounded(stats.first_reversals(V.lineitem_packets(s, d))), f"{L}, {V.DELTA_SQL}, z AS (SELECT pcap_id, packet_index, round(delta, 6) AS delta, row_number() OVER (PARTITION BY pcap_id ORDER BY packet_index)::INT AS rank FROM d WHERE delta < 0) SELECT * FROM z WHERE rank <= 10"),
    "largest_n_reversals": (lambda s, d: rounded(stats.largest_reversals(V.lineitem_packets(s, d))), f"{L}, {V.DELTA_SQL}, z AS (SELECT pcap_id, packet_index, round(delta, 6) AS delta, row_number() OVER (PARTITION BY pcap_id ORDER BY delta, packet_index)::INT AS rank FROM d WHERE delta < 0) SELECT * FROM z WHERE rank <= 10"),
    "windowing_policy_grid": (lambda s, d: rounded(grid(s, d)), GRID_SQL),
    "windowing_rollup": (lambda s, d: rounded(stats.windowing_rollup(grid(s, d).withColumn("bucket", F.expr("cast(cast(pcap_id as int) % 3 as string)")), "bucket")), GRID_SQL.replace("SELECT pcap_id, policy, sum(k)", ", gg AS (SELECT pcap_id, policy, sum(k)").replace(_r("avg(CASE WHEN k = size THEN span END)", "span_mean"), "avg(CASE WHEN k = size THEN span END) AS span_mean").replace(_r("quantile_cont(CASE WHEN k = size THEN span END, 0.5)", "span_p50"), "quantile_cont(CASE WHEN k = size THEN span END, 0.5) AS span_p50").replace(_r("quantile_cont(CASE WHEN k = size THEN span END, 0.95)", "span_p95"), "quantile_cont(CASE WHEN k = size THEN span END, 0.95) AS span_p95") + f") SELECT policy, (pcap_id::INT % 3)::VARCHAR AS bucket, count(*) AS captures, sum(packets)::BIGINT AS packets, sum(full_windows)::BIGINT AS full_windows, {_r('sum(packets - dropped_packets) / sum(packets)', 'retention')}, {_r('sum(dropped_packets) / sum(packets)', 'tail_loss')}, {_r('sum(zero_span_windows) / nullif(sum(full_windows), 0)', 'zero_span_ratio')}, {_r('avg(span_p50)', 'span_p50_mean')}, {_r('avg(span_p95)', 'span_p95_mean')} FROM gg GROUP BY ALL"),
    "arp_capture_stats": (lambda s, d: rounded(arp_capture(s, d)), ARP_CAPTURE_SQL),
    "arp_group_rollup": (lambda s, d: rounded(stats.arp_group_rollup(arp_capture(s, d).withColumn("grp", F.expr("cast(cast(pcap_id as int) % 4 as string)")), stats.arp_distances(V.event_packets(s, d)), "grp").select("grp", "pcap_count", "conflict_obs_count", "mapping_transition_count", "conflict_packet_distance_count", "conflict_packet_distance_mean", "conflict_packet_distance_p50", "conflict_packet_distance_p95", "conflict_time_distance_max")), f"{E}, {_ARP.format(src='p')}, {_ARP_BY}, u AS (SELECT DISTINCT pcap_id FROM p) SELECT (pcap_id::INT % 4)::VARCHAR AS grp, count(DISTINCT pcap_id) AS pcap_count, sum(CASE WHEN macs > 1 THEN n ELSE 0 END)::BIGINT AS conflict_obs_count, coalesce(sum(moves), 0)::BIGINT AS mapping_transition_count, count(packets_to) AS conflict_packet_distance_count, {_r('coalesce(avg(packets_to), 0)', 'conflict_packet_distance_mean')}, {_r('coalesce(quantile_cont(packets_to::DOUBLE, 0.5), 0)', 'conflict_packet_distance_p50')}, {_r('coalesce(quantile_cont(packets_to::DOUBLE, 0.95), 0)', 'conflict_packet_distance_p95')}, {_r('coalesce(max(seconds_to), 0)', 'conflict_time_distance_max')} FROM u LEFT JOIN q USING (pcap_id) GROUP BY ALL"),
    "l3_category": (lambda s, d: V.event_packets(s, d).groupBy(S.l3_category().alias("l3")).agg(F.count(F.lit(1)).alias("n")), f"{E} SELECT CASE WHEN is_ipv4 THEN 'ipv4' WHEN is_ipv6 THEN 'ipv6' WHEN is_arp THEN 'arp' WHEN is_llc THEN 'llc' ELSE 'other' END AS l3, count(*) AS n FROM p GROUP BY ALL"),
    "tcp_flags": (lambda s, d: V.event_packets(s, d).where("is_tcp").agg(*[F.count_if(S.tcp_flag(f)).alias(f) for f in S.TCP_FLAGS]), f"{E} SELECT " + ", ".join(f"count_if(tcp_flag_{f}) AS {f}" for f in S.TCP_FLAGS) + " FROM p WHERE is_tcp"),
    "port_gate": (lambda s, d: V.event_packets(s, d).where(F.col("is_tcp") & S.is_mqtt_port()).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("n")), f"{E} SELECT pcap_id, count(*) AS n FROM p WHERE is_tcp AND coalesce(src_port = 1883 OR dst_port = 1883, false) GROUP BY pcap_id"),
    "arp_predicates": (lambda s, d: V.event_packets(s, d).groupBy("pcap_id").agg(F.count_if(S.is_arp_probe()).alias("probes"), F.count_if(F.col("is_arp") & S.is_gratuitous_arp()).alias("gratuitous"), F.count_if(S.is_arp_identity()).alias("identities")), f"{E}, {_ARP.format(src='p')} SELECT pcap_id, count_if(arp_op = 1 AND src_ip = '0.0.0.0') AS probes, count_if(is_arp AND src_ip = dst_ip AND src_ip <> '0.0.0.0') AS gratuitous, count_if(ident) AS identities FROM b GROUP BY pcap_id"),
    "issue_codes": (lambda s, d: V.event_packets(s, d).groupBy(S.issue_code().alias("issue_code")).agg(F.count(F.lit(1)).alias("n")), f"{E} SELECT {_ISSUE} AS issue_code, count(*) AS n FROM p GROUP BY ALL"),
    "issue_cap": (lambda s, d: issue_examples(V.event_packets(s, d)), f"{E}, i AS (SELECT pcap_id, {_ISSUE} AS issue_code, packet_index FROM p), j AS (SELECT *, row_number() OVER (PARTITION BY pcap_id, issue_code ORDER BY packet_index)::INT AS rank FROM i WHERE issue_code IS NOT NULL) SELECT * FROM j WHERE rank <= 5"),
    "failure_filter": (lambda s, d: V.event_packets(s, d).where(S.is_failure()).groupBy("parse_status").agg(F.count(F.lit(1)).alias("n")), f"{E} SELECT parse_status, count(*) AS n FROM p WHERE parse_status IN ('malformed', 'error') GROUP BY ALL"),
    "error_abort": (lambda s, d: windows.window_counts(windows.without_failed_captures(V.event_packets(s, d).withColumn("parse_status", F.expr("CASE WHEN event_id % 997 = 1 THEN 'error' ELSE parse_status END")))[0], V.SLOW), f"{E}, {V.segments_sql(V.SLOW)}, z AS (SELECT pcap_id, segment_index, count(*) // 25 AS n FROM g WHERE pcap_id NOT IN (SELECT pcap_id FROM p WHERE event_id % 997 = 1) GROUP BY ALL) SELECT pcap_id, sum(n)::BIGINT AS full_windows FROM z GROUP BY pcap_id"),
}


def _tables(spark, d) -> DataFrame:
    """Window features with groups, as the dataset operators read them."""
    f = features.base_features(V.event_packets(spark, d), V.SLOW)
    return f.withColumn("primary_group", F.expr("CASE WHEN cast(pcap_id as int) % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END")).withColumn("attack_family", F.expr("CASE WHEN cast(pcap_id as int) % 3 > 0 THEN 'DDoS' END")).withColumn("attack_type", F.expr("CASE WHEN cast(pcap_id as int) % 3 = 1 THEN 'DDoS_UDP' WHEN cast(pcap_id as int) % 3 = 2 THEN 'DDoS_SYN' END"))


_SOME = ("window_span_seconds", "iat_p95_seconds", "frame_length_mean", "arp_ratio", "tcp_syn_ratio", "unique_ip_count", "icmpv6_ratio")
_RAW = FEATURES_SQL.replace("round((", "((").replace(")::DOUBLE, 6)", ")::DOUBLE)")
_F = f"WITH f AS ({_RAW})"
_MELT = "m AS (SELECT {keys} feature, value FROM (" + " UNION ALL ".join("SELECT {keys} '" + x + "' AS feature, " + x + "::DOUBLE AS value FROM {src}" for x in _SOME) + "))"


def _melt(src: str, keys: str = "") -> str:
    return _MELT.format(src=src, keys=keys)


_PROBE_COLS = "count(value) AS count, count_if(value <> 0) AS nonzero_count, " + ", ".join(_r(x, n) for n, x in (("nonzero_rate", "coalesce(count_if(value <> 0) / nullif(count(value), 0), 0)"), ("mean", "avg(value)"), ("p50", "quantile_cont(value, 0.5)"), ("p95", "quantile_cont(value, 0.95)"), ("p99", "quantile_cont(value, 0.99)"), ("max", "max(value)")))
_G = f"{_F}, f2 AS (SELECT *, CASE WHEN pcap_id::INT % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END AS primary_group FROM f), x AS (SELECT *, 'all_train' AS grp FROM f2 UNION ALL SELECT *, primary_group FROM f2 UNION ALL SELECT *, 'attack_family_DDoS' FROM f2 WHERE pcap_id::INT % 3 > 0 UNION ALL SELECT *, CASE WHEN pcap_id::INT % 3 = 1 THEN 'attack_type_DDoS_UDP' ELSE 'attack_type_DDoS_SYN' END FROM f2 WHERE pcap_id::INT % 3 > 0)"

QUERIES |= {
    "feature_summary": (lambda s, d: rounded(stats.feature_summary(_tables(s, d), _SOME)), f"{_F}, {_melt('f')} SELECT feature, count(value) AS count, 0::BIGINT AS nonfinite, {_r('min(value)', 'min')}, {_r('max(value)', 'max')}, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, min(value) = max(value) AS is_constant FROM m GROUP BY feature"),
    "group_characterization": (lambda s, d: rounded(stats.group_characterization(_tables(s, d), _SOME).withColumnRenamed("group", "grp")), f"{_G}, {_melt('x', 'grp,')} SELECT grp, feature, count(value) AS count, count_if(value = 0) AS zero_count, count_if(value <> 0) AS nonzero_count, {_r('min(value)', 'min')}, {_r('max(value)', 'max')}, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, " + ", ".join(_r(f"quantile_cont(value, {q})", n) for q, n in ((0.01, "p01"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + ", min(value) = max(value) AS is_constant, CASE WHEN grp = 'all_train' THEN 'all' WHEN grp LIKE 'attack_family%' THEN 'attack_family' WHEN grp LIKE 'attack_type%' THEN 'attack_type' WHEN grp = 'publisher_benign' THEN 'benign' ELSE 'other' END AS group_kind, 'exact' AS method FROM m GROUP BY grp, feature"),
    "pcap_diagnostics": (lambda s, d: rounded(stats.capture_diagnostics(_tables(s, d), 700.0)), f"{_F} SELECT pcap_id, count(*) AS windows, " + ", ".join(f"count_if({c} > 0) AS {k}_windows" for k, c in (("urg", "tcp_urg_ratio"), ("ipv6", "ipv6_ratio"), ("llc", "llc_ratio"), ("igmp", "igmp_ratio"), ("icmpv6", "icmpv6_ratio"))) + f", count_if(frame_length_max = 700) AS jumbo_windows, {_r('max(frame_length_max)', 'frame_length_max')}, {_r('max(tcp_urg_ratio)', 'tcp_urg_ratio_max')}, {_r('avg(window_span_seconds)', 'span_mean')}, {_r('avg(iat_mean_seconds)', 'iat_mean')} FROM f GROUP BY pcap_id"),
    "presence_lists": (lambda s, d: stats.presence(stats.capture_diagnostics(_tables(s, d))).where("feature <> 'jumbo'"), f"{_F} SELECT feature, pcap_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, pcap_id FROM f WHERE {c} > 0" for k, c in (("urg", "tcp_urg_ratio"), ("ipv6", "ipv6_ratio"), ("llc", "llc_ratio"), ("igmp", "igmp_ratio"), ("icmpv6", "icmpv6_ratio"))) + ") GROUP BY ALL"),
    "probe_summary": (lambda s, d: rounded(stats.probe_summary(_tables(s, d), _SOME, "primary_group")), f"{_F}, f2 AS (SELECT *, CASE WHEN pcap_id::INT % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END AS primary_group FROM f), {_melt('f2', 'primary_group,')} SELECT primary_group, feature, {_PROBE_COLS} FROM m GROUP BY ALL"),
    "scoped_summary": (lambda s, d: rounded(stats.scoped_summary(_tables(s, d), _SOME, "primary_group", F.col("arp_ratio") > 0.2)), f"{_F}, f2 AS (SELECT *, CASE WHEN pcap_id::INT % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END AS primary_group FROM f), f3 AS (SELECT *, 'all_windows' AS scope FROM f2 UNION ALL SELECT *, 'present' FROM f2 WHERE arp_ratio > 0.2), {_melt('f3', 'primary_group, scope,')} SELECT primary_group, feature, scope, {_PROBE_COLS} FROM m GROUP BY ALL"),
    "conditional_evidence": (lambda s, d: rounded(stats.conditional_evidence(_tables(s, d), _SOME, "primary_group", F.col("arp_ratio") > 0.2)), f"{_F}, f2 AS (SELECT *, CASE WHEN pcap_id::INT % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END AS primary_group FROM f WHERE arp_ratio > 0.2), {_melt('f2', 'primary_group,')} SELECT primary_group, feature, count(*) AS windows, count_if(value <> 0) AS nonzero, {_r('count_if(value <> 0) / count(*)', 'nonzero_rate')}, {_r('avg(value)', 'mean')}, {_r('coalesce(avg(CASE WHEN value <> 0 THEN value END), 0)', 'mean_nonzero')} FROM m GROUP BY ALL"),
    "vs_arp_ratio": (lambda s, d: rounded(stats.beside_arp_ratio(_tables(s, d), ("tcp_ratio", "window_span_seconds"), "primary_group").select("primary_group", "feature", "mean", "arp_ratio_mean", "arp_ratio_p95")), f"{_F}, f2 AS (SELECT *, CASE WHEN pcap_id::INT % 3 = 0 THEN 'publisher_benign' ELSE 'DDoS' END AS primary_group FROM f) SELECT primary_group, feature, {_r('avg(v)', 'mean')}, {_r('avg(arp_ratio)', 'arp_ratio_mean')}, {_r('quantile_cont(arp_ratio, 0.95)', 'arp_ratio_p95')} FROM (SELECT *, 'tcp_ratio' AS feature, tcp_ratio AS v FROM f2 UNION ALL SELECT *, 'window_span_seconds', window_span_seconds FROM f2) GROUP BY ALL"),
}
assert set(_AGG) | set(_DISTINCT) == set(BASE_FEATURES) and len(ARP_FEATURES) == 11
