"""Statistics of captures, windows and groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import STATUSES
from .windows import WindowPolicy, in_order, upto, with_delta

PROTOCOLS = ("ipv4", "ipv6", "arp", "llc", "tcp", "udp", "icmp", "icmpv6", "igmp")
#: Distinct addresses that a characterization reports, at most.
IP_CAP, PORT_CAP = 100_000, 65_536
EXAMPLES = 10


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("parse_status") == s).alias(f"{s}_count") for s in STATUSES]


def read_stats(packets: DataFrame) -> DataFrame:
    """A capture's packets by status, first and last time in capture order, link type."""
    return packets.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("packet_count"), *_status_counts(), F.min_by("timestamp", "packet_index").alias("first_timestamp"), F.max_by("timestamp", "packet_index").alias("last_timestamp"), F.first("linktype", True).alias("linktype"))


def protocol_counts(packets: DataFrame) -> DataFrame:
    """pcap_id, protocol_name, packets: the long table beside read_stats."""
    return packets.groupBy("pcap_id", F.coalesce("protocol_name", F.lit("unknown")).alias("protocol_name")).agg(F.count(F.lit(1)).alias("packets"))


def _integrity_columns() -> list[Column]:
    d = F.col("delta")
    first, last = F.min_by("timestamp", "packet_index"), F.max_by("timestamp", "packet_index")
    return [
        F.count(F.lit(1)).alias("packet_count"), *_status_counts(), *[F.count_if(f"is_{p}").alias(f"{p}_count") for p in PROTOCOLS],
        F.min("frame_length").alias("min_frame_length"), F.max("frame_length").alias("max_frame_length"), F.sum("frame_length").alias("total_bytes"), F.avg("frame_length").alias("mean_frame_length"),
        first.alias("first_timestamp"), last.alias("last_timestamp"), F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"),
        (last - first).alias("capture_order_duration"), (F.max("timestamp") - F.min("timestamp")).alias("capture_timestamp_span"),
        F.count_if(d == 0).alias("duplicate_timestamp_count"), F.count_if(d < 0).alias("negative_delta_count"), F.count_if(d <= 0).alias("non_monotonic_count"),
        S.ratio(F.count_if(F.col("parse_status") == "malformed"), F.count(F.lit(1))).alias("malformed_rate"), F.first("linktype", True).alias("linktype"),
    ]


def integrity(packets: DataFrame) -> DataFrame:
    """One row of accounting a capture."""
    return with_delta(packets).groupBy("pcap_id").agg(*_integrity_columns())


def capped_distinct(column: str, cap: int) -> list[Column]:
    n = F.count_distinct(column)
    return [F.least(n, F.lit(cap)).alias(f"unique_{column}s"), (n > cap).alias(f"unique_{column}s_capped")]


def characterization(packets: DataFrame, ip_cap: int = IP_CAP, port_cap: int = PORT_CAP) -> DataFrame:
    """Rates over the time span, protocol and flag ratios and capped distinct counts of each capture."""
    n, span = F.count(F.lit(1)), F.max("timestamp") - F.min("timestamp")
    n_tcp = F.count_if("is_tcp")
    rate = lambda x: F.when(span > 0, x / span)
    columns = [n.alias("packet_count"), rate(n).alias("packets_per_second"), rate(F.sum("frame_length")).alias("bytes_per_second")]
    columns += [S.ratio(F.count_if(f"is_{p}"), n).alias(f"{p}_ratio") for p in PROTOCOLS]
    columns += [x for f in ("syn", "ack", "fin", "rst", "psh", "urg") for x in (F.count_if(f"tcp_flag_{f}").alias(f"tcp_{f}_count"), S.ratio(F.count_if(F.col("is_tcp") & F.col(f"tcp_flag_{f}")), n_tcp).alias(f"tcp_{f}_ratio"))]
    distinct = [c for column, cap in (("src_ip", ip_cap), ("dst_ip", ip_cap), ("src_port", port_cap), ("dst_port", port_cap)) for c in capped_distinct(column, cap)]
    return packets.groupBy("pcap_id").agg(*columns, *distinct)


def timestamp_probe(packets: DataFrame) -> DataFrame:
    """Positive, equal and negative deltas of each capture, magnitudes of the negative ones, and their runs: one sort of the capture serves all."""
    d = F.col("delta")
    back = F.when(d < 0, -d)
    own = with_delta(packets.select("pcap_id", "packet_index", "timestamp")).withColumn("n", F.row_number().over(in_order()).cast("bigint"))
    forth = F.when(~F.coalesce(d < 0, F.lit(False)), F.col("n"))
    own = own.withColumn("run", F.col("n") - F.max(forth).over(upto()))  # place in a run of reversals, 0 outside
    by = own.groupBy("pcap_id").agg(
        F.count(F.lit(1)).alias("packet_count"), F.count_if(d > 0).alias("positive_count"), F.count_if(d == 0).alias("duplicate_count"), F.count_if(d < 0).alias("negative_count"),
        S.ratio(F.count_if(d < 0), F.count("delta")).alias("negative_ratio"), S.ratio(F.count_if(d == 0), F.count("delta")).alias("duplicate_ratio"),
        F.min(back).alias("reversal_min"), F.max(back).alias("reversal_max"), F.avg(back).alias("reversal_mean"), F.percentile(back, F.array(*map(F.lit, (0.5, 0.95, 0.99)))).alias("_p"),
        F.count_if(F.col("run") == 1).alias("run_count"), F.max("run").alias("run_max"),
    )
    by = by.select("*", *[F.get("_p", i).alias(f"reversal_p{p}") for i, p in enumerate((50, 95, 99))]).drop("_p")
    return by.withColumn("run_mean", S.ratio(F.col("negative_count"), F.col("run_count")))


def reversal_runs(packets: DataFrame) -> DataFrame:
    """Maximal runs of consecutive negative deltas: first packet and length."""
    own = with_delta(packets.select("pcap_id", "packet_index", "timestamp")).withColumn("n", F.row_number().over(in_order())).where("delta < 0")
    island = own.withColumn("island", F.col("n") - F.row_number().over(in_order()))
    return island.groupBy("pcap_id", "island").agg(F.min("packet_index").alias("first_index"), F.count(F.lit(1)).alias("run_length")).drop("island")


def first_reversals(packets: DataFrame, n: int = EXAMPLES) -> DataFrame:
    own = with_delta(packets.select("pcap_id", "packet_index", "timestamp")).where("delta < 0")
    return own.withColumn("rank", F.row_number().over(in_order())).where(F.col("rank") <= n).select("pcap_id", "rank", "packet_index", "delta")


def largest_reversals(packets: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """By size, then packet_index. Among equal sizes at the cut the lowest index stays."""
    own = with_delta(packets.select("pcap_id", "packet_index", "timestamp")).where("delta < 0")
    order = Window.partitionBy("pcap_id").orderBy(F.col("delta"), "packet_index")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("pcap_id", "rank", "packet_index", "delta")


def windowing_grid(packets: DataFrame, policies: list[WindowPolicy]) -> DataFrame:
    """Cuts by cause, segments, full windows, retention and spans of each capture under each policy: one scan, one shuffle, one sort.

    Policies with the same bounds cut alike. For each pair of bounds the rows are summed in windows of the largest size that divides those of its policies,
    and these windows, not the rows, are put together to the windows of each policy."""
    bounds = sorted({(float(p.inactivity_s), float(p.backward_s)) for p in policies})
    base = {b: math.gcd(*(p.window_size for p in policies if (float(p.inactivity_s), float(p.backward_s)) == b)) for b in bounds}
    d = F.col("delta")
    rows = with_delta(packets.select("pcap_id", "packet_index", "timestamp")).withColumn("n", F.row_number().over(in_order()).cast("bigint"))
    is_late = [F.coalesce(d > gap, F.lit(False)) for gap, _ in bounds]
    is_early = [F.coalesce(d < -back, F.lit(False)) for _, back in bounds]
    rows = rows.withColumns({f"late{i}": x for i, x in enumerate(is_late)} | {f"early{i}": x for i, x in enumerate(is_early)})
    cuts = [F.col(f"late{i}") | F.col(f"early{i}") for i in range(len(bounds))]
    rows = rows.withColumns({f"segment{i}": F.sum(c.cast("bigint")).over(upto()) for i, c in enumerate(cuts)} | {f"start{i}": F.max(F.when(c | (F.col("n") == 1), F.col("n"))).over(upto()) for i, c in enumerate(cuts)})
    of_bounds = F.array(*[F.struct(F.lit(i).alias("b"), F.col(f"segment{i}").alias("segment"), F.floor((F.col("n") - F.col(f"start{i}")) / base[x]).alias("w"), F.col(f"late{i}").alias("late"), F.col(f"early{i}").alias("early")) for i, x in enumerate(bounds)])
    small = rows.select("pcap_id", "timestamp", F.inline(of_bounds)).groupBy("pcap_id", "b", "segment", "w")
    small = small.agg(F.count(F.lit(1)).alias("k"), F.max("timestamp").alias("hi"), F.min("timestamp").alias("lo"), F.count_if("late").alias("late"), F.count_if("early").alias("early"))
    table = [(bounds.index((float(p.inactivity_s), float(p.backward_s))), p) for p in policies]
    own = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(p.id).alias("policy"), F.lit(p.window_size).alias("size"), F.lit(p.window_size // base[bounds[i]]).alias("step")) for i, p in table])
    key = ["pcap_id", "policy", "size"]
    windows = small.select("*", F.inline(F.filter(own, lambda x: x["of"] == F.col("b")))).groupBy(*key, "segment", F.floor(F.col("w") / F.col("step")).alias("w"))
    windows = windows.agg(F.sum("k").alias("k"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("late").alias("late"), F.sum("early").alias("early"))
    full = F.col("k") == F.col("size")
    span = F.when(full, F.col("hi") - F.col("lo"))
    out = windows.groupBy(*key).agg(
        F.sum("k").alias("packets"), F.sum("late").alias("positive_gap_cuts"), F.sum("early").alias("backward_cuts"), F.count_if(F.col("w") == 0).alias("segments"), F.count_if(full).alias("full_windows"),
        F.coalesce(F.sum(F.when(~full, F.col("k"))), F.lit(0)).alias("dropped_packets"), F.count_if(span == 0).alias("zero_span_windows"), F.avg(span).alias("span_mean"), F.percentile(span, 0.5).alias("span_p50"), F.percentile(span, 0.95).alias("span_p95"),
    )
    return out.withColumn("retention", S.ratio(F.col("full_windows") * F.col("size"), F.col("packets"))).drop("size")


def windowing_rollup(grid: DataFrame, bucket: str) -> DataFrame:
    """Policies by bucket: pooled retention, tail loss and zero spans; span percentiles are means over captures."""
    own = grid.withColumn("kept", F.col("packets") - F.col("dropped_packets"))
    return own.groupBy("policy", bucket).agg(
        F.count(F.lit(1)).alias("captures"), F.sum("packets").alias("packets"), F.sum("full_windows").alias("full_windows"), S.ratio(F.sum("kept"), F.sum("packets")).alias("retention"), S.ratio(F.sum("dropped_packets"), F.sum("packets")).alias("tail_loss"),
        S.ratio(F.sum("zero_span_windows"), F.sum("full_windows")).alias("zero_span_ratio"), F.avg("span_p50").alias("span_p50_mean"), F.avg("span_p95").alias("span_p95_mean"),
    )


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def melted(table: DataFrame, features: tuple[str, ...], keys: list[str]) -> DataFrame:
    return table.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def feature_summary(table: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """A feature's count, non-finite values, extremes, mean, population deviation, whether it is constant."""
    v = F.when(finite(F.col("value")), F.col("value"))
    out = melted(table, features, []).groupBy("feature").agg(F.count(v).alias("count"), F.count_if(~finite(F.col("value"))).alias("nonfinite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.withColumn("is_constant", F.coalesce(F.col("min") == F.col("max"), F.lit(False)))


QUANTILES = (0.01, 0.5, 0.95, 0.99, 0.999)


def exact_quantiles(rows: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """keys, _p: linear quantiles of column value (not null) by keys. Values are counted, cut in ranges and summed along them, so that not even a key that
    holds all rows meets in one task."""
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy("_part", *keys).agg(F.sum("n").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.select("_part", *keys, F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    within = Window.partitionBy("_part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_upto", F.sum("n").over(within)).join(parts, ["_part", *keys]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("n") <= place) & (place < F.col("_upto")), F.col("value")))

    places = [F.lit(q) * (F.col("_total") - 1) for q in quantiles]
    out = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(F.floor(x)).alias(f"_lo{i}") for i, x in enumerate(places)], *[at(F.ceil(x)).alias(f"_hi{i}") for i, x in enumerate(places)])
    return out.select(*keys, F.array(*[F.col(f"_lo{i}") + (x - F.floor(x)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, x in enumerate(places)]).alias("_p"))


def group_characterization(table: DataFrame, features: tuple[str, ...], exact: bool = True) -> DataFrame:
    """Statistics by (group, feature) for all rows, the primary group, the family and the type: columns primary_group, attack_family, attack_type."""
    named = lambda prefix, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix), F.col(c)))
    groups = F.array_compact(F.array_distinct(F.array(F.lit("all_train"), F.col("primary_group"), named("attack_family_", "attack_family"), named("attack_type_", "attack_type"))))
    rows = melted(table.withColumn("group", F.explode(groups)), features, ["group"])
    v = F.when(finite(F.col("value")), F.col("value"))
    sums = [F.count(v).alias("count"), F.count_if(v == 0).alias("zero_count"), F.count_if(v != 0).alias("nonzero_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    if exact:
        out = rows.groupBy("group", "feature").agg(*sums).join(exact_quantiles(rows.where(finite(F.col("value"))), ["group", "feature"], QUANTILES), ["group", "feature"], "left")
    else:
        out = rows.groupBy("group", "feature").agg(*sums, F.percentile_approx(v, F.array(*map(F.lit, QUANTILES)), 10_000).alias("_p"))
    out = out.select("*", *[F.get("_p", i).alias(n) for i, n in enumerate(("p01", "p50", "p95", "p99", "p999"))]).drop("_p")
    return out.withColumn("is_constant", F.coalesce(F.col("min") == F.col("max"), F.lit(False))).withColumn("group_kind", S.group_kind(F.col("group"))).withColumn("method", F.lit("exact" if exact else "approximate"))


def capture_diagnostics(table: DataFrame, jumbo: float = 8754.0) -> DataFrame:
    """A capture's windows with urgent, IPv6, LLC, IGMP, ICMPv6 and jumbo frames, maxima and mean times."""
    seen = {"urg": "tcp_urg_ratio", "ipv6": "ipv6_ratio", "llc": "llc_ratio", "igmp": "igmp_ratio", "icmpv6": "icmpv6_ratio"}
    return table.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("windows"), *[F.count_if(F.col(c) > 0).alias(f"{k}_windows") for k, c in seen.items()], F.count_if(F.col("frame_length_max") == jumbo).alias("jumbo_windows"), F.max("frame_length_max").alias("frame_length_max"), F.max("tcp_urg_ratio").alias("tcp_urg_ratio_max"), F.avg("window_span_seconds").alias("span_mean"), F.avg("iat_mean_seconds").alias("iat_mean"))


def presence(diagnostics: DataFrame) -> DataFrame:
    """feature, pcap_id: captures with any such window."""
    columns = [c for c in diagnostics.columns if c.endswith("_windows")]
    return diagnostics.unpivot(["pcap_id"], columns, "feature", "n").where("n > 0").select(F.regexp_replace("feature", "_windows$", "").alias("feature"), "pcap_id", "n")


def value_stats(values: Column, prefix: str = "") -> list[Column]:
    """Count, share of nonzero, mean, percentiles and maximum; all 0 where there is none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(values).alias(f"{prefix}count"), F.count_if(values != 0).alias(f"{prefix}nonzero_count"), S.ratio0(F.count_if(values != 0), F.count(values)).alias(f"{prefix}nonzero_rate"), zero(F.avg(values)).alias(f"{prefix}mean"), *[zero(F.percentile(values, q)).alias(f"{prefix}p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], zero(F.max(values)).alias(f"{prefix}max")]


def probe_summary(table: DataFrame, features: tuple[str, ...], group: str) -> DataFrame:
    return melted(table, features, [group]).groupBy(group, "feature").agg(*value_stats(F.col("value")))


def scoped_summary(table: DataFrame, features: tuple[str, ...], group: str, present: Column) -> DataFrame:
    """probe_summary over all windows and over those where ``present`` holds."""
    some = probe_summary(table.where(present), features, group).withColumn("scope", F.lit("present"))
    return probe_summary(table, features, group).withColumn("scope", F.lit("all_windows")).unionByName(some)


def conditional_evidence(table: DataFrame, features: tuple[str, ...], group: str, present: Column) -> DataFrame:
    """Among windows where ``present`` holds: nonzero windows of a feature, their share and means."""
    rows = melted(table.where(present), features, [group])
    v = F.col("value")
    return rows.groupBy(group, "feature").agg(F.count(F.lit(1)).alias("windows"), F.count_if(v != 0).alias("nonzero"), S.ratio0(F.count_if(v != 0), F.count(F.lit(1))).alias("nonzero_rate"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.avg(F.when(v != 0, v)), F.lit(0.0)).alias("mean_nonzero"))


def beside_arp_ratio(table: DataFrame, features: tuple[str, ...], group: str) -> DataFrame:
    """A feature's statistics beside those of arp_ratio, by group."""
    ratio = table.groupBy(group).agg(*value_stats(F.col("arp_ratio"), "arp_ratio_"))
    return probe_summary(table, features, group).join(ratio, group)


def _arp_senders(packets: DataFrame) -> DataFrame:
    """One row for each (capture, sender address spa): observations n, hardware addresses macs, moves, and the distances to the first conflict."""
    own = packets.where(S.is_arp_identity()).select("pcap_id", F.col("src_ip").alias("spa"), F.col("arp_sha").alias("sha"), "packet_index", "timestamp")
    order = Window.partitionBy("pcap_id", "spa").orderBy("packet_index")
    first = F.first("sha").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("moved", F.coalesce(F.col("sha") != F.lag("sha").over(order), F.lit(False))).withColumn("other", F.col("sha") != first)
    # Summed by hardware address first, so that a sender with a flood of them is counted and never collected.
    by = own.groupBy("pcap_id", "spa", "sha").agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moves"), F.min(F.struct("packet_index", "timestamp")).alias("f"), F.min(F.when(F.col("other"), F.struct("packet_index", "timestamp"))).alias("o"))
    by = by.groupBy("pcap_id", "spa").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("macs"), F.sum("moves").alias("moves"), F.min("f").alias("f"), F.min("o").alias("o"))
    return by.select("pcap_id", "spa", "n", "macs", "moves", (F.col("o.packet_index") - F.col("f.packet_index")).cast("double").alias("packets_to"), (F.col("o.timestamp") - F.col("f.timestamp")).alias("seconds_to"))


def arp_capture_stats(packets: DataFrame) -> DataFrame:
    """Sender conflicts over a whole capture. Senders are first summed by (capture, sender)."""
    macs = F.col("macs")
    stats = _arp_senders(packets).groupBy("pcap_id").agg(
        F.sum("n").alias("valid_identity_obs"), F.count(F.lit(1)).alias("unique_sender_ip_count"),
        F.count_if(macs > 1).alias("conflict_ip_count"), F.coalesce(F.sum(F.when(macs > 1, F.col("n"))), F.lit(0)).alias("conflict_obs_count"), F.sum(macs - 1).cast("bigint").alias("novel_mac_claim_count"),
        F.sum("moves").alias("mapping_transition_count"), F.count("packets_to").alias("first_conflict_event_count"), F.max(macs).cast("bigint").alias("max_macs_per_sender_ip"),
    )
    addresses = packets.where(S.is_arp_identity()).select("pcap_id", "arp_sha").distinct().groupBy("pcap_id").agg(F.count(F.lit(1)).alias("unique_sender_mac_count"))
    counts = packets.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("packet_count"), F.count_if("is_arp").alias("arp_packet_count"))
    out = counts.join(stats, "pcap_id", "left").join(addresses, "pcap_id", "left").fillna(0)
    return out.withColumn("conflict_obs_ratio", S.ratio0(F.col("conflict_obs_count"), F.col("valid_identity_obs")))


def arp_distances(packets: DataFrame) -> DataFrame:
    """pcap_id, spa, packets_to, seconds_to of each sender with a conflict: from its first packet to the first with another address."""
    return _arp_senders(packets).where("packets_to IS NOT NULL").select("pcap_id", "spa", "packets_to", "seconds_to")


def arp_group_rollup(captures: DataFrame, distances: DataFrame, group: str) -> DataFrame:
    """Sums over the captures of a group; distances (arp_distances) are pooled before their percentiles are taken."""
    sums = ["packet_count", "arp_packet_count", "valid_identity_obs", "unique_sender_ip_count", "conflict_ip_count", "conflict_obs_count", "novel_mac_claim_count", "mapping_transition_count", "first_conflict_event_count"]
    by = captures.groupBy(group).agg(F.count(F.lit(1)).alias("pcap_count"), *[F.sum(c).alias(c) for c in sums], F.max("max_macs_per_sender_ip").alias("max_macs_per_sender_ip"), S.ratio0(F.sum("conflict_obs_count"), F.sum("valid_identity_obs")).alias("conflict_obs_ratio"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pooled = captures.select("pcap_id", group).join(distances, "pcap_id", "left")
    stats = [x for v, prefix in (("packets_to", "conflict_packet_distance_"), ("seconds_to", "conflict_time_distance_")) for x in (F.count(v).alias(f"{prefix}count"), *[zero(f).alias(f"{prefix}{k}") for k, f in (("mean", F.avg(v)), ("p50", F.percentile(v, 0.5)), ("p95", F.percentile(v, 0.95)), ("min", F.min(v)), ("max", F.max(v)))])]
    return by.join(pooled.groupBy(group).agg(*stats), group)


def audit_totals(integrity_rows: DataFrame) -> DataFrame:
    """Corpus totals: captures, packets, bytes, link types, and captures with unsupported packets."""
    return integrity_rows.agg(F.count(F.lit(1)).alias("captures"), F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("bytes"), F.count_distinct("linktype").alias("linktypes"), F.sum("unsupported_count").alias("unsupported_packets"), F.count_if(F.col("unsupported_count") > 0).alias("captures_with_unsupported"))
