"""Constraints, with what breaks them as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BASE_FEATURES
from .stats import finite

RATIOS = tuple(f for f in BASE_FEATURES if f.endswith("_ratio"))
L3 = ("ipv4_ratio", "ipv6_ratio", "arp_ratio", "llc_ratio", "other_protocol_ratio")
MOST_DISTINCT = 50
#: Shares of malformed packets. Fixed values.
MALFORMED_HIGH, MALFORMED_CATASTROPHIC = 0.01, 0.80
LINKTYPES = (1, 101, 228, 229)


def _explode(table: DataFrame, keys: list[str], rules: list[tuple[Column, str]], name: str) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in rules]))
    return table.select(*keys, F.explode(codes).alias(name))


def window_rules() -> list[tuple[Column, str]]:
    rules = [(~finite(F.col(f).cast("double")), f"{f} is not finite") for f in BASE_FEATURES]
    rules += [(F.col(f) < 0, f"{f} is negative") for f in BASE_FEATURES]
    rules += [(F.col(f) > 1, f"{f} is above 1") for f in RATIOS]
    rules += [(F.abs(sum((F.col(f) for f in L3), F.lit(0.0)) - 1) > 1e-9, "network layer ratios do not add up to 1")]
    rules += [(F.col(f) > MOST_DISTINCT, f"{f} is above {MOST_DISTINCT}") for f in ("unique_ip_count", "unique_port_count")]
    rules += [(F.col("frame_length_min") <= 0, "frame_length_min is not positive"), (F.col("frame_length_min") > F.col("frame_length_max"), "frame lengths are reversed")]
    return rules + [(F.col("packet_index_end") < F.col("packet_index_start"), "packets are reversed")]


def window_violations(table: DataFrame) -> DataFrame:
    """pcap_id, window_index, violation."""
    return _explode(table, ["pcap_id", "window_index"], window_rules(), "violation")


def first_violation(table: DataFrame) -> DataFrame:
    """One row a capture: its first broken window and rule."""
    order = F.struct("window_index", "violation")
    return window_violations(table).groupBy("pcap_id").agg(F.min(order).alias("v"), F.count(F.lit(1)).alias("violations")).select("pcap_id", "v.*", "violations")


def accounting_violations(integrity: DataFrame) -> DataFrame:
    """pcap_id, violation of a capture's counts."""
    n = F.col("packet_count")
    statuses = [F.col(f"{s}_count") for s in ("ok", "partial", "unsupported", "malformed", "error")]
    rules = [(sum(statuses, F.lit(0)) != n, "statuses do not add up"), (F.col("tcp_count") + F.col("udp_count") > n, "more TCP and UDP than packets")]
    rules += [((F.col(c) < 0) | (F.col(c) > n), f"{c} out of range") for c in ("ipv4_count", "ipv6_count", "arp_count", "llc_count", "tcp_count", "udp_count", "icmp_count", "icmpv6_count", "igmp_count")]
    return _explode(integrity, ["pcap_id"], rules, "violation")


def file_observations(integrity: DataFrame) -> DataFrame:
    """pcap_id, issue_code, severity of what a capture as a whole shows."""
    rate = F.coalesce("malformed_rate", F.lit(0.0))
    malformed = F.when(F.col("malformed_count") > 0, F.when(rate >= MALFORMED_CATASTROPHIC, "file:malformed_catastrophic").when(rate >= MALFORMED_HIGH, "file:malformed_high").otherwise("file:malformed_present"))
    codes = [
        F.when(~F.col("linktype").isin(*LINKTYPES), "file:unsupported_linktype"), F.when(F.col("error_count") > 0, "file:decoder_error"), F.when(F.col("packet_count") == 0, "file:zero_packets"), malformed,
        F.when(F.col("partial_count") > 0, "file:partial_present"), F.when(F.col("unsupported_count") > 0, "file:unsupported_present"), F.when(F.col("duplicate_timestamp_count") > 0, "file:timestamp_duplicate"),
        F.when(F.col("negative_delta_count") > 0, "file:timestamp_reversal"), F.when((F.col("capture_timestamp_span") <= 0) & (F.col("packet_count") > 1), "file:zero_timestamp_span"),
    ]
    out = integrity.select("pcap_id", F.explode(F.array_compact(F.array(*codes))).alias("issue_code"))
    code = F.col("issue_code")
    severity = F.when(code.isin("file:unsupported_linktype", "file:decoder_error", "file:malformed_catastrophic"), "hard_failure").when(code == "file:malformed_high", "high_warning").otherwise("warning")
    return out.withColumn("severity", severity)


def dataset_violations(shards: DataFrame, manifest: DataFrame, integrity: DataFrame, windowing: DataFrame) -> DataFrame:
    """pcap_id, issue_code over a built dataset: broken windows, and counts that disagree between shards, manifest, packets and windows."""
    counts = shards.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("rows"))
    own = manifest.select("pcap_id", "output_row_count", "packets_processed", "windows_written", "status")
    joined = own.join(counts, "pcap_id", "full_outer").join(integrity.select("pcap_id", "packet_count"), "pcap_id", "left").join(windowing.select("pcap_id", "full_windows"), "pcap_id", "left")
    rows = F.coalesce("rows", F.lit(0))
    codes = F.array_compact(F.array(
        F.when(F.col("status").isNull(), "shard_without_manifest"), F.when(F.col("status") != "ok", "build_failed"), F.when(F.col("output_row_count") != rows, "row_count_mismatch"),
        F.when(F.col("windows_written") != rows, "windows_written_mismatch"), F.when(F.col("packet_count").isNull(), "missing_integrity"), F.when(F.col("packet_count") != F.col("packets_processed"), "packet_count_mismatch"),
        F.when(F.col("full_windows").isNull(), "missing_windowing"), F.when(F.col("full_windows") != rows, "window_count_mismatch"),
    ))
    counted = joined.select("pcap_id", F.explode(codes).alias("issue_code"))
    broken = window_violations(shards).select("pcap_id", F.lit("window_invariant").alias("issue_code")).distinct()
    twice = shards.groupBy("pcap_id", "window_index").count().where("count > 1").select("pcap_id", F.lit("duplicate_window").alias("issue_code")).distinct()
    return counted.unionByName(broken).unionByName(twice)


def schema_differences(actual, expected) -> list[str]:
    """What differs in names, order and types; nullability can't be told from Parquet."""
    a, b = [(f.name, f.dataType.simpleString()) for f in actual.fields], [(f.name, f.dataType.simpleString()) for f in expected.fields]
    return [f"column {i}: {x} instead of {y}" for i, (x, y) in enumerate(zip(a, b)) if x != y] + [f"{len(a)} columns instead of {len(b)}"] * (len(a) != len(b))


def require(found: DataFrame, what: str) -> None:
    """Fails with the first rows if there are any."""
    rows = found.take(5)
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
