"""Capture order: deltas, gap-cut segments and windows of a fixed number of packets.

Order is packet_index, never time. Everything here shuffles once, by capture; later steps on (pcap_id, ...) keep that distribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowPolicy:
    window_size: int = 25
    inactivity_s: float = 5.0
    backward_s: float = 1.0

    def __post_init__(self) -> None:
        if self.window_size <= 0 or self.inactivity_s <= 0 or self.backward_s <= 0:
            raise ValueError("window_size, inactivity_s and backward_s must be positive")

    @property
    def id(self) -> str:
        return f"w{self.window_size}_gap{self.inactivity_s:g}_bw{self.backward_s:g}"


FROZEN = WindowPolicy()


def candidate_policies() -> list[WindowPolicy]:
    return [WindowPolicy(w, gap, 1.0) for w in (25, 50, 100) for gap in (5.0, 30.0)]


def in_order(*more: str) -> Window:
    return Window.partitionBy("pcap_id", *more).orderBy("packet_index")


def upto(*more: str) -> Window:
    return in_order(*more).rowsBetween(Window.unboundedPreceding, 0)


def with_delta(packets: DataFrame) -> DataFrame:
    """delta: time since the packet before; null for a capture's first packet."""
    return packets.withColumn("delta", F.col("timestamp") - F.lag("timestamp").over(in_order()))


def is_cut(policy: WindowPolicy) -> Column:
    """Whether a packet begins a segment: both bounds are strict."""
    return F.coalesce((F.col("delta") > policy.inactivity_s) | (F.col("delta") < -policy.backward_s), F.lit(False))


def with_segments(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """delta, segment_index and position (in the segment). One window specification, so one sort."""
    cut = with_delta(packets).withColumn("_cut", is_cut(policy))
    out = cut.withColumn("segment_index", F.sum(F.col("_cut").cast("bigint")).over(upto())).withColumn("_n", F.row_number().over(in_order()).cast("bigint"))
    out = out.withColumn("position", F.col("_n") - F.max(F.when(F.col("_cut") | (F.col("_n") == 1), F.col("_n"))).over(upto()))
    return out.drop("_cut", "_n")


def with_windows(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """Also window_in_segment and offset (in the window); windows may be cut short, see full_windows."""
    size = F.lit(policy.window_size)
    out = with_segments(packets, policy)
    return out.withColumn("window_in_segment", F.expr(f"position DIV {policy.window_size}")).withColumn("offset", F.col("position") % size)


def numbered(windows: DataFrame) -> DataFrame:
    """window_index: windows by (segment, window in it), numbered over the capture."""
    return windows.withColumn("window_index", F.row_number().over(Window.partitionBy("pcap_id").orderBy("segment_index", "window_in_segment")).cast("bigint") - 1)


def window_table(packets: DataFrame, aggregates: dict[str, Column], policy: WindowPolicy = FROZEN, max_windows: int | None = None) -> DataFrame:
    """One row for each full window: keys, first and last packet, and the aggregates. No second shuffle: (pcap_id, ...) groups lie within captures."""
    own = with_windows(packets, policy).groupBy("pcap_id", "segment_index", "window_in_segment")
    named = [c.alias(n) for n, c in aggregates.items()]
    out = own.agg(F.count(F.lit(1)).alias("_n"), F.min("packet_index").alias("packet_index_start"), F.max("packet_index").alias("packet_index_end"), *named)
    out = numbered(out.where(F.col("_n") == policy.window_size))
    out = out.select("pcap_id", "segment_index", "window_index", "packet_index_start", "packet_index_end", *aggregates)
    return out if max_windows is None else out.where(F.col("window_index") < max_windows)


def without_failed_captures(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets of captures without a status of error, and the captures that have one: an error ends a capture, other statuses don't."""
    failed = packets.where(F.col("parse_status") == "error").groupBy("pcap_id").agg(F.min("packet_index").alias("first_error_index"))
    return packets.join(failed, "pcap_id", "left_anti"), failed


def strict(packets: DataFrame) -> DataFrame:
    """packets, failing at the first row whose status is error."""
    message = F.concat(F.lit("packet with status error in "), F.col("pcap_id"))
    return packets.withColumn("parse_status", F.when(F.col("parse_status") == "error", F.raise_error(message).cast("string")).otherwise(F.col("parse_status")))


def segment_table(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """pcap_id, segment_index, packets, full_windows."""
    own = with_segments(packets, policy).groupBy("pcap_id", "segment_index").agg(F.count(F.lit(1)).alias("packets"), F.min("packet_index").alias("first_packet"), F.max("packet_index").alias("last_packet"))
    return own.withColumn("full_windows", F.expr(f"packets DIV {policy.window_size}"))


def accounting(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """A capture's packets, segments, full windows, and what partial windows at segment ends drop; packets by status."""
    size = policy.window_size
    by_status = [F.count_if(F.col("parse_status") == s).alias(f"{s}_n") for s in ("ok", "partial", "unsupported", "malformed")]
    own = with_segments(packets, policy).groupBy("pcap_id", "segment_index").agg(F.count(F.lit(1)).alias("n"), *by_status)
    full = F.expr(f"n DIV {size}")
    return own.groupBy("pcap_id").agg(
        F.sum("n").alias("packets"), F.count(F.lit(1)).alias("segments"), F.sum(full).alias("full_windows"),
        F.count_if(F.col("n") % size > 0).alias("dropped_partial_windows"), F.sum(F.col("n") % size).alias("dropped_packets"),
        *[F.sum(f"{s}_n").alias(f"{s}_packets") for s in ("ok", "partial", "unsupported", "malformed")],
    )


def window_counts(packets: DataFrame, policy: WindowPolicy = FROZEN) -> DataFrame:
    """Only the number of full windows, from segment lengths."""
    return segment_table(packets.select("pcap_id", "packet_index", "timestamp"), policy).groupBy("pcap_id").agg(F.sum("full_windows").alias("full_windows"))


def chunked_segments(packets: DataFrame, policy: WindowPolicy = FROZEN, chunk: int = 1_000_000) -> DataFrame:
    """segment_index and position like with_segments, for captures too long for one task.

    packet_index must run from 0 without gaps. Chunks of ``chunk`` packets are cut on their own; one row a chunk (last time, cuts, place of the last cut)
    is then summed along the capture and added."""
    cid = F.expr(f"packet_index DIV {chunk}")
    rows = packets.withColumn("_c", cid)
    edges = rows.groupBy("pcap_id", "_c").agg(F.max_by("timestamp", "packet_index").alias("_last"))
    before = edges.select("pcap_id", (F.col("_c") + 1).alias("_c"), F.col("_last").alias("_before"))
    own = Window.partitionBy("pcap_id", "_c").orderBy("packet_index")
    rows = rows.join(before, ["pcap_id", "_c"], "left").withColumn("delta", F.col("timestamp") - F.coalesce(F.lag("timestamp").over(own), "_before"))
    rows = rows.withColumn("_cut", is_cut(policy) | (F.col("packet_index") == 0))
    sums = rows.groupBy("pcap_id", "_c").agg(F.count_if("_cut").alias("_cuts"), F.max(F.when(F.col("_cut"), F.col("packet_index"))).alias("_place"))
    along = Window.partitionBy("pcap_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pcap_id", "_c", F.coalesce(F.sum("_cuts").over(along), F.lit(0)).alias("_cuts_before"), F.max("_place").over(along).alias("_place_before"))
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, ["pcap_id", "_c"]).withColumn("segment_index", F.col("_cuts_before") + F.sum(F.col("_cut").cast("bigint")).over(run) - 1)
    out = out.withColumn("position", F.col("packet_index") - F.coalesce(F.max(F.when(F.col("_cut"), F.col("packet_index"))).over(run), "_place_before"))
    return out.drop("_c", "_cut", "_before", "_cuts_before", "_place_before")
