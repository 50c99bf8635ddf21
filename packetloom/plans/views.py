"""Packet, window, score and inventory views of the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import WindowPolicy

#: Gaps between a user's events are hours, so the policies are too.
SLOW = WindowPolicy(25, 200_000.0, 1.0)
CUTTING = WindowPolicy(5, 43_200.0, 1.0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


_K = "cast(coalesce(nullif(regexp_extract(props, '\"k\": *([0-9]+)', 1), ''), '0') as int)"
#: Columns derived from an event; the same text runs in both engines.
_EVENT_COLUMNS = {
    "is_ipv4": "event_type IN ('view', 'click')",
    "is_ipv6": "event_type = 'purchase'",
    "is_arp": "event_type = 'signup'",
    "is_llc": "event_type = 'error' AND k % 3 = 0",
    "is_tcp": "event_type IN ('view', 'purchase')",
    "is_udp": "event_type = 'click' AND k % 4 <> 0",
    "is_icmp": "event_type = 'click' AND k % 4 = 0",
    "is_icmpv6": "false",
    "is_igmp": "false",
    "src_ip": "CASE WHEN event_type = 'signup' THEN concat('10.0.0.', cast(k % 5 as string)) WHEN event_type = 'error' THEN NULL ELSE concat('10.1.', cast(k % 7 as string), '.', cast(k % 13 as string)) END",
    "dst_ip": "CASE WHEN event_type = 'signup' THEN concat('10.0.0.', cast(k % 3 as string)) WHEN event_type = 'error' OR k % 9 = 0 THEN NULL ELSE concat('10.1.', cast(k % 6 as string), '.', cast(k % 11 as string)) END",
    "src_port": "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1024 + k % 17 END",
    "dst_port": "CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN k % 8 = 0 THEN 1883 ELSE 443 END WHEN event_type = 'click' THEN 53 END",
    "tcp_flags": "CASE WHEN event_type IN ('view', 'purchase') THEN k % 64 END",
    "arp_op": "CASE WHEN event_type = 'signup' THEN 1 + k % 2 END",
    "arp_sha": "CASE WHEN event_type = 'signup' AND k % 10 <> 9 THEN concat('aa:bb:cc:dd:ee:0', cast(k % 4 as string)) END",
    "src_mac": "CASE WHEN k % 6 <> 5 THEN concat('aa:bb:cc:dd:ee:0', cast(k % 3 as string)) END",
    "parse_status": "CASE WHEN event_id % 97 = 5 THEN 'malformed' WHEN event_id % 53 = 7 THEN 'partial' WHEN event_id % 31 = 3 THEN 'unsupported' ELSE 'ok' END",
    "parse_detail": "CASE WHEN event_id % 97 = 5 THEN CASE WHEN k % 2 = 0 THEN 'ethernet unpack failed' ELSE 'raw ipv4 unpack failed' END WHEN event_id % 53 = 7 THEN CASE WHEN k % 3 = 0 THEN 'tcp decode failed' WHEN k % 3 = 1 THEN 'arp decode failed' ELSE 'other' END WHEN event_id % 31 = 3 THEN 'unsupported ethertype: 0x88cc' END",
    "protocol_name": "CASE WHEN event_id % 31 = 3 THEN CASE WHEN k % 2 = 0 THEN 'lldp' ELSE 'ethertype_0x88b5' END WHEN event_type IN ('view', 'purchase') THEN 'tcp' WHEN event_type = 'click' THEN 'udp' WHEN event_type = 'signup' THEN 'arp' ELSE 'llc' END",
}
_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: a user is a capture, event_id the order."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pcap_id"), F.col("event_id").alias("packet_index"), _seconds("ts").alias("timestamp"), (60 + F.round(F.col("value") * 2).cast("bigint")).alias("frame_length"), F.lit(1).alias("linktype"), F.expr(_K).alias("k"), "event_type", "event_id", "value")
    e = e.select("*", *[F.expr(x).alias(n) for n, x in _EVENT_COLUMNS.items()])
    return e.withColumns({f"tcp_flag_{f}": F.coalesce(F.col("tcp_flags").bitwiseAND(bit) != 0, F.lit(False)) for f, bit in _FLAGS.items()})


def lineitem_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packets: a supplier is a capture; ship dates go back and forth."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("pcap_id"), (F.row_number().over(order) - 1).cast("bigint").alias("packet_index"), _seconds("l_shipdate").alias("timestamp"), F.col("l_quantity").cast("bigint").alias("frame_length"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a score table: y, score, capture, family and lineage."""
    e = read(spark, sf_dir, "events")
    family = F.expr("CASE WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'DoS' WHEN 2 THEN 'MQTT' WHEN 3 THEN 'Recon' ELSE 'Spoofing' END END")
    return e.select(F.col("user_id").cast("string").alias("pcap_id"), (F.col("event_type") == "error").cast("int").alias("y"), (F.round(F.col("value")) / 600).alias("score"), family.alias("attack_family"), F.expr("CASE WHEN event_type <> 'error' THEN event_type END").alias("benign_category"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as an inventory of captures."""
    return read(spark, sf_dir, "supplier").selectExpr(*[f"{x} AS {n}" for n, x in CAPTURE_COLUMNS.items()])


CAPTURE_COLUMNS = {
    "pcap_path": "CASE WHEN s_suppkey % 4 = 0 THEN concat('attacks/pcap/train/Benign_train', cast(s_suppkey as string), '.pcap') WHEN s_suppkey % 4 = 1 THEN concat('attacks/pcap/train/TCP_IP-DDoS-UDP', cast(s_suppkey as string), '_train.pcap') WHEN s_suppkey % 4 = 2 THEN concat('attacks/pcap/train/Recon-Port_Scan_train', cast(s_suppkey as string), '.pcap') ELSE concat('profiling/PCAP/Power/SenseU_Power', cast(s_suppkey as string), '.pcap') END",
    "source": "CASE WHEN s_suppkey % 4 < 3 THEN 'attacks' ELSE 'profiling' END",
    "split": "CASE WHEN s_suppkey % 10 < 8 THEN 'train' ELSE 'test' END",
    "binary_label": "CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'ATTACK' WHEN s_suppkey % 41 = 3 THEN 'UNKNOWN' ELSE 'BENIGN' END",
    "attack_family": "CASE WHEN s_suppkey % 4 = 1 THEN 'DDoS' WHEN s_suppkey % 4 = 2 THEN 'Recon' END",
    "attack_type": "CASE WHEN s_suppkey % 4 = 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'DDoS_UDP' ELSE 'DDoS_SYN' END WHEN s_suppkey % 4 = 2 THEN 'Port_Scan' END",
    "profiling_type": "CASE WHEN s_suppkey % 4 = 3 THEN CASE WHEN s_suppkey % 5 = 0 THEN 'idle' WHEN s_suppkey % 5 = 1 THEN 'interaction' ELSE 'power' END END",
    "device": "CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 5 <> 0 THEN 'SenseU' END",
    "file_size": "cast(round(abs(s_acctbal)) as bigint)",
    "window_count": "cast(1 + (s_suppkey * 7919) % 5000 as bigint)",
    "s_suppkey": "s_suppkey",
    "s_nationkey": "s_nationkey",
}


def duck(expression: str) -> str:
    return expression.replace(" as string)", " as varchar)")


#: The event view, as the start of a WITH list.
EVENTS_SQL = (
    "e AS (SELECT user_id::VARCHAR AS pcap_id, event_id AS packet_index, epoch_us(ts) / 1e6::DOUBLE AS timestamp, 60 + round(value * 2)::BIGINT AS frame_length, "
    + duck(_K)
    + " AS k, event_type, event_id, value FROM events), p0 AS (SELECT *, "
    + ", ".join(f"{duck(x)} AS {n}" for n, x in _EVENT_COLUMNS.items())
    + " FROM e), p AS (SELECT *, "
    + ", ".join(f"coalesce(tcp_flags & {b} <> 0, false) AS tcp_flag_{f}" for f, b in _FLAGS.items())
    + " FROM p0)"
)
LINEITEM_SQL = "p AS (SELECT l_suppkey::VARCHAR AS pcap_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS packet_index, epoch_us(l_shipdate) / 1e6::DOUBLE AS timestamp, l_quantity::BIGINT AS frame_length FROM lineitem)"
DELTA_SQL = "d AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY pcap_id ORDER BY packet_index) AS delta, row_number() OVER (PARTITION BY pcap_id ORDER BY packet_index) AS rn FROM p)"
SCORES_SQL = "s AS (SELECT user_id::VARCHAR AS pcap_id, (event_type = 'error')::INT AS y, round(value) / 600 AS score, CASE WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'DoS' WHEN 2 THEN 'MQTT' WHEN 3 THEN 'Recon' ELSE 'Spoofing' END END AS attack_family, CASE WHEN event_type <> 'error' THEN event_type END AS benign_category FROM events)"
CAPTURES_SQL = "c AS (SELECT " + ", ".join(f"{duck(x)} AS {n}" for n, x in CAPTURE_COLUMNS.items()) + " FROM supplier)"


def segments_sql(policy: WindowPolicy) -> str:
    """d -> g: segment_index, position; n is the segment's length."""
    return (
        f"{DELTA_SQL}, g0 AS (SELECT *, sum(CASE WHEN delta > {policy.inactivity_s} OR delta < -{policy.backward_s} THEN 1 ELSE 0 END) OVER (PARTITION BY pcap_id ORDER BY packet_index ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_index FROM d), "
        "g AS (SELECT *, row_number() OVER (PARTITION BY pcap_id, segment_index ORDER BY packet_index) - 1 AS position, count(*) OVER (PARTITION BY pcap_id, segment_index) AS n FROM g0)"
    )


def windows_sql(policy: WindowPolicy) -> str:
    """g -> w: packets of full windows with window_index and offset."""
    size = policy.window_size
    return (
        f"{segments_sql(policy)}, w0 AS (SELECT *, position // {size} AS wis, position % {size} AS off FROM g WHERE n >= (position // {size} + 1) * {size}), "
        "w AS (SELECT *, dense_rank() OVER (PARTITION BY pcap_id ORDER BY segment_index, wis) - 1 AS window_index FROM w0)"
    )
