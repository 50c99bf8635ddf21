"""Queries over the split, the test inventory and resumed builds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, sinks, windows
from . import views as V

C = "WITH " + V.CAPTURES_SQL
E = "WITH " + V.EVENTS_SQL
_CAPTURE = "CASE WHEN s_suppkey % 4 = 2 THEN 'attacks/pcap/test/Recon-Port_Scan_test.pcap' ELSE pcap_path END"
_LABEL = "CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'ATTACK' ELSE 'BENIGN' END"
_SPLIT = "CASE WHEN s_suppkey % 3 = 0 THEN 'validation' ELSE 'fit' END"
_KIND = "CASE WHEN s_suppkey % 4 = 0 THEN 'publisher_benign' WHEN s_suppkey % 4 = 1 AND s_suppkey % 5 = 1 THEN 'spoofing' END"
_CATEGORY = "CASE WHEN s_suppkey % 4 = 3 THEN ' profiling_power' END"
_TYPE = "CASE WHEN s_suppkey % 4 = 2 AND s_suppkey % 7 = 2 THEN 'MQTT_Malformed_Data' ELSE attack_type END"
_SHARD = "concat('features/pcap_id=', {id})"


def _id(sql: bool) -> str:
    return "s_suppkey::VARCHAR" if sql else "cast(s_suppkey as string)"


def _test_captures(s, d) -> DataFrame:
    return V.captures(s, d).withColumn("pcap_path", F.expr(_CAPTURE)).withColumn("binary_label", F.expr(_LABEL))


def _split_rows(s, d) -> DataFrame:
    own = V.captures(s, d).withColumns({"modeling_split": F.expr(_SPLIT), "group_kind": F.expr(_KIND), "benign_category": F.expr(_CATEGORY), "binary_label": F.expr(_LABEL), "attack_type": F.expr(_TYPE)})
    return own.withColumn("pcap_id", F.expr(_id(False))).withColumn("feature_parquet_path", F.expr(_SHARD.format(id=_id(False))))


_ROWS = f"r AS (SELECT * REPLACE ({_LABEL} AS binary_label, {_TYPE} AS attack_type), {_SPLIT} AS modeling_split, {_KIND} AS group_kind, {_CATEGORY} AS benign_category, {_id(True)} AS pcap_id FROM c)"


def _probe_groups(s, d) -> DataFrame:
    return _split_rows(s, d).select("pcap_id", S.arp_probe_group().alias("arp_group"), S.mqtt_probe_group(F.col("s_nationkey") % 2 == 0).alias("mqtt_group"))


_PROBE_SQL = f"""{C}, {_ROWS} SELECT pcap_id,
 CASE WHEN modeling_split = 'fit' THEN CASE WHEN attack_family = 'Spoofing' OR group_kind = 'spoofing' THEN 'spoofing' WHEN binary_label = 'BENIGN' AND group_kind = 'publisher_benign' THEN 'publisher_benign'
   WHEN binary_label = 'BENIGN' AND benign_category IS NOT NULL THEN 'profiling_benign' END END AS arp_group,
 CASE WHEN modeling_split = 'fit' THEN CASE WHEN attack_type = 'MQTT_Malformed_Data' THEN 'mqtt_malformed' WHEN binary_label = 'BENIGN' AND s_nationkey % 2 = 0 THEN CASE WHEN group_kind = 'publisher_benign' THEN 'publisher_benign' ELSE 'profiling_benign' END END END AS mqtt_group
 FROM r"""
_CODES = {"DDoS": 1, "Recon": 2, "benign": 10}
_WINDOWING = "SELECT pcap_path, CASE WHEN s_suppkey % 6 = 0 THEN '25' WHEN s_suppkey % 6 = 1 THEN '25.0' WHEN s_suppkey % 6 = 2 THEN 'x' ELSE '50' END AS window_size, CASE WHEN s_suppkey % 5 = 0 THEN '30' ELSE '5.0' END AS inactivity_timeout_seconds, '1' AS backward_reset_seconds FROM"


def _manifest(s, d) -> DataFrame:
    return V.captures(s, d).select(F.expr(_id(False)).alias("pcap_id"), "binary_label", F.col("window_count").alias("output_row_count"), F.lit("OK ").alias("status"))


def _test_integrity(s, d) -> DataFrame:
    own = _manifest(s, d).withColumn("pcap_id", F.expr("CASE WHEN cast(pcap_id as int) % 50 = 7 THEN '1' ELSE pcap_id END"))
    fitted = _manifest(s, d).select(F.expr("CASE WHEN cast(pcap_id as int) % 11 = 0 THEN pcap_id ELSE concat('f', pcap_id) END").alias("pcap_id"))
    return catalog.test_inventory_violations(own, fitted, 5, 7)


#: A change of each pinned field, by which captures it befalls.
_CHANGED = {"pcap_path": 3, "binary_label": 4, "output_path": 5, "input_file_size": 6, "feature_strategy_version": 7, "feature_build_strategy_version": 8, "feature_schema_sha256": 9, "policy": 10}


def _resume_fields(s, d) -> DataFrame:
    """Captures that are built again, as one of their pinned fields has changed since, or their build had failed."""
    labels = V.captures(s, d).withColumn("pcap_id", F.expr(_id(False)))
    asked = sinks.wanted(labels, "features", windows.FROZEN)
    number = F.col("pcap_id").cast("int") % 23
    old = asked.withColumns({c: F.when(number == k, F.lit(-1) if c == "input_file_size" else F.lit("other")).otherwise(F.col(c)).cast(asked.schema[c].dataType) for c, k in _CHANGED.items()})
    old = old.withColumn("status", F.when(number == 11, "error").otherwise("ok"))
    return catalog.pending(asked, old, list(sinks.PINNED)).select("pcap_id", "input_file_size")


def _packed(s, d) -> DataFrame:
    return V.event_packets(s, d).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip IS NOT NULL").groupBy(F.lower(F.hex(S.packed_ip(F.col("ip")))).alias("packed")).agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "CASE WHEN lower(profiling_type) = 'idle' THEN 'idle' WHEN contains(lower(path), 'owltron') AND lower(profiling_type) = 'interaction' THEN 'owltron_interaction' WHEN contains(lower(path), 'owltron') AND lower(profiling_type) = 'power' THEN 'owltron_power' END"

QUERIES = {
    "test_metadata": (lambda s, d: catalog.with_test_metadata(_test_captures(s, d)).select("s_suppkey", "attack_family", "attack_type", "benign_category"), f"{C} SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'DDoS' WHEN 2 THEN 'Recon' ELSE '' END AS attack_family, CASE s_suppkey % 4 WHEN 1 THEN 'DDoS_UDP' WHEN 2 THEN 'Port_Scan' ELSE '' END AS attack_type, CASE WHEN s_suppkey % 4 IN (1, 2) THEN '' WHEN contains(pcap_path, '/Benign') THEN 'publisher' WHEN contains(lower(pcap_path), '/power/') THEN 'profiling_power' WHEN contains(lower(pcap_path), '/idle/') THEN 'profiling_idle' ELSE 'profiling_interaction' END AS benign_category FROM c"),
    "probe_groups": (_probe_groups, _PROBE_SQL),
    "group_codes": (lambda s, d: V.captures(s, d).select("s_suppkey", S.group_code(F.coalesce("attack_family", F.lit("benign")), _CODES).alias("code")), f"{C} SELECT s_suppkey, CASE attack_family WHEN 'DDoS' THEN 1 WHEN 'Recon' THEN 2 ELSE 10 END AS code FROM c"),
    "validation_specs": (lambda s, d: catalog.validation_rows(_split_rows(s, d)).select("pcap_id", "feature_parquet_path"), f"{C}, {_ROWS} SELECT pcap_id, 'features/pcap_id=' || pcap_id AS feature_parquet_path FROM r WHERE modeling_split = 'validation'"),
    "frozen_policy_rows": (lambda s, d: catalog.frozen_policy_rows(V.captures(s, d).selectExpr(*[x.strip() for x in ("pcap_path", "CASE WHEN s_suppkey % 6 = 0 THEN '25' WHEN s_suppkey % 6 = 1 THEN '25.0' WHEN s_suppkey % 6 = 2 THEN 'x' ELSE '50' END AS window_size", "CASE WHEN s_suppkey % 5 = 0 THEN '30' ELSE '5.0' END AS inactivity_timeout_seconds", "'1' AS backward_reset_seconds")]), windows.FROZEN), f"{C}, w AS ({_WINDOWING} c) SELECT * FROM w WHERE try_cast(window_size AS DOUBLE) = 25 AND try_cast(inactivity_timeout_seconds AS DOUBLE) = 5 AND try_cast(backward_reset_seconds AS DOUBLE) = 1"),
    "manifest_inventory": (lambda s, d: catalog.manifest_inventory(_manifest(s, d)), f"{C} SELECT count(*) AS pcap_count, count_if(binary_label = 'ATTACK') AS attack_pcaps, count_if(binary_label = 'BENIGN') AS benign_pcaps, sum(window_count)::BIGINT AS total_feature_rows FROM c"),
    "test_inventory_integrity": (_test_integrity, f"{C}, t AS (SELECT CASE WHEN s_suppkey % 50 = 7 THEN '1' ELSE s_suppkey::VARCHAR END AS pcap_id, window_count FROM c), f AS (SELECT s_suppkey::VARCHAR AS pcap_id FROM c WHERE s_suppkey % 11 = 0) SELECT 'capture_count' AS violation, NULL AS pcap_id FROM t HAVING count(*) <> 5 UNION ALL SELECT 'row_count', NULL FROM t HAVING sum(window_count) <> 7 UNION ALL SELECT 'duplicate_pcap', pcap_id FROM t GROUP BY pcap_id HAVING count(*) > 1 UNION ALL (SELECT 'also_in_training', pcap_id FROM (SELECT pcap_id FROM t INTERSECT SELECT pcap_id FROM f))"),
    "checkpoint_ids": (lambda s, d: V.captures(s, d).select("s_suppkey", S.checkpoint_id(F.col("pcap_path")).alias("checkpoint_id")), f"{C} SELECT s_suppkey, sha256(pcap_path) AS checkpoint_id FROM c"),
    "relative_paths": (lambda s, d: V.captures(s, d).select("s_suppkey", S.repo_relative(F.col("pcap_path"), "attacks/pcap").alias("path")), f"{C} SELECT s_suppkey, CASE WHEN starts_with(pcap_path, 'attacks/pcap/') THEN substr(pcap_path, 14) ELSE pcap_path END AS path FROM c"),
    "report_buckets": (lambda s, d: V.captures(s, d).withColumn("path", F.expr("CASE WHEN s_suppkey % 2 = 1 THEN concat('x/Owltron/', pcap_path) ELSE pcap_path END")).select("s_suppkey", S.report_bucket("path").alias("bucket")), f"{C}, p AS (SELECT *, CASE WHEN s_suppkey % 2 = 1 THEN 'x/Owltron/' || pcap_path ELSE pcap_path END AS path FROM c) SELECT s_suppkey, {_BUCKET} AS bucket FROM p"),
    "resume_fields": (_resume_fields, f"{C} SELECT s_suppkey::VARCHAR AS pcap_id, file_size AS input_file_size FROM c WHERE s_suppkey % 23 BETWEEN 3 AND 11"),
    "packed_ip": (_packed, f"{E}, i AS (SELECT unnest([src_ip, dst_ip]) AS ip FROM p) SELECT " + " || ".join(f"printf('%02x', split_part(ip, '.', {i})::INT)" for i in (1, 2, 3, 4)) + " AS packed, count(*) AS n FROM i WHERE ip IS NOT NULL GROUP BY ALL"),
}
