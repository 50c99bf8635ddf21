"""Queries over inventories, splits, samples and constraints, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, features, quality, sampling, stats, windows
from . import views as V
from .packets import FEATURES_SQL, _r, rounded

C = "WITH " + V.CAPTURES_SQL
_STEM = "regexp_replace(split_part(pcap_path, '/', -1), '\\.[^.]*$', '')"
_PID = f"{_STEM} || '-' || substr(sha256(pcap_path), 1, 16)"
_KEY = f"CASE WHEN binary_label = 'ATTACK' THEN attack_family || '|' || attack_type WHEN source = 'attacks' THEN 'benign|publisher|' || {_STEM} WHEN device IS NOT NULL THEN 'benign|device|' || device ELSE 'benign|singleton|' || {_STEM} END"
_SEED = "('0x' || substr(sha256('" + S.SEED_VERSION + "|42|' || {x}), 1, 16))::UBIGINT"
_CAT = "CASE WHEN source = 'attacks' OR profiling_type IS NULL THEN 'publisher_benign' ELSE 'profiling_' || profiling_type END"


def _labelled(s, d) -> DataFrame:
    return V.captures(s, d).where("binary_label <> 'UNKNOWN'")


def _grouped(s, d) -> DataFrame:
    return _labelled(s, d).withColumn("modeling_group_key", S.group_key()).withColumn("pcap_id", S.pcap_id(F.col("pcap_path")))


_CAPS = {"DDoS": 9_000, "DoS": 10, "MQTT": 10, "Recon": 20_000, "Spoofing": None, "BENIGN": None}
_L = f"{C}, l AS (SELECT *, {_KEY} AS modeling_group_key, {_PID} AS pcap_id, CASE WHEN binary_label = 'BENIGN' THEN NULL WHEN attack_family = 'DDoS' THEN 9000 ELSE 20000 END AS cap FROM c WHERE binary_label <> 'UNKNOWN')"
_ALLOC = f"{_L}, a AS (SELECT *, sum(window_count) OVER (PARTITION BY modeling_group_key)::BIGINT AS total FROM l), b AS (SELECT *, cap * (window_count / total) AS exact, least(window_count, floor(cap * (window_count / total)))::BIGINT AS fl FROM a), r AS (SELECT *, cap - sum(fl) OVER (PARTITION BY modeling_group_key) AS rest, (fl < window_count)::INT AS room FROM b), al AS (SELECT *, CASE WHEN cap IS NULL OR total <= cap THEN window_count ELSE fl + CASE WHEN room = 1 AND sum(room) OVER (PARTITION BY modeling_group_key ORDER BY exact - floor(exact) DESC, pcap_path ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END END::BIGINT AS selected FROM r)"
_SIM = f"{C}, l AS (SELECT *, CASE WHEN binary_label = 'BENIGN' THEN 'BENIGN' ELSE attack_family END AS family, CASE WHEN attack_family = 'DDoS' AND binary_label = 'ATTACK' THEN least(window_count, 8000) ELSE window_count END AS selected FROM c WHERE binary_label <> 'UNKNOWN'), b AS (SELECT family, count(*) AS captures, sum(window_count)::BIGINT AS available, sum(selected)::BIGINT AS kept FROM l GROUP BY family), t AS (SELECT sum(kept) FILTER (WHERE family <> 'BENIGN') AS ak, sum(kept) FILTER (WHERE family = 'BENIGN') AS bk FROM b)"
_FILES = "SELECT pcap_path, CASE WHEN s_suppkey % 17 = 2 THEN file_size + 1 ELSE file_size END AS length FROM c WHERE s_suppkey % 13 <> 5 UNION ALL SELECT 'extra/' || s_suppkey::VARCHAR, 1::BIGINT FROM c WHERE s_suppkey % 19 = 4"
_SPLITS = "SELECT pcap_path, CASE WHEN s_suppkey % 23 = 3 THEN 'other' ELSE split END AS csv_split FROM c WHERE s_suppkey % 11 <> 6 UNION ALL SELECT 'gone/' || s_suppkey::VARCHAR, 'train' FROM c WHERE s_suppkey % 29 = 1"


def _reconciled(s, d):
    c = V.captures(s, d)
    key = F.col("s_suppkey").cast("string")
    files = c.where("s_suppkey % 13 <> 5").selectExpr("pcap_path", "CASE WHEN s_suppkey % 17 = 2 THEN file_size + 1 ELSE file_size END AS length").unionByName(c.where("s_suppkey % 19 = 4").select(F.concat(F.lit("extra/"), key).alias("pcap_path"), F.lit(1).cast("bigint").alias("length")))
    splits = c.where("s_suppkey % 11 <> 6").selectExpr("pcap_path", "CASE WHEN s_suppkey % 23 = 3 THEN 'other' ELSE split END AS split").unionByName(c.where("s_suppkey % 29 = 1").select(F.concat(F.lit("gone/"), key).alias("pcap_path"), F.lit("train").alias("split")))
    return catalog.reconcile(c, splits, files)


def _broken(s, d):
    f = features.base_features(V.event_packets(s, d), V.SLOW)
    return f.withColumn("arp_ratio", F.expr("CASE WHEN cast(pcap_id as int) % 7 = 1 AND window_index = 0 THEN 1.5D ELSE arp_ratio END"))


def _issues(s, d):
    return quality.file_observations(stats.integrity(V.event_packets(s, d)))


_PATHS = "attacks/pcap/train/ARP_Spoofing_train.pcap attacks/pcap/test/TCP_IP-DoS-SYN12_test.pcap attacks/pcap/train/Odd_train.pcap attacks/pcap/train/Recon-VulScan_test.pcap attacks/pcap/Benign_train.pcap profiling/PCAP/Idle/Idle.pcap profiling/PCAP/Power/SenseU_Power.pcap profiling/PCAP/Interactions/Singcall/Singcall_LAN_1.pcap profiling/PCAP/Odd/x.pcap elsewhere/x.pcap".split()


def _classified(s, d):
    files = V.read(s, d, "region").select(F.explode(F.array(*map(F.lit, _PATHS))).alias("pcap_path"), F.lit(1).cast("bigint").alias("file_size")).distinct()
    return catalog.classify(files).select("pcap_path", "source", "split", "binary_label", "attack_type", "profiling_type", "device", "capture_session", "grouping_key", "unresolved_reason")


_CLASSIFIED = [
    ("attacks/pcap/train/ARP_Spoofing_train.pcap", "attacks", "train", "ATTACK", "ARP_Spoofing", None, None, "ARP_Spoofing", "attacks:ARP_Spoofing:train:ARP_Spoofing", None),
    ("attacks/pcap/test/TCP_IP-DoS-SYN12_test.pcap", "attacks", "test", "ATTACK", "DoS_SYN", None, None, "DoS_SYN_12", "attacks:DoS_SYN:test:DoS_SYN_12", None),
    ("attacks/pcap/train/Odd_train.pcap", "attacks", "train", "UNKNOWN", None, None, None, None, "unresolved:attacks/pcap/train/Odd_train.pcap", "unrecognized attack label: Odd"),
    ("attacks/pcap/train/Recon-VulScan_test.pcap", "attacks", "train", "UNKNOWN", None, None, None, None, "unresolved:attacks/pcap/train/Recon-VulScan_test.pcap", "contradictory split: directory=train, filename=test"),
    ("attacks/pcap/Benign_train.pcap", "attacks", "train", "UNKNOWN", None, None, None, None, "unresolved:attacks/pcap/Benign_train.pcap", "attack PCAP missing train/test directory"),
    ("profiling/PCAP/Idle/Idle.pcap", "profiling", None, "BENIGN", None, "idle", None, "Idle", "profiling:singleton:Idle", None),
    ("profiling/PCAP/Power/SenseU_Power.pcap", "profiling", None, "BENIGN", None, "power", "SenseU", "SenseU_Power", "profiling:device:SenseU", None),
    ("profiling/PCAP/Interactions/Singcall/Singcall_LAN_1.pcap", "profiling", None, "BENIGN", None, "interaction", "Singcall", "Singcall_LAN_1", "profiling:device:Singcall", None),
    ("profiling/PCAP/Odd/x.pcap", "profiling", "train", "UNKNOWN", None, None, None, None, "unresolved:profiling/PCAP/Odd/x.pcap", "unrecognized profiling experiment folder: Odd"),
    ("elsewhere/x.pcap", "unknown", "train", "UNKNOWN", None, None, None, None, "unresolved:elsewhere/x.pcap", "PCAP outside attacks/ or profiling/ trees"),
]
_CLASSIFIED_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in _CLASSIFIED) + ") AS t(pcap_path, source, split, binary_label, attack_type, profiling_type, device, capture_session, grouping_key, unresolved_reason)"
_BUCKETS = {
    "windowing": "CASE WHEN binary_label = 'ATTACK' THEN attack_family WHEN binary_label = 'BENIGN' AND source = 'attacks' THEN 'publisher_benign' WHEN profiling_type IN ('idle', 'interaction', 'power') THEN 'profiling_' || profiling_type ELSE 'other' END",
    "features": "CASE WHEN profiling_type IS NOT NULL THEN 'profiling_' || profiling_type WHEN attack_family IS NOT NULL THEN attack_family WHEN binary_label = 'BENIGN' THEN 'publisher_benign' ELSE 'other' END",
    "audit": "CASE WHEN binary_label = 'ATTACK' THEN attack_family WHEN source = 'attacks' THEN 'publisher_benign' WHEN profiling_type IN ('idle', 'interaction', 'power') THEN 'profiling_' || profiling_type ELSE 'profiling_other' END",
    "smoke": "CASE WHEN profiling_type IS NOT NULL THEN 'profiling_' || profiling_type WHEN attack_family IS NOT NULL THEN attack_family WHEN source = 'attacks' AND binary_label = 'BENIGN' THEN 'publisher_benign' ELSE binary_label END",
}
_INT = "q AS (SELECT pcap_id, count(*) AS n, count_if(parse_status = 'malformed') AS mal, count_if(parse_status = 'partial') AS par, count_if(parse_status = 'unsupported') AS uns, count_if(delta = 0) AS dup, count_if(delta < 0) AS neg FROM d GROUP BY pcap_id)"

QUERIES = {
    "classify_paths": (_classified, _CLASSIFIED_SQL),
    "taxonomy": (lambda s, d: V.captures(s, d).where("source = 'attacks'").select("s_suppkey", S.attack_family(S.base_label(S.stem(F.col("pcap_path")))).alias("family"), S.attack_type(S.base_label(S.stem(F.col("pcap_path")))).alias("type"), S.replicate(S.base_label(S.stem(F.col("pcap_path")))).alias("replicate")), f"{C} SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'DDoS' END AS family, CASE WHEN s_suppkey % 4 = 1 THEN 'DDoS_UDP' END AS type, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey::INT END AS replicate FROM c WHERE source = 'attacks'"),
    "pcap_id_hash": (lambda s, d: V.captures(s, d).select("s_suppkey", S.pcap_id(F.col("pcap_path")).alias("pcap_id")), f"{C} SELECT s_suppkey, {_PID} AS pcap_id FROM c"),
    "stable_seed": (lambda s, d: V.captures(s, d).select("s_suppkey", S.seed_u64(F.col("pcap_path")).cast("string").alias("seed")), f"{C} SELECT s_suppkey, {_SEED.format(x='pcap_path')}::VARCHAR AS seed FROM c"),
    "seed_xor": (lambda s, d: V.captures(s, d).select("s_suppkey", S.xor_u64(S.seed_u64(F.col("pcap_path")), S.seed_u64(F.col("source"))).cast("string").alias("x")), f"{C} SELECT s_suppkey, xor({_SEED.format(x='pcap_path')}, {_SEED.format(x='source')})::VARCHAR AS x FROM c"),
    "modeling_group_key": (lambda s, d: _grouped(s, d).select("s_suppkey", "modeling_group_key", S.benign_category().alias("category")), f"{_L} SELECT s_suppkey, modeling_group_key, {_CAT} AS category FROM l"),
    "summary_buckets": (lambda s, d: _labelled(s, d).select("s_suppkey", S.bucket_windowing().alias("windowing"), S.bucket_features().alias("features"), S.bucket_audit().alias("audit"), S.bucket_smoke().alias("smoke")), f"{_L} SELECT s_suppkey, " + ", ".join(f"{x} AS {n}" for n, x in _BUCKETS.items()) + " FROM l"),
    "encode_labels": (lambda s, d: _labelled(s, d).groupBy(S.encode_label().alias("y")).agg(F.count(F.lit(1)).alias("n")), f"{_L} SELECT (binary_label = 'ATTACK')::INT AS y, count(*) AS n FROM l GROUP BY ALL"),
    "train_filter": (lambda s, d: catalog.train_rows(V.captures(s, d)).select("pcap_path", "binary_label"), f"{C} SELECT pcap_path, binary_label FROM c WHERE split = 'train' AND binary_label IN ('BENIGN', 'ATTACK')"),
    "inventory_summary": (lambda s, d: catalog.inventory_summary(V.captures(s, d)), f"{C} SELECT source, split, count(*) AS captures, count_if(binary_label = 'ATTACK') AS attack, count_if(binary_label = 'BENIGN') AS benign, count_if(binary_label = 'UNKNOWN') AS unknown, sum(file_size)::BIGINT AS bytes FROM c GROUP BY ALL"),
    "split_summary": (lambda s, d: catalog.split_summary(_labelled(s, d)), f"{_L} SELECT split, CASE WHEN binary_label = 'ATTACK' THEN attack_family ELSE {_CAT} END AS category, count(*) AS captures, sum(window_count)::BIGINT AS windows, count(DISTINCT modeling_group_key) AS groups FROM l GROUP BY ALL"),
    "inventory_errors": (lambda s, d: catalog.inventory_errors(V.captures(s, d).withColumn("filename", F.col("pcap_path")).withColumn("dataset_scope", F.expr("CASE WHEN s_suppkey % 9 <> 0 THEN 'x' END")).withColumn("unresolved_reason", F.lit(None).cast("string")).withColumn("split", F.expr("CASE WHEN s_suppkey % 6 = 0 THEN 'odd' ELSE split END"))), f"{C} SELECT pcap_path, 'missing required field: dataset_scope' AS error FROM c WHERE s_suppkey % 9 = 0 UNION ALL SELECT pcap_path, 'invalid split: ''odd''' FROM c WHERE s_suppkey % 6 = 0 AND binary_label <> 'UNKNOWN' UNION ALL SELECT pcap_path, 'UNKNOWN rows require unresolved_reason' FROM c WHERE binary_label = 'UNKNOWN'"),
    "reconcile_full_outer": (_reconciled, f"{C}, f AS ({_FILES}), s AS ({_SPLITS}), j AS (SELECT coalesce(c.pcap_path, s.pcap_path, f.pcap_path) AS pcap_path, c.pcap_path IS NOT NULL AS i, s.pcap_path IS NOT NULL AS x, f.pcap_path IS NOT NULL AS k, split, csv_split, file_size, length FROM c FULL JOIN s ON c.pcap_path = s.pcap_path FULL JOIN f ON coalesce(c.pcap_path, s.pcap_path) = f.pcap_path) SELECT pcap_path, 'manifest:missing_from_split' AS issue_code FROM j WHERE i AND NOT x UNION ALL SELECT pcap_path, 'manifest:missing_from_inventory' FROM j WHERE x AND NOT i UNION ALL SELECT pcap_path, 'manifest:split_mismatch' FROM j WHERE i AND x AND split <> csv_split UNION ALL SELECT pcap_path, 'manifest:missing_pcap' FROM j WHERE i AND NOT k UNION ALL SELECT pcap_path, 'manifest:extra_pcap' FROM j WHERE k AND NOT i UNION ALL SELECT pcap_path, 'manifest:file_size_mismatch' FROM j WHERE i AND k AND file_size <> length"),
    "set_disjoint": (lambda s, d: catalog.overlap(_grouped(s, d).where("s_suppkey % 2 = 0"), _grouped(s, d).where("s_suppkey % 3 = 0")), f"{_L} SELECT pcap_id FROM l WHERE s_suppkey % 2 = 0 INTERSECT SELECT pcap_id FROM l WHERE s_suppkey % 3 = 0"),
    "set_coverage": (lambda s, d: catalog.uncovered(_grouped(s, d), _grouped(s, d).where("s_suppkey % 2 = 0"), _grouped(s, d).where("s_suppkey % 3 = 0")), f"{_L} SELECT pcap_id, 'missing' AS \"where\" FROM l WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0"),
    "anti_join_missing": (lambda s, d: V.captures(s, d).join(V.captures(s, d).where("s_suppkey % 13 <> 5"), "pcap_path", "left_anti").select("pcap_path"), f"{C} SELECT pcap_path FROM c WHERE s_suppkey % 13 = 5"),
    "semi_join_selected": (lambda s, d: catalog.selected(V.captures(s, d).withColumn("filename", F.col("pcap_path")), V.captures(s, d).where("s_suppkey % 5 = 0")).select("pcap_path", "binary_label"), f"{C} SELECT pcap_path, binary_label FROM c WHERE s_suppkey % 5 = 0"),
    "uniqueness": (lambda s, d: catalog.duplicates(_grouped(s, d), "modeling_group_key"), f"{_L} SELECT modeling_group_key, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1"),
    "resume_pending": (lambda s, d: catalog.pending(_grouped(s, d).select("pcap_id", "file_size"), _grouped(s, d).selectExpr("pcap_id", "CASE WHEN s_suppkey % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size", "CASE WHEN s_suppkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status"), ["pcap_id", "file_size"]), f"{_L} SELECT pcap_id, file_size FROM l WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0"),
    "largest_files": (lambda s, d: catalog.ranked_files(V.captures(s, d), 5).select("pcap_path", "file_size"), f"{C} SELECT pcap_path, file_size FROM c ORDER BY file_size DESC, pcap_path LIMIT 5"),
    "first_rows": (lambda s, d: catalog.first_rows(V.event_packets(s, d).select("pcap_id", "packet_index"), 3, order="packet_index"), f"WITH {V.EVENTS_SQL}, q AS (SELECT pcap_id, packet_index, row_number() OVER (PARTITION BY pcap_id ORDER BY packet_index) AS r FROM p) SELECT pcap_id, packet_index FROM q WHERE r <= 3"),
    "budget_allocation": (lambda s, d: sampling.allocate(_grouped(s, d), _CAPS, "per_modeling_group").select("pcap_path", "modeling_group_key", "selected"), f"{_ALLOC} SELECT pcap_path, modeling_group_key, selected FROM al"),
    "sampling_simulation": (lambda s, d: rounded(sampling.simulate(_grouped(s, d), "aggressive")), f"{_SIM} SELECT family, captures, available, kept, {_r('kept / available', 'fraction')}, CASE WHEN family <> 'BENIGN' THEN round((kept / ak)::DOUBLE, 6) END AS attack_share, {_r('ak / bk', 'attack_to_benign')} FROM b, t"),
    "closest_group": (lambda s, d: rounded(sampling.closest_group(_grouped(s, d).where("binary_label = 'ATTACK'").groupBy("attack_family", "modeling_group_key").agg(F.sum("window_count").alias("windows")), 0.2, "attack_family")), f"{_L}, q AS (SELECT attack_family, modeling_group_key, sum(window_count)::BIGINT AS windows FROM l WHERE binary_label = 'ATTACK' GROUP BY ALL), r AS (SELECT *, windows / sum(windows) OVER (PARTITION BY attack_family) AS share FROM q), z AS (SELECT *, row_number() OVER (PARTITION BY attack_family ORDER BY abs(share - 0.2), xor({_SEED.format(x=chr(39) + chr(39) + ' || attack_family || ' + chr(39) + '|tie|' + chr(39) + ' || modeling_group_key')}, {_SEED.format(x='attack_family')}), modeling_group_key) AS n FROM r) SELECT attack_family, modeling_group_key, windows, {_r('share', 'share')} FROM z WHERE n = 1"),
    "running_budget": (lambda s, d: sampling.running_budget(_grouped(s, d).withColumn("bucket", F.col("source")).withColumn("budget", F.lit(40_000))).select("pcap_path", "take"), f"{_L} SELECT pcap_path, greatest(0, least(window_count, 40000 - coalesce(sum(window_count) OVER (PARTITION BY source ORDER BY pcap_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM l"),
    "group_metas": (lambda s, d: _grouped(s, d).groupBy("modeling_group_key").agg(F.sum("window_count").alias("rows"), F.count(F.lit(1)).alias("captures")), f"{_L} SELECT modeling_group_key, sum(window_count)::BIGINT AS rows, count(*) AS captures FROM l GROUP BY ALL"),
    "selection_hash": (lambda s, d: sampling.selection_hashes(V.event_packets(s, d).select("pcap_id", F.col("packet_index").alias("window_index"))), f"WITH {V.EVENTS_SQL} SELECT pcap_id, count(*) AS rows, sha256(string_agg(packet_index::VARCHAR || chr(10), '' ORDER BY packet_index)) AS selection_sha256 FROM p GROUP BY pcap_id"),
    "feature_invariants": (lambda s, d: quality.window_violations(_broken(s, d)), f"WITH f AS ({FEATURES_SQL}) SELECT pcap_id, window_index, 'arp_ratio is above 1' AS violation FROM f WHERE pcap_id::INT % 7 = 1 AND window_index = 0 UNION ALL SELECT pcap_id, window_index, 'network layer ratios do not add up to 1' FROM f WHERE pcap_id::INT % 7 = 1 AND window_index = 0"),
    "accounting_invariants": (lambda s, d: quality.accounting_violations(stats.integrity(V.event_packets(s, d)).withColumn("ok_count", F.expr("CASE WHEN cast(pcap_id as int) % 3 = 1 THEN ok_count + 1 ELSE ok_count END"))), f"WITH {V.EVENTS_SQL} SELECT DISTINCT pcap_id, 'statuses do not add up' AS violation FROM p WHERE pcap_id::INT % 3 = 1"),
    "file_observations": (_issues, f"WITH {V.EVENTS_SQL}, {V.DELTA_SQL}, {_INT} SELECT pcap_id, CASE WHEN mal / n >= 0.8 THEN 'file:malformed_catastrophic' WHEN mal / n >= 0.01 THEN 'file:malformed_high' ELSE 'file:malformed_present' END AS issue_code, CASE WHEN mal / n >= 0.8 THEN 'hard_failure' WHEN mal / n >= 0.01 THEN 'high_warning' ELSE 'warning' END AS severity FROM q WHERE mal > 0 UNION ALL SELECT pcap_id, 'file:partial_present', 'warning' FROM q WHERE par > 0 UNION ALL SELECT pcap_id, 'file:unsupported_present', 'warning' FROM q WHERE uns > 0 UNION ALL SELECT pcap_id, 'file:timestamp_duplicate', 'warning' FROM q WHERE dup > 0 UNION ALL SELECT pcap_id, 'file:timestamp_reversal', 'warning' FROM q WHERE neg > 0"),
    "audit_totals": (lambda s, d: stats.audit_totals(stats.integrity(V.event_packets(s, d))), f"WITH {V.EVENTS_SQL}, q AS (SELECT pcap_id, count(*) AS n, sum(frame_length) AS b, count_if(parse_status = 'unsupported') AS u FROM p GROUP BY pcap_id) SELECT count(*) AS captures, sum(n)::BIGINT AS packets, sum(b)::BIGINT AS bytes, 1::BIGINT AS linktypes, sum(u)::BIGINT AS unsupported_packets, count_if(u > 0) AS captures_with_unsupported FROM q"),
    "reservoir_sample": (lambda s, d: sampling.selection_hashes(sampling.sampled(V.event_packets(s, d).select("pcap_id", F.col("packet_index").alias("window_index")), V.event_packets(s, d).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("window_count")).withColumn("selected", F.expr("window_count DIV 3")))), None),
    "window_counts_by_policy": (lambda s, d: windows.accounting(V.lineitem_packets(s, d).withColumn("parse_status", F.lit("ok")), V.CUTTING).select("pcap_id", "packets", "full_windows", "dropped_packets"), f"WITH {V.LINEITEM_SQL}, {V.segments_sql(V.CUTTING)}, z AS (SELECT pcap_id, segment_index, count(*) AS n FROM g GROUP BY ALL) SELECT pcap_id, sum(n)::BIGINT AS packets, sum(n // 5)::BIGINT AS full_windows, sum(n % 5)::BIGINT AS dropped_packets FROM z GROUP BY pcap_id"),
}
