"""Writers: feature shards, manifests, sampled views, reports and completion marks."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BASE_FEATURES, FEATURE_TABLE, WINDOW_KEYS
from . import features, sampling, windows

VERSION, BUILD_VERSION = "v1", "v1"
SCHEMA_SHA256 = hashlib.sha256(FEATURE_TABLE.json().encode()).hexdigest()
#: What a finished manifest row must agree in with what is wanted, for its capture not to be built again.
PINNED = ("pcap_id", "pcap_path", "binary_label", "output_path", "input_file_size", "feature_strategy_version", "feature_build_strategy_version", "feature_schema_sha256", "policy")


def write_features(table: DataFrame, path: str) -> None:
    """Shards by capture, zstd. A capture's shard replaces the one before, so a build that is repeated leaves the same rows."""
    own = table.select(*WINDOW_KEYS, *BASE_FEATURES)
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("pcap_id").parquet(path)


def _remove_shards(spark: SparkSession, path: str, ids: list[str]) -> None:
    for i in ids:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pcap_id={i}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """pcap_id, output_row_count, output_file_size of what lies in a folder of features."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "pcap_id string, output_row_count long, output_file_size long")
    rows = spark.read.schema(FEATURE_TABLE).parquet(path).select("pcap_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("pcap_id", "file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return files.groupBy("pcap_id").agg(F.sum("n").alias("output_row_count"), F.sum("size").alias("output_file_size"))


def wanted(labels: DataFrame, path: str, policy: windows.WindowPolicy) -> DataFrame:
    """labels (pcap_id, pcap_path, binary_label and, if known, file_size) with the pinned fields."""
    size = F.col("file_size").cast("long") if "file_size" in labels.columns else F.lit(None).cast("long")
    out = labels.select("pcap_id", "pcap_path", "binary_label", F.concat(F.lit(f"{path}/pcap_id="), "pcap_id").alias("output_path"), size.alias("input_file_size"))
    fixed = {"feature_strategy_version": VERSION, "feature_build_strategy_version": BUILD_VERSION, "feature_schema_sha256": SCHEMA_SHA256, "policy": policy.id}
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()})


def build(packets: DataFrame, labels: DataFrame, path: str, policy: windows.WindowPolicy = windows.FROZEN) -> DataFrame:
    """Features of all captures, and the manifest's rows. Captures are decoded twice: for their windows, and for one row of counts each.

    labels: pcap_id, pcap_path, binary_label and, if known, file_size. Captures with an error status are left out and reported; a capture without a full window
    has a manifest row with 0 windows, as it leaves no folder."""
    spark, began = packets.sparkSession, time.time()
    known = labels.select("pcap_id", "binary_label")
    in_segments = windows.with_segments(packets.select("pcap_id", "packet_index", "timestamp", "parse_status"), policy)
    error = F.min(F.when(F.col("parse_status") == "error", F.col("packet_index")))
    counts = in_segments.groupBy("pcap_id", "segment_index").agg(F.count(F.lit(1)).alias("n"), error.alias("e")).groupBy("pcap_id")
    counts = counts.agg(F.sum("n").alias("packets_processed"), F.sum(F.expr(f"n DIV {policy.window_size}")).alias("windows"), F.min("e").alias("first_error_index"))
    counts = counts.withColumn("windows_written", F.when(F.col("first_error_index").isNull(), F.col("windows")).otherwise(0)).drop("windows")
    counts.join(known.select("pcap_id"), "pcap_id", "left_semi").write.parquet(at := f"{path}.builds/{uuid.uuid4().hex}")
    counts = spark.read.schema(counts.schema).parquet(at)
    _remove_shards(spark, path, [r.pcap_id for r in known.select("pcap_id").join(counts.where("windows_written > 0"), "pcap_id", "left_anti").collect()])
    sound = packets.join(counts.where("first_error_index IS NULL").select("pcap_id"), "pcap_id", "left_semi")
    write_features(features.base_features(sound, policy).join(known, "pcap_id"), path)
    rows = wanted(labels, path, policy).join(counts, "pcap_id", "left").join(shards(spark, path), "pcap_id", "left")
    rows = rows.fillna(0, ["packets_processed", "output_row_count", "output_file_size", "windows_written"])
    ok = F.col("first_error_index").isNull() & (F.col("output_row_count") == F.col("windows_written"))
    message = F.when(F.col("first_error_index").isNotNull(), F.concat(F.lit("packet with status error at "), F.col("first_error_index").cast("string"))).when(~ok, "row count differs from windows")
    rows = rows.withColumn("status", F.when(ok, "ok").otherwise("error")).withColumn("error_message", message).withColumn("resumed", F.lit(False)).withColumn("elapsed_seconds", F.lit(round(time.time() - began, 3)))
    return rows.drop("first_error_index")


def resumable(manifest: DataFrame, labels: DataFrame, path: str, policy: windows.WindowPolicy = windows.FROZEN) -> DataFrame:
    """Finished manifest rows that agree with what is wanted in every pinned field, and whose shard has the rows and bytes that it had."""
    asked = wanted(labels, path, policy)
    done = manifest.where("status = 'ok'").alias("m")
    same = [done[f"m.{c}"].cast(asked.schema[c].dataType).eqNullSafe(asked[c]) for c in PINNED]
    kept = done.join(asked, same, "left_semi").select("m.*")
    there = shards(labels.sparkSession, path).select("pcap_id", F.col("output_row_count").alias("_rows"), F.col("output_file_size").alias("_bytes"))
    kept = kept.join(there, "pcap_id", "left").where((F.coalesce("_rows", F.lit(0)) == F.col("output_row_count")) & (F.coalesce("_bytes", F.lit(0)) == F.col("output_file_size")))
    return kept.drop("_rows", "_bytes")


def build_incremental(packets: DataFrame, labels: DataFrame, path: str, manifest: DataFrame | None, policy: windows.WindowPolicy = windows.FROZEN) -> DataFrame:
    """Builds only captures without a manifest row that can be resumed; returns old and new rows."""
    if manifest is None:
        return build(packets, labels, path, policy)
    spark = labels.sparkSession
    old = resumable(manifest, labels, path, policy).withColumn("resumed", F.lit(True)).withColumn("elapsed_seconds", F.lit(0.0))
    old.write.parquet(at := f"{path}.builds/{uuid.uuid4().hex}")  # before shards change
    old = spark.read.schema(old.schema).parquet(at)
    todo = labels.join(old.select("pcap_id"), "pcap_id", "left_anti")
    if todo.isEmpty():
        return old
    new = build(packets.join(todo.select("pcap_id"), "pcap_id", "left_semi"), todo, path, policy)
    return old.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in new.schema]).unionByName(new)


def write_view(table: DataFrame, allocation: DataFrame, path: str, base_seed: int = 42) -> DataFrame:
    """The sampled rows of each capture, in order; returns rows and selection hash a capture."""
    chosen = sampling.sampled(table, allocation, base_seed)
    chosen.repartition("pcap_id").sortWithinPartitions("pcap_id", "window_index").write.mode("overwrite").option("compression", "zstd").partitionBy("pcap_id").parquet(path)
    return sampling.selection_hashes(table.sparkSession.read.parquet(path))


def view_totals(hashes: DataFrame, allocation: DataFrame) -> DataFrame:
    """Captures whose view has another number of rows than allocated."""
    return allocation.join(hashes, "pcap_id", "left").where(F.coalesce("rows", F.lit(0)) != F.col("selected")).select("pcap_id", "selected", "rows")


def write_csv(table: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A report: one file, null as an empty field. For small results; large ones belong in Parquet."""
    (table.select(*columns) if columns else table).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    write_csv(rows.orderBy("pcap_path"), path)


def cache_scores(scores: DataFrame, path: str) -> DataFrame:
    """Scores on disk, read again."""
    scores.write.mode("overwrite").parquet(path)
    return scores.sparkSession.read.schema(scores.schema).parquet(path)


def mark_complete(path: str, passed: bool, facts: dict) -> bool:
    """Writes the mark if all checks passed, and removes an old one otherwise."""
    if not passed:
        if os.path.exists(path):
            os.remove(path)
        return False
    with open(f"{path}.tmp", "w") as f:
        json.dump(facts | {"completed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}, f, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)
    return True


def report(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}")
