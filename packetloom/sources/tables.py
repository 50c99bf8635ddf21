"""Scans of stored tables: feature shards, inventories, splits, manifests, contracts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import first_rows
from ..operators.quality import schema_differences
from ..schemas import BASE_FEATURES, FEATURE_TABLE, INVENTORY, SPLIT


def features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Feature shards; columns reach the scan."""
    df = spark.read.schema(FEATURE_TABLE).option("recursiveFileLookup", True).parquet(path)
    return df.select(*columns) if columns else df


def leading_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n windows of each capture."""
    return first_rows(features(spark, path), n)


def row_counts(spark: SparkSession, path: str) -> int:
    """Answered from footers."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.schema(FEATURE_TABLE).parquet(path).count()


def check_schema(spark: SparkSession, path: str) -> list[str]:
    return schema_differences(spark.read.option("recursiveFileLookup", True).parquet(path).schema, FEATURE_TABLE)


def csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """An empty field is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, INVENTORY)


def splits(spark: SparkSession, path: str) -> DataFrame:
    """Of a path that is given twice the last row counts."""
    rows = csv(spark, path, SPLIT).withColumn("_row", F.monotonically_increasing_id())
    return rows.groupBy("pcap_path").agg(F.max_by(F.struct(*[c for c in SPLIT.fieldNames() if c != "pcap_path"]), "_row").alias("s")).select("pcap_path", "s.*")


def fit_matrix(spark: SparkSession, path: str, expected: int | None = None, columns: tuple[str, ...] = BASE_FEATURES) -> DataFrame:
    """Features as floats and y, in the order of (pcap_id, window_index); values that aren't finite fail, as does another number of rows."""
    from ..functions.scalars import encode_label
    from ..operators.stats import finite

    df = features(spark, path)
    bad = ~F.expr("true")
    for c in columns:
        bad = bad | ~finite(F.col(c).cast("double"))
    df = df.withColumn("y", F.when(bad, F.raise_error(F.concat(F.lit("a value is not finite in "), "pcap_id")).cast("int")).otherwise(encode_label()))
    out = df.orderBy("pcap_id", "window_index").select("pcap_id", "window_index", "y", *[F.col(c).cast("float").alias(c) for c in columns])
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return out


def contract(path: str, sha256: str | None = None) -> dict:
    """A JSON file, whose bytes must have the pinned sum."""
    with open(path, "rb") as f:
        raw = f.read()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path} has another SHA-256")
    return json.loads(raw)


def reject_test_path(path: str) -> None:
    if "test" in path.lower().replace("\\", "/"):
        raise ValueError(f"test data is not for fitting: {path}")
