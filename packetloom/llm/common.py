"""What the corpus operators share: tables, the shared folder and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the bytes 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch to Python; documents may be long.
BATCH_ROWS = 512
_own_folder: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="packetloom-")
    return f"file://{_own_folder}"


_scopes: list[list[tuple[SparkSession, str]]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder, deleted with the innermost scratch()."""
    path = f"{shared_folder(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a lost executor costs no more than a reread. Within scratch() the table
    is deleted at its end; with keep, at the end of the scratch() around that, if there is one."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if keep and _scopes:
        own = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(own)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables written inside at the end, so results must be written with keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def per_task(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | None]], schema: str) -> DataFrame:
    """mapInArrow; function maps a task's batches, of BATCH_ROWS at most, to dicts of columns. Columns that are left out are null."""
    fields = _arrow_schema(schema)

    def run(batches):
        for out in function(_slices(batches)):
            if out:
                n = len(next(iter(out.values())))
                columns = [out.get(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(fields, columns)], schema=fields)

    return df.mapInArrow(run, schema)


def in_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS at most; function maps a pyarrow.RecordBatch to a dict of columns, or None."""
    return per_task(df, lambda batches: map(function, batches), schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(n, _ARROW[t]) for n, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def hash128(x: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of x."""
    return F.xxhash64(x), F.xxhash64(F.lit(7), x)
