"""Capture files as a data source: spark.read.format("pcap").load(path)."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PACKET, TIMESTAMPS
from .frames import decode

#: Byte order and fractions of a second, by the first four bytes. Fixed values of the format.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
BATCH = 4096


class BadCapture(ValueError):
    pass


def linktype_of(head: bytes) -> int:
    """Link type from a file's first 24 bytes."""
    if len(head) < 24 or head[:4] not in MAGICS:
        raise BadCapture("no capture header")
    return struct.unpack(MAGICS[head[:4]][0] + "I", head[20:24])[0] & 0x0FFFFFFF


def records(stream, strict: bool = True) -> Iterator[tuple[float, bytes, int]]:
    """(time, frame, link type) in file order. A record that is cut short raises if strict, else ends the scan with what is there."""
    head = stream.read(24)
    linktype = linktype_of(head)
    order, fraction = MAGICS[head[:4]]
    unpack = struct.Struct(order + "IIII").unpack
    while True:
        raw = stream.read(16)
        if not raw:
            return
        if len(raw) < 16:
            if strict:
                raise BadCapture("record header cut short")
            return
        seconds, part, kept, _ = unpack(raw)
        frame = stream.read(kept)
        if len(frame) < kept and strict:
            raise BadCapture(f"record needs {kept} bytes, has {len(frame)}")
        yield seconds + part / fraction, frame, linktype


def scan(stream, max_packets: int | None = None, strict: bool = True) -> Iterator[dict]:
    """Packet rows. The limit is checked after a record is read: one that is cut short behind the limit still raises."""
    for i, (time, frame, linktype) in enumerate(records(stream, strict)):
        if max_packets is not None and i >= max_packets:
            return
        yield decode(frame, i, time, linktype)


def capture_id(relative: str) -> str:
    name = os.path.splitext(os.path.basename(relative))[0]
    return f"{name}-{hashlib.sha256(relative.encode()).hexdigest()[:16]}"


class _File(InputPartition):
    def __init__(self, path: str, relative: str):
        super().__init__(path)
        self.path, self.relative = path, relative


def _arrow(schema) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array": pa.list_(pa.int32())}
    return pa.schema([pa.field(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


class PcapReader(DataSourceReader):
    """One task a file; rows leave it in Arrow batches, in capture order."""

    def __init__(self, options: dict, schema):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.only_times = options.get("decode", "full") == "none"
        self.strict = options.get("strict", "false" if self.only_times else "true") == "true"
        self.most = int(options["maxpackets"]) if options.get("maxpackets") else None
        self.base = options.get("relativeto", "").rstrip("/")
        self.only = json.loads(options["files"]) if options.get("files") else None
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        if self.only is not None:
            paths = self.only
        elif os.path.isfile(self.root):
            paths = [self.root]
        elif os.path.isdir(self.root):
            paths = [os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.endswith(".pcap")]
        else:
            raise BadCapture(f"no such path: {self.root}")
        return [_File(p, os.path.relpath(p, self.base) if self.base else p) for p in sorted(paths)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        own, arrow = capture_id(partition.relative), _arrow(self.schema)
        names = arrow.names
        columns: list[list] = [[] for _ in names]
        with open(partition.path, "rb") as stream:
            if self.only_times:
                found = ({"packet_index": i, "timestamp": t, "frame_length": len(f), "linktype": k} for i, (t, f, k) in enumerate(records(stream, self.strict)) if self.most is None or i < self.most)
            else:
                found = scan(stream, self.most, self.strict)
            for row in found:
                row["pcap_id"] = own
                for column, n in zip(columns, names):
                    column.append(row[n])
                if len(columns[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
                    columns = [[] for _ in names]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


class PcapDataSource(DataSource):
    """Options: path (a file or a folder that every executor sees), files (a JSON list of files, which alone are read), decode (full or none), strict, maxPackets, relativeTo (what pcap_id is hashed against)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return TIMESTAMPS if self.options.get("decode", "full") == "none" else PACKET

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def packets(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("pcap").options(**options).load(path)


def stored_packets(spark: SparkSession, path: str, relative_to: str = "", strict: bool = True) -> DataFrame:
    """The same rows for captures in a store that only Spark's readers reach: whole files as rows (2 GB at most each), decoded on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pcap").load(path).select("path", "content")
    arrow = _arrow(PACKET)

    def run(batches):
        import io

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = capture_id(name.removeprefix(relative_to).lstrip("/"))
                rows = []
                for row in scan(io.BytesIO(content), None, strict):
                    rows.append(row | {"pcap_id": own})
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, PACKET)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """pcap_path, length of all captures below root, sorted; empty files too, which Spark's own file sources pass over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        path = re.sub("^file:/+", "/", f.getPath().toString())
        if path.endswith(".pcap"):
            found.append((path, f.getLen()))
    return spark.createDataFrame(found, "pcap_path string, length long").orderBy("pcap_path")


def linktypes(spark: SparkSession, root: str) -> DataFrame:
    """pcap_path, linktype from the first 24 bytes, which alone are read; null where there is no capture header. Files must be where executors see them."""

    def peek(batches):
        for batch in batches:
            paths, kinds = [x.as_py() for x in batch.column(0)], []
            for path in paths:
                with open(path, "rb") as f:
                    try:
                        kinds.append(linktype_of(f.read(24)))
                    except BadCapture:
                        kinds.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.int32())], names=["pcap_path", "linktype"])

    return discover(spark, root).select("pcap_path").mapInArrow(peek, "pcap_path string, linktype int")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


__all__ = ["BadCapture", "PcapDataSource", "capture_id", "discover", "file_hashes", "linktype_of", "linktypes", "packets", "records", "register", "scan", "stored_packets"]
