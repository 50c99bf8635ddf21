"""Captures from a store or a folder, within an allowlist and a size limit."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field
from typing import Protocol


class FetchError(Exception):
    status = 500


class InvalidUri(FetchError):
    status = 422


class NotAllowed(FetchError):
    status = 403


class NotFound(FetchError):
    status = 404


class TooLarge(FetchError):
    status = 413


@dataclass(frozen=True)
class ObjectRef:
    bucket: str
    name: str


def parse_uri(uri: str, scheme: str = "gs") -> ObjectRef:
    """Bucket and object; no empty parts, no parent folders, no backslashes."""
    prefix = f"{scheme}://"
    bucket, _, name = uri.removeprefix(prefix).partition("/")
    if not uri.startswith(prefix) or not bucket or not name or "\\" in uri or any(p in ("", ".", "..") for p in name.split("/")):
        raise InvalidUri(f"no object address: {uri}")
    return ObjectRef(bucket, name)


def ensure_allowed(ref: ObjectRef, bucket: str, prefix: str = "") -> None:
    if ref.bucket != bucket or not ref.name.startswith(prefix):
        raise NotAllowed(f"{ref.bucket}/{ref.name}")


def ensure_size(n: int, most: int) -> None:
    if n > most:
        raise TooLarge(f"{n} bytes, {most} at most")


class Fetcher(Protocol):
    def fetch(self, uri: str, to: str) -> str: ...


@dataclass
class StoreFetcher:
    """Through Hadoop's file systems, which know the store's scheme."""

    spark: object
    bucket: str
    prefix: str = ""
    most_bytes: int = 512 << 20
    scheme: str = "gs"

    def fetch(self, uri: str, to: str) -> str:
        ensure_allowed(parse_uri(uri, self.scheme), self.bucket, self.prefix)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise NotFound(uri)
        ensure_size(fs.getFileStatus(path).getLen(), self.most_bytes)
        try:
            fs.copyToLocalFile(path, jvm.org.apache.hadoop.fs.Path(f"file://{to}"))
            ensure_size(os.path.getsize(to), self.most_bytes)
        except BaseException:
            if os.path.exists(to):
                os.remove(to)
            raise
        return to


@dataclass
class FolderFetcher:
    """bucket/name below a root folder, for local use and tests; links out of the root are refused."""

    root: str
    bucket: str
    prefix: str = ""
    most_bytes: int = 512 << 20
    scheme: str = "gs"

    def fetch(self, uri: str, to: str) -> str:
        ref = parse_uri(uri, self.scheme)
        ensure_allowed(ref, self.bucket, self.prefix)
        root = os.path.realpath(self.root)
        path = os.path.realpath(os.path.join(root, ref.name))
        if os.path.commonpath((root, path)) != root:
            raise NotAllowed(uri)
        if not os.path.isfile(path):
            raise NotFound(uri)
        ensure_size(os.path.getsize(path), self.most_bytes)
        return shutil.copyfile(path, to)


@dataclass
class FakeFetcher:
    """Bytes by address, and addresses that are denied."""

    objects: dict[str, bytes]
    denied: set[str] = field(default_factory=set)
    most_bytes: int = 512 << 20

    def fetch(self, uri: str, to: str) -> str:
        parse_uri(uri)
        if uri in self.denied:
            raise NotAllowed(uri)
        if uri not in self.objects:
            raise NotFound(uri)
        ensure_size(len(self.objects[uri]), self.most_bytes)
        with open(to, "wb") as f:
            f.write(self.objects[uri])
        return to
