"""Pinned inputs: a contract lists files and their sums; a run that finds others stops."""

from __future__ import annotations

import hashlib
import json
import os


def file_sha256(path: str) -> str:
    """Of a file, or of a folder: of the sorted sums of its files."""
    if os.path.isdir(path):
        own = sorted(f"{os.path.relpath(os.path.join(d, n), path)} {file_sha256(os.path.join(d, n))}" for d, _, names in os.walk(path) for n in names if not n.startswith(("_", ".")))
        return hashlib.sha256("\n".join(own).encode()).hexdigest()
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def prepare(path: str, kind: str, inputs: dict[str, str], settings: dict | None = None) -> dict:
    """Writes a contract; one that exists with other contents is never overwritten."""
    payload = {"kind": kind, "inputs": {k: {"path": p, "sha256": file_sha256(p)} for k, p in sorted(inputs.items())}, "settings": settings or {}}
    text = json.dumps(payload, indent=2, sort_keys=True)
    if os.path.exists(path):
        with open(path) as f:
            if f.read() != text:
                raise ValueError(f"{path} holds another contract")
        return payload
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)
    return payload


def verify(path: str, kind: str, overrides: dict | None = None) -> dict:
    """The contract, if it is of this kind, its inputs are as they were and nothing in it is overridden."""
    with open(path) as f:
        payload = json.load(f)
    if payload["kind"] != kind:
        raise ValueError(f"{path} is a contract for {payload['kind']}, not {kind}")
    for name, x in payload["inputs"].items():
        if file_sha256(x["path"]) != x["sha256"]:
            raise ValueError(f"{name} has changed: {x['path']}")
    changed = {k for k, v in (overrides or {}).items() if v is not None and payload["settings"].get(k) != v}
    if changed:
        raise ValueError(f"a contract's settings can't be overridden: {sorted(changed)}")
    return payload
