"""Predictions over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import tempfile
import threading
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .sources.fetch import Fetcher, FetchError


@dataclass
class Settings:
    most_bytes: int = 512 << 20
    in_flight: int = 1

    def __post_init__(self) -> None:
        if self.most_bytes <= 0 or self.in_flight <= 0:
            raise ValueError("limits must be positive")


def predict(body: bytes, fetcher: Fetcher, classify: Callable[[str], dict], slots: threading.Semaphore) -> tuple[int, dict]:
    """Status and answer for one request; it must hold exactly one instance with gcs_uri. Messages never tell of paths or traces."""
    try:
        instances = json.loads(body)["instances"]
        (instance,) = instances
        uri = instance["gcs_uri"]
        if not isinstance(uri, str) or not uri.startswith("gs://"):
            raise ValueError
    except (ValueError, KeyError, TypeError):
        return 422, {"error": "one instance with gcs_uri is needed"}
    try:
        with slots, tempfile.NamedTemporaryFile(suffix=".pcap") as f:
            return 200, {"predictions": [classify(fetcher.fetch(uri, f.name))]}
    except FetchError as e:
        return e.status, {"error": type(e).__name__}
    except Exception:
        return 500, {"error": "internal error"}


def server(fetcher: Fetcher, classify: Callable[[str], dict], settings: Settings | None = None, port: int = 0) -> ThreadingHTTPServer:
    settings = settings or Settings()
    slots = threading.Semaphore(settings.in_flight)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, value: dict) -> None:
            raw = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self.answer(*((200, {"status": "ok"}) if self.path == "/health" else (404, {"error": "no such path"})))

        def do_POST(self) -> None:
            if self.path != "/predict":
                self.answer(404, {"error": "no such path"})
                return
            self.answer(*predict(self.rfile.read(int(self.headers.get("Content-Length") or 0)), fetcher, classify, slots))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
