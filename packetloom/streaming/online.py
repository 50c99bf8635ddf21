"""The windower as a stateful stream, and verdicts as a streaming aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import FROZEN, WindowPolicy

OUTPUT = "pcap_id string, kind string, segment_index bigint, window_index bigint, packet_index_start bigint, packet_index_end bigint, window_span_seconds double, bytes bigint, dropped bigint"
STATE = "open array<struct<i:bigint,t:double,n:bigint>>, last_time double, last_index bigint, segment bigint, windows bigint, dead boolean"


class OutOfOrder(ValueError):
    pass


def advance(rows, state: tuple, policy: WindowPolicy) -> tuple[list[tuple], tuple]:
    """Windows that rows (index, time, length, status) complete, and the state after them. state: open packets, last time and index, segment, windows, dead."""
    held, last_time, last_index, segment, made, dead = state
    held, out = list(held), []
    for i, t, n, status in rows:
        if last_index is not None and i <= last_index:
            raise OutOfOrder(f"packet {i} after {last_index}")
        last_index = i
        if dead:
            continue
        if status == "error":
            out.append(("error", segment, None, i, i, None, None, len(held)))
            held, dead = [], True
            continue
        if last_time is not None and (t - last_time > policy.inactivity_s or t - last_time < -policy.backward_s):
            if held:
                out.append(("dropped", segment, None, held[0][0], held[-1][0], None, None, len(held)))
            held, segment = [], segment + 1
        last_time = t
        held.append((i, t, n))
        if len(held) == policy.window_size:
            times = [x[1] for x in held]
            out.append(("window", segment, made, held[0][0], i, max(times) - min(times), sum(x[2] for x in held), 0))
            held, made = [], made + 1
    return out, (held, last_time, last_index, segment, made, dead)


def stream_windows(packets: DataFrame, policy: WindowPolicy = FROZEN, idle_ms: int = 600_000) -> DataFrame:
    """Full windows of a stream of packets, keyed by capture, for any cut into micro-batches.

    State is the open window and a few counters. Order is packet_index: rows of a batch are sorted, a batch that goes back raises. There is no watermark, as
    time may go back; a capture that is idle for idle_ms of processing time is closed and its partial window reported as dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ([], None, None, 0, 0, False)
        now = ([(x["i"], x["t"], x["n"]) if isinstance(x, dict) else tuple(x) for x in (now[0] if now[0] is not None else [])], *now[1:])
        if state.hasTimedOut:
            held = now[0]
            state.remove()
            out = [("dropped", now[3], None, held[0][0], held[-1][0], None, None, len(held))] if held else []
        else:
            rows = pd.concat(list(frames)).sort_values("packet_index", kind="stable")
            own = zip(rows["packet_index"].tolist(), rows["timestamp"].tolist(), rows["frame_length"].tolist(), rows["parse_status"].tolist())
            out, now = advance(own, now, policy)
            state.update((now[0], *now[1:]))
            state.setTimeoutDuration(idle_ms)
        names = ["kind", "segment_index", "window_index", "packet_index_start", "packet_index_end", "window_span_seconds", "bytes", "dropped"]
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, "pcap_id", key[0])
        for c in ("window_index", "bytes"):
            frame[c] = frame[c].astype("Int64")
        yield frame

    slim = packets.select("pcap_id", "packet_index", "timestamp", "frame_length", "parse_status")
    return slim.groupBy("pcap_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_verdicts(scores: DataFrame, threshold: float, least: int = 3, k: int = 3, r: float = 0.005) -> DataFrame:
    """Running verdicts: constant state a capture, for update or complete mode."""
    from ..operators.verdict import verdicts

    return verdicts(scores, threshold, least, k, r)


def progress(query) -> dict:
    """Rows and rates of a stream's last batch."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond")}


def stream_packets(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def accounting(windows: DataFrame) -> DataFrame:
    """Windows and dropped packets a capture, of what stream_windows wrote."""
    return windows.groupBy("pcap_id").agg(F.count_if(F.col("kind") == "window").alias("full_windows"), F.sum("dropped").alias("dropped_packets"))
