"""GIF: LZW code streams, palettes, disposal and transparency; timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches, texts

WIDTH, MOST_ROWS, DELAY_CS = 64, 256, 10
GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
HIST_BINS = 8


class BadGif(ValueError):
    pass


def _widths(code_bits: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear: code i is written when clear + 1 + i entries exist, and a width grows once the table outgrows it."""
    size = np.minimum((1 << code_bits) + 1 + np.maximum(np.arange(1, n + 1), 1), 4096)
    return np.maximum(np.ceil(np.log2(size)).astype(np.int64), code_bits + 1)


@lru_cache(maxsize=16)
def _schedule(code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and first bits of the codes after a clear; 12 bits from where the table is full."""
    widths = _widths(code_bits, 4098)
    return widths, np.concatenate(([0], np.cumsum(widths)))


_BITS = np.arange(16)


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a stream of bits, lowest bit first."""
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(bits[_BITS < widths[:, None]], bitorder="little").tobytes()


def lzw_encode(data: bytes, code_bits: int = 8) -> bytes:
    """LZW as GIF has it: codes grow to 12 bits, then the table is cleared."""
    clear = 1 << code_bits
    codes, clears = [clear], [0]
    append = codes.append
    table: dict[int, int] = {}
    get, nxt = table.get, clear + 2
    it = iter(data)
    first = next(it, None)
    if first is not None:
        prefix = first
        for b in it:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            prefix = b
            if nxt < 4096:
                table[key] = nxt
                nxt += 1
            else:
                clears.append(len(codes))
                append(clear)
                table.clear()
                nxt = clear + 2
        append(prefix)
    append(clear + 1)
    widths = np.empty(len(codes), np.int64)
    for start, stop in zip(clears, [*clears[1:], len(codes)]):
        widths[start + 1 : stop] = _widths_upto(code_bits, stop - start - 1)
        widths[start] = 12 if start else code_bits + 1
    return _packed(np.array(codes, np.int64), widths)


def _widths_upto(code_bits: int, n: int) -> np.ndarray:
    own = _schedule(code_bits)[0]
    return own[:n] if n <= len(own) else np.concatenate((own, np.full(n - len(own), 12)))


def lzw_decode(data: bytes, code_bits: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at most; raises BadGif where a code can't occur.

    Code widths after a clear follow from the codes' number alone, so the codes up to the next clear are cut from the bits at once."""
    clear, end = 1 << code_bits, (1 << code_bits) + 1
    packed = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    packed = packed[:-2] | packed[1:-1] << 8 | packed[2:] << 16  # 24 bits from every byte on
    out: list[bytes] = []
    at = done = 0
    while at < 8 * len(data) and done < most:
        codes, ends = _codes(packed, at, 8 * len(data), code_bits)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            done += _entries(codes[:stop].tolist(), _roots(code_bits), clear, out)
        if stop == len(codes) or codes[stop] == end:
            break
        at = int(ends[stop])
    return b"".join(out)[:most]


def _codes(packed: np.ndarray, at: int, n_bits: int, code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from bit ``at``, where a table starts, and the bit where each ends."""
    widths, ends = _schedule(code_bits)
    if n_bits - at > ends[-1]:  # a full table stays in use
        n = (n_bits - at - int(ends[-1])) // 12
        widths, ends = np.concatenate((widths, np.full(n, 12))), np.concatenate((ends, ends[-1] + 12 * np.arange(1, n + 1)))
    n = int(np.searchsorted(ends, n_bits - at, "right")) - 1
    starts = ends[:n] + at
    return packed[starts >> 3] >> (starts & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32), ends[1 : n + 1] + at


@lru_cache(maxsize=16)
def _root_table(code_bits: int) -> tuple[bytes, ...]:
    return (*(bytes((i,)) for i in range(1 << code_bits)), b"", b"")


def _roots(code_bits: int) -> list[bytes]:
    return list(_root_table(code_bits))


def _entries(codes: list[int], table: list[bytes], clear: int, out: list[bytes]) -> int:
    """Appends the strings of codes to out; their length."""
    last = table[codes[0]] if codes[0] < clear else None
    if last is None:
        raise BadGif("a stream can't begin with this code")
    first, n = len(out), len(table)
    out.append(last)
    append, grow = out.append, table.append
    rest = iter(codes)
    next(rest)
    for code in rest:
        if n == 4096:
            break
        if code < n:
            entry = table[code]
        elif code == n:
            entry = last + last[:1]
        else:
            raise BadGif("code outside the table")
        grow(last + entry[:1])
        n += 1
        append(entry)
        last = entry
    else:
        return sum(map(len, out[first:]))
    for code in (code, *rest):  # the table is full
        if code < n:
            append(table[code])
        else:
            raise BadGif("code outside the table")
    return sum(map(len, out[first:]))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray  # height x width x RGBA of the whole picture after this frame is drawn

    def histogram(self, bins: int = HIST_BINS) -> np.ndarray:
        """Visible pixels by (channel, range of value)."""
        own = self.canvas[self.canvas[:, :, 3] > 0][:, :3]
        return np.stack([np.bincount(own[:, c] // (256 // bins), minlength=bins) for c in range(3)])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    if at >= len(data):
        raise BadGif("blocks don't end")
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 * (2 << (flags & 7))
    if at + n > len(data):
        raise BadGif("palette cut short")
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def decode(data: bytes) -> list[Frame]:
    """All frames in order, drawn upon each other by their disposal and transparency."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, colours = 13, None
    if flags & 128:
        colours, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at + 1 < len(data) or data[at:] == b"\x3b":
        kind = data[at]
        if kind == 0x3B:
            return frames
        if kind == 0x21:
            block, at2 = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(block) >= 4:
                delay, disposal = struct.unpack_from("<H", block, 1)[0], block[0] >> 2 & 7
                transparent = block[3] if block[0] & 1 else None
            at = at2
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise BadGif("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, own = at + 10, colours
        if flags & 128:
            own, at = _palette(data, at, flags)
        if own is None or left + w > width or top + h > height:
            raise BadGif("no palette or outside the picture")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if len(samples) < w * h:
            raise BadGif("too few samples")
        indices = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 64:  # rows come in four passes
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = slice(None) if transparent is None else indices != transparent
        visible = indices[seen]
        if len(own) < 256 and visible.size and int(visible.max()) >= len(own):
            raise BadGif("colour outside the palette")
        area[seen] = np.concatenate((own, np.full((len(own), 1), 255, np.uint8)), axis=1)[visible]
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, indices, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    raise BadGif("no trailer")


def encode(payload: bytes, width: int = WIDTH, most_rows: int = MOST_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A grey GIF whose frames hold payload, a multiple of width, as samples; the last frame may be lower than the others."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, most_rows), 0xF7, 0, 0), GREY]
    for y in range(0, rows, most_rows):
        h = min(most_rows, rows - y)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, h, 0), b"\x08"]
        stream = lzw_encode(payload[y * width : (y + h) * width])
        out += [bytes((len(part),)) + part for part in (stream[i : i + 255] for i in range(0, len(stream), 255))] + [b"\0"]
    return b"".join(out) + b"\x3b"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def payload_of(frames: list[Frame]) -> bytes:
    """What encode() stored, from the drawn pictures."""
    return b"".join(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes() for f in frames)


def store_frames(docs: DataFrame) -> DataFrame:
    """doc_id and, for each document's text as a GIF: frame, delay_cs, width, height, gif (whole file, on frame 0 alone) and the histogram of its first channel."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            media = encode(padded(text.encode("utf-8", "surrogatepass")))
            rows += [(doc, i, f.delay_cs * i, f.width, f.height, media if i == 0 else None, f.histogram()[0].tolist()) for i, f in enumerate(decode(media))]
        return dict(zip(("doc_id", "frame", "at_cs", "width", "height", "gif", "histogram"), map(list, zip(*rows))))

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, frame long, at_cs long, width long, height long, gif binary, histogram array<long>")


def op3_gif(docs: DataFrame) -> DataFrame:
    """Every text stored as a GIF and read back: sizes, sums and the histogram feature. Null text is empty: one row of zero samples."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in texts(batch):
            raw = text.encode("utf-8", "surrogatepass")
            media = encode(padded(raw))
            frames = decode(media)
            payload = payload_of(frames)
            hist = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=HIST_BINS)
            values = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(frames)};cs={sum(f.delay_cs for f in frames)};hist=" + ",".join(map(str, hist.tolist())))
            for column, v in zip(out.values(), values):
                column.append(v)
        return {"doc_id": batch.column(0)} | out

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
