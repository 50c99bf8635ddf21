"""Frames, captures and packet rows for tests."""

import struct

from packetloom.schemas import PACKET
from packetloom.sources.frames import blank

MAC_A, MAC_B = bytes.fromhex("020000000001"), bytes.fromhex("020000000002")
IP_A, IP_B = bytes((10, 0, 0, 1)), bytes((10, 0, 0, 2))


def ethernet(kind, body, tags=()):
    return MAC_B + MAC_A + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


def ipv4(protocol, body, src=IP_A, dst=IP_B):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0, src, dst) + body


def ipv6(first, body):
    return struct.pack(">IHBB16s16s", 6 << 28, len(body), first, 64, bytes(15) + b"\1", bytes(15) + b"\2") + body


def tcp(sport=1000, dport=80, flags=2, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload


def udp(sport=1000, dport=53, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def arp(op=1, sha=MAC_A, spa=IP_A, tpa=IP_B):
    return struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, op, sha, spa, bytes(6), tpa)


def capture(frames, linktype=1, order="<", nanoseconds=False):
    magic = 0xA1B23C4D if nanoseconds else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for t, frame in frames:
        part = round((t - int(t)) * (1e9 if nanoseconds else 1e6))
        out += struct.pack(order + "IIII", int(t), part, len(frame), len(frame)) + frame
    return out


def packet(index, time, capture_id="c", **more):
    return blank(index, time, 100, 1) | {"pcap_id": capture_id} | more


def packets(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in PACKET.fieldNames()) for r in rows], PACKET)


def timed(spark, times, **more):
    return packets(spark, [packet(i, float(t), **more) for i, t in enumerate(times)])
