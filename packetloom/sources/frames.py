"""Frames of bytes as packet rows.

Layouts are those of the standards. A frame that is cut short in its first header is malformed; one that is cut short further in is partial and keeps what
was read; anything unforeseen makes a row with status error, so one frame never ends a scan."""

from __future__ import annotations

import ipaddress
import struct

from ..schemas import PACKET

ETHERNET, RAW, IPV4_LINK, IPV6_LINK = 1, 101, 228, 229
ARP, IP4, IP6, LLDP = 0x0806, 0x0800, 0x86DD, 0x88CC
TAGS = (0x8100, 0x88A8, 0x9100)
TCP, UDP, ICMP, ICMP6, IGMP = 6, 17, 1, 58, 2
#: IPv6 headers that lead to another one.
EXTENSIONS = (0, 43, 44, 51, 60)
LEAST_TYPE = 0x0600
_FALSE = [f.name for f in PACKET.fields if f.dataType.typeName() == "boolean" and f.name != "is_ethernet_ii"]


class Short(ValueError):
    pass


def _need(data: bytes, n: int, what: str) -> None:
    if len(data) < n:
        raise Short(f"{what} needs {n} bytes, has {len(data)}")


def mac(raw: bytes) -> str:
    return raw.hex(":")


def blank(index: int, timestamp: float, length: int, linktype: int) -> dict:
    row = dict.fromkeys(PACKET.fieldNames())
    row.update(dict.fromkeys(_FALSE, False), packet_index=index, timestamp=timestamp, frame_length=length, linktype=linktype, parse_status="ok", vlan_ids=[])
    return row


def _transport(row: dict, protocol: int, data: bytes) -> None:
    if protocol == TCP:
        try:
            _need(data, 20, "TCP")
            offset = max(20, (data[12] >> 4) * 4)
            if (data[12] >> 4) < 5:
                raise Short("TCP header length below 5")
        except Short as e:
            row.update(parse_status="partial", parse_detail=f"tcp decode failed: {e}", protocol_name="ipv4" if row["is_ipv4"] else "ipv6")
            return
        flags = data[13]
        row.update(is_tcp=True, src_port=int.from_bytes(data[:2], "big"), dst_port=int.from_bytes(data[2:4], "big"), tcp_flags=flags, tcp_payload=data[offset:], protocol_name="tcp")
        row.update({f"tcp_flag_{n}": bool(flags & b) for n, b in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))})
    elif protocol == UDP:
        if len(data) < 8:
            row.update(parse_status="partial", parse_detail=f"udp decode failed: UDP needs 8 bytes, has {len(data)}", protocol_name="ipv4" if row["is_ipv4"] else "ipv6")
            return
        row.update(is_udp=True, src_port=int.from_bytes(data[:2], "big"), dst_port=int.from_bytes(data[2:4], "big"), protocol_name="udp")
    elif protocol in (ICMP, ICMP6, IGMP):
        name = {ICMP: "icmp", ICMP6: "icmpv6", IGMP: "igmp"}[protocol]
        row.update({f"is_{name}": True, "protocol_name": name})
    else:
        row.update(parse_status="unsupported", parse_detail=f"unsupported ip protocol: {protocol}", protocol_name=f"ip_proto_{protocol}")


def _ipv4(row: dict, data: bytes) -> None:
    _need(data, 20, "IPv4")
    if data[0] >> 4 != 4 or data[0] & 15 < 5:
        raise Short("no IPv4 header")
    head = (data[0] & 15) * 4
    _need(data, head, "IPv4 options")
    total = int.from_bytes(data[2:4], "big")
    body = data[head : total if total >= head else len(data)]  # without padding; 0 where the card cuts segments
    row.update(is_ipv4=True, ip_version=4, ip_protocol=data[9], src_ip=".".join(map(str, data[12:16])), dst_ip=".".join(map(str, data[16:20])), protocol_name="ipv4")
    _transport(row, data[9], body)


def _ipv6(row: dict, data: bytes) -> None:
    _need(data, 40, "IPv6")
    if data[0] >> 4 != 6:
        raise Short("no IPv6 header")
    length, first = struct.unpack_from(">HB", data, 4)
    body, protocol = data[40 : 40 + length if length else len(data)], first
    while protocol in EXTENSIONS:
        if len(body) < 8:
            break
        size = 8 if protocol == 44 else (body[1] + 2) * 4 if protocol == 51 else (body[1] + 1) * 8
        protocol, body = body[0], body[size:]
    row.update(is_ipv6=True, ip_version=6, ip_protocol=protocol, src_ip=str(ipaddress.IPv6Address(data[8:24])), dst_ip=str(ipaddress.IPv6Address(data[24:40])), protocol_name="ipv6", ipv6_first_next_header=first)
    _transport(row, protocol, body)


def _arp(row: dict, data: bytes) -> None:
    _need(data, 8, "ARP")
    hlen, plen, op = struct.unpack_from(">BBH", data, 4)
    _need(data, 28, "ARP addresses")
    at = 8
    parts = []
    for n in (hlen, plen, hlen, plen):
        parts.append(data[at : at + n])
        at += n
    sha, spa, tha, tpa = parts
    ip = lambda x: ".".join(map(str, x)) if len(x) == 4 else None
    row.update(is_arp=True, src_ip=ip(spa), dst_ip=ip(tpa), protocol_name="arp", arp_op=op, arp_sha=mac(sha) if len(sha) == 6 else None, arp_tha=mac(tha) if len(tha) == 6 else None)


def _llc(row: dict, data: bytes) -> None:
    if len(data) < 3:
        row.update(parse_status="partial", parse_detail=f"llc decode failed: LLC needs 3 bytes, has {len(data)}", protocol_name="ieee802.3")
        return
    row.update(is_llc=True, ethertype=None, protocol_name="llc", parse_detail=None, llc_dsap=data[0], llc_ssap=data[1], llc_ctrl=data[2])


def _ethernet(row: dict, frame: bytes) -> None:
    kind = int.from_bytes(frame[12:14], "big")
    row.update(dst_mac=mac(frame[:6]), src_mac=mac(frame[6:12]), ethernet_type_or_length=kind, is_ethernet_ii=kind >= LEAST_TYPE)
    if kind < LEAST_TYPE:
        row["parse_detail"] = f"ieee802.3 length={kind}"
        _llc(row, frame[14 : 14 + kind])
        return
    at, tags = 14, []
    while kind in TAGS:
        if len(frame) < at + 4:
            row.update(parse_status="malformed", parse_detail="ethernet unpack failed: VLAN tag cut short", protocol_name="ethernet")
            return
        tags.append(int.from_bytes(frame[at : at + 2], "big") & 0xFFF)
        kind = int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 4
    row.update(vlan_ids=tags, ethertype=kind)
    inner = {ARP: ("arp", _arp), IP4: ("ipv4", _ipv4), IP6: ("ipv6", _ipv6)}.get(kind)
    if inner is None:
        row.update(parse_status="unsupported", parse_detail=f"unsupported ethertype: 0x{kind:04x}", protocol_name="lldp" if kind == LLDP else f"ethertype_0x{kind:04x}")
        return
    try:
        inner[1](row, frame[at:])
    except Short as e:
        row.update(parse_status="partial", parse_detail=f"{inner[0]} decode failed: {e}", protocol_name="ethernet")


def decode(frame: bytes, index: int, timestamp: float, linktype: int) -> dict:
    """The packet row of one frame, without pcap_id."""
    row = blank(index, timestamp, len(frame), linktype)
    try:
        if linktype == ETHERNET:
            if len(frame) < 14:
                row.update(parse_status="malformed", parse_detail="ethernet frame shorter than 14 bytes", protocol_name="ethernet")
            else:
                _ethernet(row, frame)
        elif linktype in (RAW, IPV4_LINK, IPV6_LINK):
            version, read = (6, _ipv6) if linktype == IPV6_LINK else (4, _ipv4)
            try:
                read(row, frame)
            except Short as e:
                row.update(parse_status="malformed", parse_detail=f"raw ipv{version} unpack failed: {e}")
        else:
            row.update(parse_status="unsupported", parse_detail=f"unsupported linktype: {linktype}", protocol_name=f"linktype_{linktype}")
    except Exception as e:  # a frame must never end the scan
        row = blank(index, timestamp, len(frame), linktype)
        row.update(parse_status="error", parse_detail=f"unexpected decode error: {type(e).__name__}: {e}")
    return row
