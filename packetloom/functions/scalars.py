"""Column expressions: protocol classes, labels, group keys, identifiers and seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_IP = "0.0.0.0"
ARP_REQUEST, ARP_REPLY = 1, 2
MQTT_PORTS = (1883,)
#: Bits of the TCP flags octet. Fixed values.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
#: Enters every seed. Fixed value.
SEED_VERSION = "phase2a_v1"

# Label tables of the capture collection. Fixed values.
ATTACKS = {
    "ARP_Spoofing": ("Spoofing", "ARP_Spoofing"),
    "Recon-OS_Scan": ("Recon", "OS_Scan"),
    "Recon-Ping_Sweep": ("Recon", "Ping_Sweep"),
    "Recon-Port_Scan": ("Recon", "Port_Scan"),
    "Recon-VulScan": ("Recon", "VulScan"),
    "MQTT-DDoS-Connect_Flood": ("MQTT", "MQTT_DDoS_Connect_Flood"),
    "MQTT-DDoS-Publish_Flood": ("MQTT", "MQTT_DDoS_Publish_Flood"),
    "MQTT-DoS-Connect_Flood": ("MQTT", "MQTT_DoS_Connect_Flood"),
    "MQTT-DoS-Publish_Flood": ("MQTT", "MQTT_DoS_Publish_Flood"),
    "MQTT-Malformed_Data": ("MQTT", "MQTT_Malformed_Data"),
} | {f"TCP_IP-{f}-{p}": (f, f"{f}_{p}") for f in ("DDoS", "DoS") for p in ("ICMP", "SYN", "TCP", "UDP")}
DEVICES = {
    "Blink_Camera": "Blink_Camera",
    "Blink_Mini_Camera": "Blink_Camera",
    "Ecobee_Camera": "Ecobee_Camera",
    "M1T_Camera": "M1T_Camera",
    "Owltron_Camera": "Owltron_Camera",
    "Multifunctional_Pager": "Multifunctional_Pager",
    "SenseU": "SenseU",
    "SenseUBaby": "SenseU",
    "Singcall": "Singcall",
}
FAMILIES = ("DDoS", "DoS", "MQTT", "Recon", "Spoofing")


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE WHEN in the order of pairs."""
    first, rest = pairs[0], pairs[1:]
    out = reduce(lambda c, p: c.when(p[0], p[1]), rest, F.when(*first))
    return out.otherwise(otherwise)


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def l3_category() -> Column:
    """Exclusive: ipv4 before ipv6 before arp before llc before other."""
    return cases(*((F.col(f"is_{x}"), x) for x in ("ipv4", "ipv6", "arp", "llc")), otherwise="other")


def tcp_flag(name: str) -> Column:
    return F.col("tcp_flags").bitwiseAND(TCP_FLAGS[name]) != 0


def is_failure() -> Column:
    return F.col("parse_status").isin("malformed", "error")


def is_mqtt_port() -> Column:
    return F.coalesce(F.col("src_port").isin(*MQTT_PORTS), F.lit(False)) | F.coalesce(F.col("dst_port").isin(*MQTT_PORTS), F.lit(False))


def is_arp_probe() -> Column:
    return F.coalesce((F.col("arp_op") == ARP_REQUEST) & (F.col("src_ip") == ZERO_IP), F.lit(False))


def is_gratuitous_arp() -> Column:
    return F.coalesce((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_ip") != ZERO_IP), F.lit(False))


def is_arp_identity() -> Column:
    """ARP rows whose sender addresses can be compared."""
    return F.coalesce(F.col("is_arp") & (F.col("src_ip") != ZERO_IP) & (F.col("arp_sha") != ""), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def issue_code() -> Column:
    """Fixed code of a packet that is not ok, null otherwise; which test comes first matters."""
    detail, proto = F.lower(F.coalesce("parse_detail", F.lit(""))), F.lower(F.coalesce("protocol_name", F.lit("unknown")))

    def first(kind: str, words: tuple[str, ...], suffix: dict[str, str] | None = None) -> Column:
        return cases(*((detail.contains(w), f"{kind}:{(suffix or {}).get(w, w)}") for w in words), otherwise=f"{kind}:other")

    return cases(
        (F.col("parse_status") == "unsupported", F.when((proto == "lldp") | detail.contains("0x88cc"), "unsupported:lldp").otherwise(F.concat(F.lit("unsupported:"), proto))),
        (F.col("parse_status") == "partial", first("partial", ("tcp", "udp", "ipv4", "ipv6", "arp", "llc"), {"tcp": "tcp_truncated", "udp": "udp_truncated"})),
        (F.col("parse_status") == "malformed", first("malformed", ("ethernet", "ipv4", "ipv6"))),
        (F.col("parse_status") == "error", "error:unexpected"),
    )


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def base_label(name: Column) -> Column:
    return F.regexp_replace(name, "_(train|test)$", "")


def split_of_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "_(train|test)$", 1), F.lit(""))


def replicate(base: Column) -> Column:
    return F.nullif(F.regexp_extract(base, r"^TCP_IP-(?:DDoS|DoS)-(?:ICMP|SYN|TCP|UDP)(\d+)$", 1), F.lit("")).cast("int")


def attack_label(base: Column) -> Column:
    """The base label without a replicate number, where one may follow."""
    return F.regexp_replace(base, r"^(TCP_IP-(?:DDoS|DoS)-(?:ICMP|SYN|TCP|UDP))\d+$", "$1")


def attack_family(base: Column) -> Column:
    return lookup({k: v[0] for k, v in ATTACKS.items()}, attack_label(base))


def attack_type(base: Column) -> Column:
    return lookup({k: v[1] for k, v in ATTACKS.items()}, attack_label(base))


def device(name: Column) -> Column:
    return lookup(DEVICES, name)


def repo_relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def pcap_id(relative_path: Column) -> Column:
    return F.concat(stem(relative_path), F.lit("-"), F.substring(F.sha2(relative_path.cast("binary"), 256), 1, 16))


def seed_u64(salt: Column, base_seed: int = 42, version: str = SEED_VERSION) -> Column:
    """Unsigned 64-bit seed as decimal(20,0): the first 16 hex digits of a SHA-256."""
    text = F.concat(F.lit(f"{version}|{base_seed}|"), salt)
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def xor_u64(a: Column, b: Column) -> Column:
    """XOR of two unsigned 64-bit numbers held as decimal(20,0)."""

    half = F.lit(1 << 32).cast("decimal(20,0)")

    def halves(x: Column) -> tuple[Column, Column]:
        low = F.pmod(x, half)
        return ((x - low) / half).cast("bigint"), low.cast("bigint")

    (ah, al), (bh, bl) = halves(a), halves(b)
    return (ah.bitwiseXOR(bh).cast("decimal(10,0)") * half + al.bitwiseXOR(bl)).cast("decimal(20,0)")


def selection_hash(indices: Column) -> Column:
    """SHA-256 of the sorted indices, each followed by a line end."""
    lines = F.array_join(F.transform(F.sort_array(indices), lambda i: F.concat(i.cast("string"), F.lit("\n"))), "")
    return F.sha2(lines.cast("binary"), 256)


def group_key() -> Column:
    """Lineage that is never split between fitting and validation."""
    name = stem(F.col("pcap_path"))
    publisher = (F.col("source") == "attacks") | F.element_at(F.split("pcap_path", "/"), -1).startswith("Benign_")
    missing = F.raise_error(F.concat(F.lit("no modeling group: "), F.coalesce("pcap_path", F.lit("null"))))
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return cases(
        ((F.col("binary_label") == "ATTACK") & has("attack_family") & has("attack_type"), F.concat_ws("|", F.trim("attack_family"), F.trim("attack_type"))),
        ((F.col("binary_label") == "BENIGN") & publisher, F.concat(F.lit("benign|publisher|"), name)),
        ((F.col("binary_label") == "BENIGN") & has("device"), F.concat(F.lit("benign|device|"), F.trim("device"))),
        (F.col("binary_label") == "BENIGN", F.concat(F.lit("benign|singleton|"), name)),
        otherwise=missing.cast("string"),
    )


def group_kind(key: Column) -> Column:
    """Kind of a group of the feature characterization; a bare family is other."""
    return cases((key == "all_train", "all"), (key.startswith("attack_family_"), "attack_family"), (key.startswith("attack_type_"), "attack_type"), (key.startswith("profiling_"), "profiling"), (key == "publisher_benign", "benign"), otherwise="other")


def benign_category() -> Column:
    kind = F.lower(F.trim(F.coalesce("profiling_type", F.lit(""))))
    return F.when((F.col("source") == "attacks") | (kind == ""), "publisher_benign").otherwise(F.concat(F.lit("profiling_"), kind))


def bucket_windowing() -> Column:
    """Summary bucket that needs source."""
    kind = F.lower(F.coalesce("profiling_type", F.lit("")))
    return cases((F.col("binary_label") == "ATTACK", F.coalesce("attack_family", F.lit("other"))), ((F.col("binary_label") == "BENIGN") & (F.col("source") == "attacks"), "publisher_benign"), (kind.isin("idle", "active", "interaction", "power"), F.concat(F.lit("profiling_"), kind)), otherwise="other")


def bucket_features() -> Column:
    """Summary bucket without source: benign rows with neither family nor profiling type are the publisher's."""
    kind, family = F.lower(F.coalesce("profiling_type", F.lit(""))), F.coalesce("attack_family", F.lit(""))
    return cases((kind.isin("idle", "active", "interaction", "power"), F.concat(F.lit("profiling_"), kind)), (family != "", family), (F.col("binary_label") == "BENIGN", "publisher_benign"), otherwise="other")


def bucket_audit() -> Column:
    """Summary bucket with a place for other profiling and any family name."""
    kind = F.lower(F.coalesce("profiling_type", F.lit("")))
    return cases((F.col("binary_label") == "ATTACK", F.coalesce(F.nullif("attack_family", F.lit("")), F.lit("attack_unknown"))), (F.col("source") == "attacks", "publisher_benign"), (kind.isin("idle", "active", "interaction", "power"), F.concat(F.lit("profiling_"), kind)), otherwise="profiling_other")


def bucket_smoke() -> Column:
    """Summary bucket of the smoke run: profiling, then family, then publisher, then label."""
    kind, family = F.coalesce("profiling_type", F.lit("")), F.coalesce("attack_family", F.lit(""))
    return cases((kind != "", F.concat(F.lit("profiling_"), kind)), (family != "", family), ((F.col("source") == "attacks") & (F.col("binary_label") == "BENIGN"), "publisher_benign"), otherwise=F.coalesce(F.nullif("binary_label", F.lit("")), F.lit("unknown")))


def report_bucket(path: str = "pcap_path") -> Column:
    """Benign report group: idle, owltron_interaction, owltron_power or null."""
    low = F.lower(F.col(path))
    return cases((F.lower(F.coalesce("profiling_type", F.lit(""))) == "idle", "idle"), (low.contains("owltron") & (F.lower("profiling_type") == "interaction"), "owltron_interaction"), (low.contains("owltron") & (F.lower("profiling_type") == "power"), "owltron_power"))


def encode_label() -> Column:
    return cases((F.col("binary_label") == "BENIGN", 0), (F.col("binary_label") == "ATTACK", 1), otherwise=F.raise_error(F.concat(F.lit("no such label: "), F.coalesce("binary_label", F.lit("null")))).cast("int"))


def is_attack(threshold: float) -> Column:
    """Inclusive, on doubles."""
    return F.col("score").cast("double") >= F.lit(float(threshold))


def policy_id(k: int, r: float) -> str:
    return f"K{k}_R{r:g}"


def checkpoint_id(path: Column) -> Column:
    return F.sha2(path.cast("binary"), 256)


def packed_ip(text: Column) -> Column:
    """An address as 4 or 16 bytes, so that equal ones in two spellings are equal; anything else as its UTF-8 bytes."""
    octets = F.split(text, r"\.")
    v4 = F.unhex(F.array_join(F.transform(octets, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), ""))
    sides = F.split(F.lower(text), "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda x: x != "")
    left, right = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    v6 = F.unhex(F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), ""))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    is_v4 = text.rlike(rf"^{octet}(\.{octet}){{3}}$")
    is_v6 = text.rlike("^[0-9A-Fa-f:]{2,39}$") & text.contains(":") & (F.size(sides) <= 2) & (F.octet_length(v6) == 16) & ((F.size(sides) == 2) | (F.size(left) == 8))
    return F.when(is_v4, v4).when(F.coalesce(is_v6, F.lit(False)), v6).otherwise(text.cast("binary"))


def test_category(path: Column) -> Column:
    """Benign category of a capture of the test split from its path; one that fits none fails."""
    parts = F.transform(F.split(path, "/"), F.lower)
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    missing = F.raise_error(F.concat(F.lit("no benign category: "), path)).cast("string")
    return cases((F.lower(stem(path)).startswith("benign"), "publisher"), (has("power"), "profiling_power"), (has("idle"), "profiling_idle"), (has("interactions", "interaction"), "profiling_interaction"), otherwise=missing)


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def arp_probe_group() -> Column:
    """Group of a capture in the ARP probe: of fitting captures only, null where it is in none. Reads benign_category and group_kind."""
    category, kind = _text("benign_category"), _text("group_kind")
    benign = _text("binary_label") == "BENIGN"
    own = cases(((_text("attack_family") == "Spoofing") | (kind == "spoofing"), "spoofing"), (benign & ((category == "publisher_benign") | (kind == "publisher_benign")), "publisher_benign"), (benign & (category.startswith("profiling_") | kind.startswith("profiling_")), "profiling_benign"))
    return F.when(F.col("modeling_split") == "fit", own)


def mqtt_probe_group(has_mqtt: Column) -> Column:
    """Group of a capture in the MQTT probe: malformed data, or benign captures that hold MQTT; of fitting captures only, null where it is in none."""
    category, kind = _text("benign_category"), _text("group_kind")
    benign = (_text("binary_label") == "BENIGN") & has_mqtt
    own = cases((_text("attack_type") == "MQTT_Malformed_Data", "mqtt_malformed"), (benign & ((category == "publisher_benign") | (kind == "publisher_benign")), "publisher_benign"), (benign, "profiling_benign"))
    return F.when(F.col("modeling_split") == "fit", own)


def group_code(group: Column, codes: dict[str, int]) -> Column:
    """The small number of a validation group; one that has none fails."""
    return F.coalesce(lookup(codes, group), F.raise_error(F.concat(F.lit("no such group: "), F.coalesce(group, F.lit("null")))).cast("int"))
