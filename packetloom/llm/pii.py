"""Personal data: high-recall generators propose spans, boosted trees score them by format and context, calibrated thresholds choose."""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import in_batches, texts

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the model can select, in the order of spans.
MORE = ("secret", "ipv6", "iban", "local_phone", "national_id", "spoken_email")
KINDS = BASE + MORE

# Same matches as the plain patterns: a failed start inside a run of the same class fails everywhere in that run.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: High-recall proposals of the further kinds.
_PROPOSALS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+=-])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "spoken_email": re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+", re.I),
}
#: Words before a span that speak for a kind. Fixed values.
CUES = {
    "secret": ("token", "secret", "key", "password", "passwd", "api", "auth", "bearer"),
    "ipv6": ("ip", "address", "host", "addr", "server"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "national_id": ("ssn", "social", "security", "id", "insurance"),
    "spoken_email": ("email", "mail", "contact", "write"),
}
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds, each kind leftmost and non-overlapping; matches that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x) < 4 and int(x) <= 255 for x in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of the further kinds."""
    if not _DIGIT.search(text) and ":" not in text and "at" not in text.lower():
        return [("secret", *m.span()) for m in _PROPOSALS["secret"].finditer(text)]
    return [(k, *m.span()) for k, p in _PROPOSALS.items() for m in p.finditer(text)]


def _mod97(x: str) -> float:
    x = x.replace(" ", "")
    return float(int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1) if x.isascii() and x.isalnum() else 0.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    n = len(span)
    counts: dict[str, int] = {}
    for c in span:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    digits, upper, lower = sum("0" <= c <= "9" for c in span), sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    before = text[max(0, start - CONTEXT) : start].lower()
    cue = max((before.rfind(w) + len(w) for w in CUES[kind] if w in before), default=0)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    return [KINDS.index(kind), n, entropy, digits / n, upper / n, lower / n, switches / n, float(all(c in "0123456789abcdefABCDEF" for c in span)), _mod97(span) if kind == "iban" else 0.0, cue / max(1, len(before)), float(before.rstrip().endswith(("=", ":", '"', "'"))), float(span.count(":")), float("--" in span or "__" in span)]


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Invented spans of every kind in invented sentences, half of them look-alikes that are no personal data."""
    r = random.Random(seed)
    letters, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    word = lambda k=0: "".join(r.choice(letters) for _ in range(k or r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def iban(valid: bool) -> str:
        country, body = "".join(r.choice(letters.upper()) for _ in "ab"), num(r.randint(12, 22))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{(check if valid else (check + r.randint(1, 90)) % 98):02d}{body}"

    def one(kind: str, real: bool) -> str:
        if kind == "secret":
            return ("".join(r.choice(hexes if r.random() < 0.5 else letters + letters.upper() + "0123456789") for _ in range(r.randint(24, 64) if r.random() < 0.8 else r.randint(65, 600))) if r.random() < 0.5 else "".join(r.choice(hexes) for _ in range(r.choice((32, 40, 64))))) if real else r.choice((word(25), "-".join(word() for _ in range(6)), "/".join(word() for _ in range(5)), "x" * 30, "-" * 40, word(22).upper(), num(24)))
        if kind == "ipv6":
            return ":".join("".join(r.choice(hexes) for _ in range(4)) for _ in range(8)) if real else r.choice((f"{num(2)}:{num(2)}:{num(2)}", "::1", "a:b:c", f"1:{num(1)}:{num(1)}:3"))
        if kind == "iban":
            return iban(real)
        if kind == "local_phone":
            return f"({num(3)}) {num(3)}-{num(4)}" if real else f"{num(3)} {num(3)} {num(3)}"
        if kind == "national_id":
            return f"{num(3)}-{num(2)}-{num(4)}"
        return f"{word()} [at] {word()} [dot] com" if real else f"{word()}(at){word()}(dot){word(1)}"

    x, y = [], []
    while len(x) < n:
        kind, real = r.choice(MORE), r.random() < 0.5
        cue = r.choice(CUES[kind]) if r.random() < (0.6 if real else 0.05) else word()
        if kind == "national_id" and real:
            cue = r.choice(CUES[kind])
        head = " ".join(word() for _ in range(5)) + f" {cue}{r.choice((': ', ' = ', ' ') if real else (' ', ' ', ', '))}"
        quote = '"' if real and kind == "secret" and r.random() < 0.5 else ""
        text = f"{head}{quote}{one(kind, real)}{quote} {word()} {word()}"
        for k, s, e in proposals(text):
            x.append(features(text, k, s, e))
            y.append(float(real and k == kind))
    return np.array(x, float), np.array(y)


@lru_cache(maxsize=2)
def model(seed: int = 7, n: int = 1500, precision: float = 0.98) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees fitted on invented spans, calibrated and given one threshold a kind on others: the lowest at which a kind keeps the precision."""
    trees = BoostedTrees(rounds=25).fit(*_examples(seed, n))
    trees.calibrate(*_examples(seed + 1, n // 2))
    x, y = _examples(seed + 2, n)
    p = trees.probability(x)
    thresholds = {}
    for k in MORE:
        own = x[:, 0] == KINDS.index(k)
        order = np.argsort(-p[own], kind="stable")
        hits = np.cumsum(y[own][order])
        good = np.flatnonzero(hits / np.arange(1, len(order) + 1) >= precision) if len(order) else []
        thresholds[k] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return trees, thresholds


def spans(text: str, trees: BoostedTrees, thresholds: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Base spans and those that the model selects; of selected ones that overlap, the likelier stays, and none overlaps a base span."""
    found = base_spans(text)
    more = proposals(text)
    if not more:
        return found
    p = trees.probability(np.array([features(text, *c) for c in more], float))
    taken = sorted(s for v in found.values() for s in v)
    for score, (kind, start, end) in sorted(zip(p, more), key=lambda x: (-x[0], x[1])):
        if score >= thresholds[kind] and all(e <= start or s >= end for s, e in taken):
            taken.append((start, end))
            found.setdefault(kind, []).append((start, end))
    return found


def digest(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in sorted(found.get(k, ())))


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """text with every span replaced by its kind in angle brackets; of spans that overlap, the first and longest counts."""
    out, at = [], 0
    for s, e, k in sorted(((s, e, k) for k, v in found.items() for s, e in v), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_more and, if asked for, the redacted text.

    Null text is empty; an empty text has no spans. Rows are independent, so repeated rows and null ids give rows of their own."""
    trees, thresholds = model()

    def run(batch: pa.RecordBatch) -> dict:
        own = texts(batch)
        found = [spans(t, trees, thresholds) for t in own]
        out = {"doc_id": batch.column(0), "base_sha256": [hashlib.sha256(digest(f, BASE).encode()).hexdigest() for f in found], "spans": [digest(f, KINDS) for f in found], "n_more": [sum(len(f.get(k, ())) for k in MORE) for f in found]}
        out |= {f"n_{k}": [len(f[k]) for f in found] for k in BASE}
        return out | ({"redacted": [redact(t, f) for t, f in zip(own, found)]} if redacted else {})

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long" + ", redacted string" * redacted)


def op2_pii(docs: DataFrame) -> DataFrame:
    return find_pii(docs)
