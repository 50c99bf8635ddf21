"""Benchmark decontamination: texts as templates with typed placeholders, hash-joined in windows, with slots that must be consistent."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, texts, written
from .filters import bloom_filter, passes

#: Words in a window, and words of it that must not be placeholders.
WINDOW, LEAST_PLAIN = 8, 5
#: A document holds an item from this share of the item's windows on, or from this many windows on end.
LEAST_SHARE, LEAST_RUN = 0.3, 6
REMEMBERED = 600_000
#: Added to the width that begins the hash of an exact window.
EXACT = 16
#: Units after a number. Fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ton tons l ml liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent degree degrees kmh mph hz khz mhz ghz w kw v a b kb mb gb tb".split())
NUMBER, NAME, UNIT, EMPTY = 1, 2, 3, 4

_NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?\Z")
_TRIM = "!?.,;:#$%&*|\"'()[]{}<>“”‘’«»¿¡…`~_=+/\\-"


class Words(dict):
    """By word: a hash of its plain form, or EMPTY; and whether it looks like a name, is a unit, ends a sentence, is a number."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        core = word if word.isalpha() else word.strip(_TRIM)
        flags = (word.rstrip("\"'”’)*#&$%|")[-1:] in ".!?:") << 2
        if not core:
            code = EMPTY
        else:
            lower = core.lower()
            raw = lower.encode("utf-8", "surrogatepass")
            code = (zlib.crc32(raw) << 24 | zlib.adler32(raw) & 0xFFFFFF) + 8
            if not core.isalpha() and _NUMERIC.match(core):
                flags |= 8
            else:
                flags |= (len(core) > 1 and core[0].isupper() and core[1:].islower()) | (lower in UNITS) << 1
        out = self[word] = code << 4 | flags
        return out


_words = Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: An odd number for each place in a window.
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, WINDOW).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def template(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Codes of the text's words with placeholders for numbers, names and units, the slot kinds, the words, and the codes without placeholders;
    words of marks alone are left out."""
    words = text.split()
    packed = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    starts = np.zeros(len(words), bool)
    starts[:1] = True
    starts[1:] = packed[:-1] & 4 > 0
    codes = packed >> 4
    kind = np.where(packed & 8 > 0, NUMBER, 0)
    kind[(packed & 1 > 0) & ~starts] = NAME
    after = np.zeros(len(words), bool)
    after[1:] = packed[:-1] & 8 > 0
    kind[(packed & 2 > 0) & after] = UNIT
    keep = codes != EMPTY
    plain = codes[keep]
    codes = np.where(kind > 0, kind, codes)
    return codes[keep], kind[keep], [w for w, k in zip(words, keep) if k] if not keep.all() else words, plain


def _sums(codes: np.ndarray, width: int, seed: int) -> np.ndarray:
    x = codes.astype(np.uint64)
    h = np.full(len(x) - width + 1, seed, np.uint64)
    for i, factor in enumerate(_FACTORS[:width]):
        h += x[i : len(h) + i] * factor
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    return ((h ^ h >> np.uint64(31)) * _MIX).view(np.int64)


def _n_plain(kind: np.ndarray, width: int) -> np.ndarray:
    placeholders = np.concatenate(([0], np.cumsum(kind > 0)))
    return width - (placeholders[width:] - placeholders[:-width])


def windows(codes: np.ndarray, kind: np.ndarray, size: int = WINDOW, plain: int = LEAST_PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows with enough plain words, and where each begins. A text shorter than a window is one window."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = min(size, len(codes))
    good = np.flatnonzero(_n_plain(kind, width) >= min(plain, width))
    return _mixed(_sums(codes, width, width)[good]), good


def exact_windows(plain: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hashes of all windows of the words as they are, by where they begin. A text shorter than a window is one window."""
    width = min(size, len(plain))
    return _mixed(_sums(plain, width, width + EXACT)) if width else np.zeros(0, np.int64)


def with_sentence_starts(codes: np.ndarray, kind: np.ndarray, plain: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """windows(), and again those that begin with a name, with that word taken as plain: an item that is quoted within a sentence keeps its capital.
    The third array tells which are which."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    width = min(size, len(codes))
    h, room, least = _sums(codes, width, width), _n_plain(kind, width), min(LEAST_PLAIN, width)
    at = np.flatnonzero(room >= least)
    again = np.flatnonzero((kind[: len(h)] == NAME) & (room + 1 >= least))
    more = h[again] + (plain[again] - codes[again]).view(np.uint64) * _FACTORS[0]
    return _mixed(np.concatenate((h[at], more))), np.concatenate((at, again)), np.repeat((False, True), (len(at), len(again)))


def slots(words: list[str], kind: np.ndarray, start: int, width: int) -> str:
    """The values of a window's slots, one a line."""
    return "\n".join(words[start + i].strip(_TRIM).lower() for i in np.flatnonzero(kind[start : start + width]))


WINDOW_ROWS = "id long, hash long, pos long, slots string, width long, exact boolean"


def _rows(rows: list[tuple]) -> dict | None:
    return dict(zip(("id", "hash", "pos", "slots", "width", "exact"), map(list, zip(*rows)))) if rows else None


def _item_rows(items: DataFrame) -> DataFrame:
    """The windows of each item's text. Items shorter than a window, and those of which no window has enough plain words, have exact windows too."""

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), texts(batch)):
            codes, kind, words, plain = template(text)
            width = min(WINDOW, len(codes))
            hashes, at = windows(codes, kind)
            rows += [(item, int(h), int(p), slots(words, kind, int(p), width), width, False) for h, p in zip(hashes, at)]
            if width < WINDOW or not len(at):
                rows += [(item, int(h), p, "", width, True) for p, h in enumerate(exact_windows(plain))]
        return _rows(rows)

    return in_batches(items, run, WINDOW_ROWS)


def _document_rows(docs: DataFrame, shapes: list[tuple[int, bool]], known: np.ndarray) -> DataFrame:
    """The windows of each document that have one of the shapes, which are (width, exact), and pass the filter of known hashes. Of windows that are exact
    the first of each hash is enough."""

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            codes, kind, words, plain = template(text)
            for width, exact in shapes:
                if width > len(codes):
                    continue
                if exact:
                    hashes = exact_windows(plain, width)
                    at = np.flatnonzero(passes(hashes, known))
                    hashes, first = np.unique(hashes[at], return_index=True)
                    rows += [(doc, int(h), int(p), "", width, True) for h, p in zip(hashes, at[first])]
                    continue
                hashes, at, second = with_sentence_starts(codes, kind, plain, width)
                found = passes(hashes, known)
                rows += [(doc, int(h), int(p), slots(words, kind, int(p) + int(s), width - int(s)), width, False) for h, p, s in zip(hashes[found], at[found], second[found])]
        return _rows(rows)

    return in_batches(docs, run, WINDOW_ROWS)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item found in the document), item_windows, longest_run, n_reworded (windows whose slots differ).

    A window counts if its slots agree with the item's, or if each slot value of the item stands for one value throughout the document's match, so that a
    question with other numbers or names is found, but a mere pattern of numbers is not. All places of a window count: those at one offset to the item are
    judged together. An item of fewer than WINDOW words is found by a window of its own width, word for word or with other slot values; one without a window
    of LEAST_PLAIN plain words is found word for word only. Null or empty texts match nothing, nor do texts match an item without words; texts of any length
    are read whole. An item given twice counts once an item_id, an item with null item_id as an item of its own, null; a null doc_id matches as a document of
    its own id, null, and rows that repeat a doc_id as one document. Other columns play no part. Without documents or items there are no rows."""
    own = _item_rows(benchmark.select(F.col("item_id").alias("id"), "text")).select(F.col("id").alias("item_id"), "hash", "width", "exact", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")).distinct()
    own = written(own, "item-windows")
    shapes = sorted((r.width, r.exact) for r in own.select("width", "exact").distinct().collect())
    known = bloom_filter(own.select("hash").distinct())
    in_docs = _document_rows(docs.select(F.col("doc_id").alias("id"), "text"), shapes, known).select(F.col("id").alias("doc_id"), "hash", "pos", "slots")
    totals = own.groupBy("item_id").agg(F.count_distinct("item_pos").alias("item_windows"))
    # The one window of a short item must agree with itself.
    here, there = F.split("slots", "\n"), F.split("item_slots", "\n")
    agrees = F.col("exact") | (F.col("width") == WINDOW) | (F.size(F.array_distinct(F.arrays_zip(here, there))) == F.size(F.array_distinct(there)))
    hit = in_docs.join(own, "hash").where(agrees).select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"), F.struct("item_pos", "slots", "item_slots").alias("w"))
    # A row holds no more than an item's windows; quotes that are repeated word for word become one.
    aligned = hit.groupBy("doc_id", "item_id", "offset").agg(F.sort_array(F.collect_set("w")).alias("found")).groupBy("doc_id", "item_id", "found").agg(F.min("offset").alias("offset"))
    pair = aligned.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list(F.struct("offset", "found"))).alias("places"))

    def judge(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_windows": [], "longest_run": [], "n_reworded": []}
        for places in batch.column(2).to_pylist():
            n, longest, reworded = best_match([[(f["item_pos"], f["slots"], f["item_slots"]) for f in p["found"]] for p in places])
            out["n_windows"].append(n)
            out["longest_run"].append(longest)
            out["n_reworded"].append(reworded)
        return {"doc_id": batch.column(0), "item_id": batch.column(1)} | out

    judged = in_batches(pair, judge, "doc_id long, item_id long, n_windows long, longest_run long, n_reworded long")
    return judged.join(totals.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).select("doc_id", "item_id", "n_windows", "item_windows", "longest_run", "n_reworded")


def consistent(found: list[tuple[int, str, str]], means: dict[str, str]) -> tuple[dict[int, bool], int, dict[str, str]]:
    """Of windows at one offset, by item position, those that fit one assignment of slot values and whether they have other values than the item's; the
    longest run of them; and the assignment, which begins as means."""
    means, fitting = dict(means), {}
    run = longest = 0
    before = None
    for item_pos, here, there in found:
        mine, theirs = here.split("\n"), there.split("\n")
        if item_pos in fitting or len(mine) != len(theirs):
            continue
        new = dict(zip(theirs, mine))
        if any(new[t] != m for t, m in zip(theirs, mine)) or any(means.get(t, m) != m for t, m in new.items()):
            continue
        means |= new
        fitting[item_pos] = mine != theirs
        run = run + 1 if before is not None and item_pos - before <= WINDOW else 1
        before = item_pos
        longest = max(longest, run)
    return fitting, longest, means


def best_match(places: list[list[tuple[int, str, str]]]) -> tuple[int, int, int]:
    """Windows of an item that fit one assignment, the longest run of them, and those with other values than the item's. Each offset is judged on its own;
    to the one with most windows those of the others are added that agree with its assignment, as in a quote with words put in."""
    judged = [(f, *consistent(f, {})) for f in places]
    judged.sort(key=lambda x: (-len(x[1]), -x[2]))
    _, fitting, longest, means = judged[0]
    for found, _, own_longest, _ in judged[1:]:
        longest = max(longest, own_longest)
        more, _, after = consistent([f for f in found if f[0] not in fitting], means)
        if more:
            fitting, means = fitting | more, after
    return len(fitting), longest, sum(fitting.values())


def contaminated(found: DataFrame) -> F.Column:
    return (F.col("n_windows") >= LEAST_SHARE * F.col("item_windows")) | (F.col("longest_run") >= LEAST_RUN)


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds."""
    found = matches(docs, benchmark)
    return found.where(contaminated(found))
