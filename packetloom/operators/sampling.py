"""Budgets, reservoirs, splits and folds: deterministic, from SHA-256 seeds."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: Caps by family and mode; None keeps all. Fixed values.
PLANS = {
    "fullish": ("per_pcap", {"DDoS": 50_000, "DoS": 50_000, "MQTT": 50_000, "Recon": None, "Spoofing": None, "BENIGN": None}),
    "family_balanced": ("per_pcap", {"DDoS": 15_000, "DoS": 15_000, "MQTT": 30_000, "Recon": None, "Spoofing": None, "BENIGN": None}),
    "aggressive": ("per_pcap", {"DDoS": 8_000, "DoS": 8_000, "MQTT": 15_000, "Recon": None, "Spoofing": None, "BENIGN": None}),
    "group_balanced": ("per_modeling_group", {"DDoS": 60_000, "DoS": 60_000, "MQTT": 30_000, "Recon": None, "Spoofing": None, "BENIGN": None}),
}


def cap_of(caps: dict[str, int | None]) -> Column:
    kind = F.when(F.col("binary_label") == "BENIGN", "BENIGN").otherwise(F.trim("attack_family"))
    return S.cases(*((kind == k, v) for k, v in caps.items() if v is not None)).cast("bigint")


def allocate(captures: DataFrame, caps: dict[str, int | None], mode: str = "per_pcap") -> DataFrame:
    """captures with ``selected``: windows to keep. Group budgets are dealt in proportion, rounded down, and the rest by largest remainder, ties by path.

    A group's remainder is never larger than its number of captures, so one pass over the ordered remainders deals all of it."""
    own = captures.withColumn("_cap", cap_of(caps))
    n = F.col("window_count")
    if mode == "per_pcap":
        return own.withColumn("selected", F.least(n, F.coalesce("_cap", n))).drop("_cap")
    group = Window.partitionBy("modeling_group_key")
    own = own.withColumn("_cap", F.first("_cap").over(group.orderBy("pcap_path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    exact = F.col("_cap") * (n / F.col("_total"))
    own = own.withColumn("_total", F.sum(n).over(group)).withColumn("_exact", exact).withColumn("_floor", F.least(n, F.floor("_exact")))
    own = own.withColumn("_rest", F.col("_cap") - F.sum("_floor").over(group)).withColumn("_room", (F.col("_floor") < n).cast("int"))
    order = group.orderBy((F.col("_exact") - F.floor("_exact")).desc(), "pcap_path").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.when((F.col("_room") == 1) & (F.sum("_room").over(order) <= F.col("_rest")), 1).otherwise(0)
    kept = F.when(F.col("_cap").isNull() | (F.col("_total") <= F.col("_cap")), n).otherwise(F.col("_floor") + extra)
    return own.withColumn("selected", kept.cast("bigint")).drop("_cap", "_total", "_exact", "_floor", "_rest", "_room")


def simulate(captures: DataFrame, plan: str) -> DataFrame:
    """By family: captures, windows, kept, fraction kept, share of all attack rows kept."""
    mode, caps = PLANS[plan]
    kind = F.when(F.col("binary_label") == "BENIGN", "BENIGN").otherwise(F.col("attack_family"))
    by = allocate(captures, caps, mode).groupBy(kind.alias("family")).agg(F.count(F.lit(1)).alias("captures"), F.sum("window_count").alias("available"), F.sum("selected").alias("kept"))
    attack = F.broadcast(by.agg(F.sum(F.when(F.col("family") != "BENIGN", F.col("kept"))).alias("attack_kept"), F.sum(F.when(F.col("family") == "BENIGN", F.col("kept"))).alias("benign_kept")))
    by = by.crossJoin(attack).withColumn("fraction", S.ratio(F.col("kept"), F.col("available"))).withColumn("attack_share", F.when(F.col("family") != "BENIGN", S.ratio(F.col("kept"), F.col("attack_kept"))))
    return by.withColumn("attack_to_benign", S.ratio(F.col("attack_kept"), F.col("benign_kept"))).drop("attack_kept", "benign_kept")


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """Algorithm R with Python's generator, sorted: the sequence is part of the contract."""
    if min(n, k) < 0 or k > n:
        raise ValueError(f"cannot choose {k} of {n}")
    if k in (0, n):
        return list(range(k))
    draw, held = random.Random(seed).randint, list(range(k))
    for i in range(k, n):
        if (j := draw(0, i)) < k:
            held[j] = i
    return sorted(held)


@F.pandas_udf(T.ArrayType(T.LongType()))
def reservoir_rows(n: pd.Series, k: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([reservoir(int(a), int(b), int(c)) for a, b, c in zip(n, k, seed)])


def sampled(windows: DataFrame, allocation: DataFrame, base_seed: int = 42) -> DataFrame:
    """Rows of windows that the captures' reservoirs choose, by position in the order of window_index."""
    seed = S.seed_u64(F.col("pcap_id"), base_seed).cast("string")
    chosen = allocation.select("pcap_id", F.explode(reservoir_rows("window_count", "selected", seed)).alias("_row"))
    placed = windows.withColumn("_row", F.row_number().over(Window.partitionBy("pcap_id").orderBy("window_index")).cast("bigint") - 1)
    return placed.join(chosen, ["pcap_id", "_row"], "left_semi").drop("_row")


def selection_hashes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("rows"), S.selection_hash(F.collect_list("window_index")).alias("selection_sha256"))


def running_budget(captures: DataFrame, budget: str = "budget", key: str = "bucket") -> DataFrame:
    """take: rows of each capture in path order until the key's budget is spent."""
    before = F.coalesce(F.sum("window_count").over(Window.partitionBy(key).orderBy("pcap_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return captures.withColumn("take", F.greatest(F.lit(0), F.least(F.col("window_count"), F.col(budget) - before)))


def closest_group(groups: DataFrame, target: float, salt: str = "family", base_seed: int = 42) -> DataFrame:
    """Per family the group whose share of windows is nearest to the target; ties by a seeded rank, then the key."""
    share = F.col("windows") / F.sum("windows").over(Window.partitionBy(salt))
    seed = S.seed_u64(F.col(salt), base_seed)
    rank = S.xor_u64(S.seed_u64(F.concat(F.col(salt), F.lit("|tie|"), F.col("modeling_group_key")), base_seed), seed)
    own = groups.withColumn("share", share).withColumn("_rank", rank)
    order = Window.partitionBy(salt).orderBy(F.abs(F.col("share") - target), "_rank", "modeling_group_key")
    return own.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank")


def _seed(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)


#: Singletons that are held out first. Fixed values.
PREFERRED = ("Idle", "Active", "ActiveBroker")


def modeling_split(groups: list[dict], target: float = 0.2, least_device_windows: int = 1000, least_profiling_share: float = 0.15, base_seed: int = 42) -> dict[str, str]:
    """fit or validation of each lineage. A row a lineage (a few dozen): key, kind, family, windows, types (profiling types).

    Per attack family the lineage nearest to the target is held out, unless it is the only one; spoofing and the publisher's benign capture are for fitting only.
    Of the devices that have power and interaction captures and enough windows, the nearest to the target is held out, and a singleton with it if its share of
    profiling windows is small or it shows fewer than two profiling types."""
    out = {g["key"]: "fit" for g in groups}

    def nearest(own: list[dict], total: int, salt: str) -> dict:
        seed = _seed(f"{S.SEED_VERSION}|{base_seed}|{salt}")
        return min(own, key=lambda g: (abs(g["windows"] / total - target), _seed(f"{S.SEED_VERSION}|{base_seed}|{salt}|tie|{g['key']}") ^ seed, g["key"]))

    families: dict[str, list[dict]] = defaultdict(list)
    for g in groups:
        if g["kind"] == "attack_lineage":
            families[g["family"]].append(g)
    held = [nearest(own, sum(g["windows"] for g in own), f"attack_family|{family}") for family, own in sorted(families.items()) if len(own) > 1]
    profiling = [g for g in groups if g["kind"] in ("profiling_device", "profiling_singleton")]
    total = sum(g["windows"] for g in profiling)
    devices = [g for g in profiling if g["kind"] == "profiling_device" and {"power", "interaction"} <= set(g["types"]) and g["windows"] >= least_device_windows]
    singles = {g["key"].rpartition("|")[2]: g for g in profiling if g["kind"] == "profiling_singleton"}
    if devices:
        device = nearest(devices, total, "benign_profiling_device")
        held.append(device)
        few, small = len(set(device["types"])) < 2, device["windows"] / total < least_profiling_share
        if singles and (few or small):
            first = [singles[n] for n in PREFERRED if n in singles and (small or set(singles[n]["types"]) - set(device["types"]))]
            held.append(first[0] if first else nearest(list(singles.values()), total, "benign_profiling_singleton"))
    return out | {g["key"]: "validation" for g in held}


def profiling_splits(rows: list[dict], share: float = 0.2, seed: int = 42) -> dict[str, str]:
    """train or test of each profiling grouping_key. rows: grouping_key, profiling_type, one a capture.

    Of all sets of device groups one is the test set: with power and interaction captures if any has, then nearest to the share, then smallest; the order of
    sets of a size is shuffled with the seed. Singletons are for training."""
    kinds: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        kinds[r["grouping_key"]].append(r["profiling_type"])
    devices = sorted(k for k in kinds if k.startswith("profiling:device:"))
    total = sum(len(kinds[k]) for k in devices)
    shuffle = random.Random(seed).shuffle
    best: tuple | None = None
    both = {"power", "interaction"}
    capable = any(both <= set(kinds[k]) for k in devices)
    for size in range(1, len(devices) + 1):
        sets = list(itertools.combinations(devices, size))
        shuffle(sets)
        for chosen in sets:
            own = [t for k in chosen for t in kinds[k]]
            if capable and not both <= set(own):
                continue
            score = (not both <= set(own), abs(len(own) - share * total), size)
            if best is None or score < best[0]:
                best = (score, chosen)
    test = set(best[1]) if best else set()
    return {k: "test" if k in test else "train" for k in kinds}


def cv_folds(groups: list[dict], families: tuple[str, ...] = S.FAMILIES[:4], version: str = "phase2c1_v1", base_seed: int = 42, folds: int = 3) -> dict[str, int]:
    """Fold of each lineage: key, family (BENIGN for benign), rows.

    A family with as many lineages as folds gives each fold one, in the order of their hashes, and the rest go to the lightest fold; with fewer, and for
    spoofing, the hash decides. Benign lineages go to the lightest fold. Each choice needs the sums before it, so this is a loop over a few dozen rows."""
    digest = {g["key"]: _seed(f"{version}|{base_seed}|{g['key']}") for g in groups}
    weight, out = [0] * folds, {}

    def put(g: dict, fold: int) -> None:
        out[g["key"]] = fold
        weight[fold] += g["rows"]

    def lightest() -> int:
        return min(range(folds), key=lambda i: (weight[i], i))

    by: dict[str, list[dict]] = defaultdict(list)
    for g in sorted(groups, key=lambda g: (digest[g["key"]], g["key"])):
        by[g["family"]].append(g)
    for family in families:
        own = by.get(family, [])
        for i, g in enumerate(own):
            put(g, digest[g["key"]] % folds if len(own) < folds else i if i < folds else lightest())
    for g in by.get("Spoofing", []):
        put(g, digest[g["key"]] % folds)
    for g in by.get("BENIGN", []):
        put(g, lightest())
    return out


def with_folds(table: DataFrame, assignment: dict[str, int]) -> DataFrame:
    """Rows with the fold of their lineage; a few dozen lineages are broadcast."""
    small = F.broadcast(table.sparkSession.createDataFrame(sorted(assignment.items()), "modeling_group_key string, fold int"))
    return table.join(small, "modeling_group_key")


def ranked_candidates(table: DataFrame) -> DataFrame:
    """Configurations by their cross-validation: least family recall, reconnaissance, macro recall, spread, FPR, depth, name."""
    order = Window.orderBy(F.col("min_recall").desc(), F.col("recon_recall").desc(), F.col("macro_recall").desc(), "recall_std", "fpr", "complexity", "config_id")
    return table.withColumn("rank", F.row_number().over(order))


def confirmed(baseline: dict, candidate: dict) -> bool:
    """Whether a candidate replaces the baseline: least or reconnaissance recall gains a point, and MQTT loses one at most."""
    gain = max(candidate["min_recall"] - baseline["min_recall"], candidate["recon_recall"] - baseline["recon_recall"])
    return gain >= 0.01 and candidate["mqtt_recall"] - baseline["mqtt_recall"] >= -0.01
