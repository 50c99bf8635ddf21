"""Inventory of captures: classification of paths, reconciliation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import INVENTORY

SCOPE = "wifi_mqtt"
REQUIRED = ("pcap_path", "filename", "dataset_scope", "source", "split", "binary_label", "file_size")


def classify(files: DataFrame, scope: str = SCOPE) -> DataFrame:
    """Inventory rows of (pcap_path, file_size). Contradictions and unknown names become UNKNOWN with a reason; nothing is guessed.

    Profiling captures have no split yet; see sampling.profiling_splits."""
    f = files.withColumn("parts", F.split("pcap_path", "/")).withColumn("low", F.split(F.lower("pcap_path"), "/"))
    f = f.withColumn("filename", F.element_at("parts", -1)).withColumn("stem", S.stem(F.col("pcap_path"))).withColumn("base", S.base_label(F.col("stem"))).withColumn("named", S.split_of_name(F.col("stem")))
    has = lambda x: F.array_contains("low", x)
    f = f.withColumn("source", S.cases((has("attacks"), "attacks"), (has("profiling"), "profiling"), otherwise="unknown"))
    directory = S.cases((has("train"), "train"), (has("test"), "test"))
    f = f.withColumn("at", F.array_position("low", "pcap").cast("int")).withColumn("dir", directory)
    below = lambda n: F.get("parts", (F.col("at") - 1 + n))
    deep = lambda n: F.col("at") + n < F.size("parts")  # noqa: E731  whether the n-th part below PCAP is a folder
    f = f.withColumn("experiment", below(1)).withColumn("kind", F.lower("experiment"))
    power, spot = F.regexp_replace("stem", "_Power$", ""), below(2)
    gadget = S.cases((F.col("kind") == "power", S.device(power)), (F.col("kind") == "interactions", S.device(spot)))
    f = f.withColumn("gadget", gadget)
    say = lambda text, c: F.concat(F.lit(text), F.coalesce(c, F.lit("")))
    attack_reason = S.cases(
        (has("train") & has("test"), "path contains both train and test"),
        (F.col("dir").isNull(), "attack PCAP missing train/test directory"),
        (F.col("named") != F.col("dir"), F.concat(F.lit("contradictory split: directory="), "dir", F.lit(", filename="), "named")),
        ((F.col("base") != "Benign") & S.attack_type(F.col("base")).isNull(), say("unrecognized attack label: ", F.col("base"))),
    )
    singles = {"idle": "Idle", "active": "Active", "broker": "ActiveBroker"}
    profiling_reason = S.cases(
        (F.col("at") == 0, "profiling path missing PCAP directory"),
        (~deep(1), "profiling path missing experiment subdirectory"),
        *[((F.col("kind") == k) & (F.col("stem") != v), say(f"unexpected {k} filename: ", F.col("filename"))) for k, v in singles.items()],
        ((F.col("kind") == "power") & ~F.col("stem").endswith("_Power"), say("unexpected power filename: ", F.col("filename"))),
        ((F.col("kind") == "power") & F.col("gadget").isNull(), say("unknown power device alias: ", power)),
        ((F.col("kind") == "interactions") & ~deep(2), "interaction path missing device directory"),
        ((F.col("kind") == "interactions") & F.col("gadget").isNull(), say("unknown interaction device alias: ", spot)),
        (~F.col("kind").isin(*singles, "power", "interactions"), say("unrecognized profiling experiment folder: ", F.col("experiment"))),
    )
    f = f.withColumn("reason", S.cases((F.col("source") == "attacks", attack_reason), (F.col("source") == "profiling", profiling_reason), otherwise="PCAP outside attacks/ or profiling/ trees"))
    ok, attacks = F.col("reason").isNull(), F.col("source") == "attacks"
    benign = attacks & (F.col("base") == "Benign")
    session = S.cases(
        (benign, "Benign"), (attacks, F.concat_ws("_", S.attack_type(F.col("base")), S.replicate(F.col("base")).cast("string"))),
        *[(F.col("kind") == k, v) for k, v in singles.items()], (F.col("kind") == "power", F.concat("gadget", F.lit("_Power"))), otherwise=F.col("stem"),
    )
    key = S.cases(
        (benign, F.concat(F.lit("attacks:Benign:"), "dir")), (attacks, F.concat_ws(":", F.lit("attacks"), S.attack_type(F.col("base")), "dir", session)),
        (F.col("gadget").isNotNull(), F.concat(F.lit("profiling:device:"), "gadget")), otherwise=F.concat(F.lit("profiling:singleton:"), session),
    )
    known = lambda c: F.when(ok, c)
    columns = {
        "pcap_path": F.col("pcap_path"), "filename": F.col("filename"), "dataset_scope": F.lit(scope), "source": F.col("source"),
        "split": S.cases((attacks & ok, F.col("dir")), (attacks & (F.col("reason").startswith("contradictory") | F.col("reason").startswith("unrecognized attack")), F.col("dir")), (~ok, "train")),
        "binary_label": S.cases((~ok, "UNKNOWN"), (attacks & ~benign, "ATTACK"), otherwise="BENIGN"),
        "attack_family": known(F.when(attacks, S.attack_family(F.col("base")))), "attack_type": known(F.when(attacks, S.attack_type(F.col("base")))),
        "profiling_type": known(F.when(~attacks, S.cases((F.col("kind") == "idle", "idle"), (F.col("kind").isin("active", "broker"), "active"), (F.col("kind") == "power", "power"), otherwise="interaction"))),
        "profiling_variant": known(F.when(~attacks, S.cases((F.col("kind") == "active", "standard"), (F.col("kind") == "broker", "active_broker")))),
        "device": known(F.when(~attacks, F.col("gadget"))), "capture_session": known(session), "file_size": F.col("file_size"),
        "grouping_key": F.when(ok, key).otherwise(F.concat(F.lit("unresolved:"), "pcap_path")), "unresolved_reason": F.col("reason"),
    }
    return f.select(*[columns[c.name].cast(c.dataType).alias(c.name) for c in INVENTORY.fields])


def row_errors() -> Column:
    """Messages of the rules that an inventory row breaks."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c), F.lit("'")), F.lit("None"))
    among = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    unknown = among("binary_label", "UNKNOWN")
    rules = [(empty(c), F.lit(f"missing required field: {c}")) for c in REQUIRED]
    rules += [
        (~among("binary_label", "ATTACK", "BENIGN", "UNKNOWN"), F.concat(F.lit("invalid binary_label: "), shown("binary_label"))),
        (~among("source", "attacks", "profiling", "unknown"), F.concat(F.lit("invalid source: "), shown("source"))),
        (~among("split", "train", "test") & ~unknown, F.concat(F.lit("invalid split: "), shown("split"))),
        (among("binary_label", "ATTACK") & empty("attack_family"), F.lit("ATTACK rows require attack_family")),
        (among("binary_label", "ATTACK") & empty("attack_type"), F.lit("ATTACK rows require attack_type")),
        (among("source", "profiling") & ~unknown & empty("profiling_type"), F.lit("profiling rows require profiling_type")),
        (unknown & empty("unresolved_reason"), F.lit("UNKNOWN rows require unresolved_reason")),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))


def inventory_errors(inventory: DataFrame) -> DataFrame:
    """pcap_path, error: broken rules and paths given twice."""
    broken = inventory.select("pcap_path", F.explode(row_errors()).alias("error"))
    twice = inventory.groupBy("pcap_path").count().where("count > 1").select("pcap_path", F.lit("duplicate pcap_path").alias("error"))
    return broken.unionByName(twice)


def reconcile(inventory: DataFrame, splits: DataFrame, files: DataFrame) -> DataFrame:
    """pcap_path, issue_code of what inventory, split table and files on disk (pcap_path, length) disagree on. Of a path split twice the last row counts."""
    inv = inventory.select("pcap_path", F.col("split").alias("inv_split"), F.col("file_size").cast("bigint").alias("inv_size"), F.lit(True).alias("in_inv"))
    spl = splits.withColumn("_row", F.monotonically_increasing_id()).groupBy("pcap_path").agg(F.max_by("split", "_row").alias("csv_split")).withColumn("in_csv", F.lit(True))
    disk = files.select("pcap_path", F.col("length").alias("disk_size"), F.lit(True).alias("on_disk"))
    all_ = inv.join(spl, "pcap_path", "full_outer").join(disk, "pcap_path", "full_outer")
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(t("in_inv") & ~t("in_csv"), "manifest:missing_from_split"), F.when(~t("in_inv") & t("in_csv"), "manifest:missing_from_inventory"),
        F.when(t("in_inv") & t("in_csv") & ~F.col("inv_split").eqNullSafe(F.col("csv_split")), "manifest:split_mismatch"),
        F.when(t("in_inv") & ~t("on_disk"), "manifest:missing_pcap"), F.when(~t("in_inv") & t("on_disk"), "manifest:extra_pcap"),
        F.when(t("in_inv") & t("on_disk") & ~F.col("inv_size").eqNullSafe(F.col("disk_size")), "manifest:file_size_mismatch"),
    ))
    return all_.select("pcap_path", F.explode(codes).alias("issue_code"))


def train_rows(inventory: DataFrame) -> DataFrame:
    return inventory.where((F.col("split") == "train") & F.col("binary_label").isin("BENIGN", "ATTACK"))


def selected(inventory: DataFrame, paths: DataFrame) -> DataFrame:
    """Inventory rows of the requested paths; one that is missing fails the query."""
    asked = paths.select("pcap_path").distinct().join(inventory, "pcap_path", "left")
    return asked.withColumn("filename", F.when(F.col("binary_label").isNull(), F.raise_error(F.concat(F.lit("not in the inventory: "), "pcap_path")).cast("string")).otherwise(F.col("filename")))


def pending(wanted: DataFrame, manifest: DataFrame, pinned: list[str]) -> DataFrame:
    """Captures to build: those that no finished manifest row matches in every pinned field."""
    done = manifest.where("status = 'ok'").select(*pinned)
    same = [wanted[c].eqNullSafe(done[c]) for c in pinned]
    return wanted.join(done, same, "left_anti")


def inventory_summary(inventory: DataFrame) -> DataFrame:
    label = lambda x: F.count_if(F.col("binary_label") == x)
    return inventory.groupBy("source", "split").agg(F.count(F.lit(1)).alias("captures"), label("ATTACK").alias("attack"), label("BENIGN").alias("benign"), label("UNKNOWN").alias("unknown"), F.sum("file_size").alias("bytes"))


def split_summary(table: DataFrame) -> DataFrame:
    """Captures, windows and lineages by split and category."""
    category = F.when(F.col("binary_label") == "ATTACK", F.col("attack_family")).otherwise(S.benign_category())
    return table.withColumn("category", category).withColumn("modeling_group_key", S.group_key()).groupBy("split", "category").agg(F.count(F.lit(1)).alias("captures"), F.sum("window_count").alias("windows"), F.count_distinct("modeling_group_key").alias("groups"))


def in_audit_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("scope", "pcap_path", F.coalesce("packet_index", F.lit(-1)), "issue_code")


def overlap(a: DataFrame, b: DataFrame, key: str = "pcap_id") -> DataFrame:
    """Keys in both; must be empty for disjoint sets."""
    return a.select(key).intersect(b.select(key))


def uncovered(universe: DataFrame, *parts: DataFrame, key: str = "pcap_id") -> DataFrame:
    """Keys of the universe in none of the parts, and keys of parts outside it."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionByName(p.select(key))
    missing = universe.select(key).join(union, key, "left_anti").withColumn("where", F.lit("missing"))
    return missing.unionByName(union.join(universe.select(key), key, "left_anti").distinct().withColumn("where", F.lit("extra")))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fingerprint(manifest: DataFrame, without: tuple[str, ...] = ("elapsed_seconds", "resumed", "output_file_size", "manifest_file_size", "disk_file_size")) -> DataFrame:
    """One hash of a manifest's rows in any order, without times and sizes."""
    columns = sorted(c for c in manifest.columns if c not in without)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return manifest.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def ranked_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.col("file_size").desc(), "pcap_path").limit(n)


def first_rows(table: DataFrame, n: int, key: str = "pcap_id", order: str = "window_index") -> DataFrame:
    """The first n rows of each key."""
    return table.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def with_test_metadata(captures: DataFrame) -> DataFrame:
    """attack_family, attack_type and benign_category of test captures from their paths; what does not apply is empty, what is unknown fails."""
    label, base = F.upper(F.trim("binary_label")), S.base_label(S.stem(F.col("pcap_path")))
    attack = label == "ATTACK"
    unknown = F.raise_error(F.concat(F.lit("no such attack: "), F.col("pcap_path"))).cast("string")
    benign = F.when(label == "BENIGN", S.test_category(F.col("pcap_path"))).otherwise(F.raise_error(F.concat(F.lit("no such label: "), F.coalesce("binary_label", F.lit("null")))).cast("string"))
    own = {"attack_family": F.when(attack, F.coalesce(S.attack_family(base), unknown)).otherwise(""), "attack_type": F.when(attack, F.coalesce(S.attack_type(base), unknown)).otherwise("")}
    return captures.withColumns(own | {"benign_category": F.when(attack, "").otherwise(benign)})


def validation_rows(split: DataFrame) -> DataFrame:
    """Rows of the validation captures; one whose features are a sampled view or test data fails."""
    path = F.regexp_replace("feature_parquet_path", r"\\", "/")
    bad = path.contains("views/") | F.lower(path).contains("test")
    message = F.concat(F.lit("not unsampled training features: "), path)
    return split.where(F.col("modeling_split") == "validation").withColumn("feature_parquet_path", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("feature_parquet_path")))


def frozen_policy_rows(table: DataFrame, policy) -> DataFrame:
    """Rows of a windowing table, as text, whose policy is this one in numbers; those that can't be read as numbers are passed over."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return table.where((F.floor(number("window_size")) == policy.window_size) & (number("inactivity_timeout_seconds") == policy.inactivity_s) & (number("backward_reset_seconds") == policy.backward_s) & (F.coalesce("pcap_path", F.lit("")) != ""))


def manifest_inventory(manifest: DataFrame) -> DataFrame:
    """Captures by label and rows of a build's manifest, in one row; a row that is not ok fails."""
    label = F.upper(F.coalesce("binary_label", F.lit("")))
    rows = F.when(F.lower(F.trim("status")) == "ok", F.coalesce(F.col("output_row_count").cast("long"), F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not ok: "), F.col("pcap_id"))).cast("long"))
    return manifest.agg(F.count(F.lit(1)).alias("pcap_count"), F.count_if(label == "ATTACK").alias("attack_pcaps"), F.count_if(label == "BENIGN").alias("benign_pcaps"), F.coalesce(F.sum(rows), F.lit(0)).alias("total_feature_rows"))


def test_inventory_violations(inventory: DataFrame, fitted: DataFrame, captures: int, rows: int) -> DataFrame:
    """violation, pcap_id: other numbers of captures or rows than expected, ids given twice, and ids of the fitting or validation split."""
    total = inventory.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("output_row_count"), F.lit(0)).alias("k"))
    wrong = total.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != captures, "capture_count"), F.when(F.col("k") != rows, "row_count")))).alias("violation"), F.lit(None).cast("string").alias("pcap_id"))
    twice = duplicates(inventory, "pcap_id").select(F.lit("duplicate_pcap").alias("violation"), "pcap_id")
    return wrong.unionByName(twice).unionByName(overlap(inventory, fitted).select(F.lit("also_in_training").alias("violation"), "pcap_id"))
