"""Commands: python -m packetloom.cli COMMAND --output FOLDER [inputs]. Every command writes its tables as CSV folders and prints what it wrote."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts
from .functions import scalars as S
from .operators import catalog, features, metrics, ml, quality, sampling, sinks, stats, verdict, windows
from .schemas import ARP_FEATURES, BASE_FEATURES, FEATURE_TABLE, MODEL_FEATURES, MQTT_FEATURES
from .sources import pcap, tables

Tables = dict[str, DataFrame]
COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], Tables]] = {}


def command(*names: str):
    def put(f):
        COMMANDS.update(dict.fromkeys(names, f))
        return f

    return put


def _packets(spark, a) -> DataFrame:
    return pcap.packets(spark, a.input, relativeTo=a.root or "", **({"maxPackets": a.max_packets} if a.max_packets else {}))


def _inventory(spark, a) -> DataFrame:
    return tables.inventory(spark, a.inventory).withColumn("pcap_id", S.pcap_id(F.col("pcap_path")))


def _features(spark, path: str) -> DataFrame:
    return tables.features(spark, path).withColumn("y", S.encode_label())


@command("build-manifests")
def build_manifests(spark, a) -> Tables:
    files = pcap.discover(spark, a.input).select(S.repo_relative(F.col("pcap_path"), a.root or a.input).alias("pcap_path"), F.col("length").alias("file_size"))
    rows = catalog.classify(files)
    profiling = [r.asDict() for r in rows.where("source = 'profiling' AND split IS NULL").select("grouping_key", "profiling_type").collect()]  # one row a capture of a lab, a few dozen
    split = sampling.profiling_splits(profiling)
    small = spark.createDataFrame(sorted(split.items()) or [("", "")], "grouping_key string, _split string")
    rows = rows.join(F.broadcast(small), "grouping_key", "left").withColumn("split", F.coalesce("split", "_split")).select(*rows.columns)
    quality.require(catalog.inventory_errors(rows), "inventory")
    origin = F.when(F.col("source") == "attacks", "publisher").otherwise("derived")
    return {"pcap_inventory": rows.orderBy("pcap_path"), "dataset_split": rows.select("pcap_path", "source", "grouping_key", "split", origin.alias("split_origin"), F.lit(sinks.VERSION).alias("strategy_version"), F.lit(42).alias("seed")).orderBy("pcap_path"), "summary": catalog.inventory_summary(rows)}


@command("inspect-pcaps")
def inspect(spark, a) -> Tables:
    p = _packets(spark, a)
    return {"read_stats": stats.read_stats(p), "protocols": stats.protocol_counts(p)}


@command("audit-corpus")
def audit(spark, a) -> Tables:
    p = _packets(spark, a)
    rows = stats.integrity(p)
    out = {"pcap_integrity": rows, "train_characterization": stats.characterization(p), "observations": quality.file_observations(rows), "accounting": quality.accounting_violations(rows), "totals": stats.audit_totals(rows)}
    if a.inventory and a.split:
        files = pcap.discover(spark, a.input).select(S.repo_relative(F.col("pcap_path"), a.root or a.input).alias("pcap_path"), "length")
        out["reconciliation"] = catalog.reconcile(tables.inventory(spark, a.inventory), tables.splits(spark, a.split), files)
    return out


@command("probe-timestamps")
def probe_timestamps(spark, a) -> Tables:
    p = pcap.packets(spark, a.input, decode="none", relativeTo=a.root or "")
    return {"timestamp_probe": stats.timestamp_probe(p), "first_reversals": stats.first_reversals(p), "largest_reversals": stats.largest_reversals(p)}


@command("characterize-windowing")
def characterize_windowing(spark, a) -> Tables:
    grid = stats.windowing_grid(pcap.packets(spark, a.input, decode="none", relativeTo=a.root or ""), windows.candidate_policies())
    out = {"windowing": grid}
    if a.inventory:
        buckets = _inventory(spark, a).select("pcap_id", S.bucket_windowing().alias("bucket"))
        out["rollup"] = stats.windowing_rollup(grid.join(F.broadcast(buckets), "pcap_id"), "bucket")
    return out


@command("extract-features")
def extract(spark, a) -> Tables:
    sound, failed = windows.without_failed_captures(_packets(spark, a))
    table = features.base_features(sound, max_windows=a.max_windows)
    return {"features": table, "violations": quality.window_violations(table), "accounting": windows.accounting(sound), "failed": failed, "summary": stats.feature_summary(table, BASE_FEATURES)}


@command("build-feature-parquet", "build-feature-dataset")
def build_dataset(spark, a) -> Tables:
    labels = catalog.train_rows(_inventory(spark, a)).select("pcap_id", "pcap_path", "binary_label", "file_size")
    old = spark.read.parquet(a.manifest) if a.manifest else None
    return {"build_manifest": sinks.build_incremental(_packets(spark, a), labels, f"{a.output}/features", old).orderBy("pcap_path")}


@command("validate-feature-dataset")
def validate(spark, a) -> Tables:
    wrong = tables.check_schema(spark, a.features)
    if wrong:
        raise ValueError(f"schema: {wrong}")
    table, p = tables.features(spark, a.features), _packets(spark, a)
    found = quality.dataset_violations(table, spark.read.parquet(a.manifest), stats.integrity(p), windows.window_counts(p)).cache()
    sinks.mark_complete(f"{a.output}/validated.json", found.isEmpty(), {"schema": FEATURE_TABLE.simpleString()})
    return {"violations": found, "summary": stats.feature_summary(table, BASE_FEATURES)}


@command("characterize-feature-dataset")
def characterize(spark, a) -> Tables:
    groups = _inventory(spark, a).select("pcap_id", S.bucket_features().alias("primary_group"), "attack_family", "attack_type")
    table = tables.features(spark, a.features).join(F.broadcast(groups), "pcap_id")
    diagnostics = stats.capture_diagnostics(table)
    return {"groups": stats.group_characterization(table, BASE_FEATURES), "diagnostics": diagnostics, "presence": stats.presence(diagnostics)}


def _split(spark, a) -> DataFrame:
    """Inventory with window counts and fit or validation; a row a lineage goes through the driver."""
    counts = tables.features(spark, a.features).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("window_count"))
    rows = catalog.train_rows(_inventory(spark, a)).join(counts, "pcap_id").withColumn("modeling_group_key", S.group_key())
    key = F.col("modeling_group_key")
    kind = S.cases((F.col("attack_family") == "Spoofing", "spoofing"), (F.col("binary_label") == "ATTACK", "attack_lineage"), (key.startswith("benign|publisher"), "publisher_benign"), (key.startswith("benign|device"), "profiling_device"), otherwise="profiling_singleton")
    groups = rows.groupBy(key.alias("key"), kind.alias("kind"), F.coalesce("attack_family", F.lit("")).alias("family")).agg(F.sum("window_count").alias("windows"), F.array_sort(F.collect_set("profiling_type")).alias("types"))
    assigned = sampling.modeling_split([r.asDict() for r in groups.collect()])
    small = spark.createDataFrame(sorted(assigned.items()), "modeling_group_key string, modeling_split string")
    return rows.join(F.broadcast(small), "modeling_group_key")


@command("characterize-modeling-split", "freeze-modeling-split")
def modeling_split(spark, a) -> Tables:
    rows = _split(spark, a).cache()
    fit, held = rows.where("modeling_split = 'fit'"), rows.where("modeling_split = 'validation'")
    quality.require(catalog.overlap(fit, held, "modeling_group_key"), "lineages on both sides")
    return {"modeling_split": rows.orderBy("pcap_path"), "summary": catalog.split_summary(rows), **{f"plan_{p}": sampling.simulate(fit, p) for p in sampling.PLANS}}


@command("build-modeling-fit-view")
def fit_view(spark, a) -> Tables:
    mode, caps = sampling.PLANS[a.plan]
    chosen = sampling.allocate(_split(spark, a).where("modeling_split = 'fit'"), caps, mode)
    hashes = sinks.write_view(tables.features(spark, a.features), chosen, f"{a.output}/view")
    quality.require(sinks.view_totals(hashes, chosen), "view")
    return {"fit_view_manifest": chosen.join(hashes, "pcap_id", "left").orderBy("pcap_path")}


RUNS = {
    "baseline-run": ("train-baselines", ["logistic_regression", "hist_gradient_boosting"], BASE_FEATURES), "model-family-bakeoff": ("run-model-family-bakeoff", ["hist_gradient_boosting", "random_forest", "adaboost"], BASE_FEATURES),
    "extratrees-challenger": ("run-extratrees-challenger", ["extra_trees"], BASE_FEATURES), "external-boost-challengers": ("run-external-boost-challengers", ["xgboost", "catboost"], BASE_FEATURES), "feature22-boost-rematch": ("run-feature22-boost-rematch", ["hist_gradient_boosting"], MODEL_FEATURES),
    "hgb-sensitivity": ("run-hgb-sensitivity", [], MODEL_FEATURES), "final-test": ("run-final-test", [], MODEL_FEATURES),
}
#: The configurations that are compared, H0 being the baseline, as parameters of depth-limited boosted trees: twice the leaves are one level more. MLlib's trees
#: have no L2 penalty, so H5, H6 and H7 fit as H0. Fixed values.
CONFIGS = {
    "H0": {}, "H1": {"maxDepth": 4}, "H2": {"maxDepth": 6}, "H3": {"minInstancesPerNode": 50}, "H4": {"minInstancesPerNode": 100}, "H5": {}, "H6": {}, "H7": {},
    "H8": {"stepSize": 0.05, "maxIter": 100}, "H9": {"stepSize": 0.15, "maxIter": 38}, "H10": {"featureSubsetStrategy": "0.8"},
    "H11": {"maxDepth": 5, "minInstancesPerNode": 50, "featureSubsetStrategy": "0.8"},
}


def _prepared(kind: str):
    def run(spark, a) -> Tables:
        inputs = {k: v for k, v in (("features", a.features), ("validation", a.validation), ("inventory", a.inventory), ("scores", a.scores)) if v}
        contracts.prepare(a.contract, kind, inputs, {"threshold": a.threshold} if a.threshold is not None else {})
        return {}

    return run


def _model_run(kind: str, names: list[str], columns: tuple[str, ...]):
    def run(spark, a) -> Tables:
        contracts.verify(a.contract, kind, {"threshold": a.threshold})
        fit, held = _features(spark, a.features), _features(spark, a.validation)
        quality.require(catalog.overlap(fit, held), "captures on both sides")
        return {"comparison": ml.baseline_run(fit, held, names, columns)}

    return run


for _kind, (_run, _names, _columns) in RUNS.items():
    COMMANDS[f"prepare-{_kind}"] = _prepared(_kind)
    if _names:
        COMMANDS[_run] = _model_run(_kind, _names, _columns)
for _freeze in ("freeze-v1-candidate", "freeze-phase2c"):
    COMMANDS[_freeze] = _prepared(_freeze.removeprefix("freeze-"))


@command("preflight-final-test")
def preflight(spark, a) -> Tables:
    contracts.verify(a.contract, "final-test")
    return {}


@command("run-hgb-ablations")
def ablations(spark, a) -> Tables:
    return {"ablations": ml.ablations(_features(spark, a.features), _features(spark, a.validation))}


@command("run-hgb-sensitivity")
def sensitivity(spark, a) -> Tables:
    contracts.verify(a.contract, "hgb-sensitivity")
    groups = _inventory(spark, a).select("pcap_id", S.group_key().alias("modeling_group_key"), "attack_family")
    table = _features(spark, a.features).join(F.broadcast(groups), "pcap_id")
    metas = table.groupBy("modeling_group_key").agg(F.count(F.lit(1)).alias("rows"), F.first(F.when(F.col("y") == 1, F.col("attack_family")).otherwise("BENIGN")).alias("family")).collect()
    folds = sampling.cv_folds([{"key": r.modeling_group_key, "family": r.family, "rows": r.rows} for r in metas])
    by_fold = ml.sensitivity(sampling.with_folds(table, folds), CONFIGS)
    by = by_fold.groupBy("config_id").agg(*[F.avg(c).alias(c) for c in ("min_recall", "recon_recall", "mqtt_recall", "macro_recall", "fpr")], F.stddev_pop("macro_recall").alias("recall_std"))
    depth = F.create_map(*[F.lit(x) for k, v in CONFIGS.items() for x in (k, v.get("maxDepth", 5))])
    ranking = sampling.ranked_candidates(by.withColumn("complexity", depth[F.col("config_id")]))
    best = ranking.where("rank = 1").first()
    out = {"by_fold": by_fold, "ranking": ranking}
    if not a.validation or best is None:
        return out
    held = _features(spark, a.validation).join(F.broadcast(_inventory(spark, a).select("pcap_id", "attack_family")), "pcap_id")
    rows = {k: ml.held_out(table, held, CONFIGS[k]) for k in dict.fromkeys(("H0", best.config_id))}
    frozen = best.config_id if best.config_id == "H0" or sampling.confirmed(rows["H0"], rows[best.config_id]) else "H0"
    return out | {"confirmation": spark.createDataFrame([(k, k == frozen, *(float(v) if v is not None else None for v in r.values())) for k, r in rows.items()], "config_id string, frozen boolean, " + ", ".join(f"{c} double" for c in ml.RECALLS))}


def _scores(spark, a) -> DataFrame:
    return spark.read.parquet(a.scores)


@command("threshold-sweep-baselines", "refine-c-thresholds")
def sweep(spark, a) -> Tables:
    s = _scores(spark, a).cache()
    return {"sweep": metrics.sweep(s), "fpr_targets": metrics.threshold_for_fpr(s), "ranking": metrics.ranking(s), "scores": metrics.score_stats(s, "y")}


@command("run-final-test")
def final_test(spark, a) -> Tables:
    settings = contracts.verify(a.contract, "final-test", {"threshold": a.threshold})["settings"]
    s, t = _scores(spark, a), settings.get("threshold", verdict.THRESHOLD)
    return {"metrics": metrics.evaluation(s, t, [("attack_family",), ("benign_category",), ("pcap_id",)]), "families": metrics.family_recall(s, t), "ranking": metrics.ranking(s), "capture_fpr": metrics.macro_capture_fpr(s, t)}


def _probe(names: tuple[str, ...], make, present: str, with_ratio: bool):
    def run(spark, a) -> Tables:
        p, groups = _packets(spark, a), _inventory(spark, a).select("pcap_id", S.bucket_features().alias("group"))
        table = make(p).join(F.broadcast(groups), "pcap_id")
        if with_ratio:
            table = table.join(features.base_features(p).select("pcap_id", "window_index", "arp_ratio"), ["pcap_id", "window_index"])
        out = {"windows": table, "summary": stats.scoped_summary(table, names, "group", F.col(present) > 0), "evidence": stats.conditional_evidence(table, names, "group", F.col(present) > 0)}
        return out | ({"beside_arp_ratio": stats.beside_arp_ratio(table, names, "group")} if with_ratio else {})

    return run


COMMANDS["probe-arp-features-fit"] = _probe(ARP_FEATURES, features.arp_features, "arp_ratio", True)
COMMANDS["probe-mqtt-features-fit"] = _probe(MQTT_FEATURES, features.mqtt_features, "mqtt_frame_count", False)


@command("probe-arp-stateful-fit")
def probe_stateful(spark, a) -> Tables:
    own = stats.arp_capture_stats(_packets(spark, a)).join(F.broadcast(_inventory(spark, a).select("pcap_id", S.bucket_features().alias("group"))), "pcap_id")
    return {"by_pcap": own, "by_group": stats.arp_group_rollup(own, stats.arp_distances(_packets(spark, a)), "group")}


@command("evaluate-pcap-aggregation")
def aggregation(spark, a) -> Tables:
    s = _scores(spark, a)
    facts = s.groupBy("pcap_id").agg(F.max("y").alias("y"), F.first("attack_family", True).alias("attack_family"))
    decided = verdict.grid(verdict.summaries(s, a.threshold or verdict.THRESHOLD).join(facts, "pcap_id"))
    return {"by_pcap": verdict.pivoted(decided), "summary": verdict.ranked(verdict.grid_summary(decided))}


@command("classify-pcap")
def classify_pcap(spark, a) -> Tables:
    from .plans.classify import classify_files

    model = ml.load(a.model)
    return {"verdicts": classify_files(spark, a.input, lambda df: ml.scored(model, ml.assembled(df)), threshold=a.threshold or verdict.THRESHOLD)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="packetloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    for name in ("input", "root", "inventory", "split", "manifest", "features", "validation", "scores", "contract", "model", "output"):
        p.add_argument(f"--{name}")
    p.add_argument("--plan", default="group_balanced", choices=sorted(sampling.PLANS))
    p.add_argument("--threshold", type=float)
    p.add_argument("--max-packets", type=int)
    p.add_argument("--max-windows", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = COMMANDS[a.command](spark, a)
    flat = {k: t.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in t.dtypes]) for k, t in out.items()}
    sinks.report(spark, flat, a.output)
    print(json.dumps({"command": a.command, "tables": sorted(flat), "output": a.output}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
