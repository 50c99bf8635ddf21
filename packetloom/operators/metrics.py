"""Detection metrics of a score table: y (0 or 1), score and group columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FIXED_THRESHOLDS = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
FPR_TARGETS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05)


def confusion_columns(positive: Column) -> list[Column]:
    y = F.col("y") == 1
    return [F.count_if(y & positive).alias("tp"), F.count_if(~y & positive).alias("fp"), F.count_if(~y & ~positive).alias("tn"), F.count_if(y & ~positive).alias("fn")]


def confusion(scores: DataFrame, threshold: float, *groups: str) -> DataFrame:
    return scores.groupBy(*groups).agg(*confusion_columns(S.is_attack(threshold)))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Metrics of tp, fp, tn, fn; null where a denominator is 0, F1 also where precision and recall are both 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r, s = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn), S.ratio(tn, tn + fp)
    fpr = S.ratio(fp, fp + tn)
    return counts.withColumns({"precision": p, "recall": r, "specificity": s, "fpr": fpr, "f1": S.ratio(2 * p * r, p + r), "balanced_accuracy": (r + s) / 2, "accuracy": S.ratio(tp + tn, tp + fp + tn + fn), "fp_per_10k": fpr * 10_000})


def score_stats(scores: DataFrame, *groups: str) -> DataFrame:
    v = F.col("score").cast("double")
    return scores.groupBy(*groups).agg(F.count(v).alias("rows"), F.avg(v).alias("mean"), *[F.percentile(v, q).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95, 0.99)], F.max(v).alias("max"))


def _score_counts(scores: DataFrame, *groups: str) -> DataFrame:
    """Rows and positives of each distinct score: everything after it is as large as the number of distinct scores."""
    return scores.groupBy(*groups, F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("pos"))


def _running(counts: DataFrame, groups: tuple[str, ...], columns: dict[str, str], descending: bool = True) -> DataFrame:
    """Running sums over scores. Without groups the scores are cut in ranges, summed in each, and only one row a range is put in order."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    if groups:
        w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({k: F.sum(c).over(w) for k, c in columns.items()})
    ranged = counts.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in columns.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in columns])
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(c).over(w) for k, c in columns.items()}).join(F.broadcast(parts), "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in columns}).drop("_part", *[f"_{k}" for k in columns])


def ranking(scores: DataFrame, *groups: str) -> DataFrame:
    """ROC-AUC by rank sums with average ranks, average precision over distinct scores; null with one class."""
    counts = _score_counts(scores, *groups)
    run = _running(counts, groups, {"cn": "n", "cpos": "pos"})
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"), F.sum("pos").alias("p"))
    joined = run.join(totals, list(groups)) if groups else run.crossJoin(F.broadcast(totals))
    rank = F.col("total") - F.col("cn") + (F.col("n") + 1) / 2  # average rank from the lowest score on
    by = joined.groupBy(*groups).agg(F.max("total").alias("rows"), F.max("p").alias("positives"), F.sum(F.col("pos") * rank).alias("rank_sum"), F.sum(F.col("pos") / F.col("p") * (F.col("cpos") / F.col("cn"))).alias("ap"))
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    both = (p > 0) & (n > 0)
    return by.select(*groups, "rows", "positives", F.when(both, S.ratio(F.col("rank_sum") - p * (p + 1) / 2, p * n)).alias("roc_auc"), F.when(both, F.col("ap")).alias("average_precision"))


def at_thresholds(scores: DataFrame, thresholds: list[float], *groups: str) -> DataFrame:
    """Confusion at each threshold: one scan counts rows by how many thresholds they reach, and only these counts, as many as there are thresholds and one,
    are crossed with the thresholds. Rows without a score count nowhere."""
    levels = sorted({float(t) for t in thresholds})
    table = F.broadcast(scores.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(levels)], "place int, threshold double"))
    v = F.col("score").cast("double")
    reached = sum(((v >= t).cast("int") for t in levels), F.lit(0))
    counts = scores.groupBy(*groups, reached.alias("reached")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    positive = F.coalesce(F.col("reached") >= F.col("place"), F.lit(False))
    negative = F.coalesce(F.col("reached") < F.col("place"), F.lit(False))
    total = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0))
    out = counts.crossJoin(table).groupBy("threshold", *groups)
    return with_metrics(out.agg(total("pos", positive).alias("tp"), total("neg", positive).alias("fp"), total("neg", negative).alias("tn"), total("pos", negative).alias("fn")))


def threshold_for_fpr(scores: DataFrame, targets: list[float] | tuple[float, ...] = FPR_TARGETS) -> DataFrame:
    """target, threshold, reachable: the lowest observed benign score with a share of benign scores at or above it within the target; else 1.0."""
    benign = _score_counts(scores.where("y = 0"))
    run = _running(benign, (), {"above": "n"})
    total = F.broadcast(benign.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("score") >= 1.0, F.col("n"))), F.lit(0)).alias("ones")))
    table = F.broadcast(scores.sparkSession.createDataFrame([(float(t),) for t in targets], "target double"))
    found = run.crossJoin(total).crossJoin(table).where(F.col("above") / F.col("total") <= F.col("target") + 1e-15).groupBy("target").agg(F.min("score").alias("threshold"))
    out = table.crossJoin(total).join(found, "target", "left")
    return out.select("target", F.coalesce("threshold", F.lit(1.0)).alias("threshold"), (F.col("threshold").isNotNull() | F.coalesce(F.col("ones") / F.col("total") <= F.col("target"), F.lit(False))).alias("reachable"))


def sweep(scores: DataFrame, *groups: str) -> DataFrame:
    """Fixed thresholds and those of the FPR targets; the latter are few and known before the second scan."""
    found = [r.threshold for r in threshold_for_fpr(scores).collect()]
    return at_thresholds(scores, sorted({*FIXED_THRESHOLDS, *found}), *groups)


def macro(table: DataFrame, value: str, *groups: str) -> DataFrame:
    """Mean and minimum over the groups that have a value."""
    return table.groupBy(*groups).agg(F.avg(value).alias(f"macro_{value}"), F.min(value).alias(f"min_{value}"), F.count(value).alias("supported"))


def macro_capture_fpr(scores: DataFrame, threshold: float) -> DataFrame:
    """Mean over benign captures of their own FPR."""
    per = scores.where("y = 0").groupBy("pcap_id").agg(F.avg(S.is_attack(threshold).cast("double")).alias("fpr"))
    return per.agg(F.avg("fpr").alias("macro_fpr"), F.max("fpr").alias("max_fpr"), F.count(F.lit(1)).alias("captures"))


def evaluation(scores: DataFrame, threshold: float, sets: list[tuple[str, ...]]) -> DataFrame:
    """Confusion and metrics overall and by each set of groups in one pass, as GROUPING SETS; columns outside a set are null, level names the set."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    by = scores.groupingSets([[F.col(c) for c in s] for s in [*sets, ()]], *names).agg(F.grouping_id().alias("_id"), *confusion_columns(S.is_attack(threshold)))
    level = F.array_join(F.array_compact(F.array(*[F.when(F.col("_id").bitwiseAND(1 << (len(names) - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(names)])), ",")
    return with_metrics(by.withColumn("level", F.when(level == "", "global").otherwise(level)).drop("_id"))


def family_recall(scores: DataFrame, threshold: float, families: tuple[str, ...] = S.FAMILIES) -> DataFrame:
    """Recall of every known family in its order, present or not."""
    order = F.broadcast(scores.sparkSession.createDataFrame(list(enumerate(families)), "place int, attack_family string"))
    own = scores.where("y = 1").groupBy("attack_family").agg(F.count_if(S.is_attack(threshold)).alias("tp"), F.count(F.lit(1)).alias("rows"))
    out = order.join(own, "attack_family", "left")
    return out.select("place", "attack_family", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("present"), S.ratio(F.col("tp"), F.col("rows")).alias("recall"))


def fold_summary(table: DataFrame, value: str, *groups: str) -> DataFrame:
    return table.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))


def class_weights(table: DataFrame, label: str = "y") -> DataFrame:
    """n / (2 n_c)."""
    by = table.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = F.broadcast(by.agg(F.sum("rows").alias("total")))
    return by.crossJoin(total).select(label, "rows", (F.col("total") / (2 * F.col("rows"))).alias("weight"))


def delta_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta of two one-row tables of metrics."""
    long = lambda df, name: df.unpivot([], [F.col(c).cast("double").alias(c) for c in df.columns], "metric", name)
    return long(a, "a").join(long(b, "b"), "metric", "full_outer").withColumn("delta", F.col("b") - F.col("a"))


def replaced(stored: DataFrame, new: DataFrame, key: str = "model_id") -> DataFrame:
    """Stored rows but for those of models that new has, and new."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ablation_preview(table: DataFrame, baseline: str) -> DataFrame:
    """table: variant, fpr_target, recon_recall, mqtt_recall. Gains over the baseline, and whether they pass (0.02 and -0.01)."""
    base = table.where(F.col("variant") == baseline).select("fpr_target", F.col("recon_recall").alias("recon_base"), F.col("mqtt_recall").alias("mqtt_base"))
    out = table.where(F.col("variant") != baseline).join(F.broadcast(base), "fpr_target").withColumn("recon_gain", F.col("recon_recall") - F.col("recon_base")).withColumn("mqtt_delta", F.col("mqtt_recall") - F.col("mqtt_base"))
    return out.withColumn("passes", (F.col("recon_gain") >= 0.02) & (F.col("mqtt_delta") >= -0.01))
