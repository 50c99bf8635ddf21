"""From window scores to a verdict on the capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The frozen decision: threshold, fewest windows, K and R. Fixed values.
THRESHOLD, LEAST_WINDOWS, K, R = 0.9490790963172913, 3, 3, 0.005
GRID_K, GRID_R = (1, 3, 5), (0.005, 0.01, 0.025, 0.05)


def summaries(scores: DataFrame, threshold: float = THRESHOLD, captures: DataFrame | None = None) -> DataFrame:
    """total, attack, max, mean and rate of each capture; captures without windows come from ``captures``."""
    attack = F.count_if(S.is_attack(threshold))
    own = scores.groupBy("pcap_id").agg(F.count(F.lit(1)).alias("total_windows"), attack.alias("attack_windows"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
    if captures is not None:
        own = captures.select("pcap_id").distinct().join(own, "pcap_id", "left").fillna(0, ["total_windows", "attack_windows"])
    return own.withColumn("attack_rate", S.ratio(F.col("attack_windows"), F.col("total_windows")))


def verdicts(scores: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WINDOWS, k: int = K, r: float = R, captures: DataFrame | None = None) -> DataFrame:
    """status, prediction (null with too few windows) and the summary; all bounds are inclusive."""
    enough = F.col("total_windows") >= least
    attack = (F.col("attack_windows") >= k) & (F.col("attack_rate") >= r)
    return summaries(scores, threshold, captures).withColumn("status", F.when(enough, "OK").otherwise("INSUFFICIENT_DATA")).withColumn("prediction", F.when(enough, F.when(attack, "ATTACK").otherwise("BENIGN")))


def nested(verdict_rows: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WINDOWS, k: int = K, r: float = R) -> DataFrame:
    """The shape of a response: window_summary and decision as structs."""
    summary = F.struct("total_windows", "attack_windows", "max_score", "mean_score", "attack_rate")
    decision = F.struct(F.lit(threshold).alias("window_threshold"), F.lit(least).alias("minimum_windows"), F.lit(k).alias("K"), F.lit(r).alias("R"))
    return verdict_rows.select("pcap_id", "status", "prediction", F.col("attack_rate").alias("rate"), summary.alias("window_summary"), decision.alias("decision"))


def grid(summary: DataFrame, ks: tuple[int, ...] = GRID_K, rs: tuple[float, ...] = GRID_R) -> DataFrame:
    """Every capture under every (K, R). Here a capture needs K windows, not LEAST_WINDOWS."""
    table = F.broadcast(summary.sparkSession.createDataFrame([(S.policy_id(k, r), k, r) for k in ks for r in rs], "policy_id string, K int, R double"))
    enough = F.col("total_windows") >= F.col("K")
    attack = (F.col("attack_windows") >= F.col("K")) & (F.col("attack_rate") >= F.col("R"))
    return summary.crossJoin(table).withColumn("prediction", F.when(enough, F.when(attack, "ATTACK").otherwise("BENIGN")).otherwise("INSUFFICIENT_DATA"))


def grid_summary(decided: DataFrame, family: str = "attack_family") -> DataFrame:
    """False positives, FPR, recall, macro and least family recall of each policy. decided: grid() with y and the family."""
    hit = F.col("prediction") == "ATTACK"
    key = ["policy_id", "K", "R"]
    own = decided.groupBy(*key).agg(F.count_if((F.col("y") == 0) & hit).alias("benign_fp"), F.count_if(F.col("y") == 0).alias("benign"), F.count_if((F.col("y") == 1) & hit).alias("attack_tp"), F.count_if(F.col("y") == 1).alias("attack"), F.count_if(F.col("prediction") == "INSUFFICIENT_DATA").alias("insufficient"))
    by = decided.where("y = 1").groupBy(*key, family).agg(F.avg(hit.cast("double")).alias("recall")).groupBy(*key).agg(F.avg("recall").alias("macro_recall"), F.min("recall").alias("min_recall"))
    return own.withColumn("fpr", S.ratio(F.col("benign_fp"), F.col("benign"))).withColumn("recall", S.ratio(F.col("attack_tp"), F.col("attack"))).join(by, key, "left")


def ranked(summary: DataFrame) -> DataFrame:
    """rank 1 is recommended: fewest false positives, then recall, macro recall, K, R. A dozen rows, so one ordered window is fine."""
    order = Window.orderBy("benign_fp", F.col("recall").desc_nulls_last(), F.col("macro_recall").desc_nulls_last(), "K", "R")
    return summary.withColumn("rank", F.row_number().over(order))


def pivoted(decided: DataFrame) -> DataFrame:
    """One column a policy."""
    policies = [S.policy_id(k, r) for k in GRID_K for r in GRID_R]
    return decided.groupBy("pcap_id").pivot("policy_id", policies).agg(F.first("prediction"))
