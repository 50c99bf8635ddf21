"""Queries over scores and verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, verdict
from . import views as V
from .packets import _r, rounded

W = "WITH " + V.SCORES_SQL
T = 0.8
_CONF = "count_if(y = 1 AND {p}) AS tp, count_if(y = 0 AND {p}) AS fp, count_if(y = 0 AND NOT ({p})) AS tn, count_if(y = 1 AND NOT ({p})) AS fn"
_METRICS = ", ".join(_r(x, n) for n, x in {
    "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "specificity": "tn / nullif(tn + fp, 0)", "fpr": "fp / nullif(fp + tn, 0)",
    "f1": "(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0)",
    "balanced_accuracy": "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2", "accuracy": "(tp + tn) / nullif(tp + fp + tn + fn, 0)", "fp_per_10k": "fp / nullif(fp + tn, 0) * 10000",
}.items())
_VAL = f"(VALUES {', '.join(f'({t}::DOUBLE)' for t in metrics.FIXED_THRESHOLDS)})"
_RANK = "q AS (SELECT {g} score, count(*) AS n, count_if(y = 1) AS pos FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(pos) OVER (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos, sum(n) OVER (PARTITION BY {p}) AS total, sum(pos) OVER (PARTITION BY {p}) AS tp FROM q), z AS (SELECT {g} max(total)::BIGINT AS rows, max(tp)::BIGINT AS positives, sum(pos * (total - cn + (n + 1) / 2)) AS rs, sum(pos / nullif(tp, 0) * (cpos / cn)) AS ap FROM r GROUP BY ALL) SELECT {g} rows, positives, " + _r("CASE WHEN positives > 0 AND positives < rows THEN (rs - positives * (positives + 1) / 2) / (positives * (rows - positives)) END", "roc_auc") + ", " + _r("CASE WHEN positives > 0 AND positives < rows THEN ap END", "average_precision") + " FROM z"
_SUMMARY = "v AS (SELECT pcap_id, count(*) AS total_windows, count_if(score >= {t}) AS attack_windows, max(score) AS max_score, avg(score) AS mean_score, count_if(score >= {t}) / count(*) AS attack_rate FROM s GROUP BY pcap_id)"
_POLICIES = " UNION ALL ".join(f"SELECT '{S.policy_id(k, r)}' AS policy_id, {k} AS K, {r}::DOUBLE AS R" for k in verdict.GRID_K for r in verdict.GRID_R)
_DECIDED = f"pol AS ({_POLICIES}), u AS (SELECT v.*, pol.*, (pcap_id::BIGINT % 2)::INT AS y, CASE WHEN pcap_id::BIGINT % 4 = 1 THEN 'DDoS' WHEN pcap_id::BIGINT % 4 = 3 THEN 'Recon' END AS attack_family, CASE WHEN total_windows >= K THEN CASE WHEN attack_windows >= K AND attack_rate >= R THEN 'ATTACK' ELSE 'BENIGN' END ELSE 'INSUFFICIENT_DATA' END AS prediction FROM v, pol)"
_GRIDSUM = f"{W}, {_SUMMARY.format(t=T)}, {_DECIDED}, a AS (SELECT policy_id, K, R, count_if(y = 0 AND prediction = 'ATTACK') AS benign_fp, count_if(y = 0) AS benign, count_if(y = 1 AND prediction = 'ATTACK') AS attack_tp, count_if(y = 1) AS attack, count_if(prediction = 'INSUFFICIENT_DATA') AS insufficient FROM u GROUP BY ALL), f AS (SELECT policy_id, attack_family, avg((prediction = 'ATTACK')::INT) AS recall FROM u WHERE y = 1 GROUP BY ALL), m AS (SELECT policy_id, avg(recall) AS macro_recall, min(recall) AS min_recall FROM f GROUP BY ALL), gs AS (SELECT a.*, benign_fp / nullif(benign, 0) AS fpr, attack_tp / nullif(attack, 0) AS recall, macro_recall, min_recall FROM a JOIN m USING (policy_id))"


def _decided(s, d):
    summary = verdict.summaries(V.scores(s, d), T)
    own = summary.withColumn("y", F.expr("cast(cast(pcap_id as bigint) % 2 as int)")).withColumn("attack_family", F.expr("CASE WHEN cast(pcap_id as bigint) % 4 = 1 THEN 'DDoS' WHEN cast(pcap_id as bigint) % 4 = 3 THEN 'Recon' END"))
    return verdict.grid(own)


_R = ", ".join
_FPR = "b AS (SELECT score, count(*) AS n FROM s WHERE y = 0 GROUP BY score), a AS (SELECT score, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS above, sum(n) OVER () AS total, coalesce(sum(CASE WHEN score >= 1.0 THEN n END) OVER (), 0) AS ones FROM b), t AS (SELECT * FROM (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in metrics.FPR_TARGETS) + ") AS t(target)), th AS (SELECT target, coalesce(min(CASE WHEN above / total <= target + 1e-15 THEN score END), 1.0) AS threshold, min(CASE WHEN above / total <= target + 1e-15 THEN score END) IS NOT NULL OR max(ones / total) <= target AS reachable FROM a, t GROUP BY target)"

QUERIES = {
    "confusion": (lambda s, d: metrics.confusion(V.scores(s, d), T), f"{W} SELECT {_CONF.format(p=f'score >= {T}')} FROM s"),
    "confusion_metrics": (lambda s, d: rounded(metrics.with_metrics(metrics.confusion(V.scores(s, d), T))), f"{W}, c AS (SELECT {_CONF.format(p=f'score >= {T}')} FROM s) SELECT *, {_METRICS} FROM c"),
    "group_metrics": (lambda s, d: rounded(metrics.evaluation(V.scores(s, d), T, [("attack_family",), ("benign_category",), ("pcap_id",)])), f"{W}, c AS (SELECT attack_family, benign_category, pcap_id, grouping_id(attack_family, benign_category, pcap_id) AS g, {_CONF.format(p=f'score >= {T}')} FROM s GROUP BY GROUPING SETS ((attack_family), (benign_category), (pcap_id), ())) SELECT * EXCLUDE (g), {_METRICS}, CASE g WHEN 7 THEN 'global' WHEN 3 THEN 'attack_family' WHEN 5 THEN 'benign_category' ELSE 'pcap_id' END AS level FROM c"),
    "family_recall": (lambda s, d: rounded(metrics.family_recall(V.scores(s, d).where("attack_family <> 'MQTT'"), T)), f"{W}, o AS (SELECT * FROM (VALUES (0, 'DDoS'), (1, 'DoS'), (2, 'MQTT'), (3, 'Recon'), (4, 'Spoofing')) AS o(place, attack_family)), q AS (SELECT attack_family, count_if(score >= {T}) AS tp, count(*) AS rows FROM s WHERE y = 1 AND attack_family <> 'MQTT' GROUP BY ALL) SELECT place, attack_family, coalesce(tp, 0) AS tp, coalesce(rows, 0) AS rows, rows IS NOT NULL AS present, {_r('tp / rows', 'recall')} FROM o LEFT JOIN q USING (attack_family)"),
    "macro_metrics": (lambda s, d: rounded(metrics.macro(metrics.family_recall(V.scores(s, d), T), "recall")), f"{W}, q AS (SELECT attack_family, count_if(score >= {T}) / count(*) AS recall FROM s WHERE y = 1 GROUP BY ALL) SELECT {_r('avg(recall)', 'macro_recall')}, {_r('min(recall)', 'min_recall')}, count(recall) AS supported FROM q"),
    "roc_auc": (lambda s, d: rounded(metrics.ranking(V.scores(s, d)).drop("average_precision")), f"{W}, " + _RANK.format(g="", p="1").replace(", " + _r("CASE WHEN positives > 0 AND positives < rows THEN ap END", "average_precision"), "")),
    "average_precision": (lambda s, d: rounded(metrics.ranking(V.scores(s, d)).drop("roc_auc")), f"{W}, " + _RANK.format(g="", p="1").replace(_r("CASE WHEN positives > 0 AND positives < rows THEN (rs - positives * (positives + 1) / 2) / (positives * (rows - positives)) END", "roc_auc") + ", ", "")),
    "group_ranking": (lambda s, d: rounded(metrics.ranking(V.scores(s, d), "pcap_id")), f"{W}, " + _RANK.format(g="pcap_id,", p="pcap_id")),
    "score_percentiles": (lambda s, d: rounded(metrics.score_stats(V.scores(s, d), "y")), f"{W} SELECT y, count(score) AS rows, {_r('avg(score)', 'mean')}, " + _R([_r(f"quantile_cont(score, {q})", n) for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]) + f", {_r('max(score)', 'max')} FROM s GROUP BY y"),
    "threshold_fixed_sweep": (lambda s, d: rounded(metrics.at_thresholds(V.scores(s, d), list(metrics.FIXED_THRESHOLDS))), f"{W}, t AS (SELECT * FROM {_VAL} AS t(threshold)), c AS (SELECT threshold, {_CONF.format(p='score >= threshold')} FROM s, t GROUP BY threshold) SELECT *, {_METRICS} FROM c"),
    "threshold_for_fpr": (lambda s, d: rounded(metrics.threshold_for_fpr(V.scores(s, d)), 9), f"{W}, {_FPR} SELECT target, round(threshold, 9) AS threshold, reachable FROM th"),
    "threshold_sweep": (lambda s, d: rounded(metrics.sweep(V.scores(s, d))), f"{W}, {_FPR}, tt AS (SELECT DISTINCT threshold FROM (SELECT threshold FROM th UNION ALL SELECT * FROM {_VAL} AS t(threshold))), c AS (SELECT threshold, {_CONF.format(p='score >= threshold')} FROM s, tt GROUP BY threshold) SELECT round(threshold, 6) AS threshold, * EXCLUDE (threshold), {_METRICS} FROM c"),
    "macro_capture_fpr": (lambda s, d: rounded(metrics.macro_capture_fpr(V.scores(s, d), T)), f"{W}, q AS (SELECT pcap_id, count_if(score >= {T}) / count(*) AS fpr FROM s WHERE y = 0 GROUP BY pcap_id) SELECT {_r('avg(fpr)', 'macro_fpr')}, {_r('max(fpr)', 'max_fpr')}, count(*) AS captures FROM q"),
    "class_weights": (lambda s, d: rounded(metrics.class_weights(V.scores(s, d))), f"{W} SELECT y, count(*) AS rows, {_r('sum(count(*)) OVER () / (2 * count(*))', 'weight')} FROM s GROUP BY y"),
    "fold_summary": (lambda s, d: rounded(metrics.fold_summary(metrics.with_metrics(metrics.confusion(V.scores(s, d).withColumn("fold", F.expr("cast(pcap_id as bigint) % 3")), T, "fold")), "recall")), f"{W}, c AS (SELECT pcap_id::BIGINT % 3 AS fold, {_CONF.format(p=f'score >= {T}')} FROM s GROUP BY fold), q AS (SELECT tp / nullif(tp + fn, 0) AS recall FROM c) SELECT {_r('avg(recall)', 'mean')}, {_r('stddev_pop(recall)', 'std')}, {_r('max(recall) - min(recall)', 'range')} FROM q"),
    "validation_vs_test": (lambda s, d: rounded(metrics.delta_table(metrics.with_metrics(metrics.confusion(V.scores(s, d).where("pcap_id % 2 = 0"), T)).select("recall", "fpr", "precision"), metrics.with_metrics(metrics.confusion(V.scores(s, d).where("pcap_id % 2 = 1"), T)).select("recall", "fpr", "precision"))), f"{W}, c AS (SELECT pcap_id::BIGINT % 2 AS h, {_CONF.format(p=f'score >= {T}')} FROM s GROUP BY h), q AS (SELECT h, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision FROM c), m AS (SELECT h, 'recall' AS metric, recall AS v FROM q UNION ALL SELECT h, 'fpr', fpr FROM q UNION ALL SELECT h, 'precision', precision FROM q) SELECT metric, round(x.v, 6) AS a, round(z.v, 6) AS b, round(z.v - x.v, 6) AS delta FROM (SELECT * FROM m WHERE h = 0) x FULL JOIN (SELECT * FROM m WHERE h = 1) z USING (metric)"),
    "pcap_verdict": (lambda s, d: rounded(verdict.verdicts(V.scores(s, d), T)), f"{W}, {_SUMMARY.format(t=T)} SELECT pcap_id, total_windows, attack_windows, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score, round(attack_rate, 6) AS attack_rate, CASE WHEN total_windows >= 3 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN total_windows >= 3 THEN CASE WHEN attack_windows >= 3 AND attack_rate >= 0.005 THEN 'ATTACK' ELSE 'BENIGN' END END AS prediction FROM v"),
    "verdict_with_empty": (lambda s, d: verdict.verdicts(V.scores(s, d).where("score > 0.95"), 0.98, captures=V.scores(s, d)).select("pcap_id", "total_windows", "attack_windows", "status", "prediction"), f"{W}, u AS (SELECT DISTINCT pcap_id FROM s), z AS (SELECT pcap_id, count_if(score > 0.95) AS total_windows, count_if(score >= 0.98) AS attack_windows FROM s GROUP BY pcap_id) SELECT pcap_id, total_windows, attack_windows, CASE WHEN total_windows >= 3 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN total_windows >= 3 THEN CASE WHEN attack_windows >= 3 AND attack_windows / total_windows >= 0.005 THEN 'ATTACK' ELSE 'BENIGN' END END AS prediction FROM z"),
    "policy_grid": (lambda s, d: rounded(verdict.grid_summary(_decided(s, d))), f"{_GRIDSUM} SELECT policy_id, K, R, benign_fp, benign, attack_tp, attack, insufficient, round(fpr, 6) AS fpr, round(recall, 6) AS recall, round(macro_recall, 6) AS macro_recall, round(min_recall, 6) AS min_recall FROM gs"),
    "policy_rank": (lambda s, d: verdict.ranked(verdict.grid_summary(_decided(s, d))).select("policy_id", "rank"), f"{_GRIDSUM} SELECT policy_id, row_number() OVER (ORDER BY benign_fp, round(recall, 12) DESC NULLS LAST, round(macro_recall, 12) DESC NULLS LAST, K, R)::INT AS rank FROM gs"),
    "policy_pivot": (lambda s, d: verdict.pivoted(_decided(s, d)), f"{W}, {_SUMMARY.format(t=T)}, {_DECIDED} SELECT pcap_id, " + ", ".join(f"max(prediction) FILTER (WHERE policy_id = '{S.policy_id(k, r)}') AS \"{S.policy_id(k, r)}\"" for k in verdict.GRID_K for r in verdict.GRID_R) + " FROM u GROUP BY pcap_id"),
}
