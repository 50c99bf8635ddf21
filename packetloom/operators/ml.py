"""Models over window features: fit, score, and run them against one evaluator."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BASE_FEATURES, MODEL_FEATURES, assert_model_input
from . import metrics
from .stats import finite

#: Names of model families and what they need beyond Spark.
#: Module, class, and the names that the class has for the columns of features and labels. Fixed values.
EXTERNAL = {"xgboost": ("xgboost.spark", "SparkXGBClassifier", "features_col", "label_col"), "catboost": ("catboost_spark", "CatBoostClassifier", "featuresCol", "labelCol")}


def assembled(table: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """features: the columns in their order, as a vector; a value that is not finite fails."""
    assert_model_input(list(columns), columns)
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~finite(F.col(c).cast("double"))
    checked = table.withColumn(columns[0], F.when(bad, F.raise_error(F.lit("a feature is not finite")).cast("double")).otherwise(F.col(columns[0]).cast("double")))
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(checked)


def logistic_regression(**p) -> Pipeline:
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=p.pop("maxIter", 200), **p)])


def gradient_boosting(**p) -> Pipeline:
    """Depth-limited trees; not score-equal to leaf-wise growth."""
    return Pipeline(stages=[GBTClassifier(labelCol="y", seed=42, **({"maxIter": 50, "maxDepth": 5, "stepSize": 0.1} | p))])


def random_forest(**p) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(labelCol="y", seed=42, **({"numTrees": 100, "maxDepth": 12} | p))])


def extra_trees(**p) -> Pipeline:
    """Trees over all rows with few bins and a random subset of features a node: the nearest to random cuts that MLlib has."""
    return Pipeline(stages=[RandomForestClassifier(labelCol="y", seed=42, bootstrap=False, featureSubsetStrategy="sqrt", **({"numTrees": 100, "maxDepth": 12, "maxBins": 8} | p))])


class AdaBoost:
    """Weighted stumps, one after the other (SAMME). Weights are a function of the votes so far, so a round is one tree fit and one sum."""

    def __init__(self, rounds: int = 50, depth: int = 1):
        self.rounds, self.depth = rounds, depth

    def fit(self, table: DataFrame) -> AdaBoostModel:
        model = AdaBoostModel([])
        y = F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
        for _ in range(self.rounds):
            voted = model.transform(table).withColumn("w", F.exp(-y * F.col("margin"))).drop("margin", "score")
            tree = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=self.depth, seed=42, predictionCol="p", rawPredictionCol="raw", probabilityCol="prob").fit(voted)
            wrong, total = tree.transform(voted).agg(F.sum(F.when(F.col("p") != F.col("y"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
            error = min(max(wrong / total, 1e-10), 1 - 1e-10)
            if error >= 0.5:
                break
            model.stumps.append((tree, 0.5 * math.log((1 - error) / error)))
            if wrong == 0:
                break
        return model


@dataclass
class AdaBoostModel:
    stumps: list = field(default_factory=list)

    def transform(self, table: DataFrame) -> DataFrame:
        out = table.withColumn("margin", F.lit(0.0))
        for tree, weight in self.stumps:
            out = tree.setPredictionCol("_p").setRawPredictionCol("_raw").setProbabilityCol("_prob").transform(out)
            out = out.withColumn("margin", F.col("margin") + F.when(F.col("_p") == 1.0, weight).otherwise(-weight)).drop("_p", "_raw", "_prob")
        return out.withColumn("score", 1 / (1 + F.exp(-2 * F.col("margin"))))


MODELS: dict[str, Callable] = {"logistic_regression": logistic_regression, "hist_gradient_boosting": gradient_boosting, "random_forest": random_forest, "extra_trees": extra_trees, "adaboost": AdaBoost}


def build(name: str, **params):
    if name in EXTERNAL:
        import importlib

        module, kind, features, label = EXTERNAL[name]
        try:
            found = importlib.import_module(module)
        except ImportError as e:
            raise RuntimeError(f"{name} needs the package {module.split('.')[0]}") from e
        return getattr(found, kind)(**{features: "features", label: "y"}, **params)
    return MODELS[name](**params)


def attack_probability(labels: list, column: str = "probability") -> Column:
    """Probability of label 1 by its place among the labels, never by position alone."""
    if 1 not in labels:
        raise ValueError("the model doesn't know the attack label")
    return F.get(vector_to_array(column), labels.index(1))


def scored(model, table: DataFrame) -> DataFrame:
    """table with score: probability of attack. Rows in, rows out; micro-batches don't matter."""
    out = model.transform(table)
    if isinstance(model, PipelineModel):
        out = out.withColumn("score", attack_probability(list(range(model.stages[-1].numClasses))))
    elif "score" not in out.columns:  # an external package's
        out = out.withColumn("score", attack_probability([0, 1]))
    return out.drop("features", "scaled", "rawPrediction", "probability", "prediction", "margin")


def weighted(table: DataFrame) -> DataFrame:
    """weight: n / (2 n_c)."""
    return table.join(F.broadcast(metrics.class_weights(table).select("y", "weight")), "y")


def baseline_run(fit: DataFrame, validation: DataFrame, names: list[str], columns: tuple[str, ...] = BASE_FEATURES, threshold: float = 0.5, params: dict | None = None) -> DataFrame:
    """model_id with confusion, metrics, ROC-AUC and average precision of each model on validation; y in both tables."""
    train = assembled(fit, columns).cache()
    test = assembled(validation, columns)
    out = None
    for name in names:
        scores = scored(build(name, **(params or {}).get(name, {})).fit(train), test).select("y", "score")
        row = metrics.with_metrics(metrics.confusion(scores, threshold)).crossJoin(metrics.ranking(scores)).withColumn("model_id", F.lit(name))
        out = row if out is None else out.unionByName(row)
    train.unpersist()
    return out


def ablations(fit: DataFrame, validation: DataFrame, name: str = "hist_gradient_boosting", **params) -> DataFrame:
    """27 and 22 features, weighted and not: variant with its metrics."""
    out = None
    for columns in (BASE_FEATURES, MODEL_FEATURES):
        for use in (False, True):
            train = assembled(weighted(fit) if use else fit, columns)
            model = build(name, **(params | ({"weightCol": "weight"} if use else {}))).fit(train)
            row = metrics.with_metrics(metrics.confusion(scored(model, assembled(validation, columns)), 0.5)).withColumn("variant", F.lit(f"{len(columns)}_{'weighted' if use else 'unweighted'}"))
            out = row if out is None else out.unionByName(row)
    return out


#: What configurations are compared by.
RECALLS = ("threshold", "fpr", "recon_recall", "mqtt_recall", "macro_recall", "min_recall")


def recalls(scores: DataFrame, fpr_target: float) -> dict[str, float | None]:
    """RECALLS of y, score, attack_family at the threshold of the FPR target; the hardest family counts for neither macro nor least recall."""
    threshold = metrics.threshold_for_fpr(scores, [fpr_target]).first().threshold
    own = {r.attack_family: r.recall for r in metrics.family_recall(scores, threshold).collect()}
    supported = [own[x] for x in own if x != "Spoofing" and own[x] is not None]
    fpr = metrics.with_metrics(metrics.confusion(scores, threshold)).first().fpr
    return dict(zip(RECALLS, (float(threshold), fpr, own.get("Recon"), own.get("MQTT"), sum(supported) / len(supported) if supported else None, min(supported, default=None))))


def held_out(fit: DataFrame, validation: DataFrame, params: dict, columns: tuple[str, ...] = MODEL_FEATURES, fpr_target: float = 0.001, name: str = "hist_gradient_boosting") -> dict[str, float | None]:
    """recalls() on validation of a model of fit."""
    model = build(name, **params).fit(assembled(fit, columns))
    return recalls(scored(model, assembled(validation, columns)).select("y", "score", "attack_family"), fpr_target)


def sensitivity(table: DataFrame, configs: dict[str, dict], columns: tuple[str, ...] = MODEL_FEATURES, fpr_target: float = 0.001, name: str = "hist_gradient_boosting") -> DataFrame:
    """config_id by fold: each fold is scored by a model of the others, at the threshold of its FPR target. table: y, fold, attack_family."""
    full = assembled(table, columns).cache()
    folds = [r.fold for r in full.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for config, params in configs.items():
        for f in folds:
            model = build(name, **params).fit(full.where(F.col("fold") != f))
            scores = scored(model, full.where(F.col("fold") == f)).select("y", "score", "attack_family").cache()
            own = recalls(scores, fpr_target)
            row = table.sparkSession.createDataFrame([(config, int(f), *own.values())], "config_id string, fold int, " + ", ".join(f"{c} double" for c in RECALLS))
            out = row if out is None else out.unionByName(row)
            scores.unpersist()
    full.unpersist()
    return out


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
