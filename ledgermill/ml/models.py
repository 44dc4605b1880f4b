"""The preprocessing stages and the registry of models."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.files import delete
from .columns import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET

WEIGHT = "class_weight"
MAX_CATEGORIES = 10_000  # of one feature; beyond it the caller must group or drop it
FINAL_VALUES = 20_000  # values of one column fetched at most, once the median's bracket holds no more
ACCURACY = 10_000  # of percentile_approx in each narrowing pass: a pass cuts a bracket about 2,500-fold


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def most_frequent(rows: DataFrame, names: list[str]) -> dict[str, str | None]:
    """The most frequent text of each column, the smallest among equals; NULL does not count.

    Values are counted before they meet, so a column with many of them stays in the tasks.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    counts = rows.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return {**dict.fromkeys(names), **{row["name"]: row["value"] for row in best.collect()}}


def _usable(name: str) -> Column:
    """A number that counts for the median: neither null nor NaN, as the imputer fills both."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def exact_medians(rows: DataFrame, names: list[str]) -> dict[str, float | None]:
    """The exact lower median (rank ceil(n/2) of the sorted values) of each column, without
    gathering a column anywhere: None for a column without values.

    Each round is one aggregate for all columns: approximate quantiles of the values inside a
    column's bracket propose a narrower one around the wanted rank, and exact counts check that
    it still holds that rank (a side that fails keeps its old bound). Once a bracket holds at
    most FINAL_VALUES values, or one value only, those values are fetched and the median picked.
    """
    spark = rows.sparkSession
    where = f"{shared_folder(spark)}/medians-{uuid.uuid4().hex}"
    rows.select(*[_usable(n).alias(n) for n in names]).write.parquet(where)  # read by every pass
    values = spark.read.parquet(where)
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first()
    state = {n: {"lo": None, "hi": None, "below": 0, "inside": counts[n], "want": (counts[n] + 1) // 2} for n in names}
    found: dict[str, float | None] = {n: None for n in names if counts[n] == 0}

    def inside(n: str) -> Column:
        lo, hi = state[n]["lo"], state[n]["hi"]
        test = F.lit(True)
        if lo is not None:
            test = test & (F.col(n) >= lo)
        if hi is not None:
            test = test & (F.col(n) <= hi)
        return F.col(n).isNotNull() & test

    while open_ := [n for n in names if n not in found and state[n]["inside"] > FINAL_VALUES]:
        spans = {}
        for n in open_:
            st = state[n]
            rank = (st["want"] - st["below"]) / st["inside"]
            margin = 2.0 / ACCURACY
            spans[n] = (max(rank - margin, 0.0), min(rank + margin, 1.0))
        quantiles = values.agg(*[
            F.percentile_approx(F.when(inside(n), F.col(n)), list(spans[n]), ACCURACY).alias(n) for n in open_
        ]).first()
        checks = values.agg(*[
            agg for n in open_ for agg in (
                F.count_if(F.col(n) < quantiles[n][0]).alias(f"{n}__below"),
                F.count_if(F.col(n) <= quantiles[n][1]).alias(f"{n}__upto"),
            )
        ]).first()
        for n in open_:
            st, (lo, hi) = state[n], quantiles[n]
            below, upto = checks[f"{n}__below"], checks[f"{n}__upto"]
            narrowed = False
            if below < st["want"] and (st["lo"] is None or lo > st["lo"]):
                st["lo"], st["below"], narrowed = lo, below, True
            if upto >= st["want"] and (st["hi"] is None or hi < st["hi"]):
                st["hi"], narrowed = hi, True
            if st["lo"] is not None and st["lo"] == st["hi"]:
                found[n] = float(st["lo"])
                continue
            st["inside"] = values.filter(inside(n)).count()
            if not narrowed:  # the proposal did not help: fetch the bracket as it is
                st["inside"] = min(st["inside"], FINAL_VALUES)
    for n in names:
        if n in found:
            continue
        st = state[n]
        picked = values.filter(inside(n)).select(n).orderBy(n).offset(st["want"] - st["below"] - 1).first()
        found[n] = float(picked[0])
    delete(spark, where)
    return found


def preprocessor(
    train: DataFrame, medians: dict[str, float | None] | None = None, modes: dict[str, str | None] | None = None
) -> Pipeline:
    """Median fill and scaling of numbers, most-frequent fill and one-hot of categories.

    A category unseen in training becomes all zeros. ``medians`` and ``modes`` are computed if not given.
    """
    modes = modes if modes is not None else most_frequent(train, CATEGORICAL_FEATURES)
    medians = medians if medians is not None else exact_medians(train, NUMERIC_FEATURES)
    labels = train.agg(*[F.approx_count_distinct(c).alias(c) for c in CATEGORICAL_FEATURES]).first()
    wide = [c for c in CATEGORICAL_FEATURES if labels[c] > MAX_CATEGORIES]
    if wide:
        raise ValueError(f"More than {MAX_CATEGORIES} categories, too many for one-hot columns: {', '.join(wide)}")
    fills = ", ".join(
        f"coalesce({c}, {_quoted(modes[c] if modes[c] is not None else '')}) AS {c}_filled"
        for c in CATEGORICAL_FEATURES
    )
    numeric = [f"{c}_filled" for c in NUMERIC_FEATURES]
    filled = [f"{c}_filled" for c in CATEGORICAL_FEATURES]
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    encoded = [f"{c}_onehot" for c in CATEGORICAL_FEATURES]
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {median_fills(medians)} FROM __THIS__"),
            VectorAssembler(inputCols=numeric, outputCol="numeric_raw"),
            StandardScaler(withMean=True, withStd=True, inputCol="numeric_raw", outputCol="numeric"),
            SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
            StringIndexer(inputCols=filled, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            VectorAssembler(inputCols=["numeric", *encoded], outputCol="features"),
        ]
    )


def median_fills(medians: dict[str, float | None]) -> str:
    """SQL that fills null and NaN numbers with their column's median, keeping the column's type."""
    def fill(name: str) -> str:
        value = "NULL" if medians[name] is None else repr(float(medians[name]))
        return (f"CASE WHEN {name} IS NULL OR isnan(CAST({name} AS DOUBLE)) THEN CAST({value} AS DOUBLE) "
                f"ELSE CAST({name} AS DOUBLE) END AS {name}_filled")

    return ", ".join(fill(n) for n in medians)


def feature_names(prepared: PipelineModel) -> list[str]:
    """Names of the places in the feature vector, in order."""
    from pyspark.ml.feature import StringIndexerModel

    labels = next(s for s in prepared.stages if isinstance(s, StringIndexerModel)).labelsArray
    names = [f"numeric__{c}" for c in NUMERIC_FEATURES]
    for column, values in zip(CATEGORICAL_FEATURES, labels, strict=True):
        names += [f"categorical__{column}_{value}" for value in values]
    return names


def class_counts(train: DataFrame) -> dict[int, int]:
    """Rows per label: two numbers."""
    return {row[TARGET]: row["n"] for row in train.groupBy(TARGET).agg(F.count("*").alias("n")).collect()}


def balanced_weight(counts: dict[int, int]) -> Column:
    """Weights that give both classes the same total."""
    total = sum(counts.values())
    weights = {label: total / (2.0 * n) for label, n in counts.items()}
    return F.when(F.col(TARGET) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))


@dataclass(frozen=True)
class ModelSpec:
    """How to build a model for n training rows, and what its scores are."""

    build: Callable[[int, int], object] | None = None
    kind: str = "probability"
    balanced: bool = True
    notes: str = ""
    skip_reason: str = ""


def _logistic(balanced: bool):
    def build(rows: int, seed: int):
        # Unit penalty against the summed loss, written against Spark's mean loss.
        model = LogisticRegression(
            labelCol=TARGET, featuresCol="features", maxIter=1000, regParam=1.0 / rows, standardization=False
        )
        return model.setWeightCol(WEIGHT) if balanced else model

    return build


def _forest(trees: int):
    def build(rows: int, seed: int):
        return RandomForestClassifier(
            labelCol=TARGET, featuresCol="features", weightCol=WEIGHT, numTrees=trees,
            minInstancesPerNode=10, maxDepth=30, seed=seed,  # Spark's deepest; the rule has no limit
        )

    return build


def _tree(rows: int, seed: int):
    return DecisionTreeClassifier(
        labelCol=TARGET, featuresCol="features", weightCol=WEIGHT, maxDepth=12,
        minInstancesPerNode=50, seed=seed,
    )


def _boosted(rows: int, seed: int):
    return GBTClassifier(
        labelCol=TARGET, featuresCol="features", weightCol=WEIGHT, maxIter=200, maxDepth=4,
        stepSize=0.05, subsamplingRate=0.9, seed=seed,
    )


def _ridge(rows: int, seed: int):
    return LinearRegression(
        labelCol="signed_label", featuresCol="features", weightCol=WEIGHT, regParam=1.0 / rows,
        standardization=False, predictionCol="decision",
    )


def _svc(rows: int, seed: int):
    return LinearSVC(
        labelCol=TARGET, featuresCol="features", weightCol=WEIGHT, maxIter=200, regParam=1.0 / rows,
        standardization=False,
    )


_NO_COUNTERPART = "Skipped: Spark ML has no estimator of this kind."
_COVERED = "Skipped: gradient boosting is covered by the Spark ML boosted trees."
_REGISTRY = {
    "dummy_majority": ModelSpec(kind="majority", notes="Majority-class baseline."),
    "dummy_stratified": ModelSpec(kind="stratified", notes="Random baseline with the class rates."),
    "logistic_regression_balanced": ModelSpec(_logistic(True), notes="Explainable baseline to beat."),
    "logistic_regression_unweighted": ModelSpec(_logistic(False), balanced=False, notes="Without class weights."),
    "sgd_log_loss_balanced": ModelSpec(skip_reason=_NO_COUNTERPART),
    "ridge_classifier_balanced": ModelSpec(_ridge, "regression", notes="Decision scores, no probabilities."),
    "decision_tree_balanced": ModelSpec(_tree, notes="Regularized single tree."),
    "random_forest_balanced": ModelSpec(_forest(200), notes="Tree ensemble."),
    "extra_trees_balanced": ModelSpec(skip_reason=_NO_COUNTERPART),
    "linear_svc_balanced": ModelSpec(_svc, "margin", notes="Decision scores, no probabilities."),
    "boosted_trees_balanced": ModelSpec(_boosted, notes="Stands for the external boosting libraries."),
    "gaussian_nb": ModelSpec(skip_reason="Skipped: needs dense input, which does not suit one-hot features."),
    "gradient_boosting": ModelSpec(skip_reason=_COVERED),
    "hist_gradient_boosting": ModelSpec(skip_reason=_COVERED),
    "adaboost": ModelSpec(skip_reason="Skipped: poor trade of run time for accuracy here."),
    "kernel_svc": ModelSpec(skip_reason="Skipped: kernel methods do not scale to this many rows."),
    "knn": ModelSpec(skip_reason="Skipped: neighbor search at scoring time does not scale."),
    "xgboost": ModelSpec(skip_reason="Skipped: optional dependency xgboost is not installed."),
    "lightgbm": ModelSpec(skip_reason="Skipped: optional dependency lightgbm is not installed."),
    "catboost": ModelSpec(skip_reason="Skipped: optional dependency catboost is not installed."),
}


def model_registry() -> dict[str, ModelSpec]:
    return dict(_REGISTRY)


def scored_rows(spec: ModelSpec, predictions: DataFrame, counts: dict[int, int], seed: int) -> DataFrame:
    """Label, score and default decision of each row."""
    label = F.col(TARGET).alias("label")
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if spec.kind == "probability":
        score = vector_to_array("probability")[1]
        return predictions.select(label, score.alias("score"), (score > 0.5).alias("predicted"))
    if spec.kind == "regression":
        return predictions.select(
            label, F.col("decision").alias("score"), (F.col("decision") > 0).alias("predicted")
        )
    if spec.kind == "margin":
        score = vector_to_array("rawPrediction")[1]
        return predictions.select(label, score.alias("score"), (score > 0).alias("predicted"))
    if spec.kind == "majority":
        score = F.lit(1.0 if share > 0.5 else 0.0)
    else:
        score = (F.rand(seed) < share).cast("double")
    return predictions.select(label, score.alias("score")).withColumn("predicted", F.col("score") > 0.5)
