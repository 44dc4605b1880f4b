"""Model queries over the sample tables. Metrics run on given scores; fits on payment reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import columns, jobs, metrics, models, scoring, split
from ..operators.common import written
from ..session import shared_folder
from ..sources import sample_tables as samples
from .sample_enrichment import model_rows


HIGH_FLOOR = 1.01


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows, written once: the split, the counts and every fit read them again."""
    return written(columns.training_rows(model_rows(spark, sf_dir)), "training-rows")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.mapped(spark, sf_dir, samples.SCORED_ROWS)


def thresholds(spark, sf_dir):
    return metrics.threshold_report(scored(spark, sf_dir))


def thresholds_by_model(spark, sf_dir):
    return metrics.threshold_report(
        scored(spark, sf_dir), metrics.BENCHMARK_THRESHOLDS, by=["model_number"]
    )


def best_threshold(spark, sf_dir):
    report = thresholds_by_model(spark, sf_dir)
    return metrics.best_threshold(report, by=["model_number"])


def best_threshold_high_floor(spark, sf_dir):
    """A floor that no threshold reaches, so every model takes the fallback."""
    return metrics.best_threshold(thresholds_by_model(spark, sf_dir), HIGH_FLOOR, by=["model_number"])


def default_metrics(spark, sf_dir):
    return metrics.default_metrics(scored(spark, sf_dir), F.col("score") > 0.5, probability="score")


def ranking(spark, sf_dir):
    work = f"{shared_folder(spark)}/ranking-{uuid.uuid4().hex}"
    return metrics.ranking_metrics(metrics.score_curve(scored(spark, sf_dir), work=work))


def calibration(spark, sf_dir):
    return metrics.calibration_bins(scored(spark, sf_dir))


def brier(spark, sf_dir):
    return metrics.brier_score(scored(spark, sf_dir))


def model_results(spark, sf_dir):
    """One result row per sample model, with its tuned threshold's rates."""
    best = best_threshold(spark, sf_dir)
    number = F.col("model_number")
    name = F.when(number == 3, metrics.BASELINE_MODEL).otherwise(F.concat(F.lit("model_"), number.cast("string")))
    curve = metrics.score_curve(
        scored(spark, sf_dir), by=["model_number"], work=f"{shared_folder(spark)}/curves-{uuid.uuid4().hex}"
    )
    return best.join(metrics.ranking_metrics(curve, by=["model_number"]), "model_number").select(
        name.alias("model_name"),
        F.when(number == 7, "skipped").otherwise("trained").alias("status"),
        "precision",
        "recall",
        "f1",
        "roc_auc",
        F.when(number != 2, F.col("pr_auc")).alias("pr_auc"),
        F.lit(None).cast("double").alias("brier_score"),
        "selected_threshold",
    )


def model_select(spark, sf_dir):
    return metrics.select_final_model(model_results(spark, sf_dir))


def model_best_baseline(spark, sf_dir):
    return metrics.best_by_f1(model_results(spark, sf_dir)).select("model_name", "f1", "roc_auc")


def score_bands(spark, sf_dir):
    band = scoring.probability_band(F.col("score"), 0.6)
    return scored(spark, sf_dir).groupBy(band.alias("risk_band")).agg(
        F.count("*").alias("rows"), F.sum("label").alias("positives")
    )


# Fixed, given coefficients and intercept: what scoring makes of a linear model's numbers.
GIVEN_COEFFICIENTS = {
    "pct_paid_within_30": -0.04,
    "pct_paid_later_60": 0.05,
    "pct_not_paid_within_terms": 0.03,
    "shortest_standard_payment_period": 0.01,
}
GIVEN_INTERCEPT = -1.5


def linear_driver_bands(spark, sf_dir):
    """Band, label and strongest drivers of each model-ready report under given coefficients,
    counted by combination: the scoring rules without a fitted model, so SQL can check them."""
    rows = model_rows(spark, sf_dir)
    names = list(GIVEN_COEFFICIENTS)
    values = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    up, down = scoring.linear_drivers(F.array(*values), names, list(GIVEN_COEFFICIENTS.values()), 1)
    logit = sum((v * c for v, c in zip(values, GIVEN_COEFFICIENTS.values())), F.lit(GIVEN_INTERCEPT))
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    shown = rows.select(
        F.coalesce(F.get(up, 0)["feature"], F.lit("")).alias("top_up"),
        F.coalesce(F.get(down, 0)["feature"], F.lit("")).alias("top_down"),
        scoring.probability_band(probability, 0.5).alias("risk_band"),
        (probability >= 0.5).cast("int").alias("predicted_label"),
    )
    return shown.groupBy("top_up", "top_down", "risk_band", "predicted_label").agg(F.count("*").alias("rows"))


def majority_baseline(spark, sf_dir):
    """Default metrics of the majority-class baseline on the test side: a model without a fit,
    so SQL can check it. Its score is 1 when more than half of the training labels are 1."""
    rows = labelled_rows(spark, sf_dir)
    train, test = split.split_by_company(rows, columns.GROUP)
    counts = models.class_counts(train)
    scored = models.scored_rows(models.model_registry()["dummy_majority"], test, counts, 42)
    return metrics.default_metrics(scored, F.col("predicted"), probability="score")


def train_split(spark, sf_dir):
    rows = labelled_rows(spark, sf_dir)
    train, test = split.split_by_company(rows, columns.GROUP)
    return split.split_summary(rows, train, test, columns.GROUP, columns.TARGET)


def split_members(spark, sf_dir):
    """Every company with its side of the split and its rows."""
    rows = labelled_rows(spark, sf_dir)
    train, test = split.split_by_company(rows, columns.GROUP)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy(columns.GROUP, "side").agg(F.count("*").alias("rows"))


def fill_values(spark, sf_dir):
    """What the preprocessing learns from the training side: medians, modes, means after filling."""
    rows = labelled_rows(spark, sf_dir)
    train, _ = split.split_by_company(rows, columns.GROUP)
    medians = models.exact_medians(train, columns.NUMERIC_FEATURES)
    modes = models.most_frequent(train, columns.CATEGORICAL_FEATURES)
    stages = models.preprocessor(train, medians, modes).fit(train).stages
    means = dict(zip(columns.NUMERIC_FEATURES, stages[2].mean.toArray().tolist(), strict=True))
    found = [(name, float(medians[name]), round(means[name], 6), None) for name in columns.NUMERIC_FEATURES]
    found += [(name, None, None, modes[name]) for name in columns.CATEGORICAL_FEATURES]
    return spark.createDataFrame(found, "feature string, median double, mean double, mode string")


def class_weights(spark, sf_dir):
    rows = labelled_rows(spark, sf_dir)
    train, _ = split.split_by_company(rows, columns.GROUP)
    counts = models.class_counts(train)
    weighted = train.select(columns.TARGET, models.balanced_weight(counts).alias("weight"))
    return weighted.groupBy(columns.TARGET).agg(
        F.count("*").alias("rows"), F.round(F.max("weight"), 9).alias("weight")
    )


def benchmark(spark, sf_dir):
    """All models of the registry on the payment reports, without the columns that hold the clock."""
    data = jobs.prepare(model_rows(spark, sf_dir))
    results, _, _ = jobs.benchmark_models(data)
    return results.drop("training_time_seconds", "inference_time_seconds", "model_size_bytes")


def predict_drivers(spark, sf_dir):
    """Every report scored by a logistic model, with its main drivers."""
    rows = model_rows(spark, sf_dir)
    data = jobs.prepare(rows)
    spec = jobs.model_registry()["logistic_regression_balanced"]
    model, _, _, _ = jobs.fit_and_score("logistic_regression_balanced", spec, data)
    return scoring.score_rows(rows, data.stages, model, {"selected_threshold": 0.5}, keep=["report_id"])


QUERIES = {
    "thresholds": thresholds,
    "thresholds_by_model": thresholds_by_model,
    "best_threshold": best_threshold,
    "best_threshold_high_floor": best_threshold_high_floor,
    "default_metrics": default_metrics,
    "ranking": ranking,
    "calibration": calibration,
    "brier": brier,
    "model_select": model_select,
    "model_best_baseline": model_best_baseline,
    "score_bands": score_bands,
    "linear_driver_bands": linear_driver_bands,
    "majority_baseline": majority_baseline,
    "train_split": train_split,
    "split_members": split_members,
    "fill_values": fill_values,
    "class_weights": class_weights,
    "benchmark": benchmark,
    "predict_drivers": predict_drivers,
}
