"""Training and benchmark jobs: fit, evaluate, choose and save."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files
from . import metrics
from .columns import FEATURES, GROUP, LEAKAGE_COLUMNS, TARGET, training_rows
from .forests import fit_forest
from .models import WEIGHT, ModelSpec, balanced_weight, class_counts, model_registry, preprocessor, scored_rows
from .scoring import DEFAULT_THRESHOLD, importance_rows, score_rows
from .split import split_by_company, split_summary

RESULT_SCHEMA = """
    model_name string, status string, accuracy double, precision double, recall double, f1 double,
    roc_auc double, pr_auc double, brier_score double, true_positive bigint, false_positive bigint,
    true_negative bigint, false_negative bigint, selected_threshold double, threshold_strategy string,
    training_time_seconds double, inference_time_seconds double, model_size_bytes bigint, skip_reason string
"""
RESULT_FIELDS = [part.split()[0] for part in RESULT_SCHEMA.split(",")]
BASELINES = ("logistic_regression_balanced", "random_forest_balanced")


@dataclass
class Prepared:
    """One split with its fitted preprocessing; features are computed once per side."""

    rows: DataFrame
    train: DataFrame
    test: DataFrame
    train_features: DataFrame
    test_features: DataFrame
    stages: PipelineModel
    counts: dict[int, int]
    work: str


def prepare(df: DataFrame, test_share: float = 0.2, seed: int = 42, work: str | None = None) -> Prepared:
    """Split by company, fit the preprocessing on train and write both feature tables.

    The tables in the work folder end the lineage: every model reads finished features, and
    a lost executor costs a re-read instead of the whole preparation. Jobs give a folder below
    their output and clear it when done.
    """
    spark = df.sparkSession
    work = work or f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    training_rows(df).write.mode("overwrite").parquet(f"{work}/rows")
    rows = spark.read.parquet(f"{work}/rows")
    train, test = split_by_company(rows, GROUP, test_share, seed)
    counts = class_counts(train)
    stages = preprocessor(train).fit(train)
    signed = (F.col(TARGET) * 2.0 - 1.0).alias("signed_label")
    for side, name in ((train, "train"), (test, "test")):
        stages.transform(side).select(
            GROUP, TARGET, signed, balanced_weight(counts).alias(WEIGHT), "features"
        ).write.mode("overwrite").parquet(f"{work}/{name}")
    return Prepared(
        rows, train, test, spark.read.parquet(f"{work}/train"), spark.read.parquet(f"{work}/test"),
        stages, counts, work,
    )


def fit_and_score(
    name: str, spec: ModelSpec, data: Prepared, seed: int = 42
) -> tuple[PipelineModel | None, DataFrame, float, float]:
    """(model, scored test rows, fit seconds, scoring seconds); scores are written once."""
    spark = data.rows.sparkSession
    start = time.perf_counter()
    model = None
    if spec.build is not None:
        rows = sum(data.counts.values())
        estimator = spec.build(rows, seed)
        if isinstance(estimator, RandomForestClassifier):
            model = fit_forest(estimator, data.train_features, rows, f"{data.work}/forests/{name}")
        else:
            model = Pipeline(stages=[estimator]).fit(data.train_features)
    fitted = time.perf_counter()
    predictions = model.transform(data.test_features) if model else data.test_features
    path = f"{data.work}/scored/{name}"
    scored_rows(spec, predictions, data.counts, seed).write.mode("overwrite").parquet(path)
    return model, spark.read.parquet(path), fitted - start, time.perf_counter() - fitted


def evaluate(scored: DataFrame, has_probability: bool, work: str | None = None) -> dict:
    """Metrics at the default decision and over the ranking, as one record."""
    fixed = metrics.default_metrics(
        scored, F.col("predicted"), probability="score" if has_probability else None
    ).first()
    ranking = metrics.ranking_metrics(metrics.score_curve(scored, work=work)).first()
    return {**fixed.asDict(), **ranking.asDict()}


def _benchmark_record(name, spec, data, recall_floor, seed):
    model, scored, fit_seconds, score_seconds = fit_and_score(name, spec, data, seed)
    has_probability = spec.kind not in ("regression", "margin")
    record = evaluate(scored, has_probability, f"{data.work}/curves/{name}")
    report = None
    if has_probability:
        # With probabilities, precision, recall, F1 and counts are those of the tuned threshold;
        # accuracy stays at the default decision.
        report = metrics.threshold_report(scored, metrics.BENCHMARK_THRESHOLDS)
        chosen = metrics.best_threshold(report, recall_floor).first().asDict()
        record.update({k: v for k, v in chosen.items() if k not in ("strategy", "recall_floor")})
        record["threshold_strategy"] = chosen["strategy"]
    else:
        record["threshold_strategy"] = "not_available_no_predict_proba"
    size = 0
    if model is not None:
        path = f"{data.work}/models/{name}"
        model.write().overwrite().save(path)
        size = files.total_bytes(model_spark(data), path)
    record.update(
        model_name=name, status="trained", training_time_seconds=round(fit_seconds, 4),
        inference_time_seconds=round(score_seconds, 4), model_size_bytes=size, skip_reason="",
    )
    return record, model, report


def model_spark(data: Prepared) -> SparkSession:
    return data.rows.sparkSession


def benchmark_models(
    data: Prepared,
    model_names: Sequence[str] | None = None,
    recall_floor: float = metrics.RECALL_FLOOR,
    seed: int = 42,
    registry: dict[str, ModelSpec] | None = None,
) -> tuple[DataFrame, dict[str, PipelineModel], dict[str, DataFrame]]:
    """(result table, fitted models, threshold reports); skipped models get a row with a reason."""
    records, models, reports = [], {}, {}
    for name, spec in (registry or model_registry()).items():
        if model_names and name not in model_names:
            continue
        if spec.skip_reason:
            records.append({"model_name": name, "status": "skipped", "skip_reason": spec.skip_reason})
            continue
        record, model, report = _benchmark_record(name, spec, data, recall_floor, seed)
        records.append(record)
        models[name] = model
        if report is not None:
            reports[name] = report
    rows = [tuple(record.get(field) for field in RESULT_FIELDS) for record in records]
    return model_spark(data).createDataFrame(rows, RESULT_SCHEMA), models, reports


def save_model(model: PipelineModel | None, stages: PipelineModel, path: str) -> str:
    """Preprocessing and model as one saved pipeline. A constant model has nothing to save."""
    if model is None:
        raise ValueError("A constant model cannot be saved for scoring.")
    parts = [*stages.stages, *(model.stages if model else [])]
    PipelineModel(parts).write().overwrite().save(path)
    return path


def load_model(path: str) -> tuple[PipelineModel, PipelineModel]:
    """(preprocessing, model) of a saved pipeline."""
    stages = PipelineModel.load(path).stages
    return PipelineModel(stages[:-1]), PipelineModel(stages[-1:])


def load_threshold_config(spark: SparkSession, path: str, legacy_path: str | None = None) -> dict:
    """The stored threshold; an older file is tried next, then 0.5."""
    for candidate in (path, legacy_path):
        if candidate and files.exists(spark, candidate):
            return files.read_json(spark, candidate)
    return dict(DEFAULT_THRESHOLD)


def _save_importance(model, stages, name, path, spark):
    rows = importance_rows(model, stages, name) if model else []
    kind = "coefficient" if model and hasattr(model.stages[-1], "coefficients") else "importance"
    schema = f"model string, feature string, {kind} double, absolute_value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def run_training(
    df: DataFrame,
    output_dir: str,
    test_share: float = 0.2,
    seed: int = 42,
    recall_floor: float = metrics.RECALL_FLOOR,
    model_names: Sequence[str] = BASELINES,
    registry: dict[str, ModelSpec] | None = None,
) -> dict:
    """Train the baselines, tune the best one's threshold and save model and reports."""
    spark = df.sparkSession
    data = prepare(df, test_share, seed, f"{output_dir}/_work")
    known = registry or model_registry()
    results, fitted = {}, {}
    for name in model_names:
        model, scored, _, _ = fit_and_score(name, known[name], data, seed)
        record = evaluate(scored, True, f"{data.work}/curves/{name}")
        results[name] = {k: record[k] for k in ("accuracy", "precision", "recall", "f1", "roc_auc")}
        fitted[name] = (model, scored)
    table = spark.createDataFrame(
        [(n, r["f1"], r["roc_auc"]) for n, r in results.items()], "model_name string, f1 double, roc_auc double"
    )
    best = metrics.best_by_f1(table).first()["model_name"]
    model, scored = fitted[best]
    report = metrics.threshold_report(scored)
    chosen = metrics.best_threshold(report, recall_floor).first().asDict()
    bins = metrics.calibration_bins(scored)
    calibration = {
        **metrics.brier_score(scored).first().asDict(),
        "n_bins": 10,
        "calibration_bins": [row.asDict() for row in bins.drop("bin").collect()],
        "calibrated_model_created": False,
    }
    summary = {
        "target": TARGET,
        "features": FEATURES,
        "leakage_columns_excluded": sorted(LEAKAGE_COLUMNS),
        "rows_available": df.count(),
        **split_summary(data.rows, data.train, data.test, GROUP, TARGET).first().asDict(),
        "models": results,
        "best_model": best,
        "threshold_config": chosen,
        "calibration_metrics": calibration,
    }
    paths = {
        "model_path": save_model(model, data.stages, f"{output_dir}/public_payment_model"),
        "metrics_path": files.write_json(spark, summary, f"{output_dir}/model_metrics"),
        "training_columns_path": files.write_json(spark, FEATURES, f"{output_dir}/training_columns"),
        "feature_importance_path": _save_importance(
            model, data.stages, best, f"{output_dir}/feature_importance", spark
        ),
        "threshold_report_path": files.write_table(report.coalesce(1), f"{output_dir}/threshold_report", "csv"),
        "threshold_config_path": files.write_json(spark, chosen, f"{output_dir}/threshold_config"),
        "calibration_metrics_path": files.write_json(spark, calibration, f"{output_dir}/calibration_metrics"),
    }
    files.delete(spark, data.work)
    return {**summary, "artifact_paths": paths}


def run_scoring(
    rows: DataFrame, model_path: str, output_path: str, threshold_path: str | None = None,
    legacy_threshold_path: str | None = None, keep: Sequence[str] = (GROUP,),
) -> DataFrame:
    """Load a saved model and its threshold, score all rows, write and return the result.

    Rows may come from Parquet or all-text CSV and may lack features, which count as missing.
    """
    spark = rows.sparkSession
    prepared, model = load_model(model_path)
    threshold = load_threshold_config(spark, threshold_path or "", legacy_threshold_path)
    kept = [name for name in keep if name in rows.columns]
    scored = score_rows(rows, prepared, model, threshold, model_path=model_path, keep=kept)
    scored.write.mode("overwrite").parquet(output_path)
    return spark.read.parquet(output_path)


def run_benchmark(
    df: DataFrame,
    output_dir: str,
    test_share: float = 0.2,
    seed: int = 42,
    recall_floor: float = metrics.RECALL_FLOOR,
    model_names: Sequence[str] | None = None,
    registry: dict[str, ModelSpec] | None = None,
) -> dict:
    """Benchmark the registered models, choose the final one and save the artifacts."""
    spark = df.sparkSession
    data = prepare(df, test_share, seed, f"{output_dir}/_work")
    results, models, reports = benchmark_models(data, model_names, recall_floor, seed, registry)
    chosen = metrics.select_final_model(results).first()
    if chosen is None:
        raise ValueError("No trained models available for final selection.")
    selection = chosen.asDict()
    name = selection["selected_model"]
    threshold = {k: selection[k] for k in ("selected_model", "selected_threshold", "selection_reason")}
    records = [row.asDict() for row in results.collect()]
    paths = {
        "benchmark_csv_path": files.write_table(results.coalesce(1), f"{output_dir}/benchmark_results_csv", "csv"),
        "benchmark_json_path": files.write_table(results.coalesce(1), f"{output_dir}/benchmark_results_json", "json"),
        "model_metrics_path": files.write_json(
            spark, {"final_selection": selection, "benchmark_results": records}, f"{output_dir}/model_metrics"
        ),
        "training_columns_path": files.write_json(spark, FEATURES, f"{output_dir}/training_columns"),
        "selected_threshold_path": files.write_json(spark, threshold, f"{output_dir}/selected_threshold"),
        "best_model_path": save_model(models[name], data.stages, f"{output_dir}/best_model"),
        "feature_importance_path": _save_importance(
            models[name], data.stages, name, f"{output_dir}/feature_importance", spark
        ),
    }
    if reports:
        named = [report.withColumn("model_name", F.lit(n)) for n, report in reports.items()]
        table = named[0]
        for other in named[1:]:
            table = table.unionByName(other)
        table.write.mode("overwrite").partitionBy("model_name").parquet(f"{output_dir}/threshold_reports")
        paths["threshold_reports_path"] = f"{output_dir}/threshold_reports"
    if selection["brier_score"] is not None:
        paths["calibration_metrics_path"] = files.write_json(
            spark, {"selected_model": name, "brier_score": selection["brier_score"]},
            f"{output_dir}/calibration_metrics",
        )
    summary = split_summary(data.rows, data.train, data.test, GROUP, TARGET).first().asDict()
    status = [record["status"] for record in records]
    files.delete(spark, data.work)
    return {
        **{k: summary[k] for k in ("rows_used", "train_companies", "test_companies", "group_overlap")},
        "models_benchmarked": status.count("trained"),
        "models_skipped": status.count("skipped"),
        "selected_model": selection,
        "artifact_paths": paths,
    }
