"""Split, metrics against brute force, threshold and model choice, training and scoring."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermill.ml import columns, jobs, metrics, models, scoring, split
from ledgermill.sources import csv_files

RESULTS = ("model_name string, status string, precision double, recall double, f1 double, roc_auc double,"
           " pr_auc double, brier_score double, selected_threshold double")


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, score double")


def payment_rows(spark, companies=60, per_company=6):
    rng = random.Random(7)
    rows = []
    for c in range(companies):
        for n in range(per_company):
            late = rng.random() * 100
            slow = int(late + rng.random() * 30 > 70)
            rows.append((f"{c:08d}", slow, 100 - late, late / 2, late / 2, late, 1.0, 30.0, 60.0,
                         None if n == 0 else 90.0, per_company, 0, n % 2, 0, ("Yes", "No", "Unknown")[n % 3],
                         "True", None if c % 4 == 0 else "False", "False"))
    spec = ", ".join(["company_number string", "slow_payer_label int",
                      *[f"{c} double" for c in columns.NUMERIC_FEATURES[:8]],
                      *[f"{c} int" for c in columns.NUMERIC_FEATURES[8:]],
                      *[f"{c} string" for c in columns.CATEGORICAL_FEATURES]])
    return spark.createDataFrame(rows, spec)


def test_split_takes_the_exact_share(spark):
    for companies in (1, 7, 500):
        rows = spark.range(companies * 3).select((F.col("id") % companies).cast("string").alias("g"), "id")
        train, test = split.split_by_company(rows, "g", 0.2, 42)
        sides = [{r["g"] for r in side.collect()} for side in (train, test)]
        assert not sides[0] & sides[1] and len(sides[0] | sides[1]) == companies
        assert len(sides[1]) == -(-companies // 5)
        assert train.count() + test.count() == companies * 3
    again = split.company_cut(rows, "g", 0.2, 42)
    assert again == split.company_cut(rows.repartition(3), "g", 0.2, 42)


def test_small_threshold_example(spark):
    row = metrics.threshold_report(frame(spark, [(0, 0.1), (0, 0.4), (1, 0.7), (1, 0.9)]), [0.5]).first()
    assert [row[c] for c in metrics.COUNTS] == [2, 0, 2, 0] and row["f1"] == 1.0


def test_threshold_choice(spark):
    spec = ("threshold double, precision double, recall double, f1 double, true_positive bigint,"
            " false_positive bigint, true_negative bigint, false_negative bigint")
    report = spark.createDataFrame([(0.4, 0.5, 0.9, 0.64, 1, 1, 1, 1), (0.5, 0.6, 0.82, 0.69, 2, 1, 1, 1),
                                    (0.6, 0.8, 0.7, 0.75, 3, 1, 1, 1)], spec)
    picked = metrics.best_threshold(report).first()
    assert (picked["selected_threshold"], picked["strategy"]) == (0.5, "max_f1_with_recall_floor_0.8")
    picked = metrics.best_threshold(report, 0.95).first()
    assert (picked["selected_threshold"], picked["strategy"]) == (0.6, "max_f1_no_recall_floor_match")


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), 3 if rng.random() < 0.5 else 1)) for _ in range(900)]
    pairs += [(1, 0.5)] * 400 + [(0, 0.5)] * 300
    got = metrics.ranking_metrics(metrics.score_curve(frame(spark, pairs))).first()
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in {p for _, p in pairs}:
        above = [y for y, p in pairs if p >= s]
        ap += sum(1 for y, p in pairs if y and p == s) / len(pos) * (sum(above) / len(above))
    assert got["roc_auc"] == pytest.approx(auc, abs=6e-5) and got["pr_auc"] == pytest.approx(ap, abs=6e-5)
    one_class = metrics.ranking_metrics(metrics.score_curve(frame(spark, [(1, 0.2), (1, 0.3)]))).first()
    assert one_class["roc_auc"] is None


def test_calibration_edges_belong_below(spark):
    rows = metrics.calibration_bins(frame(spark, [(0, 0.0), (1, 0.1), (1, 0.11), (0, 1.0)])).collect()
    assert [(r["bin"], r["observed_positive_rate"]) for r in rows] == [(0, 0.5), (1, 1.0), (9, 0.0)]


@pytest.mark.parametrize(
    ("rows", "chosen", "reason"),
    [
        ([("b", 0.697, 0.81), ("x", 0.705, 0.81)], "b", "kept_logistic_regression_due_to_insufficient_improvement"),
        ([("b", 0.69, 0.81), ("x", 0.72, 0.81)], "x", "replacement_model_met_minimum_f1_improvement"),
        ([("b", 0.69, 0.81), ("x", 0.72, 0.5)], "b", "baseline_logistic_regression_won_selection_rule"),
        ([("x", 0.5, 0.81), ("y", 0.6, 0.1)], "x", "baseline_missing_selected_best_available_model"),
    ],
)
def test_model_choice(spark, rows, chosen, reason):
    names = {"b": metrics.BASELINE_MODEL}
    table = [(names.get(n, n), "trained", 0.6, recall, f1, 0.9, 0.8, None, 0.5) for n, f1, recall in rows]
    table.append(("skip", "skipped", None, None, None, None, None, None, None))
    got = metrics.select_final_model(spark.createDataFrame(table, RESULTS)).first()
    assert (got["selected_model"], got["selection_reason"]) == (names.get(chosen, chosen), reason)
    assert got["selection_pool"] == "recall_at_least_0.8"


def test_features_are_checked(spark):
    columns.check_features()
    with pytest.raises(ValueError, match="avg_days_to_pay"):
        columns.check_features(["avg_days_to_pay"])
    with pytest.raises(ValueError, match="Missing required"):
        columns.training_rows(spark.range(1))


def test_training_and_scoring(spark, tmp_path):
    rows = payment_rows(spark)
    registry = {**models.model_registry(), "random_forest_balanced": models.ModelSpec(models._forest(5))}
    result = jobs.run_training(rows, str(tmp_path / "train"), registry=registry)
    assert result["group_overlap"] == 0 and result["test_companies"] == 12 and result["train_companies"] == 48
    assert set(result["models"]) == set(jobs.BASELINES)
    assert result["models"]["logistic_regression_balanced"]["roc_auc"] > 0.8
    config = jobs.load_threshold_config(spark, str(tmp_path / "none"), result["artifact_paths"]["threshold_config_path"])
    assert config["selected_threshold"] == result["threshold_config"]["selected_threshold"]
    assert jobs.load_threshold_config(spark, str(tmp_path / "none"))["selected_threshold"] == 0.5
    prepared, model = jobs.load_model(result["artifact_paths"]["model_path"])
    scored = scoring.score_rows(rows, prepared, model, config, keep=["company_number"]).collect()
    assert len(scored) == rows.count() and all(0 <= r["probability"] <= 1 for r in scored)


def test_scoring_of_text_rows_that_lack_a_feature(spark, tmp_path):
    rows = payment_rows(spark)
    registry = {**models.model_registry(), "random_forest_balanced": models.ModelSpec(models._forest(5))}
    paths = jobs.run_training(rows, str(tmp_path / "train"), registry=registry)["artifact_paths"]
    whole = jobs.run_scoring(rows, paths["model_path"], str(tmp_path / "whole"), paths["threshold_config_path"])
    rows.write.option("header", True).csv(str(tmp_path / "rows.csv"))
    text = csv_files.read_ml_ready(spark, str(tmp_path / "rows.csv"))
    assert {kind for _, kind in text.dtypes} == {"string"}
    again = jobs.run_scoring(text, paths["model_path"], str(tmp_path / "text"), paths["threshold_config_path"])
    assert sorted(r["probability"] for r in again.collect()) == sorted(r["probability"] for r in whole.collect())
    lacking = rows.drop("company_reporting_count", "e_invoicing_offered")
    scored = jobs.run_scoring(lacking, paths["model_path"], str(tmp_path / "lacking"))
    assert scored.count() == rows.count()
    assert scored.first()["feature_snapshot"]["company_reporting_count"] is None
    with pytest.raises(ValueError, match="constant"):
        jobs.save_model(None, jobs.load_model(paths["model_path"])[0], str(tmp_path / "none"))


def test_linear_drivers(spark):
    row = spark.range(1).select(F.array(F.lit(2.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0)).alias("v"))
    up, down = scoring.linear_drivers(F.col("v"), ["a", "b", "c", "d"], [1.0, 3.0, 9.0, 2.0], 2)
    got = row.select(up.alias("up"), down.alias("down")).first()
    assert [(d["feature"], d["contribution"]) for d in got["up"]] == [("a", 2.0), ("d", 2.0)]
    assert [(d["feature"], d["contribution"]) for d in got["down"]] == [("b", -3.0)]


def test_benchmark(spark, tmp_path):
    names = ["dummy_majority", "logistic_regression_balanced", "ridge_classifier_balanced", "linear_svc_balanced",
             "decision_tree_balanced", "knn"]
    result = jobs.run_benchmark(payment_rows(spark), str(tmp_path / "bench"), model_names=names)
    assert (result["models_benchmarked"], result["models_skipped"]) == (5, 1)
    table = {r["model_name"]: r for r in spark.read.json(result["artifact_paths"]["benchmark_json_path"]).collect()}
    assert table["ridge_classifier_balanced"]["selected_threshold"] is None
    assert table["linear_svc_balanced"]["roc_auc"] > 0.8 and table["knn"]["status"] == "skipped"
    assert table["dummy_majority"]["recall"] in (0.0, 1.0)
    prepared, model = jobs.load_model(result["artifact_paths"]["best_model_path"])
    bands = scoring.score_rows(payment_rows(spark, 3), prepared, model, {"selected_threshold": 0.5}).select("risk_band")
    assert {r[0] for r in bands.collect()} <= {"High", "Medium", "Low"}


def test_bands(spark):
    rows = frame(spark, [(0, 0.8), (0, 0.4), (0, 0.1)]).select(
        scoring.probability_band(F.col("score"), 0.5).alias("b"))
    assert [r["b"] for r in rows.collect()] == ["High", "Medium", "Low"]


def test_exact_medians_by_counting(spark, monkeypatch):
    import math
    import random

    from ledgermill.ml import models as m

    rng = random.Random(3)
    rows = []
    for k in range(3001):
        rows.append((
            rng.gauss(0, 1e6) if k % 3 else 7.0,  # a third of the rows hold one value
            float(rng.randint(-5, 5)) if k % 10 else None,
            float("nan") if k % 4 == 0 else rng.expovariate(1e-3),
            None,
            float(k),
        ))
    rows = rows[:-1] + [rows[5]]  # an even count and a repeated row
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    monkeypatch.setattr(m, "FINAL_VALUES", 40)  # several rounds of narrowing

    def lower_median(values):
        values = sorted(v for v in values if v is not None and not math.isnan(v))
        return values[(len(values) + 1) // 2 - 1] if values else None

    got = m.exact_medians(df, list("abcde"))
    assert got == {n: lower_median([r[i] for r in rows]) for i, n in enumerate("abcde")}


def test_fill_values_derives_the_rows_once(spark, tmp_path, monkeypatch):
    """The split and every fit read written training rows, not the whole preparation again."""
    from ledgermill.plans import sample_models

    tables = str(tmp_path)
    n = F.col("id")
    spark.range(4000).select(
        n.alias("l_orderkey"), (n % 40).alias("l_suppkey"), (n % 7).cast("int").alias("l_linenumber"),
        F.expr("timestamp'1995-01-01' + make_dt_interval(cast(id * 13 % 1500 as int))").alias("l_shipdate"),
    ).write.parquet(f"{tables}/lineitem.parquet")
    seen = []
    split_rows = sample_models.split.split_by_company
    monkeypatch.setattr(
        sample_models.split, "split_by_company", lambda rows, *a: seen.append(rows.inputFiles()) or split_rows(rows, *a)
    )
    for name in ("fill_values", "class_weights", "train_split", "split_members", "majority_baseline"):
        sample_models.QUERIES[name](spark, tables)
    assert len(seen) == 5
    assert all(files and all("lineitem" not in f for f in files) for files in seen)


def test_forest_beyond_the_driver_is_built_in_blocks(spark, tmp_path, monkeypatch):
    """No fit or load holds more trees than their bound on nodes allows; all trees vote."""
    from ledgermill.ml import forests

    fits, whole = [], forests.RandomForestClassifier._fit
    monkeypatch.setattr(
        forests.RandomForestClassifier, "_fit", lambda self, rows: fits.append(self.getNumTrees()) or whole(self, rows)
    )
    data = jobs.prepare(payment_rows(spark))
    spec = models.ModelSpec(models._forest(12))
    small = jobs.fit_and_score("small", spec, data)[1]
    assert fits == [12]
    fits.clear()
    monkeypatch.setattr(forests, "NODES", 300)
    model, scored, _, _ = jobs.fit_and_score("blocks", spec, data)
    assert sum(fits) == 12 and len(fits) > 1 and fits[0] == forests.trees_at_once(sum(data.counts.values()), 10)
    assert scored.count() == small.count()
    auc = [metrics.ranking_metrics(metrics.score_curve(s)).first()["roc_auc"] for s in (small, scored)]
    assert min(auc) > 0.8
    path = jobs.save_model(model, data.stages, str(tmp_path / "forest"))
    prepared, loaded = jobs.load_model(path)
    again = scoring.score_rows(payment_rows(spark), prepared, loaded, keep=["company_number"])
    assert again.count() == 360 and again.filter("probability between 0 and 1").count() == 360
    assert len(scoring.importance_rows(loaded, prepared, "f")) == len(models.feature_names(prepared))
    raw = loaded.transform(prepared.transform(payment_rows(spark))).select(forests.vector_to_array("rawPrediction").alias("v"))
    assert all(abs(sum(r["v"]) - 12) < 1e-9 for r in raw.collect())
