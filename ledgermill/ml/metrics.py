"""Classification metrics as aggregates over (label, score) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded

# Threshold grids, the recall floor and the selection rule.
DEFAULT_THRESHOLDS = [round(n / 100, 2) for n in range(20, 81, 5)]
BENCHMARK_THRESHOLDS = [round(n / 100, 2) for n in range(20, 91, 5)]
RECALL_FLOOR = 0.8
BASELINE_MODEL = "logistic_regression_balanced"
MIN_F1_GAIN = 0.02
CURVE_BUCKETS = 256
COUNTS = ("true_positive", "false_positive", "true_negative", "false_negative")


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _confusion(predicted: Column, label: Column) -> dict[str, Column]:
    return {
        "true_positive": F.count_if(predicted & (label == 1)),
        "false_positive": F.count_if(predicted & (label == 0)),
        "true_negative": F.count_if(~predicted & (label == 0)),
        "false_negative": F.count_if(~predicted & (label == 1)),
    }


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": rounded(_share(tp, tp + fp), 4),
        "recall": rounded(_share(tp, tp + fn), 4),
        "f1": rounded(_share(2 * tp, 2 * tp + fp + fn), 4),
    }


def default_metrics(
    scored: DataFrame, predicted: Column, label: str = "label", probability: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall, F1, confusion counts and Brier score at a fixed decision."""
    y = F.col(label)
    counts = _confusion(predicted, y)
    squared = F.pow(F.col(probability) - y, 2) if probability else F.lit(None).cast("double")
    totals = scored.agg(
        *[value.alias(name) for name, value in counts.items()], F.avg(squared).alias("brier")
    )
    tp, fp, tn, fn = (F.col(name) for name in COUNTS)
    return totals.select(
        rounded(_share(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        *[value.alias(name) for name, value in _rates(tp, fp, fn).items()],
        *COUNTS,
        rounded(F.col("brier"), 6).alias("brier_score"),
    )


def score_curve(
    scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), work: str | None = None,
    buckets: int = CURVE_BUCKETS,
) -> DataFrame:
    """Positives and negatives at and above every distinct score, at any number of scores.

    Distinct scores are cut into value ranges at approximate quantiles. Running counts are
    kept inside a range; the totals of the ranges above (at most ``buckets`` + 1 rows) are
    added to them, so no task sees all scores. The result is exact wherever the cuts fall.
    ``by`` names columns that hold several models' rows. The counts per score are used three
    times: ``work`` is a folder to write them to, so that the rows are read once.
    """
    by_score = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("negatives"),
    )
    if work is not None:
        by_score.write.mode("overwrite").parquet(work)
        by_score = scored.sparkSession.read.schema(by_score.schema).parquet(work)
    steps = [n / buckets for n in range(1, buckets)]
    cuts = sorted(set(by_score.approxQuantile("score", steps, 0.001)))
    splits = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="score", outputCol="range").transform(by_score)

    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "range")
        .agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
        .select(
            *by,
            "range",
            F.coalesce(F.sum("p").over(above), F.lit(0)).alias("positives_before"),
            F.coalesce(F.sum("n").over(above), F.lit(0)).alias("negatives_before"),
        )
    )
    running = (
        Window.partitionBy(*by, "range").orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.join(offsets, [*by, "range"]).select(
        *by,
        "score",
        "positives",
        "negatives",
        (F.col("positives_before") + F.sum("positives").over(running)).alias("positives_to_here"),
        (F.col("negatives_before") + F.sum("negatives").over(running)).alias("negatives_to_here"),
    )


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision from a score curve.

    NULL when a class is missing. The AUC is summed in whole numbers, so it does not depend on
    the order of rows.
    """
    pos, neg = F.col("positives"), F.col("negatives")
    above = F.col("positives_to_here") - pos
    wide = "decimal(19,0)"
    area = (neg.cast(wide) * (2 * above + pos).cast(wide)).cast("decimal(38,0)")
    here = (F.col("positives_to_here") + F.col("negatives_to_here")).cast("double")
    precision = F.col("positives_to_here").cast("double") / here
    sums = curve.groupBy(*by).agg(
        F.sum(area).cast("double").alias("area"),
        F.sum(pos).cast("double").alias("p"),
        F.sum(neg).cast("double").alias("n"),
        F.sum(pos.cast("double") * precision).alias("weighted"),
    )
    return sums.select(
        *by,
        rounded(F.try_divide(F.col("area"), 2 * F.col("p") * F.col("n")), 4).alias("roc_auc"),
        rounded(F.try_divide(F.col("weighted"), F.col("p")), 4).alias("pr_auc"),
    )


def threshold_report(
    scored: DataFrame,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and confusion counts at each threshold, from one aggregate.

    ``by`` names columns that hold several models' rows in one DataFrame.
    """
    y, p = F.col(label), F.col(score)
    sums = []
    for place, threshold in enumerate(thresholds):
        for name, value in _confusion(p >= threshold, y).items():
            sums.append(value.alias(f"{name}_{place}"))
    wide = scored.groupBy(*by).agg(*sums) if by else scored.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(threshold)).alias("threshold"),
                *[F.col(f"{name}_{place}").alias(name) for name in COUNTS],
            )
            for place, threshold in enumerate(thresholds)
        ]
    )
    long = wide.select(*by, F.inline(rows))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    rates = _rates(tp, fp, fn)
    return long.select(
        *by, "threshold", *[value.alias(name) for name, value in rates.items()], *COUNTS
    )


def best_threshold(
    report: DataFrame, recall_floor: float = RECALL_FLOOR, by: Sequence[str] = ()
) -> DataFrame:
    """The threshold of highest F1 among those reaching the recall floor, else among all.

    Ties prefer higher recall, then the higher threshold.
    """
    reaches = F.col("recall") >= recall_floor
    strategy = F.when(reaches, f"max_f1_with_recall_floor_{recall_floor}").otherwise(
        "max_f1_no_recall_floor_match"
    )
    rank = F.struct(reaches, F.col("f1"), F.col("recall"), F.col("threshold"))
    row = F.struct(
        F.col("threshold").alias("selected_threshold"),
        strategy.alias("strategy"),
        F.lit(float(recall_floor)).alias("recall_floor"),
        "precision",
        "recall",
        "f1",
        *COUNTS,
    )
    picked = F.max_by(row, rank).alias("row")
    best = report.groupBy(*by).agg(picked) if by else report.agg(picked)
    return best.filter(F.col("row").isNotNull()).select(*by, "row.*")


def calibration_bins(
    scored: DataFrame, bins: int = 10, label: str = "label", score: str = "score"
) -> DataFrame:
    """Mean probability and observed rate per equal-width bin; an edge belongs to the bin below it.

    Empty bins are left out.
    """
    p = F.col(score)
    place = sum(((p > n * (1.0 / bins)).cast("int") for n in range(1, bins)), F.lit(0))
    return (
        scored.groupBy(place.alias("bin"))
        .agg(F.avg(score).alias("mean"), F.avg(F.col(label).cast("double")).alias("rate"))
        .select(
            "bin",
            rounded(F.col("mean"), 6).alias("mean_predicted_probability"),
            rounded(F.col("rate"), 6).alias("observed_positive_rate"),
        )
        .orderBy("bin")
    )


def brier_score(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return scored.agg(rounded(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier_score"))


def best_by_f1(results: DataFrame) -> DataFrame:
    """The model of highest F1, then ROC AUC; missing values count as 0."""
    rank = [F.desc(F.coalesce(F.col(c), F.lit(0.0))) for c in ("f1", "roc_auc")]
    return results.orderBy(*rank, "model_name").limit(1)


def select_final_model(
    results: DataFrame,
    baseline: str = BASELINE_MODEL,
    recall_floor: float = RECALL_FLOOR,
    min_f1_gain: float = MIN_F1_GAIN,
) -> DataFrame:
    """The final model: best of those reaching the recall floor, but the baseline stays unless
    the winner's F1 is higher by the required gain."""
    values = ["precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score", "selected_threshold"]
    trained = results.filter(F.col("status") == "trained").select(
        "model_name", *[F.col(c).cast("double").alias(c) for c in values]
    )
    reaches = F.coalesce(F.col("recall"), F.lit(0.0)) >= recall_floor
    winner = (
        trained.withColumn("reaches", reaches)
        .orderBy(F.desc("reaches"), F.desc("f1"), F.desc("precision"), F.desc("pr_auc"), "model_name")
        .limit(1)
    )
    fields = ["model_name", *values]
    baseline_row = (
        trained.filter(F.col("model_name") == baseline).limit(1).select(F.struct(*fields).alias("b")).scalar()
    )
    both = winner.select(F.struct(*fields).alias("winner"), "reaches", baseline_row.alias("baseline"))

    def f1(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.f1"), F.lit(0.0))

    missing = F.col("baseline").isNull()
    same = F.col("winner.model_name") == baseline
    enough = f1("winner") >= f1("baseline") + min_f1_gain
    reason = (
        F.when(missing, "baseline_missing_selected_best_available_model")
        .when(same, "baseline_logistic_regression_won_selection_rule")
        .when(enough, "replacement_model_met_minimum_f1_improvement")
        .otherwise("kept_logistic_regression_due_to_insufficient_improvement")
    )
    final = F.when(missing | same | enough, F.col("winner")).otherwise(F.col("baseline"))
    pool = F.when(F.col("reaches"), f"recall_at_least_{recall_floor}").otherwise(
        "no_model_met_recall_floor"
    )
    return both.select(
        final.alias("final"),
        reason.alias("selection_reason"),
        pool.alias("selection_pool"),
        F.lit(float(recall_floor)).alias("recall_floor"),
        F.lit(float(min_f1_gain)).alias("min_f1_improvement_required"),
    ).select(
        F.col("final.model_name").alias("selected_model"),
        "selection_reason",
        "selection_pool",
        "recall_floor",
        "min_f1_improvement_required",
        *[F.col(f"final.{c}").alias(c) for c in values],
    )
