"""Batch scoring with risk bands and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import first_match
from ..functions.numbers import rounded
from .columns import FEATURES, typed_features
from .models import feature_names

# Fixed values.
MODEL_VERSION = "public_payment_model_v1"
MEDIUM_PROBABILITY = 0.3
DEFAULT_THRESHOLD = {"selected_threshold": 0.5, "strategy": "default_0.5_no_threshold_config"}
LOCAL, GLOBAL, NONE = "local_linear_contribution", "global_feature_importance", "unavailable"
TOP_DRIVERS = 5
_DRIVER = "array<struct<feature:string,coefficient:double,contribution:double,importance:double>>"


def probability_band(probability: Column, threshold: float) -> Column:
    return first_match(
        [(probability >= threshold, "High"), (probability >= MEDIUM_PROBABILITY, "Medium")], "Low"
    )


def _entry(feature: Column, coefficient=None, contribution=None, importance=None) -> Column:
    def value(v):
        return v if isinstance(v, Column) else F.lit(v).cast("double")

    return F.struct(
        feature.alias("feature"),
        value(coefficient).alias("coefficient"),
        value(contribution).alias("contribution"),
        value(importance).alias("importance"),
    )


def linear_drivers(
    features: Column, names: Sequence[str], coefficients: Sequence[float], top: int = TOP_DRIVERS
) -> tuple[Column, Column]:
    """Largest positive and most negative contributions (value times coefficient) of each row.

    Both arrays have one entry per feature at most; they are built from the row itself.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(float(c)).alias("weight"), F.lit(i).alias("place"))
            for i, (n, c) in enumerate(zip(names, coefficients, strict=True))
        ]
    )

    def entry(value: Column, pair: Column) -> Column:
        return F.struct(
            rounded(value * pair["weight"], 6).alias("size"),
            pair["place"].alias("place"),
            _entry(pair["name"], rounded(pair["weight"], 6), rounded(value * pair["weight"], 6)).alias("shown"),
        )

    entries = F.zip_with(features, pairs, entry)

    def best(sign: int) -> Column:
        kept = F.filter(entries, lambda e: e["size"] * sign > 0)
        keyed = F.transform(
            kept, lambda e: F.struct((e["size"] * -sign).alias("key"), e["place"].alias("place"), e["shown"].alias("shown"))
        )
        return F.transform(F.slice(F.array_sort(keyed), 1, top), lambda e: e["shown"])

    return best(1), best(-1)


def importance_rows(model: PipelineModel, prepared: PipelineModel, name: str) -> list[tuple]:
    """(model, feature, value, absolute value) of a fitted model, largest first.

    A model has tens of features, so this is a small driver-side list.
    """
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = last.coefficients.toArray()
    else:
        return []
    rows = [(name, f, float(v), abs(float(v))) for f, v in zip(feature_names(prepared), values, strict=True)]
    return sorted(rows, key=lambda row: -row[3])


def global_drivers(model: PipelineModel, prepared: PipelineModel, top: int = TOP_DRIVERS) -> list[tuple]:
    """The most important features of a tree model; features without importance are left out."""
    rows = [row for row in importance_rows(model, prepared, "") if row[2] != 0]
    return [(feature, round(value, 6)) for _, feature, value, _ in rows[:top]]


def feature_rows(df: DataFrame) -> DataFrame:
    """All model features of each row with their types; features the input lacks become NULL."""
    others = [c for c in df.columns if c not in FEATURES]
    return df.select(*others, *typed_features(df))


def score_rows(
    df: DataFrame,
    prepared: PipelineModel,
    model: PipelineModel,
    threshold_config: dict | None = None,
    model_path: str = "",
    top: int = TOP_DRIVERS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Probability, label, band, drivers and feature snapshot of each row."""
    threshold = float((threshold_config or DEFAULT_THRESHOLD).get("selected_threshold") or 0.5)
    rows = feature_rows(df)
    predicted = model.transform(prepared.transform(rows))
    probability = vector_to_array("probability")[1]
    last = model.stages[-1]
    none = F.array().cast(_DRIVER)
    drivers = global_drivers(model, prepared, top) if hasattr(last, "featureImportances") else []
    by_importance = (
        F.array(*[_entry(F.lit(f), importance=v) for f, v in drivers]).cast(_DRIVER) if drivers else none
    )
    if hasattr(last, "coefficients"):
        up, down = linear_drivers(vector_to_array("features"), feature_names(prepared), last.coefficients.toArray(), top)
        predicted = predicted.withColumns({"__up": up.cast(_DRIVER), "__down": down.cast(_DRIVER)})
        local = (F.size("__up") > 0) | (F.size("__down") > 0)
        kind = F.when(local, LOCAL).otherwise(NONE)
        positive, negative = F.col("__up"), F.col("__down")
    else:
        kind = F.lit(GLOBAL if drivers else NONE)
        positive, negative = by_importance, none
    scored = predicted.withColumn("__p", probability)
    return scored.select(
        *keep,
        rounded(F.col("__p"), 6).alias("probability"),
        F.lit(threshold).alias("selected_threshold"),
        probability_band(F.col("__p"), threshold).alias("risk_band"),
        (F.col("__p") >= threshold).cast("int").alias("predicted_label"),
        kind.alias("explanation_type"),
        positive.alias("top_positive_drivers"),
        negative.alias("top_negative_drivers"),
        F.struct(*FEATURES).alias("feature_snapshot"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(model_path).alias("model_artifact_path"),
    )
