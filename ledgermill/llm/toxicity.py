"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over a document's words and word
beginnings. Each later model also gets the probabilities of the earlier ones. It is trained on
out-of-fold probabilities, so it learns how far it can trust them on unseen documents; when
scoring, the models fitted on all labelled rows supply them.

Models are fitted on at most SAMPLE labelled documents, chosen by a hash of their ids, with at
most FEATURES features a category, each in MIN_DOCUMENTS or more of them, in STEPS steps. These
bound the fit alone: every document is scored over its whole text. Features are learnt, not
hashed, so words of long documents can't collide with the words that matter. The features that
tell most about each category are found first, by one aggregate over the sample; the fits then
work on short rows, and scoring tasks get a few thousand weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain as chained

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .pieces import Kept

SAMPLE = 8_000  # labelled documents that models are fitted on, at most
FEATURES = 1_500  # that models may use, at most, for each category; those that tell most
MIN_DOCUMENTS = 4  # of the sample, for a feature to be used
PREFIXES = range(3, 9)  # letters of the word beginnings
LEVELS = 3
FOLDS = 3
PENALTY = 1e-3
L1_SHARE = 0.3
POSITIVE_WEIGHT = 4.0  # positives are rare, and missing one counts for more
STEPS = 15
KEPT_TOKENS = 50_000  # of a scoring task, with the stems that tell
THRESHOLD = 0.5
# Words, and runs of signs such as junk and masking leave.
_TOKEN = re.compile(r"[^\W_]+|[!-/:-@\[-`{-~]{2,}")


def text_tokens(text: str | None) -> set[str]:
    return set(_TOKEN.findall((text or "").lower()))


def token_stems(token: str) -> list[str]:
    """The word itself and its beginnings, which catch stems with any ending."""
    return [token, *[f"{token[:n]}-" for n in PREFIXES if n < len(token)]]


def stem_features(stems: Iterable[str]) -> list[str]:
    """A feature for each stem that one, two or three different words have."""
    return [f"{stem}{level}" for stem, n in Counter(stems).items() for level in range(1, min(n, LEVELS) + 1)]


def default_categories() -> dict[str, Column]:
    """Categories in chain order, as conditions on the labels: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


@dataclass
class Link:
    """One category's linear model: weights of features, of earlier probabilities, intercept."""

    weights: dict[str, float]
    earlier: list[float]
    intercept: float


@dataclass
class ToxicityChain:
    """Fitted models in chain order."""

    categories: list[str]
    links: list[Link] = field(default_factory=list)

    def probabilities(self, spark: SparkSession, text: Column) -> Column:
        """A struct of p_<category>. Null and empty texts have no features: intercepts decide."""
        shared = spark.sparkContext.broadcast(self.links)  # FEATURES bounds the weights
        names = [f"p_{name}" for name in self.categories]

        @F.pandas_udf(", ".join(f"{name} double" for name in names))
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            links = shared.value
            known = {feature[:-1] for link in links for feature in link.weights}
            telling = Kept(lambda token: tuple(stem for stem in token_stems(token) if stem in known), KEPT_TOKENS)
            for texts in batches:
                rows = []
                for text in texts:
                    found = stem_features(chained.from_iterable(map(telling.__getitem__, text_tokens(text))))
                    given: list[float] = []
                    for link in links:
                        # fsum is exact, so the order of the features doesn't matter.
                        logit = link.intercept + math.fsum(link.weights.get(f, 0.0) for f in found)
                        logit += math.fsum(w * p for w, p in zip(link.earlier, given, strict=True))
                        given.append(round(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))), 9))
                    rows.append(given)
                yield pd.DataFrame(rows, columns=names, dtype="float64")

        return score(text)


def _assembled(frame: DataFrame, earlier: list[str]) -> DataFrame:
    columns = ["_words", *[f"p_{name}" for name in earlier]]
    return VectorAssembler(inputCols=columns, outputCol="_features").transform(frame)


def _fit(frame: DataFrame, earlier: list[str], name: str) -> LogisticRegressionModel | float:
    """A model, or its constant logit where the rows hold one class or none."""
    row = frame.agg(F.count("*").alias("n"), F.avg(f"_y_{name}").alias("mean")).first()
    if not row["n"] or row["mean"] in (0.0, 1.0):
        return 500.0 if row["mean"] == 1.0 else -500.0
    learner = LogisticRegression(
        featuresCol="_features", labelCol=f"_y_{name}", rawPredictionCol="_raw", probabilityCol="_probability",
        predictionCol="_prediction", weightCol="_weight", regParam=PENALTY, elasticNetParam=L1_SHARE,
        standardization=False, maxIter=STEPS,
    )
    weight = F.when(F.col(f"_y_{name}") == 1, POSITIVE_WEIGHT).otherwise(1.0)
    return learner.fit(_assembled(frame, earlier).withColumn("_weight", weight))


def _fold_probability(frame: DataFrame, model: LogisticRegressionModel | float, earlier: list[str], name: str) -> DataFrame:
    if isinstance(model, float):
        return frame.withColumn(name, F.lit(1.0 if model > 0 else 0.0))
    scored = model.transform(_assembled(frame, earlier))
    return scored.withColumn(name, vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_prediction")


def _link(model: LogisticRegressionModel | float, vocabulary: list[str], n_earlier: int) -> Link:
    if isinstance(model, float):
        return Link({}, [0.0] * n_earlier, model)
    values = model.coefficients.toArray()
    weights = {vocabulary[k]: float(values[k]) for k in values[: len(vocabulary)].nonzero()[0]}
    return Link(weights, [float(v) for v in values[len(vocabulary):]], float(model.intercept))


def _featured(rows: DataFrame) -> DataFrame:
    """Add _tokens, the features of each text."""
    @F.pandas_udf("array<string>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: stem_features(stem for token in text_tokens(text) for stem in token_stems(token)))

    return rows.withColumn("_tokens", features("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents: features, one 0/1 column per category, fold.

    Labels of one id count together (a category holds if any says so); rows with a null id or
    category are not used.
    """
    marks = [F.max(condition.cast("double")).alias(f"_y_{name}") for name, condition in categories.items()]
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(*marks).dropna()
    chosen = stage(known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample), "op10-chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))  # at most ``sample`` rows
    return _featured(rows).select(
        "_tokens",
        *[f"_y_{name}" for name in categories],
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("_fold"),
    )


def telling_features(rows: DataFrame, names: list[str]) -> list[str]:
    """The features of the sample that tell most about each category, by the chi-square statistic.

    Ties go to the feature that sorts first. Features of under MIN_DOCUMENTS rows are not used.
    """
    sums = [F.sum(f"_y_{name}").alias(name) for name in names]
    totals = rows.agg(F.count("*").alias("n"), *sums).first()
    each = rows.select(F.explode("_tokens").alias("feature"), *[f"_y_{name}" for name in names]).groupBy("feature")
    counts = stage(each.agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= min(MIN_DOCUMENTS, totals["n"])), "op10-counts")
    found: set[str] = set()
    for name in names:
        n, positive = float(totals["n"]), float(totals[name] or 0.0)
        odd = F.col(name) * n - F.col("n") * positive
        chi = odd * odd / (F.col("n") * (n - F.col("n")) + 1)
        best = counts.select("feature", chi.alias("chi")).filter("chi > 0").orderBy(F.desc("chi"), "feature").limit(FEATURES)
        found |= {row["feature"] for row in best.collect()}
    return sorted(found)


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, sample: int = SAMPLE
) -> ToxicityChain:
    """Fit the chain.

    A category that all labelled documents share gets probability 1; one that none has, or
    without labelled documents, gets 0.
    """
    categories = categories or default_categories()
    names = list(categories)
    rows = stage(labelled_sample(docs, labels, categories, sample), "op10-sample")
    chain = ToxicityChain(names)
    vocabulary = telling_features(rows, names)
    if not vocabulary:
        means = rows.agg(*[F.avg(f"_y_{name}") for name in names]).first()
        for k, mean in enumerate(means):
            logit = -500.0 if not mean else 500.0 if mean == 1 else math.log(mean / (1 - mean))
            chain.links.append(Link({}, [0.0] * k, logit))
        return chain
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_tokens", outputCol="_words").setBinary(True)
    frame = stage(counter.transform(rows).drop("_tokens").coalesce(FOLDS * 2), "op10-features")
    for k, name in enumerate(names):
        earlier = names[:k]
        chain.links.append(_link(_fit(frame, earlier, name), vocabulary, k))
        if k + 1 < len(names):
            parts = [
                _fold_probability(frame.filter(F.col("_fold") == fold), _fit(frame.filter(F.col("_fold") != fold), earlier, name),
                                  earlier, f"p_{name}")
                for fold in range(FOLDS)
            ]
            joined = parts[0]
            for part in parts[1:]:
                joined = joined.unionByName(part)
            frame = stage(joined, "op10-folds")
    return chain


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document row with its probabilities and the decision: doc_id, p_low_quality, p_toxic, toxic."""
    chain = fit_chain(docs, labels)
    scored = docs.select("doc_id", chain.probabilities(docs.sparkSession, F.col("text")).alias("p"))
    return scored.select("doc_id", "p.*").withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with their columns. Rows are judged one by one."""
    chain = fit_chain(docs, labels)
    return docs.filter(chain.probabilities(docs.sparkSession, F.col("text"))["p_toxic"] < threshold)
