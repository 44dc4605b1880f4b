"""Hard-negative mining by segment summary filtering.

Each vector is cut into segments of its dimensions, and every segment keeps its mean and its
deviation. For one segment of length L, sum a_i x_i = L (mu_a mu_x + cov), and by Cauchy-Schwarz
|cov| <= sd_a sd_x, so the means' product plus or minus the deviations' product bounds the
segment's share of the score; summed over segments it bounds the score. The bounds are refined
hierarchically (LEVELS: 1, then 4, then 16 segments): a pair whose upper bound falls below what
other rows already guarantee (their lower bounds) is dropped at the coarsest level that shows
it, and only the pairs left are scored exactly, with integers. The bounds of a chunk of queries
against a block of rows are matrix products of the summaries, and the exact scores one product
over the rows that still have a pair.

The anchors (every vec_id divisible by 100) are the stated query set; they meet all rows in
blocks. Rows are dealt into row blocks of about ROW_BLOCK rows and anchors into anchor blocks
of about ANCHOR_BLOCK; each pair of blocks is one group of a cogroup, so no task holds more
than one block of each, and each group returns at most the first few rows of each of its
anchors. A window over those few rows an anchor keeps the first ones overall. Positives are
found in one pass over the rows and negatives, in the windows of the positives' scores, in a
second. Work inside a group runs in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

POSITIVES = 5  # fixed: an anchor's first so many other rows of its label
NEGATIVES = 5  # fixed: a positive's first so many different-label rows in its window
LOW, HIGH = 80, 100  # fixed: LOW * positive_score <= HIGH * negative_score <= HIGH * positive_score
SCALE = 256  # fixed: components become floor(SCALE * x)
ANCHOR_EVERY = 100  # fixed: anchors are rows whose vec_id is divisible by it
RELABEL_EVERY = 7  # fixed: where vec_id is divisible by it, label becomes (label + 1) % 10
LEVELS = (1, 4, 16)  # segments of the summaries, coarse to fine
ROW_BLOCK = 8192  # rows of a block
ANCHOR_BLOCK = 256  # anchors of a block
CHUNK = 64  # queries scored at once inside a block: bounds a task's matrices to CHUNK x ROW_BLOCK
SAFETY = 1e-9  # relative slack of the bounds computed in double precision
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor_id long, akey long, k int, vec_id long, score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v (integer components) of every row that takes part.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    Rows equal in vec_id, label and integer vector count once.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (
        embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.cast("long").alias("label"),
            F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"),
        )
        .dropDuplicates(["vec_id", "label", "v"])
    )


def _matrix(vectors) -> np.ndarray:
    """Vectors of a group as one integer matrix, shorter ones padded with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def summaries(X: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each vector's segments, and the segments' lengths."""
    parts = [p for p in np.array_split(np.arange(X.shape[1]), segments) if len(p)]
    lengths = np.array([len(p) for p in parts], float)
    mean = np.stack([X[:, p].mean(1) for p in parts], 1) if parts else np.zeros((len(X), 0))
    dev = np.stack([X[:, p].std(1) for p in parts], 1) if parts else np.zeros((len(X), 0))
    return mean, dev, lengths


class _Bounds:
    """Score bounds of all anchor-row pairs of a chunk at each level of segments, as matrices."""

    def __init__(self, A: np.ndarray, X: np.ndarray):
        width = max(A.shape[1], X.shape[1])
        self.A = np.pad(A, ((0, 0), (0, width - A.shape[1])))
        self.X = np.pad(X, ((0, 0), (0, width - X.shape[1])))
        self.levels = [(summaries(self.A, s), summaries(self.X, s)) for s in LEVELS]

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every pair (anchors x rows) at level k."""
        (ma, sa, length), (mx, sx, _) = self.levels[k]
        centre, spread = (ma * length) @ mx.T, (sa * length) @ sx.T
        margin = (np.abs(centre) + spread) * SAFETY + 1.0
        return centre - spread - margin, centre + spread + margin

    def exact(self, alive: np.ndarray) -> np.ndarray:
        """Exact scores of the pairs alive (others 0); only rows with a live pair are scored.

        Products in double precision are exact while |score| < 2^53 (64 components of at most
        2^20 in size each); past that the integers are multiplied as integers.
        """
        columns = np.flatnonzero(alive.any(0))
        scores = np.zeros(alive.shape, np.int64)
        if len(columns):
            big = max(int(np.abs(self.A).max(initial=0)), 1) * max(int(np.abs(self.X[columns]).max(initial=0)), 1)
            if big * self.A.shape[1] < 2**53:
                part = np.rint(self.A.astype(np.float64) @ self.X[columns].T.astype(np.float64)).astype(np.int64)
            else:
                part = self.A @ self.X[columns].T
            scores[:, columns] = part
        return scores


def _kth(values: np.ndarray, eligible: np.ndarray, k: int) -> np.ndarray:
    """Per row of values, the k-th largest eligible value; -inf where fewer are eligible."""
    masked = np.where(eligible, values, -np.inf)
    if masked.shape[1] < k:
        return np.full(len(masked), -np.inf)
    return -np.partition(-masked, k - 1, axis=1)[:, k - 1]


def _first(anchor: np.ndarray, score: np.ndarray, vec: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k pairs of each anchor: score descending, vec_id ascending, null last."""
    order = np.lexsort((vec, null, -score, anchor))
    anchor = anchor[order]
    starts = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def _chunked(find):
    """Runs ``find`` on the queries of a block CHUNK at a time, with the block's rows made once."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame, chunk: int = CHUNK) -> pd.DataFrame:
        if rows.empty or anchors.empty:
            return pd.DataFrame({c: [] for c in ("anchor_id", "akey", "k", "vec_id", "score")})
        X = _matrix(rows["v"])
        parts = [find(rows, X, anchors.iloc[k : k + chunk].reset_index(drop=True)) for k in range(0, len(anchors), chunk)]
        return pd.concat(parts, ignore_index=True)

    return run


@_chunked
def _positives(rows: pd.DataFrame, X: np.ndarray, anchors: pd.DataFrame) -> pd.DataFrame:
    """First POSITIVES rows of each anchor in this block: same label, another (non-null) vec_id.

    At each level the POSITIVES-th largest lower bound of an anchor's pairs is a score that
    many rows surely reach; pairs whose upper bound stays below it go.
    """
    bounds = _Bounds(_matrix(anchors["v"]), X)
    ids = rows["vid"].to_numpy(np.int64)
    other = ~rows["nid"].to_numpy(bool)[None, :] & (ids[None, :] != anchors["anchor_id"].to_numpy(np.int64)[:, None])
    alive = other & (rows["label"].to_numpy()[None, :] == anchors["a_label"].to_numpy()[:, None])
    tau = np.full(len(anchors), -np.inf)
    for level in range(len(LEVELS)):
        lb, ub = bounds.level(level)
        tau = np.maximum(tau, _kth(lb, alive, POSITIVES))
        alive &= ub >= tau[:, None]
    score = bounds.exact(alive)
    a, x = np.nonzero(alive)
    pick = _first(a, score[a, x], ids[x], np.zeros(len(a), bool), POSITIVES)
    return pd.DataFrame({
        "anchor_id": anchors["anchor_id"].to_numpy()[a[pick]], "akey": anchors["akey"].to_numpy()[a[pick]],
        "k": np.zeros(len(pick), np.int32), "vec_id": ids[x[pick]], "score": score[a[pick], x[pick]],
    })


@_chunked
def _negatives(rows: pd.DataFrame, X: np.ndarray, anchors: pd.DataFrame) -> pd.DataFrame:
    """First NEGATIVES rows of each anchor's positive in this block: another label, in its window.

    anchors has one row per (anchor, positive k) with its score ps. A pair stays while its
    bounds meet the window [LOW/HIGH ps, ps] and its upper bound reaches the NEGATIVES-th
    largest lower bound of pairs surely inside the window.
    """
    bounds = _Bounds(_matrix(anchors["v"]), X)
    ps = anchors["ps"].to_numpy(np.int64)
    low, high = (ps * (LOW / HIGH))[:, None], ps.astype(float)[:, None]
    alive = (rows["label"].to_numpy()[None, :] != anchors["a_label"].to_numpy()[:, None]) & (ps[:, None] >= 0)
    tau = np.full(len(anchors), -np.inf)
    for level in range(len(LEVELS)):
        lb, ub = bounds.level(level)
        alive &= (ub >= low) & (lb <= high)
        tau = np.maximum(tau, _kth(lb, alive & (lb >= low) & (ub <= high), NEGATIVES))
        alive &= ub >= tau[:, None]
    score = bounds.exact(alive)
    alive &= (LOW * ps[:, None] <= HIGH * score) & (score <= ps[:, None])
    a, x = np.nonzero(alive)
    vec, null = rows["vid"].to_numpy(np.int64)[x], rows["nid"].to_numpy(bool)[x]
    pick = _first(a, score[a, x], vec, null, NEGATIVES)
    return pd.DataFrame({
        "anchor_id": anchors["anchor_id"].to_numpy()[a[pick]], "akey": anchors["akey"].to_numpy()[a[pick]],
        "k": anchors["k"].to_numpy()[a[pick]],
        "vec_id": pd.array([None if n else int(v) for v, n in zip(vec[pick], null[pick])], dtype="Int64"),
        "score": score[a[pick], x[pick]],
    })


def _blocks(df: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
    """Deals rows into blocks of about ``size`` by a hash of all their columns."""
    blocks = max(1, math.ceil(df.count() / size))
    return df.withColumn(label, F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")), blocks


def _meet(rows: DataFrame, anchors: DataFrame, find, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every anchor block against every row block: each row goes to all anchor blocks, each anchor
    to all row blocks, and each (anchor block, row block) is one group."""
    spread_rows = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    spread_anchors = anchors.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    chunk = CHUNK
    return (
        spread_rows.groupBy("ab", "rb")
        .cogroup(spread_anchors.groupBy("ab", "rb"))
        .applyInPandas(lambda r, a: find(r, a, chunk), FOUND)
    )


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of every anchor and positive.

    Input: vec_id, embedding (array of numbers), label; more columns are ignored, whatever their
    names. Rows with a null label, a null vector, or a null or non-finite component take no part;
    an empty vector does and scores 0. Where vec_id is divisible by 7, label first becomes
    (label + 1) % 10. Components become floor(256 x), x as double; a row's score is its integer
    inner product with the anchor (shorter vectors padded with zeros). Higher scores come first,
    ties by smaller vec_id, null last. Anchors are rows whose vec_id is divisible by 100; an
    anchor's positives are its first 5 rows of the same label and another, non-null vec_id (all,
    if fewer). For each anchor and positive the first 5 rows of another label with
    80 ps <= 100 ns <= 100 ps (all, if fewer; none if ps < 0).

    Returns anchor_id, positive_id, rank (from 1 among those returned), negative_id,
    positive_score, negative_score. Rows equal in vec_id, label and integer vector count once;
    two distinct anchor rows of one vec_id each give their own rows. Empty input: no rows.
    """
    spark = embeddings.sparkSession
    rows = stage(prepared(embeddings), "negatives-rows")
    rows = rows.select("*", F.coalesce("vec_id", F.lit(0)).alias("vid"), F.col("vec_id").isNull().alias("nid"))
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), "v", F.xxhash64("label", "v").alias("akey")
    )
    anchors, anchor_blocks = _blocks(stage(anchors, "negatives-anchors"), ANCHOR_BLOCK, "ab")
    if anchors.isEmpty():
        return spark.createDataFrame([], RESULT)
    rows, row_blocks = _blocks(rows, ROW_BLOCK, "rb")
    who = ["anchor_id", "akey"]

    found = _meet(rows, anchors, _positives, row_blocks, anchor_blocks)
    best = Window.partitionBy(*who).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    chosen = stage(
        found.withColumn("k", F.row_number().over(best).cast("int")).filter(F.col("k") <= positives)
        .select(*who, "k", F.col("vec_id").alias("positive_id"), F.col("score").alias("ps")),
        "negatives-positives",
    )

    queries = anchors.join(chosen, who)
    found = _meet(rows, queries, _negatives, row_blocks, anchor_blocks)
    ranked = Window.partitionBy(*who, "k").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .filter(F.col("rank") <= negatives)
        .join(chosen, [*who, "k"])
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )
