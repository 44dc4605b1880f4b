"""Embedding near-dedup by an epsilon grid order join.

Vectors of cosine >= SIMILARITY are, scaled to length 1, at most EPSILON apart. They are
projected on the leading principal directions, put in the order of grid cells of that width,
and cut into blocks of consecutive vectors. Two blocks whose boxes are further apart than
EPSILON hold no link, as a projection never makes distances longer. Intervals of the sequence
are joined recursively: a pair of intervals that is near enough splits into the pairs of its
parts, down to blocks, and inside a task down to small runs of vectors, which one matrix
product compares in double precision.

Equal vectors are one class with a count. A block pair returns link counts and a spanning
forest of its links, never the links themselves, so groups of any size stay small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .graphs import components

SIMILARITY = 0.95
DIRECTIONS = 16  # principal directions that boxes are measured in
CELLS = 4  # of them, that order the sequence
BLOCK = 2048  # vectors
RUN = 256  # vectors that one matrix product takes from each side
FANOUT = 16  # parts of an interval
SLACK = 1e-6  # boxes count as near up to so much more, against rounding


def _valid(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link: vec_id, vector (doubles)."""
    doubles = F.col("embedding").cast("array<double>")
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    return vectors.select("vec_id", doubles.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(fit & nonzero, F.lit(False))
    ).dropDuplicates(["vec_id", "vector"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest part first, so squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading directions of the unit vectors of each length: {length: array (length, k)}.

    Tasks add up products of components; what reaches the driver has the square of a vector's
    length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                x = _units(_matrix(batch.column(0).filter(pa.array(sizes == dim)), dim))
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            i, j = np.divmod(np.arange(total.size), dim + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, dim)), pa.array(i), pa.array(j), pa.array(total.reshape(-1))],
                names=["dim", "i", "j", "value"],
            )

    parts = classes.select("vector").mapInArrow(moments, "dim long, i long, j long, value double")
    out: dict[int, np.ndarray] = {}
    for row in parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        out.setdefault(row["dim"], np.zeros((row["dim"] + 1, row["dim"] + 1)))[row["i"], row["j"]] = row["value"]
    for dim, total in out.items():
        mean = total[0, 1:] / total[0, 0]
        _, axes = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
        out[dim] = axes[:, ::-1][:, :DIRECTIONS]
    return out


def _spread(batch_axes: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Coordinates in the leading directions, filled up with zeros."""
    at = unit @ batch_axes
    return np.pad(at, ((0, 0), (0, DIRECTIONS - at.shape[1])))


def ordered_blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """The vectors in grid order, cut into blocks: part, number, dim, ids, counts, vectors, low, high."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)  # length of a vector x DIRECTIONS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            cells = np.zeros((len(sizes), CELLS), np.int32)
            for dim in np.unique(sizes).tolist():
                own = sizes == dim
                at = _spread(shared.value[dim], _units(_matrix(batch.column(2).filter(pa.array(own)), dim)))
                cells[own] = np.floor(at[:, :CELLS] / epsilon)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes.astype(np.int32)), *[pa.array(cells[:, k]) for k in range(CELLS)]],
                names=["id", "n", "vector", "dim", *[f"cell_{k}" for k in range(CELLS)]],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, dim = TaskContext.get().partitionId(), 0, [], None

        def block() -> pa.RecordBatch:
            x = np.array([row[2] for row in held])
            at = _spread(shared.value[dim], _units(x))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([dim], pa.int32()),
                 pa.array([np.array([row[0] for row in held], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([row[1] for row in held], np.int64).tobytes()], pa.binary()),
                 pa.array([x.tobytes()], pa.binary()),
                 pa.array([at.min(axis=0)], pa.list_(pa.float64())), pa.array([at.max(axis=0)], pa.list_(pa.float64()))],
                names=["part", "number", "dim", "ids", "counts", "vectors", "low", "high"],
            )

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                           (v.values.to_numpy(zero_copy_only=False) for v in batch.column(2)), strict=True):
                if held and (len(held) == BLOCK or len(row[2]) != dim):
                    yield block()
                    number, held = number + 1, []
                dim = len(row[2])
                held.append(row)
        if held:
            yield block()

    names = [f"cell_{k}" for k in range(CELLS)]
    placed = classes.select("id", "n", "vector").mapInArrow(
        place, "id long, n long, vector array<double>, dim int, " + ", ".join(f"{name} int" for name in names)
    )
    placed = stage(placed, "op7-cells")
    ordered = placed.repartitionByRange("dim", *names, "id").sortWithinPartitions("dim", *names, "id")
    schema = ("part int, number int, dim int, ids binary, counts binary, vectors binary, low array<double>, high array<double>")
    return ordered.select("id", "n", "vector").mapInArrow(cut, schema)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered along the sequence: block. Only counts per written task meet in one window."""
    totals = blocks.groupBy("part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return blocks.join(starts, "part").withColumn("block", (F.col("_start") + F.col("number")).cast("long")).drop("_start")


def _distance(a_low, a_high, b_low, b_high):
    """Squared distance of two boxes."""
    gaps = F.zip_with(
        F.zip_with(a_low, b_high, lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with(b_low, a_high, lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: F.greatest(x, y),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def near_block_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks (a <= b) that may hold links, by recursive joins of sequence intervals.

    ``boxes``: block (0, 1, ...), low, high. An interval of a level holds FANOUT of the next.
    """
    n = boxes.count()
    heights = max(1, math.ceil(math.log(max(n, 2), FANOUT) - 1e-9))

    def bound(name: str, pick):
        return F.array(*[pick(F.col(name)[k]) for k in range(DIRECTIONS)]).alias(name)

    def level(height: int) -> DataFrame:
        size = FANOUT**height
        node = F.floor(F.col("block") / size).cast("long").alias("node")
        return boxes.groupBy(node).agg(bound("low", F.min), bound("high", F.max)).withColumn(
            "parent", F.floor(F.col("node") / FANOUT).cast("long")
        )

    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for height in reversed(range(heights)):
        nodes = stage(level(height), "op7-intervals")
        left = nodes.select(F.col("parent").alias("a"), F.col("node").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
        right = nodes.select(F.col("parent").alias("b"), F.col("node").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
        near = _distance(F.col("x_low"), F.col("x_high"), F.col("y_low"), F.col("y_high")) <= (epsilon + SLACK) ** 2
        pairs = stage(
            pairs.join(left, "a").join(right, "b").filter(F.col("x") <= F.col("y")).filter(near)
            .select(F.col("x").alias("a"), F.col("y").alias("b")),
            "op7-pairs",
        )
    return pairs


# ---- inside a pair of blocks ---------------------------------------------------------------------

def _linked(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, similarity: float, epsilon: float,
            same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of linked unit vectors; runs too far apart are skipped."""
    def boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = range(0, len(at), RUN)
        return np.array([at[k : k + RUN].min(axis=0) for k in cuts]), np.array([at[k : k + RUN].max(axis=0) for k in cuts])

    (x_low, x_high), (y_low, y_high) = boxes(x_at), boxes(y_at)
    for i in range(len(x_low)):
        gap = np.maximum(0, np.maximum(x_low[i] - y_high, y_low - x_high[i]))
        for j in np.flatnonzero((gap * gap).sum(axis=1) <= (epsilon + SLACK) ** 2):
            if same and j < i:
                continue
            product = x[i * RUN : (i + 1) * RUN] @ y[j * RUN : (j + 1) * RUN].T
            u, v = np.nonzero(product >= similarity)
            u, v = u + i * RUN, v + j * RUN
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u, v


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest place that each place is linked to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(pairs: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], similarity: float, epsilon: float) -> DataFrame:
    """Per pair of blocks: link counts (a, n) and forest edges (a, b)."""
    shared = blocks.sparkSession.sparkContext.broadcast(axes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["dim_a"] != row["dim_b"]:
                    continue
                dim, same = row["dim_a"], row["a"] == row["b"]
                ids, counts, units = {}, {}, {}
                for side in "ab":
                    ids[side] = np.frombuffer(row[f"ids_{side}"], np.int64)
                    counts[side] = np.frombuffer(row[f"counts_{side}"], np.int64)
                    units[side] = _units(np.frombuffer(row[f"vectors_{side}"], np.float64).reshape(-1, dim))
                at = {side: _spread(shared.value[dim], units[side]) for side in "ab"}
                n_a, n = len(ids["a"]), len(ids["a"]) + (0 if same else len(ids["b"]))
                shift = 0 if same else n_a
                links, root = np.zeros(n, np.int64), np.arange(n)
                for u, v in _linked(units["a"], units["b"], at["a"], at["b"], similarity, epsilon, same):
                    links += np.bincount(u, weights=counts["b"][v], minlength=n).astype(np.int64)
                    links += np.bincount(v + shift, weights=counts["a"][u], minlength=n).astype(np.int64)
                    # Earlier runs' links are kept as one edge per vector.
                    root = _forest(n, np.concatenate([u, np.arange(n)]), np.concatenate([v + shift, root]))
                every = ids["a"] if same else np.concatenate([ids["a"], ids["b"]])
                seen, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([every[seen], every[tied]])),
                     pa.array([None] * len(seen) + every[root[tied]].tolist(), pa.int64()),
                     pa.array(links[seen].tolist() + [0] * len(tied), pa.int64())],
                    names=["a", "b", "n"],
                )

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("dim", "ids", "counts", "vectors")])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(compare, "a long, b long, n long")


def link_embeddings(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, as
    do vectors of different lengths and rows without an id (their component is null; they are
    kept). Repeated rows of one id and vector are one vector; rows of one id with different
    vectors are one vector with the links of both.
    """
    epsilon = math.sqrt(2 - 2 * similarity)
    valid = stage(_valid(vectors), "op7-valid")
    grouped = valid.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = stage(grouped, "op7-classes")
    member = stage(valid.join(classes, "vector").select("vec_id", "id", "n"), "op7-members")
    axes = principal_directions(classes)
    blocks = stage(_numbered(stage(ordered_blocks(classes, axes, epsilon), "op7-sequence")), "op7-blocks")
    pairs = near_block_pairs(blocks.select("block", "low", "high"), epsilon)
    found = stage(block_links(pairs, blocks, axes, similarity, epsilon), "op7-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("outside"))
    edges = found.filter("b is not null").select("a", "b").unionByName(
        member.select(F.col("vec_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
    )
    groups = stage(components(edges), "op7-groups")
    per_class = member.join(counts, "id", "left").select(
        "vec_id", (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    found_rows = per_class.groupBy("vec_id").agg(F.sum("links").alias("links")).join(
        groups.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left"
    ).withColumnRenamed("vec_id", "_id")
    rows = vectors.select("vec_id").join(found_rows, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
