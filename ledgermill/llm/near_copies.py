"""MinHash near-dedup: BagMinHash signatures, banding, exact multiset overlap.

A document is a bag: its runs of SHINGLE words with their counts. Weights (counts) are
discretised into unit levels, grouped into octaves 1, 2-3, 4-7, ... Each (run, octave) is a
Poisson process whose rate is the octave's width; a point is marked with a level of its octave
and with a signature component, and counts only if the level is within the bag's count. The
first point of each component is its signature value, so two bags agree in a component with
probability equal to their weighted Jaccard similarity. Points are generated in order up to
the time at which all components are surely filled, about m log m for a document of any size.

Signatures are cut into bands. Documents that share a band are candidates:

1. identical bags are one class, known by a hash of the whole bag;
2. in each bucket every class is compared with the bucket's smallest, which ties large groups
   of near copies together with one comparison each;
3. then the members of a bucket that still lie in different components are compared by
   signature, in square blocks of bounded size. Pairs that may reach the threshold are verified
   in the block, and only one link per member and component leaves it. So no component stays
   apart that a link would join, and groups of copies don't become all their pairs.

Candidates are verified by the exact overlap of the bags. Components of the verified links
give the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private, stage
from .graphs import components
from .lookups import by_ids
from .word_hashes import mix, run_hashes, sliced, window_places

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
SIZE = BANDS * ROWS
# A pair is worth verifying from this share of equal components: five standard deviations of
# the estimate below SIMILARITY.
WORTH = SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SIZE)
BLOCK = 512  # classes on one side of a compared block
PAIRS = 200  # that a task verifies at once


# ---- bags and signatures -------------------------------------------------------------------------

def shingle_bags(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts' words: text number, run hash and count of each distinct run, in order.

    A text shorter than a shingle is one run of its own length; a text without words has none.
    """
    places, owner = window_places(sizes, SHINGLE)
    runs = run_hashes(hashes, SHINGLE)[places] if len(places) else np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    for length in range(1, SHINGLE):
        short = np.flatnonzero(sizes == length)
        if len(short):
            own = run_hashes(hashes, length)[begins[short]]
            runs, owner = np.concatenate([runs, own]), np.concatenate([owner, short])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.append(True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])) if len(runs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return owner[first], runs[first], np.diff(np.append(first, len(runs)))


def _processes(owner: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """One process per run and octave that its count reaches."""
    octaves = np.floor(np.log2(counts)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(runs)), octaves)
    octave = np.arange(len(element)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    seed = mix(runs[element] + (octave + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return owner[element], seed, octave, counts[element]


def bag_signatures(owner: np.ndarray, runs: np.ndarray, counts: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash of ``n`` bags: array (n, size) of first times; infinite for an empty bag."""
    first = np.full(n * size, np.inf)
    weight = np.bincount(owner, weights=counts, minlength=n)
    limit = np.where(weight > 0, size * (math.log(size) + 5) / np.maximum(weight, 1), 0.0)
    todo = _processes(owner, runs, counts)
    while len(todo[0]):
        who, seed, octave, count = todo
        time, step = np.zeros(len(who)), 0
        while len(who):
            step += 1
            draw = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            # In (0, 1], so that the logarithm is finite.
            time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (1 << octave)
            live = time < limit[who]
            who, seed, octave, count, time, draw = (x[live] for x in (who, seed, octave, count, time, draw))
            marks = mix(draw ^ np.uint64(0xA0761D6478BD642F))
            level = (1 << octave) + (marks & ((np.uint64(1) << octave.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            component = ((marks >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            counted = level <= count
            np.minimum.at(first, who[counted] * size + component[counted], time[counted])
        # A bag with a component still open is generated again, twice as far.
        open_bags = np.isinf(first.reshape(n, size)).any(axis=1) & (weight > 0)
        limit = np.where(open_bags, 2 * limit, limit)
        again = open_bags[todo[0]]
        todo = tuple(x[again] for x in todo)
    return first.reshape(n, size)


def document_signatures(docs: DataFrame) -> DataFrame:
    """Per text with words: id, bag (hash of the whole bag), n_runs, signature, bands.

    ``signature`` holds one byte of each component, ``bands`` one hash per band.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, sizes, hashes in sliced(batch.column(1)):
                owner, runs, counts = shingle_bags(sizes, hashes)
                if not len(runs):
                    continue
                used, starts = np.unique(owner, return_index=True)
                local = np.searchsorted(used, owner)
                times = bag_signatures(local, runs, counts, len(used))
                values = mix(times.view(np.uint64))
                bands = np.zeros((len(used), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands + values[:, k::ROWS]) + np.uint64(1)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                terms = mix(runs + mix(counts.astype(np.uint64)))
                bag = [f"{a:016x}{b:016x}" for a, b in zip(
                    np.add.reduceat(terms, starts), np.add.reduceat(mix(terms + np.uint64(7)), starts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(begin + used)), pa.array(bag),
                     pa.array(np.add.reduceat(counts, starts).astype(np.int64)),
                     pa.array([row.tobytes() for row in (values >> np.uint64(56)).astype(np.uint8)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * BANDS),
                                              pa.array(bands.reshape(-1).view(np.int64)))],
                    names=["id", "bag", "n_runs", "signature", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    return rows.mapInArrow(sign, "id long, bag string, n_runs long, signature binary, bands array<long>")


# ---- candidates and verification -----------------------------------------------------------------

def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough components."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
                good = pa.array((left == right).mean(axis=1) >= WORTH)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sig_a"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long").distinct()


def bag_similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts' bags; 0 when either has no words."""
    sides = []
    for texts in (a, b):
        parts = [(first, shingle_bags(sizes, hashes)) for first, sizes, hashes in sliced(texts)]
        sides.append([np.concatenate([part[0] + first if k == 0 else part[k] for first, part in parts]) for k in range(3)])
    out = np.zeros(len(a))
    cuts = [np.searchsorted(owner, np.arange(len(a) + 1)) for owner, _, _ in sides]
    for k in range(len(a)):
        (_, x, n), (_, y, m) = ([v[c[k] : c[k + 1]] for v in side] for side, c in zip(sides, cuts, strict=True))
        if len(x) and len(y):
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = np.minimum(n[i], m[j]).sum()
            out[k] = both / (n.sum() + m.sum() - both)
    return out


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of some documents: id, text."""
    texts = by_ids(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids)
    return stage(texts.filter("text is not null"), "op1-texts")


def verified_pairs(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts' bags overlap enough. Rows of one id count for it all."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Bags are several times larger than texts, so only a few pairs' are held at once.
            cuts = range(0, batch.num_rows, PAIRS)
            found = [bag_similarities(*[batch.column(c).slice(k, PAIRS) for c in (2, 3)]) for k in cuts]
            good = pa.array(np.concatenate(found) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    texts = _texts_of(stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "op1-wanted"), docs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a long, b long").distinct()


def _block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Verified links between different components inside buckets: a, b.

    ``members``: bucket, id, component, signature, block (of its bucket), blocks, text. Every
    pair of blocks of a bucket is one unit of work, so a bucket of any size is spread over
    tasks. A member gets one link to each other component that it reaches, not all of them.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = members.withColumn("other", other).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "id", "component", "signature", "block", "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            found = list(_links_of_unit(*held, key[1], key[2], similarity)) if key and len(set(held[1])) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, i, j, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (bucket, i, j) != key:
                    if held[0]:
                        yield flush()
                    key, held = (bucket, i, j), ([], [], [], [], [])
                for values, value in zip(held, member, strict=True):
                    values.append(value)
        yield flush()

    ordered = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _links_of_unit(
    ids: list[int], comps: list[int], signs: list[bytes], blocks: list[int], texts: list[str], i: int, j: int, similarity: float
) -> Iterator[tuple[int, int]]:
    comp, block = np.array(comps), np.array(blocks)
    sign = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, SIZE)
    # Members of the largest component need only be met by the others.
    values, counts = np.unique(comp, return_counts=True)
    near = {}
    for x in np.flatnonzero(comp != values[counts.argmax()]):
        facing = comp != comp[x] if i == j else (comp != comp[x]) & (block != block[x])
        facing = np.flatnonzero(facing)
        close = facing[(sign[facing] == sign[x]).mean(axis=1) >= WORTH]
        if len(close):
            near[int(x)] = close
    if not near:
        return
    # Exact overlaps, of one member with all it may link to, by an index from runs to members.
    used = np.unique(np.concatenate([list(near), *near.values()]))
    parts = [(first, shingle_bags(sizes, hashes)) for first, sizes, hashes in sliced(pa.array([texts[k] for k in used]))]
    owner = np.concatenate([part[0] + first for first, part in parts])
    runs, n = (np.concatenate([part[k] for _, part in parts]) for k in (1, 2))
    weight = np.bincount(owner, weights=n, minlength=len(used))
    begins = np.searchsorted(owner, np.arange(len(used) + 1))
    order = np.argsort(runs, kind="stable")
    by_run, by_owner, by_n = runs[order], owner[order], n[order]
    place = np.full(len(ids), -1)
    place[used] = np.arange(len(used))
    for x, close in near.items():
        own = slice(begins[place[x]], begins[place[x] + 1])
        low, high = np.searchsorted(by_run, runs[own]), np.searchsorted(by_run, runs[own], side="right")
        spread = high - low
        at = np.repeat(low - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
        overlap = np.bincount(by_owner[at], weights=np.minimum(by_n[at], np.repeat(n[own], spread)), minlength=len(used))
        facing = place[close]
        both = overlap[facing]
        linked = close[both >= similarity * (weight[place[x]] + weight[facing] - both)]
        for y in linked[np.unique(comp[linked], return_index=True)[1]]:
            yield min(ids[x], ids[y]), max(ids[x], ids[y])


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The group of every document row: doc_id, bag_id, class_id, kept.

    ``bag_id`` is the smallest id with the same bag of runs, ``class_id`` the smallest id that
    links of at least ``similarity`` lead to, and ``kept`` whether the row's id is that one.
    Null, empty and blank texts have no bag and link with nothing. A row without an id links
    with nothing, has null ids and is kept. Rows that share an id are one document that has the
    links of all of them.
    """
    signed = stage(document_signatures(docs), "op1-signatures")
    # Written before it is joined back, so that a bag of very many exact copies is split.
    bags = stage(signed.groupBy("bag", "n_runs").agg(F.min("id").alias("bag_id")), "op1-bag-ids")
    member = stage(signed.join(bags, ["bag", "n_runs"]).select("id", "bag_id").distinct(), "op1-members")
    signatures = stage(
        by_ids(signed, stage(member.select(F.col("bag_id").alias("id")).distinct(), "op1-bags"))
        .join(bags.select("bag", "n_runs", "bag_id"), ["bag", "n_runs"]).filter("id = bag_id")
        .select("id", "bag", "signature", "bands").dropDuplicates(["id", "bag"]).drop("bag"),
        "op1-classes",
    )
    # Rows of one id with different bags tie these together.
    several = member.groupBy("id").agg(F.min("bag_id").alias("a"), F.max("bag_id").alias("b")).filter("a <> b").select("a", "b")

    buckets = signatures.select("id", F.explode("bands").alias("bucket"))
    leaders = stage(
        buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "op1-leaders"
    )
    inside = stage(buckets.join(leaders, "bucket").select("bucket", "id", "leader", "n"), "op1-buckets")
    star = inside.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star_links = stage(verified_pairs(stage(_likely(star, signatures), "op1-star"), docs, similarity).unionByName(several), "op1-links")

    tied = stage(components(star_links), "op1-tied")
    placed = inside.join(tied, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"), "n"
    )
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    split = stage(
        placed.join(mixed, "bucket").select(
            "bucket", "id", "component", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), blocks.alias("blocks")
        ),
        "op1-split",
    )
    texts = _texts_of(stage(split.select("id").distinct(), "op1-wanted"), docs)
    members = split.join(signatures.select("id", "signature"), "id").join(texts, "id")
    rest = _block_links(members, similarity)
    groups = stage(components(stage(star_links.unionByName(rest), "op1-all")), "op1-groups")

    found = member.groupBy("id").agg(F.min("bag_id").alias("bag_id")).join(
        groups.select(F.col("id").alias("bag_id"), "component"), "bag_id", "left"
    ).select(F.col("id").alias("_id"), "bag_id", F.coalesce("component", "bag_id").alias("class_id"))
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("_here"))
    return rows.join(found, F.col("_here") == F.col("_id"), "left").select(
        "doc_id",
        F.coalesce("bag_id", "_here").alias("bag_id"),
        F.coalesce("class_id", "_here").alias("class_id"),
        F.coalesce(F.col("_here") == F.coalesce("class_id", "_here"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group, the one of smallest id; columns as given.

    Of rows that share a kept id, one of smallest text stays. Rows without an id all stay.
    Extra columns pass through whatever their names.
    """
    gone, twice = private(docs, "_gone", "_twice")
    groups = stage(near_duplicate_groups(docs, similarity), "op1-kept")
    dropped = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(dropped, docs["doc_id"] == F.col(gone), "left_anti")
    repeated = groups.filter("doc_id is not null and kept").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = stage(repeated.select(F.col("doc_id").alias(twice)), "op1-twice")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == F.col(twice), "left_anti")
    one = left.join(repeated, left["doc_id"] == F.col(twice), "left_semi").orderBy("text").dropDuplicates(["doc_id"])
    return once.unionByName(one)
