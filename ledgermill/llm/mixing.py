"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates between 0 and MAX_COPIES that meet it,
the balanced ones stay closest to 1 in relative entropy: rate = min(MAX_COPIES, exp(tilt * size)),
with one dual variable (tilt) per source. The dual is convex in each tilt; Newton steps, kept
inside a bracket, solve it. Every step is one distributed aggregate over the (source, size)
histogram of the documents, so its input is far smaller than the corpus and no source sits in
one task. Documents of one source and size share a rate; running sums over those cells turn
rates into whole copies, and a second running sum repairs what rounding missed.

Only JVM-side DataFrame functions run here. Sources are the rows of the mix: their table holds
one row per source, and only that table is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private, spaced_word_count, stage

WEIGHTS = (5.0, 2.0, 1.0)  # fixed: repeat over the sources in code point order, null last
MAX_COPIES = 3
MAX_STEPS = 60
TOLERANCE = 1e-9  # of the target; Newton stops there
CELL_DOCS = 4096  # documents of one source and size are dealt to cells of about so many


def source_targets(histogram: DataFrame, weights=WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """Per source its size and token target.

    Targets share all tokens by weight; none exceeds ``most`` times its source's size, and what
    is above goes to the others by weight. The level at which weight x level meets the total is
    found by one running sum over the sources, ordered by the level at which each is full.

    Input and output hold source; null is a source of its own, and last. Returns source,
    source_size, weight, target. A source without tokens has target 0.
    """
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    every = Window.partitionBy(F.lit(0))
    limit = F.col("source_size") * float(most)
    filling = every.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight).select(
        "*",
        F.sum("source_size").over(every).alias("_total"),
        F.sum("weight").over(every).alias("_weights"),
        F.coalesce(F.sum(limit).over(below), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("weight").over(below), F.lit(0.0)).alias("_full_weight"),
    )
    # If the sources that fill first are full, this is the level of the others. It fits the
    # first source, in filling order, that stays below its limit.
    level = (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_full_weight"))
    fits = level * F.col("weight") <= limit
    chosen = F.min(F.when(fits, F.struct(limit / F.col("weight"), level.alias("level")))).over(every)["level"]
    target = F.when(chosen.isNull(), limit).otherwise(F.least(limit, chosen * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def size_histogram(sized: DataFrame) -> DataFrame:
    """Documents per source and size: source, size, n."""
    return sized.groupBy("source", "size").agg(F.count("*").alias("n"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    # Beyond log(most) the limit holds, so the exponent need not overflow.
    return F.exp(F.least(tilt * x, F.log(F.lit(float(most))))).cast("double")


def solve_tilts(histogram: DataFrame, targets: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """The dual variable of each source: source, source_size, target, mean_size, tilt.

    Sizes enter as multiples of the source's mean. A target at the source's limit has no finite
    solution; its tilt is null and every document gets ``most``. An empty source has tilt 0.
    """
    means = histogram.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"), F.sum("n").alias("docs")
    )
    same = F.col("s.source").eqNullSafe(F.col("m.source"))
    state = targets.alias("s").join(means.alias("m"), same).select(
        F.col("s.source"), "source_size", "target", "mean_size", "docs"
    )
    full = F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-9)
    empty = F.col("source_size") == 0
    state = state.select(
        "*",
        F.when(empty, 0.0).when(~full, 0.0).alias("tilt"),
        F.lit(-50.0).alias("low"),
        F.lit(50.0).alias("high"),
        (full | empty).alias("done"),
    )
    state = stage(state, "op3-tilts")
    for _ in range(MAX_STEPS):
        x = F.try_divide("size", "mean_size")
        rate = _rate(F.col("tilt"), x, most)
        open_rows = histogram.alias("h").join(
            state.filter(~F.col("done")).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))
        )
        sums = open_rows.groupBy(F.col("s.source").alias("source")).agg(
            F.sum(F.col("n") * rate * x).alias("got"),
            F.sum(F.when(F.col("tilt") * x < F.log(F.lit(float(most))), F.col("n") * rate * x * x).otherwise(0.0))
            .alias("slope"),
        )
        wanted = F.try_divide("target", "mean_size")
        miss = F.col("got") - wanted
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        step = F.round(F.when(inside, newton).otherwise((low + high) / 2), 13)
        near = F.abs(miss) <= F.greatest(wanted * TOLERANCE, F.lit(1e-12))
        stuck = (high - low) < 1e-12
        moved = (
            state.alias("s")
            .join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left")
            .select(
                F.col("s.source").alias("source"), "source_size", "target", "mean_size", "docs",
                F.when(F.col("done") | near | stuck, F.col("tilt")).otherwise(step).alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | near | stuck).alias("done"),
            )
        )
        state = stage(moved, "op3-tilts")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "mean_size", F.round("tilt", 12).alias("tilt"))


def _cell(n: Column, key: Column) -> Column:
    """Which cell of its source and size a document is dealt to; large groups have many."""
    return F.when(n > CELL_DOCS, F.pmod(key, F.ceil(n / CELL_DOCS))).otherwise(F.lit(0)).cast("long")


def allot_copies(cells: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Whole copies for each cell of documents that share source, size and rate.

    Running sums over the sizes of a source round the wanted copies, so that rounding moves a
    copy only to a neighbouring size. What the total then misses is made up by the smallest
    documents, one copy more or less each. Adds copies to source, size, cell, n, rate, target.
    """
    order = Window.partitionBy("source").orderBy("size", "cell")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.sum(F.round(F.col("n") * F.col("rate"), 6)).over(upto)
    whole = cells.withColumn("_sum", F.floor(F.round(wanted, 5) + 0.5))
    whole = whole.withColumn(
        "_copies", F.greatest(F.lit(0), F.least(F.col("_sum") - F.coalesce(F.lag("_sum").over(order), F.lit(0)), F.col("n") * most))
    )
    miss = F.round(F.col("target")).cast("long") - F.sum(F.col("_copies") * F.col("size")).over(Window.partitionBy("source"))
    whole = whole.withColumn("_miss", miss)
    # Each cell may give or take at most one copy per document, within 0 and the limit.
    room = F.when(
        F.col("size") == 0, F.lit(0)
    ).when(F.col("_miss") > 0, F.least(F.col("n"), F.col("n") * most - F.col("_copies"))).otherwise(F.least(F.col("n"), F.col("_copies")))
    whole = whole.withColumn("_room", room)
    before = F.coalesce(F.sum(F.col("_room") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.greatest(
        F.lit(0), F.least(F.col("_room"), F.floor((F.abs("_miss") - before) / F.greatest(F.col("size"), F.lit(1)) + 0.5))
    )
    return whole.withColumn("copies", (F.col("_copies") + F.signum("_miss") * moved).cast("long")).drop(
        "_sum", "_copies", "_miss", "_room"
    )


def mix_sources(docs: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """The copies of each document row that bring every source near its token target.

    Returns doc_id, source, size (words), source_size, target, rate, copies, taken (copies x
    size), _text_key. A null text has size 0 and is never needed for a target: it keeps rate 1.
    Which documents of a cell get the extra copy follows a hash of id and text, so reruns agree;
    repeated rows count each, and among equal rows either may get it.
    """
    key = F.xxhash64("doc_id", "text")
    sized = stage(
        docs.select("doc_id", "source", spaced_word_count(F.col("text")).alias("size"), key.alias("_text_key")), "op3-sizes"
    )
    histogram = stage(size_histogram(sized), "op3-histogram")
    targets = source_targets(histogram, most=most)
    tilts = solve_tilts(histogram, targets, most)
    rate = F.when(F.col("tilt").isNull(), float(most)).when(F.col("mean_size") == 0, 1.0).otherwise(
        _rate(F.col("tilt"), F.try_divide("size", "mean_size"), most)
    )
    same_source = F.col("h.source").eqNullSafe(F.col("t.source"))
    rated = histogram.alias("h").join(tilts.alias("t"), same_source).select(
        F.col("h.source").alias("source"), "size", F.col("n").alias("group_n"), "source_size", "target", rate.alias("rate")
    )
    same_group = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size"))
    rows = sized.alias("d").join(rated.alias("g"), same_group).select(
        "d.doc_id", "d.source", "d.size", "_text_key", "source_size", "target", "rate",
        _cell(F.col("group_n"), F.col("_text_key")).alias("cell"),
    )
    rows = stage(rows, "op3-rows")
    cells = rows.groupBy("source", "size", "cell").agg(
        F.count("*").alias("n"), F.first("rate").alias("rate"), F.first("target").alias("target")
    )
    copies = stage(allot_copies(cells, most), "op3-cells")
    same_cell = (
        F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
        & (F.col("r.cell") == F.col("c.cell"))
    )
    joined = rows.alias("r").join(copies.alias("c"), same_cell).select(
        "r.doc_id", "r.source", "r.size", "r.cell", "_text_key", "source_size", "r.target", "r.rate", "n",
        F.col("copies").alias("cell_copies"),
    )
    # The copies of a cell are dealt evenly: some documents get one more than the others.
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("_text_key", "doc_id"))
    each = F.floor(F.col("cell_copies") / F.col("n")) + F.when(
        rank <= F.col("cell_copies") % F.col("n"), 1
    ).otherwise(0)
    return joined.withColumn("copies", each.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "_text_key",
    )


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document row as often as it is taken, in the columns of ``docs``.

    Equal rows are counted together, so each stands as often as they were given copies. Extra
    columns of ``docs`` pass through whatever their names.
    """
    doc, key, copies, n, here, times, rank_, copy = private(docs, "_doc", "_key", "_copies", "_n", "_key_here", "_times", "_rank", "_copy")
    total = mixed.groupBy(F.col("doc_id").alias(doc), F.col("_text_key").alias(key)).agg(
        F.sum("copies").alias(copies), F.count("*").alias(n)
    )
    keyed = docs.withColumn(here, F.xxhash64(docs["doc_id"], docs["text"]))
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.col(here) == F.col(key))
    joined = keyed.join(total.filter(F.col(copies) > 0), same)
    rank = F.row_number().over(Window.partitionBy(doc, key).orderBy(F.lit(0)))
    # Nearly all keys hold one row; only the others are ranked.
    one = joined.filter(F.col(n) == 1).withColumn(times, F.col(copies))
    more = joined.filter(F.col(n) > 1).withColumn(rank_, rank).withColumn(
        times, F.floor(F.col(copies) / F.col(n)) + F.when(F.col(rank_) <= F.col(copies) % F.col(n), 1).otherwise(0)
    ).drop(rank_)
    both = one.unionByName(more).filter(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[docs[c] for c in docs.columns])
