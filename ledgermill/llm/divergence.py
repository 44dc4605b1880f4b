"""Source divergence audit by Gustavson row accumulation.

Every (lang, source) group of documents is a row of a sparse matrix over the lang's kept terms;
its entries are smoothed integer rates p. The pair part compares every two sources of a lang by
the sum over all kept terms of |p_a - p_b|, the term part lists the terms a source uses more
than its lang.

A pair's sum runs over all kept terms, most of which a group never uses; their p is the group's
baseline. The sum is split so that only used terms are visited:

    value(a, b) = R_a[b] + C_b[a] + (V - |T_b|) * |base_a - base_b|
    R_a[b] = sum over t in T_a of |p_a(t) - P_t[b]| - |base_a - P_t[b]|
    C_b[x] = sum over t in T_b of |base_x - p_b(t)|

with T_g the terms group g uses and P_t[b] the term-major index row of t: p_b(t), or base_b
where b does not use t. Each group scatters its terms through that index into a dense
accumulator over its lang's peers (R), and into one over the peers' baselines (C), the
correction for the zero entries. No pair of postings is ever a row: the scatter runs in numpy
inside tasks, over the rows Spark has already dealt by term, and only per-task accumulators,
one value a group and peer, are summed by a shuffle.

Counting is one pass: each document's words, sorted, are exploded with their place, a word
unlike the one before it is a first occurrence, and one aggregate by (lang, source, term), combined before the shuffle, gives
occurrences and documents. All arithmetic is on integers (decimal(38,0) for p).
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

MIN_DOCUMENTS = 30  # a lang keeps the terms in at least so many of its documents
TOP_TERMS = 50  # ranks of the term part
SCALE = 1_000_000_000  # fixed: p = 1 + floor(SCALE * (count + 5) / (N + 5 V))
SMOOTHING = 5  # fixed
# Scattered cells (rows x peers) of one numpy step; bounds a task's memory, not its work.
SCATTER_CELLS = 1 << 22

# Fixed: a term is a run of characters outside \x00-\x40, \x5B-\x60, \x7B-\x7F; only A-Z are
# lower-cased. Every other ASCII character becomes a space, and splitting at one space needs no
# regular expression.
NOT_TERM = "".join(chr(c) for c in range(128) if not chr(c).isalpha())


def terms(text):
    """The terms of a text in order; null has none."""
    plain = F.translate(
        F.coalesce(text, F.lit("")),
        NOT_TERM + string.ascii_uppercase,
        " " * len(NOT_TERM) + string.ascii_lowercase,
    )
    return F.array_remove(F.split(plain, " "), "")


def _p(count: str, total: str, vocabulary: str):
    """1 + floor(SCALE * (count + 5) / (total + 5 V)) by exact integral division; null where V is 0."""
    return F.expr(
        f"case when {vocabulary} > 0 then 1 + (cast({count} + {SMOOTHING} as decimal(38,0)) * {SCALE})"
        f" div cast({total} + {SMOOTHING} * {vocabulary} as decimal(38,0)) end"
    )


def group_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents with it), written once.

    Groups whose documents have no terms keep one row with a null term, so that every
    occurring group is known from this table.
    """
    words = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.sort_array(terms(F.col("text"))).alias("_w"),
    )
    cells = words.select("lang", "source", "_w", F.posexplode_outer("_w").alias("_at", "term"))
    before = F.try_element_at("_w", F.when(F.col("_at") > 0, F.col("_at").cast("int")))
    first = F.col("term").isNotNull() & (before.isNull() | (before != F.col("term")))
    counted = cells.groupBy("lang", "source", "term").agg(F.count("term").alias("count"), F.count_if(first).alias("docs"))
    return stage(counted, "divergence-terms")


def _scatter(batches):
    """Gustavson's row accumulation of the rows of one task, one numpy step per lang and chunk.

    In: lang, g (peer index of the group), p, base, post_peer, post_p (the term's postings),
    bases (of all peers of the lang, by peer index). Out: lang, g, b, r, c, the task's partial
    sums of R_g[b] and C_g[b]. A lang's accumulators are dense, peers x peers.
    """
    sums: dict = {}
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        g, p, base = (batch.column(k).to_numpy() for k in ("g", "p", "base"))
        post_peer, post_p, bases = (batch.column(k) for k in ("post_peer", "post_p", "bases"))
        for lang in np.unique(langs):
            rows = np.flatnonzero(langs == lang)
            peers = np.asarray(bases[int(rows[0])].values, dtype=np.int64)
            width = len(peers)
            if lang not in sums:
                sums[lang] = (np.zeros((width, width), np.int64), np.zeros((width, width), np.int64))
            r_acc, c_acc = sums[lang]
            for start in range(0, len(rows), max(1, SCATTER_CELLS // max(width, 1))):
                part = rows[start : start + max(1, SCATTER_CELLS // max(width, 1))]
                row = np.tile(peers, (len(part), 1))
                sizes = [len(post_peer[int(k)]) for k in part]
                into = np.repeat(np.arange(len(part)), sizes)
                at = np.concatenate([np.asarray(post_peer[int(k)].values, dtype=np.int64) for k in part])
                row[into, at] = np.concatenate([np.asarray(post_p[int(k)].values, dtype=np.int64) for k in part])
                np.add.at(r_acc, g[part], np.abs(p[part, None] - row) - np.abs(base[part, None] - row))
                np.add.at(c_acc, g[part], np.abs(peers[None, :] - p[part, None]))
    for lang, (r_acc, c_acc) in sums.items():
        width = len(r_acc)
        touched = np.flatnonzero(r_acc.any(axis=1) | c_acc.any(axis=1))
        if len(touched):
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [lang] * (len(touched) * width),
                    "g": np.repeat(touched, width).astype(np.int32),
                    "b": np.tile(np.arange(width), len(touched)).astype(np.int32),
                    "r": r_acc[touched].ravel(),
                    "c": c_acc[touched].ravel(),
                },
                schema=SCATTERED,
            )


SCATTERED = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("b", pa.int32()), ("r", pa.int64()), ("c", pa.int64())])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Divergence of every source from the other sources of its lang, and from the lang.

    Input: documents with text, lang and source (more columns are ignored, whatever their names);
    null text, lang or source read as ''. Each row is a document, repeated rows count twice.
    Terms are runs of characters outside \\x00-\\x40, \\x5B-\\x60, \\x7B-\\x7F, A-Z lower-cased.
    A lang keeps the V terms that stand in at least ``min_documents`` of its documents. For
    every occurring group (lang, source), including groups without terms, and for each lang,
    every kept term has a count >= 0 and p = 1 + floor(1e9 (count + 5) / (N + 5 V)), N the sum
    of the counts over kept terms.

    Returns lang, source, part, item, value long, rank int:
    - part 'pair': item is every other source of the lang; value the sum over kept terms of
      |p - q|, q the other source's p (0 when V = 0); all ranks.
    - part 'term': item is every kept term the group uses whose p exceeds the lang's p (q);
      value p - q; ranks 1 to ``top_terms``.
    Ranks count from 1 within (lang, source, part), value descending, then item ascending by
    UTF-8 bytes. An empty table gives no rows; a lang with one source has no pair rows.
    """
    counted = group_terms(docs)
    groups = counted.select("lang", "source").distinct()
    occurring = counted.filter(F.col("term").isNotNull())
    lang_terms = occurring.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lcount"))
    kept = stage(lang_terms.filter(F.col("docs") >= min_documents).select("lang", "term", "lcount"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("lcount").alias("lang_n"))

    peers = Window.partitionBy("lang").orderBy("source")
    used = occurring.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "count")
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("N"), F.count("*").alias("n_terms"))
    group_table = (
        groups.join(totals, ["lang", "source"], "left")
        .join(langs.select("lang", "V"), "lang", "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(peers) - 1).cast("int").alias("g"),
            F.coalesce("N", F.lit(0)).alias("N"),
            F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
            F.coalesce("V", F.lit(0)).alias("V"),
        )
        .withColumn("base", F.coalesce(_p("0", "N", "V"), F.lit(0)))
    )
    group_table = stage(group_table, "divergence-groups")

    entries = stage(
        used.join(group_table, ["lang", "source"]).select(
            "lang", "term", "g", _p("count", "N", "V").alias("p"), "base"
        ),
        "divergence-entries",
    )

    # Term part: a group's p against its lang's p.
    lang_p = kept.join(langs, "lang").select("lang", "term", _p("lcount", "lang_n", "V").alias("q"))
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    term_rows = (
        entries.join(lang_p, ["lang", "term"])
        .filter(F.col("p") > F.col("q"))
        .join(group_table.select("lang", "g", "source"), ["lang", "g"])
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_group))
        .filter(F.col("rank") <= top_terms)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    )

    # Pair part: the term-major index, then the scatter into per-peer accumulators.
    index = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p"))).alias("_post"))
    bases = group_table.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("g", "base"))).alias("_bases"))
    scatter_in = (
        entries.join(index, ["lang", "term"])
        .join(bases, "lang")
        .select(
            "lang", "g", "p", "base",
            F.col("_post.g").alias("post_peer"),
            F.col("_post.p").alias("post_p"),
            F.col("_bases.base").alias("bases"),
        )
    )
    scattered = scatter_in.mapInArrow(_scatter, "lang string, g int, b int, r long, c long").groupBy("lang", "g", "b").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c")
    )
    scattered = stage(scattered, "divergence-accumulators")

    a = group_table.select("lang", F.col("source").alias("source"), F.col("g").alias("ga"), F.col("base").alias("base_a"))
    b = group_table.select(
        "lang", F.col("source").alias("item"), F.col("g").alias("gb"), F.col("base").alias("base_b"),
        F.col("n_terms").alias("terms_b"), "V",
    )
    rows_r = scattered.select("lang", F.col("g").alias("ga"), F.col("b").alias("gb"), F.col("r"))
    rows_c = scattered.select("lang", F.col("g").alias("gb"), F.col("b").alias("ga"), F.col("c"))
    value = (
        F.coalesce("r", F.lit(0)) + F.coalesce("c", F.lit(0))
        + (F.col("V") - F.col("terms_b")) * F.abs(F.col("base_a") - F.col("base_b"))
    )
    by_source = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pair_rows = (
        a.join(b, "lang")
        .filter(F.col("ga") != F.col("gb"))
        .join(rows_r, ["lang", "ga", "gb"], "left")
        .join(rows_c, ["lang", "ga", "gb"], "left")
        .select("lang", "source", "item", value.cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(by_source).cast("int"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )
    return pair_rows.unionByName(term_rows)
