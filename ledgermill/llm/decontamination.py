"""Benchmark decontamination by a distributed positional inverted index.

The benchmark is the stated query set: each of its windows is a phrase to find. A first pass
over the documents counts how often each benchmark term occurs. Each window is then looked up
by its two rarest terms: their postings (term, document, position), shifted by the term's
place in the window, must meet at one start. Only windows that pass are compared word by word
with the document, so matches are exact.

Only JVM-side DataFrame functions run here. Nothing grows with the documents in one place:
postings of rare terms are small, and a frequent term's list is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_word_count, plain_words, private, settled, stage

WINDOW = 10
# Up to so many terms their list travels inside the plan; beyond it terms are joined.
INLINE_TERMS = 20_000


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them.

    An item shorter than the window is one window of its own; an item without words (null or
    empty text) has none. Items are compared as strings, so equal ids count once; a null id is
    left out of the item list but its windows still count.

    Returns gram (string, words joined by a space), words (array), items (array of strings).
    """
    split = settled(items.select(F.col("item_id").cast("string").alias("_item"), F.col("text").alias("_text")),
                    _words=plain_words(F.col("_text"))).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0)))
    grams = split.select("_item", "_words", F.explode(starts).alias("_start")).select(
        "_item", F.slice("_words", F.col("_start") + 1, window).alias("words")
    )
    return grams.groupBy(F.concat_ws(" ", "words").alias("gram"), "words").agg(
        F.collect_set("_item").alias("items")
    )


def _document_terms(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(plain_words(F.col("text"))).alias("pos", "term"))


def _only_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given distinct terms. The list goes into the plan if its size allows."""
    few = [row[0] for row in terms.limit(INLINE_TERMS + 1).collect()]
    if len(few) <= INLINE_TERMS:
        return postings.filter(F.col("term").isin(few)) if few else postings.limit(0)
    return postings.join(terms, "term", "left_semi")


def rarest_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its two rarest places: columns term_1, at_1, term_2, at_2.

    Rarity is the number of occurrences in all documents; ties go to the earlier place. A
    one-word window has the same place twice.
    """
    places = windows.select("gram", F.posexplode("words").alias("at", "term"))
    terms = stage(places.select("term").distinct(), "op9-terms")
    counts = _only_terms(_document_terms(docs), terms).groupBy("term").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "term", "left").groupBy("gram").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))), 1, 2)
        .alias("rare")
    )
    first, second = F.col("rare")[0], F.col("rare")[F.size("rare") - 1]
    return windows.join(
        ranked.select("gram", first["term"].alias("term_1"), first["at"].alias("at_1"), first["n"].alias("n_1"),
                      second["term"].alias("term_2"), second["at"].alias("at_2")),
        "gram",
    )


def term_index(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """The positional index of the windows' rarest terms: term, doc_id, pos."""
    terms = anchored.select(F.explode(F.array("term_1", "term_2")).alias("term")).distinct()
    return _only_terms(_document_terms(docs), terms).select("term", "doc_id", "pos")


def candidates(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """Places where both rare terms of a window stand as in the window: gram, doc_id, start."""

    def shifted(n: int) -> DataFrame:
        keys = anchored.select("gram", F.col(f"term_{n}").alias("term"), F.col(f"at_{n}").alias("at"))
        return (
            index.join(keys, "term")
            .select("gram", "doc_id", (F.col("pos") - F.col("at")).alias("start"))
            .filter("start >= 0")
        )

    left, right = shifted(1).alias("a"), shifted(2).alias("b")
    same = (F.col("a.gram") == F.col("b.gram")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return (
        left.join(right, same & (F.col("a.start") == F.col("b.start")))
        .select("a.gram", "a.doc_id", "a.start")
        .distinct()
    )


def proximity_matches(docs: DataFrame, items: DataFrame, distance: int = 20, window: int = WINDOW) -> DataFrame:
    """Windows whose two rarest terms stand at most ``distance`` words apart, in any order.

    One row per document and window: doc_id, gram, nearest (smallest distance in words), exact
    (the two stand just as far apart, in the same order, as in the window).
    """
    anchored = stage(rarest_terms(docs, benchmark_windows(items, window)), "op9-windows")
    index = stage(term_index(docs, anchored), "op9-index")
    # Positions are dealt to cells of the distance's width, so that only neighbours meet.
    cell = F.floor(F.col("pos") / distance)
    first = index.join(anchored.select("gram", F.col("term_1").alias("term"), "at_1"), "term").select(
        "gram", "doc_id", F.col("pos").alias("pos_1"), "at_1", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    )
    second = index.join(anchored.select("gram", F.col("term_2").alias("term"), "at_2"), "term").select(
        "gram", F.col("doc_id").alias("_doc"), F.col("pos").alias("pos_2"), "at_2", cell.alias("cell")
    )
    gap = F.col("pos_2") - F.col("pos_1")
    near = first.join(second, ["gram", "cell"]).filter(F.col("doc_id").eqNullSafe(F.col("_doc")))
    return near.filter(F.abs(gap) <= distance).groupBy("doc_id", "gram").agg(
        F.min(F.abs(gap)).cast("long").alias("nearest"),
        F.max(gap == F.col("at_2") - F.col("at_1")).alias("exact"),
    )


def _verified(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """Documents with windows that really occur: doc_id, _text_key, matches (start, length, items)."""
    per_doc = (
        found.join(windows.select("gram", "words", "items"), "gram")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "words", "items")).alias("places"))
        .withColumnRenamed("doc_id", "_doc")
    )
    rows = settled(
        docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "text", "places"),
        _words=plain_words(F.col("text")),
    )
    fits = F.filter("places", lambda p: F.slice("_words", p["start"] + 1, F.size(p["words"])) == p["words"])
    return settled(rows.select("doc_id", text_key().alias("_text_key"), "_words", "places"), matches=fits).select(
        "doc_id", "_text_key", "matches"
    ).filter(F.size("matches") > 0)


def text_key() -> Column:
    return F.xxhash64(F.col("text"), F.length("text"))


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of benchmark windows in the documents that have any.

    Returns doc_id, _text_key (of the row's text), matches (start, words, items), n_hit (words
    inside any match), item_ids (sorted strings). A repeated row appears once. Documents with a
    null id are searched like others; rows that share an id are judged by their own texts.
    """
    docs = docs.select("doc_id", "text")
    windows = stage(benchmark_windows(items, window), "op9-grams")
    anchored = stage(rarest_terms(docs, windows), "op9-windows")
    index = stage(term_index(docs, anchored), "op9-index")
    found = stage(candidates(index, anchored), "op9-candidates")
    hit = F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + F.size(m["words"]) - 1)))
    return (
        _verified(docs, found, windows)
        .dropDuplicates(["doc_id", "_text_key"])
        .select(
            "doc_id",
            "_text_key",
            "matches",
            F.size(F.array_distinct(hit)).cast("long").alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten("matches.items"))).alias("item_ids"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids, contaminated.

    Null and empty texts have no words and no hits. Other columns of the input are not read.
    """
    hits = contaminated_words(docs, items, window).select(
        F.col("doc_id").alias("_doc"), F.col("_text_key").alias("_key"), "n_hit", "item_ids"
    )
    rows = docs.select("doc_id", plain_word_count(F.col("text")).alias("n_words"), text_key().alias("_text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key"))
    return rows.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The result with item ids as their count and hash."""
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their columns, whatever their names."""
    doc, key, here = private(docs, "_doc", "_key", "_text_key")
    hits = contaminated_words(docs, items, window).select(F.col("doc_id").alias(doc), F.col("_text_key").alias(key))
    keyed = docs.withColumn(here, text_key())
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.col(here) == F.col(key))
    return keyed.join(hits, same, "left_anti").select(*docs.columns)
