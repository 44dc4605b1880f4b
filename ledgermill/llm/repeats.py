"""Substring dedup: suffix automata of reference shards, documents streamed for matches.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts
earlier, in a document of smaller id or earlier in its own.

1. Exact copies are known by a hash of their text; only the first is looked at further.
2. Anchors (the smallest of the short word-run hashes inside each window) find the documents
   that may hold a repeated window: equal windows have equal anchors. Then the windows under
   repeated anchors are hashed, and each repeated window's first document is found.
3. First occurrences, joined to maximal passages, are the reference. It is dealt to shards of
   bounded size by its document, and each later span is sent to the shard of its first
   occurrence. A span's shard is thus known beforehand, and no document visits every shard.
4. A task gets one shard, builds the suffix automaton of its passages and streams the spans
   through it: where the longest match reaches WINDOW words and first ended earlier, a window
   is removed. Overlapping windows give maximal spans. The automaton compares words, so hashes
   only route. A shard with many spans is given to several tasks.

Everything between the steps is a written table in the shared folder.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced_word_count, stage
from .word_hashes import run_hashes, sliced, spaced_words, window_places

WINDOW = 20
ANCHOR = 6  # words of the runs among which a window's anchor is chosen
SHARD_WORDS = 200_000  # reference words of a shard, about
SPAN_WORDS = 800_000  # words that one task streams through a shard, about
LAST_ID = 2**63 - 1


def _order_id() -> Column:
    """The id as ordered here; null comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", _order_id().alias("_id"), F.md5(text).alias("_key"), text.alias("text")).withColumn(
        "_row", F.xxhash64("_id", "_key")
    )


# ---- anchors and windows -------------------------------------------------------------------------

def _least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the leftmost smallest of hashes[i : i + span]."""
    at, width = np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[:-step] if step else at, at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        width += step
    return at


def _anchors(sizes: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of texts hashed together: each window's place, text, anchor hash and anchor place."""
    places, owner = window_places(sizes, window)
    if not len(places):
        return places, owner, np.zeros(0, np.uint64), places
    size = min(ANCHOR, window)
    runs = run_hashes(hashes, size)
    best = _least_places(runs, window - size + 1)[places]
    return places, owner, runs[best], best


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    """One row per anchor place of each text: anchor, _row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for first, sizes, hashes in sliced(batch.column(1)):
                _, owner, anchor, best = _anchors(sizes, hashes, window)
                if len(best):
                    new = np.append(True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[new].view(np.int64)), pa.array(rows[first + owner[new]])], names=["anchor", "_row"]
                    )

    return docs.select("_row", "text").mapInArrow(find, "anchor long, _row long")


def candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """Windows whose anchor is in the document's ``_anchors``: hash, _id, _row, start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            kept = batch.column(3)
            for first, sizes, hashes in sliced(batch.column(2)):
                places, owner, anchor, _ = _anchors(sizes, hashes, window)
                if not len(places):
                    continue
                wanted = np.zeros(len(places), bool)
                edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
                for k in range(len(sizes)):
                    a, b = edges[k], edges[k + 1]
                    if b > a:
                        wanted[a:b] = np.isin(anchor[a:b].view(np.int64), kept[first + k].values.to_numpy())
                begins = np.cumsum(sizes) - sizes
                where, who = places[wanted], owner[wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hashes(hashes, window)[where].view(np.int64)), pa.array(ids[first + who]),
                     pa.array(rows[first + who]), pa.array((where - begins[who]).astype(np.int32))],
                    names=["hash", "_id", "_row", "start"],
                )

    schema = "hash long, _id long, _row long, start int"
    return docs.select("_id", "_row", "text", "_anchors").mapInArrow(find, schema)


def _starts(marks: DataFrame) -> DataFrame:
    """Window starts of one document and shard: _row, shard, starts. A document's words bound them."""
    return marks.groupBy("_row", "shard").agg(F.collect_set("start").alias("starts"))


def joined_spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Windows that touch or overlap, joined: (start, end) in words."""
    starts = np.sort(starts)
    cuts = np.flatnonzero(np.diff(starts) > 1)
    begins, ends = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)] + window
    return list(zip(begins.tolist(), ends.tolist(), strict=True))


# ---- the automaton -------------------------------------------------------------------------------

class SuffixAutomaton:
    """Suffix automaton of passages laid end to end, each behind a mark of its own.

    ``first_end`` of a state is where its strings first end. Words are numbered on the fly.
    """

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        self.last, self.size, self.marks = 0, 0, 0

    def _extend(self, token: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        state, at = len(nexts), self.last
        nexts.append({})
        link.append(0)
        length.append(length[at] + 1)
        self.first_end.append(self.size)
        while at >= 0 and token not in nexts[at]:
            nexts[at][token] = state
            at = link[at]
        if at >= 0:
            target = nexts[at][token]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                clone = len(nexts)
                nexts.append(nexts[target].copy())
                link.append(link[target])
                length.append(length[at] + 1)
                self.first_end.append(self.first_end[target])
                while at >= 0 and nexts[at].get(token) == target:
                    nexts[at][token] = clone
                    at = link[at]
                link[target] = link[state] = clone
        self.last = state
        self.size += 1

    def add(self, words: list[str]) -> int:
        """Append a passage; returns the place of its first word."""
        numbers = self.numbers
        self.marks -= 1
        self._extend(self.marks)
        begin = self.size
        for word in words:
            self._extend(numbers.setdefault(word, len(numbers)))
        return begin

    def matches(self, words: list[str], least: int) -> Iterator[tuple[int, int]]:
        """Where a run of ``least`` words ends that the passages hold: (end, first end there)."""
        nexts, link, length, first_end = self.next, self.link, self.length, self.first_end
        state = matched = 0
        for at, word in enumerate(words):
            token = self.numbers.get(word)
            if token is None:
                state = matched = 0
                continue
            while state and token not in nexts[state]:
                state = link[state]
                matched = length[state]
            if token not in nexts[state]:
                matched = 0
                continue
            state = nexts[state][token]
            matched += 1
            while length[link[state]] >= least:  # the state of the last ``least`` words
                state = link[state]
                matched = min(matched, length[state])
            if matched >= least:
                yield at, first_end[state]


def _stream_shard(reference: pa.Table, spans: pa.Table, window: int) -> pa.Table:
    """Removed spans of the documents sent to one shard."""
    order = sorted(
        zip(*[reference.column(n).to_pylist() for n in ("_id", "_row", "start", "words")], strict=True), key=lambda r: r[:3]
    )
    automaton, begins = SuffixAutomaton(), []
    for *_, words in order:
        begins.append(automaton.add(words.split(" ")))
    out = {"_id": [], "_row": [], "start": [], "end": []}
    for doc, row, begin, text in zip(*[spans.column(n).to_pylist() for n in ("_id", "_row", "start", "words")], strict=True):
        open_start = open_end = None
        for end, first_end in automaton.matches(text.split(" "), window):
            passage = bisect_right(begins, first_end) - 1
            where = order[passage]
            start = begin + end - window + 1
            earlier = (where[0], where[1], where[2] + first_end - window + 1 - begins[passage])
            if earlier >= (doc, row, start):
                continue
            if open_end is not None and start <= open_end:
                open_end = start + window
                continue
            if open_end is not None:
                for name, value in zip(out, (doc, row, open_start, open_end), strict=True):
                    out[name].append(value)
            open_start, open_end = start, start + window
        if open_end is not None:
            for name, value in zip(out, (doc, row, open_start, open_end), strict=True):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def _span_words(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """The words of each maximal span: shard, _id, _row, start, words (joined by a space), n."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"shard": [], "_id": [], "_row": [], "start": [], "words": [], "n": []}
            for k, (doc, row, text, shard) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True)):
                words = spaced_words(text)
                for a, b in joined_spans(batch.column(4)[k].values.to_numpy(), window):
                    for name, value in zip(out, (shard, doc, row, a, " ".join(words[a:b]), b - a), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("shard", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("start", pa.int32()),
                ("words", pa.string()), ("n", pa.int64())]))

    joined = docs.join(starts, "_row").select("_id", "_row", "text", "shard", "starts")
    return joined.mapInArrow(cut, "shard long, _id long, _row long, start int, words string, n long")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is repeated: (rows, texts, spans).

    ``rows``: every document row with doc_id, _id, _row, n_words, copy (an earlier document has
    exactly its text) and whole_sha256. ``texts``: the texts that may hold repeats, once each.
    ``spans``: _row and removed, an array of (start, end); rows without any are absent.
    """
    known = _identified(docs)
    narrow = known.select(
        "doc_id", "_id", "_key", "_row", spaced_word_count(F.col("text")).alias("n_words"),
        F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256).alias("whole_sha256"),
    )
    rows = stage(narrow, "op2-rows")
    firsts = rows.groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    marked = rows.join(firsts, "_key", "left").withColumn("copy", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)))
    rows = stage(marked.select("doc_id", "_id", "_row", "n_words", "whole_sha256", "copy"), "op2-marked")
    copies = rows.filter("copy").select("_row").distinct()

    anchors = document_anchors(known, window).join(copies, "_row", "left_anti")
    anchors = stage(anchors, "op2-anchors")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("_row").agg(F.collect_set("anchor").alias("_anchors"))
    texts = stage(known.join(wanted, "_row").dropDuplicates(["_row", "_id", "_key"]).select("_id", "_row", "text", "_anchors"), "op2-texts")

    windows = stage(candidate_windows(texts, window), "op2-windows")
    first = windows.groupBy("hash").agg(
        F.min(F.struct("_id", "_row", "start")).alias("first"), F.count("*").alias("_n")
    ).filter("_n > 1").select("hash", "first")
    both = windows.join(first, "hash").select(
        "_id", "_row", "start", F.col("first._row").alias("home"),
        (F.struct("_id", "_row", "start") == F.col("first")).alias("is_first"),
    )
    both = stage(both, "op2-repeats")
    reference_words = both.filter("is_first").count()
    shards = max(1, -(-reference_words // SHARD_WORDS))
    both = both.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)))
    reference = stage(_span_words(texts, _starts(both.filter("is_first")), window), "op2-reference")
    spans = stage(_span_words(texts, _starts(both.filter(~F.col("is_first"))), window), "op2-spans")

    # A shard that many spans visit is given to several tasks.
    tasks = stage(spans.groupBy("shard").agg(F.ceil(F.sum("n") / SPAN_WORDS).cast("int").alias("tasks")), "op2-tasks")
    # One partition per unit of work: the work is the automaton's, not the few bytes shuffled.
    units = max(1, tasks.agg(F.sum("tasks")).first()[0] or 0)
    sent = spans.select("shard", "_id", "_row", "start", "words").join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("_row", "start"), F.col("tasks")).cast("int")).drop("tasks")
    held = reference.select("shard", "_id", "_row", "start", "words").join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    keys = ["shard", "task"]
    sent, held = sent.repartition(units, *keys), held.repartition(units, *keys)
    removed = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        lambda left, right: _stream_shard(right, left, window), "_id long, _row long, start int, end int"
    )
    removed = removed.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    return rows, texts, stage(removed, "op2-removed")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256.

    Null texts count as empty. Documents without an id come after all others; equal ids are
    ordered by a hash of their texts, and repeated rows of one id and text are one document.
    Later exact copies of a text of at least WINDOW words lose every word.
    """
    rows, texts, spans = repeated_spans(docs, window)
    kept = kept_texts(texts, spans).select(
        F.col("_row").alias("_kept"), F.col("n_kept"), F.sha2("kept_text", 256).alias("_sha")
    )
    emptied = F.col("copy") & (F.col("n_words") >= window)
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left").select(
        "doc_id",
        "n_words",
        F.when(emptied, F.col("n_words")).when(F.col("copy"), 0)
        .otherwise(F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(emptied, F.sha2(F.lit(""), 256)).when(F.col("copy"), F.col("whole_sha256"))
        .otherwise(F.coalesce("_sha", "whole_sha256")).alias("kept_sha256"),
    )


def kept_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts that lose words: _row, n_kept, kept_text (kept words joined by a space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"_row": [], "n_kept": [], "kept_text": []}
            for row, text, removed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, kept, at = spaced_words(text), [], 0
                for span in removed:  # sorted; spans of different shards may overlap
                    kept += words[at : span["start"]]
                    at = max(at, span["end"])
                kept += words[at:]
                for name, value in zip(out, (row, len(kept), " ".join(kept)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("_row", pa.int64()), ("n_kept", pa.int64()), ("kept_text", pa.string())]))

    return texts.join(spans, "_row").select("_row", "text", "removed").mapInArrow(
        cut, "_row long, n_kept long, kept_text string"
    )
