"""Token ids in binary files: canonical length-limited Huffman coding in independent blocks.

Layout of a written folder:

* ``codebook`` (id, length): code lengths; canonical codes follow from them.
* ``blocks``: rows of documents in ascending doc_id order. ``part`` and ``block`` number a block,
  ``first`` is the number of ids before it in its part. ``payload`` holds the documents' bits,
  each document starting at a byte; ``checkpoints`` holds the bit offset of every LANE-th id of
  each document (little-endian unsigned 32-bit). Any block decodes alone, and all stretches
  between checkpoints decode side by side through one table.

Token counts cover all documents. The count of ids and the codebook are bounded by the
vocabulary; everything else stays in the tasks. Each step's input is a written table, so lost
executors only repeat tasks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .pieces import KEPT_PIECES, id_code, load, word_piece_encoder

CODE_LIMIT = 18  # bits; raised when the vocabulary needs more, at most MAX_LIMIT
MAX_LIMIT = 24
LANE = 128  # ids between checkpoints
BLOCK_IDS = 1_000_000
SLICE_IDS = 1_000_000  # ids that one encoding step handles at once


# ---- token ids ---------------------------------------------------------------------------------

def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, kept: int = KEPT_PIECES) -> DataFrame:
    """Ids of every whole text: doc_id, ids (little-endian unsigned numbers of 16 or 32 bits), n_tokens.

    Null and empty texts hold the end id alone. Rows are independent. ``kept`` bounds the
    store of encoded pieces, which stays with a worker.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType()),
                           T.StructField("n_tokens", T.LongType())])
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_piece_encoder(tokenizer_path, kept)
        kind = id_code(load(tokenizer_path).get_vocab_size())
        end = array(kind, [] if end_id is None else [end_id])
        width, end = end.itemsize, end.tobytes()
        for batch in batches:
            found = [ids_of(text.as_py() or "") + end for text in batch.column(1)]
            sizes = pa.array([len(ids) // width for ids in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), sizes],
                                             names=["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.dtype(f"<u{len(blob) // n}" if n else "<u2"))


def _all_numbers(blobs: pa.Array, sizes: pa.Array) -> np.ndarray:
    """The ids of all rows of a batch at once, from the binary column's data buffer.

    All rows of one run have ids of one width (the vocabulary's); null rows hold none.
    """
    n = int(pa.compute.sum(sizes).as_py() or 0)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    offsets = np.frombuffer(blobs.buffers()[1], wide)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.dtype(f"<u{len(data) // n}"))


def id_counts(encoded: DataFrame) -> DataFrame:
    """How often each id occurs in all documents: id, n. Each task adds up its own ids first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(_all_numbers(batch.column(0), batch.column(1)))
            if len(here) > len(total):
                total = np.pad(total, (0, len(here) - len(total)))
            total[: len(here)] += here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         names=["id", "n"])

    parts = encoded.select("ids", "n_tokens").mapInArrow(count, "id long, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


# ---- the code ----------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge).

    ``counts`` are positive; equal counts keep their order. One symbol gets one bit.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        merged = np.argsort(both, kind="stable")
        level = both[merged]
        leaves.append(merged < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, position), as in any canonical code."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for at in np.lexsort((np.arange(len(lengths)), lengths)):
        code <<= int(lengths[at]) - last
        last = int(lengths[at])
        codes[at] = code
        code += 1
    return codes


def build_codebook(counts: list[tuple[int, int]], limit: int = CODE_LIMIT) -> list[tuple[int, int]]:
    """(id, length) of every used id, from its global count."""
    if not counts:
        return []
    counts = sorted(counts)
    need = max(limit, (len(counts) - 1).bit_length())
    if need > MAX_LIMIT:
        raise ValueError(f"more than 2^{MAX_LIMIT} ids")
    lengths = code_lengths(np.array([n for _, n in counts]), need)
    return [(i, int(length)) for (i, _), length in zip(counts, lengths, strict=True)]


def encode_slice(ids: list[np.ndarray], code: np.ndarray, length: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Payload and checkpoints of each document; checkpoints count from its first bit."""
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    bits = length[flat].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(sizes)
    edge = np.concatenate([[0], ends])
    doc_first = edge[last - sizes]
    doc_bits = edge[last] - doc_first
    doc_bytes = (doc_bits + 7) // 8
    doc_at = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = ends - bits + np.repeat(8 * doc_at[:-1] - doc_first, sizes)
    word, shift = at >> 5, at & 31
    wide = code[flat].astype(np.uint64) << (64 - shift - bits).astype(np.uint64)
    n_words = int(doc_at[-1]) // 4 + 2
    # Bits of a word don't overlap and stay below 2^32, so adding doubles is exact.
    words = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n_words)
    words += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)[: len(words)]
    data = words.astype(">u4").tobytes()
    out = []
    for k in range(len(ids)):
        first = last[k] - sizes[k]
        marks = (at[first : last[k] : LANE] - 8 * doc_at[k]).astype("<u4")
        out.append((data[doc_at[k] : doc_at[k + 1]], marks.tobytes()))
    return out


class Decoder:
    """Table-driven decoding of whole blocks."""

    def __init__(self, codebook: list[tuple[int, int]]):
        ids = np.array([i for i, _ in codebook], np.uint32)
        lengths = np.array([n for _, n in codebook], np.int64)
        self.limit = int(lengths.max(initial=1))
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.length = np.ones(1 << self.limit, np.int64)
        order = np.lexsort((np.arange(len(ids)), lengths))
        # Canonical codes fill the table from the front, each with all its continuations.
        spans = 1 << (self.limit - lengths[order])
        self.symbol[: spans.sum()] = np.repeat(ids[order], spans)
        self.length[: spans.sum()] = np.repeat(lengths[order], spans)

    def decode(self, payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of a block. ``sizes``: ids of each document."""
        lanes = -(-sizes // LANE)
        left = np.full(lanes.sum(), LANE)
        full = sizes > 0
        left[np.cumsum(lanes)[full] - 1] = (sizes - (lanes - 1) * LANE)[full]
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, top = checkpoints.astype(np.int64), 8 * len(payload)
        out = np.empty((LANE, len(at)), np.uint32)
        cut = np.uint32(32 - self.limit)
        for k in range(int(left.max(initial=0))):
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> cut
            out[k] = self.symbol[peek]
            at = np.minimum(at + self.length[peek], top)  # past its end a lane reads on unused
        return out.T[np.arange(LANE) < left[:, None]]


# ---- files -------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _code_arrays(codebook: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    top = max((i for i, _ in codebook), default=0) + 1
    code, length = np.zeros(top, np.uint32), np.zeros(top, np.uint8)
    ids = np.array([i for i, _ in codebook], np.int64)
    lengths = np.array([n for _, n in codebook], np.int64)
    code[ids], length[ids] = canonical_codes(lengths), lengths
    return code, length


def _slices(blobs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, total = [], 0
    for blob in blobs:
        if held and total + len(blob) > SLICE_IDS:
            yield held
            held, total = [], 0
        held.append(blob)
        total += len(blob)
    if held:
        yield held


def write_token_files(encoded: DataFrame, path: str) -> None:
    """Write ids of all documents in ascending doc_id order (null first) under ``path``.

    ``encoded`` is read twice and should be a written table. Rows of equal doc_id are kept, in
    the order of their ids.
    """
    spark = encoded.sparkSession
    codebook = build_codebook([(r["id"], r["n"]) for r in id_counts(encoded).collect()])  # at most the vocabulary
    spark.createDataFrame(codebook, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(tuple(codebook))  # at most the vocabulary

    id_type = encoded.schema["doc_id"].dataType
    # Ids are put in order before they are coded: a range shuffle reads its input twice, and
    # reading is cheaper than coding. No count is given, so AQE sizes the partitions.
    ordered = encoded.select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "n_tokens", F.xxhash64("ids")
    )
    blocks = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    ])

    def code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gather_blocks(_coded(batches, *_code_arrays(shared.value)))

    ordered.mapInArrow(code_blocks, blocks).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _coded(batches: Iterator[pa.RecordBatch], code: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n_tokens")
        blobs = [_numbers(x, n) for x, n in zip(batch.column("ids").to_pylist(), sizes.to_pylist(), strict=True)]
        done = [pair for part in _slices(blobs) for pair in encode_slice(part, code, length)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes, pa.array([p for p, _ in done], pa.binary()), pa.array([c for _, c in done], pa.binary())],
            names=["doc_id", "n_tokens", "payload", "checkpoints"],
        )


def _gather_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, first = TaskContext.get().partitionId(), 0, 0
    ids, sizes, marks, payload, n_bytes = [], [], [], [], 0

    def closed(id_type) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
             pa.array([sum(sizes)], pa.int64()), pa.array([ids], pa.list_(id_type)),
             pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(marks)], pa.binary()),
             pa.array([b"".join(payload)], pa.binary())],
            names=["part", "block", "first", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "payload"],
        )

    id_type, sum_ids = None, 0
    for batch in batches:
        id_type = batch.column("doc_id").type
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "n_tokens", "payload", "checkpoints")]
        for doc, n, bits, lane_marks in zip(*columns, strict=True):
            # 32-bit bit offsets end at 512 MB, far above a block.
            if ids and sum_ids and sum_ids + n > BLOCK_IDS:
                yield closed(id_type)
                first += sum_ids
                block += 1
                ids, sizes, marks, payload, n_bytes, sum_ids = [], [], [], [], 0, 0
            ids.append(doc)
            sizes.append(n)
            sum_ids += n
            marks.append((np.frombuffer(lane_marks, "<u4") + np.uint32(8 * n_bytes)).astype("<u4").tobytes())
            payload.append(bits)
            n_bytes += len(bits)
    if ids:
        yield closed(id_type)


def part_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each part. A row per written task, so one window holds them."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).cast("long").alias("part_start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode a written folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before it; ``ids`` is an array.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    codebook = [(r["id"], r["length"]) for r in spark.read.parquet(f"{path}/codebook").orderBy("id").collect()]
    shared = spark.sparkContext.broadcast(codebook)  # at most the vocabulary
    id_type = blocks.schema["doc_ids"].dataType.elementType
    out = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes = np.array(row["doc_tokens"].as_py(), np.int64)
                marks = np.frombuffer(row["checkpoints"].as_py(), "<u4")
                ids = decoder.decode(row["payload"].as_py(), marks, sizes)
                ends = np.cumsum(sizes)
                begin = row["part_start"].as_py() + row["first"].as_py()
                own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                columns = [row["doc_ids"].values, pa.array(begin + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                           pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    starts = part_starts(blocks)
    placed = blocks.join(F.broadcast(starts), "part")  # a row per written task
    return placed.select("part_start", "first", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(decode, out)


def encode_to_files(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 1, kept: int = KEPT_PIECES
) -> None:
    """Tokenize all documents and write their ids under ``path``."""
    write_token_files(stage(token_ids(docs, tokenizer_path, end_id, kept), "op5-ids"), path)
