"""Token files, token counts and the source mix: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from ledgermill.llm import mixing, token_counts, token_files
from ledgermill.llm.pieces import Kept, load, word_piece_encoder
from ledgermill.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

from .conftest import spaced

ODD = "aB'é.,<|>́ \n\tΣςİıſ①٣한3.!_-—“”  \x85\x1c$&'s't'll𝒜ǅ😀"


# ---- pieces and files ----------------------------------------------------------------------------

def test_pieces_encode_like_the_library():
    path = tokenizer_path(WORD_TOKENIZER)
    tokenizer, ids_of = load(path), word_piece_encoder(path)
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) + ("<|endoftext|>" if rng.random() < 0.05 else "")
        assert np.frombuffer(ids_of(text), np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_kept_values_stay_bounded():
    kept = Kept(len, size=10)
    for k in range(1000):
        assert kept["x" * (k % 37)] == k % 37
        assert len(kept) <= 10


@pytest.mark.parametrize("limit", [6, 9, 16])
def test_code_lengths(limit):
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(1, 10**6, 50) ** 2)
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1
    codes = sorted(f"{c:0{n}b}" for c, n in zip(token_files.canonical_codes(lengths).tolist(), lengths.tolist(), strict=True))
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    if limit == 16:  # no shorter than entropy, within a bit of it
        p = counts / counts.sum()
        assert -(p * np.log2(p)).sum() <= (p * lengths).sum() < -(p * np.log2(p)).sum() + 1


def test_decoding_blocks():
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, n).clip(0, 3000).astype(np.uint16) for n in (1, 0, 127, 128, 129, 5000, 3)]
    values, counts = np.unique(np.concatenate(docs), return_counts=True)
    book = token_files.build_codebook(list(zip(values.tolist(), counts.tolist(), strict=True)), 14)
    code, length = token_files._code_arrays(tuple(book))
    parts, at, marks, payload = token_files.encode_slice(docs, code, length), 0, [], b""
    for bits, lane in parts:
        marks.append(np.frombuffer(lane, "<u4") + 8 * len(payload))
        payload += bits
    out = token_files.Decoder(book).decode(payload, np.concatenate(marks), np.array([len(d) for d in docs]))
    assert out.tolist() == np.concatenate(docs).tolist()
    assert token_files.build_codebook([]) == [] and token_files.build_codebook([(7, 3)]) == [(7, 1)]


def test_token_files(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    rng = random.Random(6)
    rows = [(rng.randint(-50, 10**9), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 200)))) for _ in range(60)]
    rows += [(5, None), (6, ""), (7, "word " * 3000), (8, "same"), (8, "same"), (None, "no id")]
    path = tokenizer_path(WORD_TOKENIZER)
    token_files.encode_to_files(documents(rows), path, str(tmp_path / "ids"))
    got = token_files.read_token_files(spark, str(tmp_path / "ids")).orderBy("start").collect()
    tokenizer, at = load(path), 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    for row, (doc, text) in zip(got, rows, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc, at, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_nothing(spark, documents, tmp_path):
    token_files.encode_to_files(documents([]), tokenizer_path(WORD_TOKENIZER), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


# ---- counts --------------------------------------------------------------------------------------

def test_trees_follow_edits():
    path = tokenizer_path(BYTE_TOKENIZER)
    tokenizer, count = load(path), token_counts.piece_counter(path)
    tokenizer.encode_special_tokens = True
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    rng = random.Random(7)
    signs = "ab'sl re  \n\t1.é!ö ll've<|endoftext|>"
    for n in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 2000 if n % 50 == 0 else 25)))
        tree = token_counts.TokenTree(text, count)
        assert tree.n_tokens == size(text)
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            new = "".join(rng.choice(signs) for _ in range(rng.randint(0, 5))) * (300 if n % 100 == 0 else 1)
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, size(text), len(text))
            assert [p for leaf in tree.leaves for p in leaf] == regex.findall(token_counts.SPLIT, text)


def test_an_edit_encodes_little():
    tree = token_counts.TokenTree("some words of text. " * 5000, token_counts.piece_counter(tokenizer_path(BYTE_TOKENIZER)))
    before = tree.encoded
    tree.replace(50_000, 50_004, "other")
    assert tree.encoded - before < 20


def test_edited_counts(spark, documents):
    docs = documents([(1, "write to me@example.com or +44 20 7946 0958 now"), (2, None), (None, ""), (1, "plain")])
    rows = token_counts.masked_counts(docs, tokenizer_path(BYTE_TOKENIZER)).collect()
    tokenizer = load(tokenizer_path(BYTE_TOKENIZER))
    masked = "write to <email> or <number> now"
    assert [r["n_edits"] for r in rows] == [2, 0, 0, 0]
    assert rows[0]["n_tokens_after"] == len(tokenizer.encode(masked).ids) and rows[1]["n_tokens"] == 0
    edits = "array<struct<start:int,end:int,text:string>>"
    odd = docs.limit(1).withColumn("edits", F.expr(f"cast(array(named_struct('start', -5, 'end', 5, 'text', null), named_struct('start', 3, 'end', 99999, 'text', 'x'), null, named_struct('start', null, 'end', 3, 'text', 'y')) as {edits})"))
    assert token_counts.edited_counts(odd, tokenizer_path(BYTE_TOKENIZER)).first()["n_edits"] == 2
    assert token_counts.masked_counts(documents([]), tokenizer_path(BYTE_TOKENIZER)).count() == 0


# ---- the mix -------------------------------------------------------------------------------------

def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Fill sources by weight, giving what is above a limit to the others, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        level = rest / open_weight if open_weight else 0
        over = {s for s in order if s not in full and weight[s] * level > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check_mix(rows, docs, near):
    sizes, taken, target = {}, {}, {}
    for (_, text, source), row in zip(sorted(docs, key=lambda d: d[0]), rows, strict=True):
        n = len(spaced(text))
        assert row["size"] == n and row["taken"] == row["copies"] * n <= 3 * n and row["copies"] >= 0
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + row["taken"]
        target[source] = row["target"]
    want = targets(sizes)
    for source, value in want.items():
        assert target[source] == pytest.approx(value, rel=1e-9, abs=1e-9)
        assert abs(taken[source] - value) <= near + 0.02 * value
    return want


def test_mix(spark, documents):
    rng = random.Random(11)
    docs = [(k, "w " * rng.choice((1, 2, 5, 40, rng.randint(0, 300))), rng.choice("aaaaaabcdeﬀ𝒜") if k % 30 else None) for k in range(900)]
    docs += [(900, None, "a"), (901, "", "only empty"), (902, "w " * 3000, "a"), (903, "w", "tiny"), (904, "w", "tiny")]
    frame = documents(docs)
    rows = mixing.mix_sources(frame).orderBy("doc_id").collect()
    want = check_mix(rows, docs, near=5)
    assert want["tiny"] == 6.0  # at its limit
    again = mixing.mix_sources(frame.repartition(7)).orderBy("doc_id").collect()
    assert [r["copies"] for r in again] == [r["copies"] for r in rows]
    mixed = mixing.take_copies(frame, mixing.mix_sources(frame))
    assert mixed.columns == frame.columns
    counted = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_mix_of_many_equal_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_DOCS", 16)
    docs = [(k, "w " * 10, "a" if k < 600 else "b") for k in range(700)]
    check_mix(mixing.mix_sources(documents(docs)).orderBy("doc_id").collect(), docs, near=10)


def test_odd_mixes(spark, documents):
    assert mixing.mix_sources(documents([])).count() == 0
    rows = mixing.mix_sources(documents([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
    frame = documents([(1, "one two", "a"), (1, "one two", "a"), (None, "three", "a"), (1, "other", "b")])
    mixed = mixing.mix_sources(frame)
    assert mixed.count() == 4
    assert mixing.take_copies(frame, mixed).count() == sum(r["copies"] for r in mixed.collect())
