"""Near dedup, substring dedup and embedding links against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgermill.llm import embedding_links, near_copies, repeats
from ledgermill.llm.graphs import components
from ledgermill.llm.word_hashes import run_hashes, sliced

from .conftest import spaced


def smallest_reached(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    pairs += [(500, k) for k in range(501, 560)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == smallest_reached(nodes, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- words and bags ------------------------------------------------------------------------------

def test_word_hashes_follow_the_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n\t😀\x1c\xa0x") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " "]
    seen = {}
    for first, sizes, hashes in sliced(pa.array(texts)):
        at = 0
        for k, n in enumerate(sizes):
            words = spaced(texts[first + k])
            assert len(words) == n
            for word, value in zip(words, hashes[at : at + n], strict=True):
                assert seen.setdefault(word, value) == value
            at += n
    assert len(set(seen.values())) == len(seen)
    values = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    runs = run_hashes(values, 3)
    assert runs[0] == runs[3] and len({int(x) for x in runs}) == 3


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def bag(text):
    words = spaced(text)
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 5, 0) + 1)) if words else Counter()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_signatures_are_unbiased():
    rng = random.Random(4)
    words = [rng.choice("a b c d e f".split()) for _ in range(400)]
    texts = [" ".join(words), edited(rng, words, 12), edited(rng, words, 40), " ".join(words[:200])]
    for first, sizes, hashes in sliced(pa.array(texts)):
        owner, runs, counts = near_copies.shingle_bags(sizes, hashes)
        times = near_copies.bag_signatures(owner, runs, counts, len(texts), 4000)
    for k in range(1, 4):
        true = jaccard(bag(texts[0]), bag(texts[k]))
        assert abs((times[0] == times[k]).mean() - true) < 5 * math.sqrt(true * (1 - true) / 4000) + 1e-3
        assert abs(near_copies.bag_similarities(pa.array(texts[:1]), pa.array(texts[k : k + 1]))[0] - true) < 1e-12


def test_near_groups(spark, documents):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 200))] for _ in range(12)]
    texts = [" ".join(rng.choice(base)) for _ in range(20)]
    texts += [edited(rng, w := rng.choice(base), rng.randint(0, max(1, len(w) // 30))) for _ in range(150)]
    texts += [edited(rng, base[0], n) for n in range(1, 6) for _ in range(12)]
    texts += ["", None, " \t", "one", "one", "two words", "two words", "one two three four five", "a a a a a a a a", "a a a a a a a"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_copies.near_duplicate_groups(documents(rows)).collect()}
    bags = {k: bag(t) for k, t in rows}
    want = smallest_reached(bags, [(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8])
    assert got == {k: (c, c == k) for k, c in want.items()}
    kept = near_copies.keep_one_of_each(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in want.values()})


def test_near_groups_in_small_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, words, rng.randint(0, 6))) for k in range(90)]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_duplicate_groups(documents(rows)).collect()}
    bags = {k: bag(t) for k, t in rows}
    assert got == smallest_reached(bags, [(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8])


def test_odd_rows_of_near_dedup(spark, documents):
    long, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    docs = documents([(None, long), (5, long), (5, long), (3, other), (5, other), (None, None), (9, None)])
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_copies.near_duplicate_groups(docs).collect()), key=repr)
    assert got == sorted([(None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (5, 3, False), (None, None, True), (9, 9, True)], key=repr)
    kept = near_copies.keep_one_of_each(documents([(1, long), (1, long), (1, None), (2, long), (None, long)]))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, None]
    assert near_copies.near_duplicate_groups(documents([])).count() == 0


# ---- repeated passages ---------------------------------------------------------------------------

def removed(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        words, gone = spaced(text), set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone |= set(range(k, k + window))
            seen.add(run)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard_words, span_words", [(200_000, 800_000), (40, 100)])
def test_repeats(spark, documents, monkeypatch, shard_words, span_words):
    monkeypatch.setattr(repeats, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(repeats, "SPAN_WORDS", span_words)
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    passages = [own(n) for n in (19, 20, 21, 60, 90)]
    rows = []
    for k in range(80):
        parts = [own(rng.randint(0, 40)) for _ in range(3)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        rows.append((rng.randint(0, 10**6) * 100 + k, (" " if k % 2 else "\n\t ").join(w for p in parts for w in p)))
    rows += [(k, rows[k][1]) for k in range(10)]
    rows += [(77, "a " * 100), (78, "b " * 19), (79, "b " * 19), (80, ""), (81, None), (82, "tick tock " * 30), (None, rows[3][1])]
    rows += [(90, " ".join(own(3000) + passages[4] + passages[4]))]
    docs = documents(rows + rows[:2])  # repeated rows are one document
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == removed(rows)


def test_repeats_of_nothing(spark, documents):
    assert repeats.remove_repeats(documents([])).count() == 0
    assert [r["n_removed"] for r in repeats.remove_repeats(documents(["a", None])).collect()] == [0, 0]


def test_automaton_finds_first_ends():
    automaton = repeats.SuffixAutomaton()
    begins = [automaton.add(list(text)) for text in ("abcabx", "xabcab")]
    found = dict(automaton.matches(list("zabcaqabx"), 3))
    assert found == {3: begins[0] + 2, 4: begins[0] + 3, 8: begins[0] + 5}


# ---- embeddings ----------------------------------------------------------------------------------

def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "BLOCK", 20)
    monkeypatch.setattr(embedding_links, "RUN", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, 260)] + rng.normal(size=(260, 12)) * rng.uniform(0, 0.35, size=(260, 1))
    x[200:230] = x[0]
    x *= rng.uniform(0.01, 100, size=(260, 1))
    rows = [(int(k), [float(v) for v in x[k]], int(k % 3)) for k in rng.permutation(260)]
    odd = [(300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [1.0] * 11 + [None], 1), (304, [float("nan")] + [1.0] * 11, 1),
           (305, [float("inf")] + [1.0] * 11, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_links.link_embeddings(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    pairs = [(a, b) for a in range(260) for b in range(a) if near[a, b]] + [(306, 307)]
    want = smallest_reached([*range(260), *range(300, 308)], pairs)
    links = Counter(k for pair in pairs for k in pair)
    assert got.pop(None) == (0, None, True)
    assert got == {k: (links[k], c, c == k) for k, c in want.items()}
    assert len(pairs) > 1000


def test_no_embeddings(spark):
    assert embedding_links.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
