"""Toxicity on held-out documents, transcripts against a plain Viterbi, and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm import toxicity, transcripts

LABELS = "doc_id long, quality int, toxic int"
BAD = ["idiot", "scum", "trash", "stemmage", "stemmout", "stemmix"]


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = random.Random(12)
    docs, labels = [], []
    for k in range(500):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 200))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        docs.append((k, text.replace(" ", "%%% ") if junk else text))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents, labelled):
    docs, labels = labelled
    extra = [(900, None), (901, ""), (902, "idiot scum trash stemmix " + "w1 " * 30_000), (None, "idiot trash scum stemmage"), (3, docs[3][1])]
    known = spark.createDataFrame(labels[:300] + labels[:5] + [(1, None, None), (None, 1, 1)], LABELS)
    rows = toxicity.classify(documents(docs + extra), known).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r["doc_id"]: r for r in rows}
    right = [got[k]["toxic"] == bool(toxic) for k, _, toxic in labels[300:]]
    assert np.mean(right) > 0.97
    low = [(got[k]["p_low_quality"] >= 0.5) == (quality == 0) for k, quality, _ in labels[300:]]
    assert np.mean(low) > 0.95
    assert got[902]["toxic"] and got[None]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"]
    clean = toxicity.drop_toxic(documents(docs + extra), known)
    assert clean.columns == documents([]).columns
    assert clean.count() == sum(not r["toxic"] for r in rows)


def test_chain_feeds_earlier_probabilities(spark, documents, labelled):
    docs, labels = labelled
    chain = toxicity.fit_chain(documents(docs), spark.createDataFrame(labels, LABELS))
    assert [len(link.earlier) for link in chain.links] == [0, 1]
    assert len(chain.links[1].weights) <= 2 * toxicity.FEATURES and chain.links[1].weights


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents(["a b", "c d", None])
    none = toxicity.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert [(r["p_toxic"], r["toxic"]) for r in none] == [(0.0, False)] * 3
    every = toxicity.classify(docs, spark.createDataFrame([(0, 1, 1), (1, 1, 1)], LABELS)).collect()
    assert all(r["p_toxic"] == 1.0 and r["p_low_quality"] == 0.0 for r in every)
    assert toxicity.classify(documents([]), spark.createDataFrame([(0, 1, 1)], LABELS)).count() == 0


# ---- transcripts ---------------------------------------------------------------------------------

def random_model(rng):
    table = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]) if len(shape) > 1 else rng.dirichlet(np.ones(shape[0])))
    return transcripts.TurnModel(table(transcripts.STATES), table(transcripts.STATES, transcripts.STATES),
                                 [table(transcripts.STATES, n) for n in transcripts.FEATURES.values()])


def test_segments_give_the_best_path():
    rng, pick = np.random.default_rng(5), random.Random(5)
    for _ in range(30):
        model = random_model(rng)
        lines = [{"line": pick.choice(["User: hi", "AI: so?", "plain,", "Bob: x" * 30, "end."]), "blank": pick.random() < 0.5} for _ in range(5)]
        scores = model.scores(lines)
        value = lambda path: model.start[path[0]] + scores[0, path[0]] + sum(
            model.step[a, b] + scores[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:], strict=False)))
        best = max(map(value, itertools.product(range(transcripts.STATES), repeat=5)))
        for cuts in ([0, 5], [0, 2, 5], [0, 1, 3, 4, 5]):
            parts = [lines[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            ends = transcripts.border_states(model, [transcripts.transfer(model, p) for p in parts])
            path = [s for p, (a, b) in zip(parts, ends, strict=True) for s in transcripts.best_path(model, p, a, b)]
            assert value(path) == pytest.approx(best)


def conversations(spark):
    rng, rows = random.Random(9), []
    for conv in range(40):
        roles = (["system"] if conv % 4 == 0 else []) + ["user", "assistant"] * rng.randint(1, 6)
        for turn, role in enumerate(roles):
            lines = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(2, 12))) + rng.choice(".?,") for _ in range(rng.randint(1, 4))]
            rows.append((conv, turn, role, "\n".join(lines)))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [2000, 3])
def test_roles_are_recovered(spark, segment):
    rows = conversations(spark)
    lines = transcripts.conversation_lines(spark.createDataFrame(rows, CONVERSATIONS))
    segments = transcripts.stage(transcripts.pack_segments(lines, segment), "test")
    seen = transcripts.stage(segments.filter("conv_id < 25"), "test")
    hidden = transcripts.stage(segments.filter("conv_id >= 25"), "test")
    turns = transcripts.parse_segments(hidden, transcripts.fit_model(seen)).collect()
    right, n = sum(t["n_right"] for t in turns), sum(t["n_lines"] for t in turns)
    assert n == sum(r[3].count("\n") + 1 for r in rows if r[0] >= 25) and right / n > 0.93
    if segment == 2000:
        want = {(r[0], r[1]): (r[2], r[3]) for r in rows if r[0] >= 25}
        got = {(t["conv_id"], t["turn"]): (t["role"], t["text"]) for t in turns}
        assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.9


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, None, "user", "first"), (1, 1, None, "Bob: who?"), (1, 1, "tool", ""), (None, 0, "user", "x"), (2, 5, "assistant", "y\n\n\nz")]
    turns = transcripts.format_conversations(spark.createDataFrame(rows + rows[-1:], CONVERSATIONS)).collect()
    assert {t["conv_id"] for t in turns} == {1, 2, None} and all(t["role"] in transcripts.ROLES for t in turns)
    assert transcripts.format_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_repeated_rows_stay_whole(spark):
    """Two equal rows are two turns of the same text one after the other, never interleaved lines."""
    rows = [(conv, 0, "user", "hello there\nsecond line") for conv in range(40) for _ in range(2)]
    rows += [(conv, 1, "assistant", "fine.") for conv in range(40)]
    lines = transcripts.conversation_lines(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    by_conv = {}
    for row in sorted(lines, key=lambda r: (r["conv_id"], r["place"])):
        by_conv.setdefault(row["conv_id"], []).append(transcripts.without_marker(row["line"]))
    for got in by_conv.values():
        assert got[:6] == ["hello there", "second line", "", "hello there", "second line", ""]
    turns = transcripts.format_conversations(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert not any("hello there\nhello there" in (t["text"] or "") for t in turns)


@pytest.mark.parametrize("segment", [2000, 3])
def test_blank_lines_inside_a_turn_are_kept(spark, segment):
    answer = "First paragraph.\n\nSecond one,\nof two lines.\n\n\n```\nif x:\n    \n\n    y = 1  \n```\n\nLast."
    rows = [row for conv in range(60) for row in ((conv, 0, "user", "So?\n\nAnd why?"), (conv, 1, "assistant", answer), (conv, 2, "user", "Thanks."))]
    lines = transcripts.conversation_lines(spark.createDataFrame(rows, CONVERSATIONS))
    segments = transcripts.stage(transcripts.pack_segments(lines, segment), "test")
    turns = transcripts.parse_segments(segments, transcripts.fit_model(segments)).orderBy("conv_id", "turn", "piece").collect()
    got = {}
    for t in turns:
        role, n, text = got.get((t["conv_id"], t["turn"]), (t["role"], 0, None))
        got[t["conv_id"], t["turn"]] = (role, n + t["n_lines"], t["text"] if text is None else text + "\n" + t["text"])
    right = [got.get((conv, turn)) == (role, text.count("\n") + 1, text) for conv, turn, role, text in rows]
    assert sum(right) / len(rows) > 0.9
    assert all(t["n_right"] <= t["n_lines"] for t in turns)


def test_markers():
    assert [transcripts.line_features(x, False)[0] for x in ("User: a", "### Response: b", "[SYSTEM] c", "Bob: d", "users of it", "A man")] == [1, 2, 0, 3, 4, 4]
    assert transcripts.without_marker("<|assistant|>text") == "text"


# ---- the pipeline --------------------------------------------------------------------------------

def test_pipeline_stages(spark, documents, labelled, tmp_path):
    docs, labels = labelled
    rng = random.Random(3)
    passage = " ".join(f"bench{k}" for k in range(14))
    rows = [(k, text) for k, text in docs[:150]] + [(1000 + k, docs[k][1]) for k in range(20)]
    rows += [(2000 + k, " ".join(f"own{k}x{n}" for n in range(60)) + " " + passage + " end") for k in range(5)] + [(3000, None), (3001, "")]
    rng.shuffle(rows)
    folder = str(tmp_path)
    documents(rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = [{r["doc_id"] for r in documents(rows).collect()}]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, frame, folder).write.parquet(f"{folder}/{k}")
        frame = spark.read.parquet(f"{folder}/{k}")
        ids.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or frame.columns == columns
    toxic = {k for k, _, t in labels[:150] if t}
    assert toxic - ids[1] and not (ids[1] & toxic) and {3000, 3001} <= ids[1]
    assert ids[1] - ids[2] == {k for k in ids[1] if 1000 <= k < 2000}
    assert ids[2] - ids[3] == {2000 + k for k in range(5)} & ids[2]
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    total = frame.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert total[0] == total[1]
    assert corpus_pipeline.run(spark, folder).count() == frame.count()
