"""Hard-negative mining against brute force."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from ledgermill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    clean = set()
    for vec_id, emb, label in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        clean.add((vec_id, label, tuple(math.floor(256 * float(x)) for x in emb)))
    order = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0)
    out = []
    for a_id, a_label, av in clean:
        if a_id is None or a_id % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), vid, label) for vid, label, v in clean]
        pos = sorted((s for s in scored if s[2] == a_label and s[1] is not None and s[1] != a_id), key=order)[:5]
        for ps, pid, _ in pos:
            neg = sorted((s for s in scored if s[2] != a_label and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:5]
            out += [(a_id, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(neg)]
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for k in range(700):
        c = centres[k % 4]
        rows.append((k, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(10)))
    rows += [
        (1000, None, 1), (1001, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0], 2), (1100, [0.5] * 6, None),
        (1200, [float("inf")] + [0.0] * 5, 3), (1300, [None, 0.1, 0.1, 0.1, 0.1, 0.1], 4),
        rows[100], rows[100], (1400, [0.25] * 6, 3), (1401, [0.25] * 6, 4), (1402, [0.25] * 6, 5),
        (None, [0.3] * 6, 3), (1500, [-0.5] * 6, 2),
    ]
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], c) for i, e, c in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("s", F.lit(1)).withColumn("lb", F.lit("x")).withColumn("_k", F.lit(2))
    got = sorted((tuple(r) for r in negatives.mine(df).collect()), key=repr)
    assert got == expected(rows)
    assert len({(r[0], r[1]) for r in got}) >= 20
    # Many row blocks, anchor blocks and chunks give the same rows.
    monkeypatch.setattr(negatives, "ROW_BLOCK", 97)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    assert sorted((tuple(r) for r in negatives.mine(df).collect()), key=repr) == got


def test_empty_and_all_invalid(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = spark.createDataFrame([(100, None, 1), (200, [float("nan")], 2)], SCHEMA)
    assert negatives.mine(bad).count() == 0
