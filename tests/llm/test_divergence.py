"""Source divergence audit against a plain recomputation."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgermill.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and Alpha beta gamma Δelta É x1 2 zeta-eta theta! über".split(" ")


def terms(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(rows, min_documents, top=50):
    groups, df = {}, Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = terms(text)
        groups.setdefault((lang, source), Counter()).update(words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), n in df.items() if l == lang and n >= min_documents)
        mine = {s: c for (l, s), c in groups.items() if l == lang}

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        ps = {s: p(c) for s, c in mine.items()}
        q = p(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in mine if o != s]
            hot = [(t, ps[s][t] - q[t]) for t in kept if mine[s][t] > 0 and ps[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", hot, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_against_plain_counts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(90):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(["a", "b", "c", None, "Ü"]) if lang != "de" else "solo"
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))
        rows.append((k, rng.choice([text, text, "", None, "123 !!"]), lang, source))
    rows += [rows[3], rows[3], (500, None, "fr", "x"), (501, "", "fr", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_w", F.lit("clash"))
    df = df.withColumn("g", df.doc_id).withColumn("p", df.text)
    got = sorted(tuple(r) for r in divergence.audit(df, min_documents=4).collect())
    assert got == expected([r[1:] for r in rows], 4)
    assert {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "x", "pair", "y", 0, 1) in got  # a lang without kept terms


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
