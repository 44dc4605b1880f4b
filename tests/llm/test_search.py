"""Decontamination and licence scan against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgermill.llm import decontamination, licences

from .conftest import plain

WORDS = "The of and to a Alpha beta, gamma. Δelta É x1 2 zeta-eta theta!".split(" ")


def expected(docs, items, window=10):
    grams = {}
    for item, text in items:
        words = plain(text)
        for k in range(max(len(words) - window, 0) + 1 if words else 0):
            grams.setdefault(tuple(words[k : k + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = plain(text), set(), set()
        for gram, who in grams.items():
            for k in range(len(words) - len(gram) + 1):
                if tuple(words[k : k + len(gram)]) == gram:
                    hit |= set(range(k, k + len(gram)))
                    found |= {str(i) for i in who if i is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(rng.randint(10, 25))) for k in range(8)]
    items += [(8, "just Three words"), (9, "one"), (10, ""), (11, None), (None, text(14)), (12, items[0][1])]
    docs = [(k, text(rng.randint(0, 60))) for k in range(30)]
    docs += [(30 + k, text(7) + " " + text_ + " " + text(5)) for k, (_, text_) in enumerate(items[:5])]
    docs += [(40, None), (41, ""), (42, "just three WORDS"), (43, "one one"), (None, items[1][1]), (None, "no id")]
    docs += [(44, items[2][1]), (44, items[2][1]), (44, "other text of one id"), (45, items[0][1] + " " + text(3000) + " " + items[0][1])]
    return docs, items


def test_contamination(spark, documents, corpus):
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(1)).withColumn("term", F.lit(2))
    rows = decontamination.digest(decontamination.decontaminate(documents(docs), benchmark)).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(docs, items)


def test_terms_beyond_the_inline_list(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "INLINE_TERMS", 3)
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.digest(decontamination.decontaminate(documents(docs), benchmark)).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(docs, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontamination.decontaminate(documents(["a b"]), none).collect()] == [False]
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(documents([]), item).count() == 0


def test_clean_documents_stay_whole(spark, documents):
    item = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = documents([(1, "x A b, C"), (2, "a b"), (None, "a b c"), (3, None)])
    kept = decontamination.drop_contaminated(docs, item)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_proximity(spark, documents):
    item = spark.createDataFrame([(1, "red common blue")], "item_id long, text string")
    docs = documents([(1, "red common blue"), (2, "blue x x red"), (3, "red " + "x " * 50 + "blue"), (4, "common common common")])
    found = {r["doc_id"]: (r["nearest"], r["exact"]) for r in decontamination.proximity_matches(docs, item, 5).collect()}
    assert found == {1: (2, True), 2: (3, False)}


def test_licences(spark, documents):
    rng = random.Random(5)
    pool = "the mit License under apache version 2 cc by nc, of 2.0 gnu".split()
    docs = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "Under  the MIT-License"), (None, "cc by nc"), (62, "again"), (62, "again")]
    docs += [(63, "x " * 5000 + "apache license, version 2.0"), (64, "This work is licensed under the GNU General Public License, version 3.")]
    rows = licences.digest(licences.scan_licences(documents(docs))).collect()
    got = sorted((tuple(r)[:6] for r in rows), key=repr)
    want = []
    for doc, text in docs:
        words = plain(text)
        places = sorted(
            (k, label) for label, phrase in licences.BASE_PHRASES
            for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()
        )
        starts = [k for k, _ in places]
        want.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({label for _, label in places}))))
    assert got == sorted(want, key=repr)
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in rows}
    assert found[64] == ("gpl-3", 1.0) and found[60] == ("", 0.0) and found[63][0] == "apache-2"
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_a_notice_without_its_key_phrase_is_not_a_licence(spark, documents):
    rows = licences.scan_licences(documents(["this work is licensed under the gnu strange license version 3"])).collect()
    assert rows[0]["found"] == []


GNU = ("{} is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n"
       "# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version.")
OFFICIAL = [
    ("gpl-2", "# " + GNU.format("This program", ";", "General Public License", ";", 2)),
    ("gpl-3", "# " + GNU.format("Foo", ":", "General Public License", ",", 3)),
    ("lgpl", "# " + GNU.format("This library", ";", "Lesser General Public\n# License", ";", 2.1)),
    ("lgpl", "# " + GNU.format("This library", ":", "Lesser General Public License", ",", 3)),
    ("agpl-3", "# " + GNU.format("This program", ":", "Affero General Public License", ",", 3)),
    ("gpl-2", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public"
              " License version 2 as\n * published by the Free Software Foundation."),
    ("gpl-3", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("lgpl", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("mpl-2", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not"),
    ("epl-2", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is"
              " available at\nhttps://www.eclipse.org/legal/epl-2.0"),
    ("epl-1", "This program and the accompanying materials\n * are made available under the terms of the Eclipse Public License v1.0\n"
              " * which accompanies this distribution, and is available at"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and"
             " redistribute it\nfreely, subject to the following restrictions:"),
    ("artistic-2", "                       The Artistic License 2.0\n\n        Copyright (c) 2000-2006, The Perl Foundation."),
    ("bsl-1", "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt"),
]


def test_official_notices(spark, documents):
    docs = [(k, f"// file {k}\n{text}\nint main() {{}}") for k, (_, text) in enumerate(OFFICIAL)] + [(100 + k, "some free prose") for k in range(20)]
    rows = licences.digest(licences.scan_licences(documents(docs))).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {k: label for k, (label, _) in enumerate(OFFICIAL)} | {100 + k: "" for k in range(20)}


def test_the_same_notice_in_every_file(spark, documents):
    rows = licences.digest(licences.scan_licences(documents([f"file{k} " + OFFICIAL[1][1] for k in range(3)]))).collect()
    assert [(r["labels"], r["score"]) for r in rows] == [("gpl-3", 1.0)] * 3


def test_own_templates(spark, documents):
    docs = documents(["Use under the House Licence, 7th form.", "House Licence", OFFICIAL[1][1], "x"])
    own = spark.createDataFrame([("house", "Use under the House Licence, 7th form", ["House-Licence"])], "label string, text string, keys array<string>")
    only = [r["labels"] for r in licences.digest(licences.scan_licences(docs, own)).orderBy("doc_id").collect()]
    assert only == ["house", "", "", ""]
    added = licences.scan_licences(docs, [*licences.TEMPLATES, ("house", "use under the house licence 7th form", ["house licence"])])
    assert [r["labels"] for r in licences.digest(added).orderBy("doc_id").collect()] == ["house", "", "gpl-3", ""]
    with pytest.raises(ValueError):
        licences.scan_licences(docs, [("house", "use under it", [])])


def test_licences_of_no_documents(spark, documents):
    assert licences.digest(licences.scan_licences(documents([]))).count() == 0


def test_proximity_against_brute_force(spark, documents):
    """Every window's two rarest terms (by occurrences in all documents, ties to the earlier
    place) within the distance, in any order, in every document."""
    from collections import Counter

    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, ""]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))) for k in range(6)]
    docs = documents(list(enumerate(texts)))
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    distance, window = 6, 10
    got = {(r["doc_id"], r["gram"]): (r["nearest"], r["exact"])
           for r in decontamination.proximity_matches(docs, item_frame, distance, window).collect()}

    words = {k: plain(t) for k, t in enumerate(texts)}
    counts = Counter(w for ws in words.values() for w in ws)
    grams = set()
    for _, text in items:
        ws = plain(text)
        for s in range(max(len(ws) - window, 0) + 1):
            grams.add(tuple(ws[s : s + window]))
    want = {}
    for gram in grams:
        rare = sorted((counts[t], at, t) for at, t in enumerate(gram))[:2]
        (_, at1, t1), (_, at2, t2) = rare[0], rare[-1]
        for doc, ws in words.items():
            gaps = [q - p for p, a in enumerate(ws) if a == t1 for q, b in enumerate(ws) if b == t2 and abs(q - p) <= distance]
            if gaps:
                want[doc, " ".join(gram)] = (min(abs(g) for g in gaps), any(g == at2 - at1 for g in gaps))
    assert got == want and len(want) > 20


def test_components_split_a_hub(spark):
    """A node linked to most others gives right components with minima written before joins.

    The joins run inside the rounds, whose plans the returned frame does not hold; the test
    looks at the result, under settings that make the hub a skewed partition."""
    from pyspark.sql import functions as F

    from ledgermill.llm import graphs

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hub = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        pairs = spark.range(6000, 6400).select(F.col("id").alias("a"), (F.col("id") + 400).alias("b"))
        found = graphs.components(hub.unionByName(pairs))
        got = {r["id"]: r["component"] for r in found.collect()}
        assert all(got[k] == 0 for k in range(5000)) and len(got) == 5000 + 800
        assert all(got[6000 + k] == got[6400 + k] == 6000 + k for k in range(400))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
