"""Licence scan by a positional index of rare licence words.

A first pass counts in how many documents each licence word occurs (its IDF). The two words of
each template with the highest IDF are its index words. A second pass finds the index words of
each file; each occurrence, shifted by the word's place in a template, gives a start where the
template may stand. There the template's whole posting list is compared by relative position:
the score of a template is the IDF share of its words that stand in place. A licence is
reported where its score reaches MIN_SCORE and one of its mandatory key phrases stands in the
file. Base phrases are reported wherever all their words stand consecutively. The templates
are an argument: TEMPLATES, which has the standard notices of the usual licences, or any small table.

Only JVM-side DataFrame functions run here, without a shuffle of texts: the templates are
constants, so their postings travel inside the plan.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, plain_words, settled

MIN_SCORE = 0.75

# Fixed values of the contract: label, phrase.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

_FSF = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation {}"
_LATER = "of the license or at your option any later version"


def _fsf_notices(label: str, name: str, version: str) -> list[tuple[str, str, list[str]]]:
    """The notices of the Free Software Foundation for one version, with and without later ones.

    A key phrase goes from the licence's name to its version, as the notices of GPL, LGPL and
    AGPL are alike besides.
    """
    key = f"gnu {name} as published by the free software foundation"
    return [
        (label, _FSF.format(name, f"either version {version} {_LATER}"), [f"{key} either version {version}"]),
        (label, _FSF.format(name, f"version {version}"), [f"{key} version {version}"]),
        (label, "you can redistribute it and or modify it under the terms of the gnu "
                f"{name} version {version} as published by the free software foundation",
         [f"gnu {name} version {version} as published by the free software foundation"]),
    ]


# label, notice text, key phrases of which one must stand in the file.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2", "apache license 2 0"]),
    ("apache-2", "licensed under the apache 2 0 license", ["apache 2 0 license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     ["general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     ["general public license version 3"]),
    ("lgpl", "this work is licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3",
     ["affero general public license"]),
    ("mpl-2", "this file is subject to the terms of the mozilla public license version 2 0",
     ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain",
     ["dedicated the work to the public domain"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    # The standard headers and the first lines of the licence texts.
    *_fsf_notices("gpl-2", "general public license", "2"),
    *_fsf_notices("gpl-3", "general public license", "3"),
    *_fsf_notices("lgpl", "library general public license", "2"),
    *_fsf_notices("lgpl", "lesser general public license", "2 1"),
    *_fsf_notices("lgpl", "lesser general public license", "3"),
    *_fsf_notices("agpl-3", "affero general public license", "3"),
    ("gpl-2", "gnu general public license version 2 june 1991", ["gnu general public license version 2 june 1991"]),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ["gnu general public license version 3 29 june 2007"]),
    ("lgpl", "gnu library general public license version 2 june 1991", ["gnu library general public license version 2"]),
    ("lgpl", "gnu lesser general public license version 2 1 february 1999", ["gnu lesser general public license version 2 1"]),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", ["gnu lesser general public license version 3"]),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", ["gnu affero general public license version 3"]),
    ("apache-2", "apache license version 2 0 january 2004", ["apache license version 2 0 january 2004"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license v 2 0"]),
    ("mpl-2", "mozilla public license version 2 0 1 definitions", ["mozilla public license version 2 0"]),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public "
              "license v1 0 which accompanies this distribution", ["eclipse public license v1 0", "eclipse public license 1 0"]),
    ("epl-1", "eclipse public license v 1 0 the accompanying program is provided under the terms of this eclipse public license",
     ["eclipse public license v 1 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public "
              "license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public "
              "license v 2 0 which", ["eclipse public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public "
              "license v2 0 which", ["eclipse public license v2 0"]),
    ("epl-2", "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license",
     ["eclipse public license v 2 0"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and "
             "to alter it and redistribute it freely subject to the following restrictions",
     ["granted to anyone to use this software for any purpose"]),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied such that "
                   "the copyright holder maintains some semblance of artistic control",
     ["semblance of artistic control"]),
    ("artistic-2", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", ["artistic license 2 0"]),
    ("artistic-2", "you can redistribute it and or modify it under the terms of the artistic license 2 0",
     ["artistic license 2 0"]),
    ("artistic-2", "you can redistribute it and or modify it under the terms of the the artistic license 2 0",
     ["artistic license 2 0"]),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee",
     ["copy modify and distribute this software for any purpose with or without fee"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("bsl-1", "boost software license version 1 0 august 17th 2003", ["boost software license version 1 0"]),
    ("cc0", "creative commons legal code cc0 1 0 universal", ["cc0 1 0 universal"]),
]

_PLAIN = str.maketrans(SEPARATORS + string.ascii_uppercase, " " * len(SEPARATORS) + string.ascii_lowercase)

Template = tuple[str, list[str], list[list[str]]]


def template_words(templates: DataFrame | Sequence[tuple[str, str, Sequence[str]]]) -> list[Template]:
    """Label, words and words of the key phrases of each template, by the word rule of the documents.

    ``templates`` is a small table of label, text and keys (array), or such tuples. A template
    needs words, and key phrases that have words.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(row) for row in templates.select("label", "text", "keys").collect()]
    found = [(label, (text or "").translate(_PLAIN).split(" "), [(key or "").translate(_PLAIN).split(" ") for key in keys or []])
             for label, text, keys in templates]
    found = [(label, [w for w in text if w], [[w for w in key if w] for key in keys]) for label, text, keys in found]
    for label, text, keys in found:
        if label is None or not text or not keys or not all(keys):
            raise ValueError(f"a template needs a label, a text and key phrases: {label}")
    return found


def _vocabulary(templates: list[Template]) -> list[str]:
    texts = [phrase.split() for _, phrase in BASE_PHRASES]
    for _, text, keys in templates:
        texts += [text, *keys]
    return sorted({word for text in texts for word in text})


def licence_word_idf(docs: DataFrame, templates: list[Template]) -> dict[str, float]:
    """IDF of every licence word over all documents: ln((1 + documents) / (1 + with the word))."""
    vocabulary = _vocabulary(templates)
    present = F.array_intersect(plain_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = (
        docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .collect()  # one row per licence word and one for all documents
    )
    known = {row["word"]: row["n"] for row in counts}
    total = known.get("", 0)
    return {word: math.log((1 + total) / (1 + known.get(word, 0))) for word in vocabulary}


def _rarest(words: list[str], idf: dict[str, float], n: int) -> list[tuple[str, int]]:
    """The n words of highest IDF with their first place; ties go to the earlier place."""
    first = {}
    for at, word in enumerate(words):
        first.setdefault(word, at)
    return sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[:n]


def _index(phrases: list[list[str]], idf: dict[str, float], n: int) -> Column:
    """Index entries of the phrases: array of (word, entry number, place)."""
    entries = [
        F.struct(F.lit(word).alias("word"), F.lit(k).alias("entry"), F.lit(at).alias("at"))
        for k, words in enumerate(phrases)
        for word, at in _rarest(words, idf, n)
    ]
    return F.array(*entries)


def _starts(rare: Column, index: Column) -> Column:
    """Possible starts: each rare word met, shifted by its place in each entry that it indexes."""
    met = F.transform(
        rare,
        lambda hit: F.transform(
            F.filter(index, lambda e: e["word"] == hit["word"]),
            lambda e: F.struct(e["entry"].alias("entry"), (hit["pos"] - e["at"]).alias("start")),
        ),
    )
    return F.filter(F.array_distinct(F.flatten(met)), lambda c: c["start"] >= 0)


def _holds(words: Column, phrase: list[str], rare: Column, idf: dict[str, float]) -> Column:
    """Whether the phrase stands in the words; looked up at its rarest word."""
    word, at = _rarest(phrase, idf, 1)[0]
    wanted = F.array(*map(F.lit, phrase))
    return F.exists(
        rare,
        lambda hit: (hit["word"] == word) & (hit["pos"] >= at)
        & (F.slice(words, F.greatest(hit["pos"] - at, F.lit(0)) + 1, len(phrase)) == wanted),
    )


def _shares(words: list[str], idf: dict[str, float]) -> list[float]:
    """Each word's share of a template's IDF. Where all documents hold all its words they weigh the same."""
    total = sum(idf[word] for word in words)
    return [idf[word] / total if total else 1 / len(words) for word in words]


def scan_licences(
    docs: DataFrame, templates: DataFrame | Sequence[tuple[str, str, Sequence[str]]] = tuple(TEMPLATES)
) -> DataFrame:
    """One row per document row with the licences found in it.

    ``templates``: label, text and key phrases, see ``template_words``; ``[*TEMPLATES, ...]`` adds own ones.
    Returns doc_id, n_words, base_places (array of label and start), found (array of label,
    start and score of each template that reaches MIN_SCORE with a key phrase), score (best
    template, 1 where a base phrase stands). Null and empty texts have no words, no places and
    score 0. Rows are independent, so repeated rows and repeated ids each get their own result.
    """
    docs = docs.select("doc_id", "text")
    templates = template_words(templates)
    idf = licence_word_idf(docs, templates)
    base = [phrase.split() for _, phrase in BASE_PHRASES]
    texts = [text for _, text, _ in templates]
    keys = [key for _, _, ks in templates for key in ks]
    rare_words = sorted(
        {w for p in base + keys for w, _ in _rarest(p, idf, 1)} | {w for p in texts for w, _ in _rarest(p, idf, 2)}
    )
    words = F.col("_words")
    rows = settled(docs.select("doc_id", "text"), _words=plain_words(F.col("text")))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare_words))
    rows = settled(
        rows.select("doc_id", "_words"),
        _rare=F.when(
            F.size(words) > 0, F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(words, i).alias("word")))
        ).otherwise(F.array().cast("array<struct<pos:int,word:string>>")),
    )
    rare = F.col("_rare")

    base_literal = F.array(*[
        F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, phrase.split())).alias("words"))
        for label, phrase in BASE_PHRASES
    ])
    base_places = F.filter(
        _starts(rare, _index(base, idf, 1)),
        lambda c: F.slice(words, c["start"] + 1, F.size(F.get(base_literal, c["entry"])["words"]))
        == F.get(base_literal, c["entry"])["words"],
    )
    base_places = F.transform(
        base_places,
        lambda c: F.struct(F.get(base_literal, c["entry"])["label"].alias("label"), c["start"].alias("start")),
    )

    template_literal = F.array(*[
        F.array(*[
            F.struct(F.lit(at).alias("at"), F.lit(word).alias("word"),
                     F.lit(share).alias("share"))
            for at, (word, share) in enumerate(zip(text, _shares(text, idf), strict=True))
        ])
        for text in texts
    ])
    labels = F.array(*[F.lit(label) for label, _, _ in templates])
    allowed = F.array(*[
        F.exists(F.array(*[_holds(words, key, rare, idf) for key in ks]), lambda x: x) for _, _, ks in templates
    ])
    scored = F.transform(
        _starts(rare, _index(texts, idf, 2)),
        lambda c: F.struct(
            c["entry"].alias("entry"),
            c["start"].alias("start"),
            F.round(
                F.aggregate(
                    F.get(template_literal, c["entry"]),
                    F.lit(0.0),
                    lambda total, p: total
                    + F.when(F.get(words, c["start"] + p["at"]) == p["word"], p["share"]).otherwise(0.0),
                ),
                6,
            ).alias("score"),
        ),
    )
    rows = settled(rows, base_places=base_places, _scored=scored)
    rows = settled(rows, _allowed=F.when(F.size("_scored") > 0, allowed))
    found = F.transform(
        F.filter("_scored", lambda c: (c["score"] >= MIN_SCORE) & F.get(F.col("_allowed"), c["entry"])),
        lambda c: F.struct(F.get(labels, c["entry"]).alias("label"), c["start"].alias("start"), c["score"].alias("score")),
    )
    best = F.coalesce(F.array_max(F.transform("_scored", lambda c: c["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        "base_places",
        found.alias("found"),
        F.when(F.size("base_places") > 0, 1.0).otherwise(F.least(best, F.lit(1.0))).alias("score"),
    )


def digest(result: DataFrame) -> DataFrame:
    """Counts, first and last base place and the sorted labels of each document."""
    starts = F.transform("base_places", lambda p: p["start"].cast("long"))
    base = F.array_distinct(F.transform("base_places", lambda p: p["label"]))
    own = F.transform("found", lambda p: p["label"])
    return result.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        "score",
    )
