"""Frames of a few rows, and the brute-force word rules the operators are held against."""

import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, (id, text) pairs or (id, text, source) triples."""

    def make(rows):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            full.append((row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")))
        return spark.createDataFrame(full, DOCUMENTS)

    return make
