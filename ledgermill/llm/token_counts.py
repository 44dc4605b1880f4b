"""Edit-aware token counts: segment trees over pre-tokens, re-encoding only what edits touch.

A byte-level vocabulary splits a text into pre-tokens by a pattern and encodes each alone. A
document keeps its pre-tokens in the leaves of a tree whose nodes hold sums of characters and
tokens. An edit is located by the character sums; scanning starts a little before it and stops
at the first boundary behind it that was one before, as the pattern looks only ahead. Only the
pre-tokens in between are encoded, and only the nodes above their leaves change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Kept, load

# Fixed value: the split rule of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(SPLIT)
LOOKAHEAD = 2  # characters behind a pre-token that its match may depend on
LEAF = 64  # pre-tokens of a new leaf
FULL = 8 * LEAF  # a fuller leaf makes the tree be laid out anew


@lru_cache(maxsize=2)
def piece_counter(path: str) -> Kept:
    """Tokens of a pre-token under a byte-level vocabulary, kept for repeated ones."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = load(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text
    tokenize = tokenizer.model.tokenize
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x250) if c == 32 or chr(c).isalpha()}

    def count(piece: str) -> int:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha() and max(word) < "ɐ":  # one pre-token for the library, too
            return len(tokenize(piece.translate(as_bytes)))
        return len(tokenizer.encode(piece, add_special_tokens=False).ids)

    return Kept(count)


class TokenTree:
    """A text as a tree of pre-tokens with their token counts."""

    def __init__(self, text: str, count: Kept):
        self._count = count
        self.encoded = 0  # pre-tokens encoded so far
        self._lay_out(self._encode(text))

    def _encode(self, text: str) -> list[str]:
        pieces = _SPLIT.findall(text)
        self.encoded += len(pieces)
        return pieces

    def _lay_out(self, pieces: list[str]) -> None:
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [[] for _ in range(self.size - len(self.leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum(k)
        for node in range(self.size - 1, 0, -1):
            self._add(node)

    def _sum(self, leaf: int) -> None:
        pieces = self.leaves[leaf]
        self.chars[self.size + leaf] = sum(map(len, pieces))
        self.tokens[self.size + leaf] = sum(map(self._count.__getitem__, pieces))

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _update(self, leaf: int) -> None:
        self._sum(leaf)
        node = (self.size + leaf) // 2
        while node:
            self._add(node)
            node //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(piece for leaf in self.leaves for piece in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The first leaf whose end is at or behind ``at``, and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if begin + self.chars[node] < at:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start to end of the present text."""
        leaf, begin = self._find(max(0, start - LOOKAHEAD + 1))
        keep = 0
        for piece in self.leaves[leaf]:
            if begin + len(piece) >= start - LOOKAHEAD + 1:
                break
            begin += len(piece)
            keep += 1
        # Pre-tokens from here on are scanned again, up to a boundary that stays.
        old: list[tuple[int, int]] = []  # (leaf, place) of each taken pre-token
        taken, place, scan = [], keep, leaf
        have = begin

        def more() -> bool:
            nonlocal place, scan, have
            while scan < len(self.leaves) and place >= len(self.leaves[scan]):
                scan, place = scan + 1, 0
            if scan >= len(self.leaves):
                return False
            piece = self.leaves[scan][place]
            taken.append(piece)
            old.append((scan, place))
            have += len(piece)
            place += 1
            return True

        while have < end and more():
            pass
        ahead = 0
        while True:
            joined = "".join(taken)
            region = joined[: start - begin] + new + joined[end - begin :]
            shift = len(new) - (end - start)
            borders, at = {}, begin
            for k, piece in enumerate(taken):
                borders[at + shift] = k
                at += len(piece)
            found, stop, reached = [], None, begin
            for match in _SPLIT.finditer(region):
                reached = begin + match.start()
                if reached >= start + len(new) and reached in borders and borders[reached] > 0:
                    stop = borders[reached]
                    break
                found.append(match.group())
            if stop is not None:
                break
            # Not yet in step: take in more text, twice as much each time.
            ahead = max(4, 2 * ahead)
            if not any([more() for _ in range(ahead)]):
                stop = len(taken)
                break
        self.encoded += len(found)
        last, past = old[stop] if stop < len(old) else (len(self.leaves), 0)
        if last == leaf:
            self.leaves[leaf][keep:past] = found
            changed = [leaf]
        else:
            self.leaves[leaf][keep:] = found
            changed = list(range(leaf, min(last + 1, len(self.leaves))))
            for k in changed[1:]:
                self.leaves[k][: past if k == last else None] = []
        if len(self.leaves[leaf]) > FULL:
            self._lay_out([piece for part in self.leaves for piece in part])
        else:
            for k in changed:
                self._update(k)

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Edits of the first text, from the last to the first so that places stay; returns how many.

        Places outside the text are drawn in, and an edit that reaches into a later one ends there.
        """
        done, limit = 0, self.n_chars
        for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
            start, end = max(0, min(start, limit)), max(0, min(end, limit))
            if start <= end:
                self.replace(start, end, new)
                limit, done = start, done + 1
        return done


def edited_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token counts before and after edits: one row per document row.

    ``docs`` has doc_id, text and edits (array of start, end, text; places in characters).
    Returns doc_id, n_pieces, n_tokens, n_edits, n_tokens_after, n_encoded_again. A null text is
    empty, null edits are none, and a null replacement is an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_pieces", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(tokenizer_path)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", count)
                before, pieces = tree.n_tokens, tree.encoded
                edits = [(e["start"], e["end"], e["text"] or "") for e in edits.as_py() or []
                         if e and e["start"] is not None and e["end"] is not None]
                done = tree.apply(edits)
                rows.append((pieces, before, done, tree.n_tokens, tree.encoded - pieces))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *names])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


# Personal data and secrets, with what to put in their place.
MASKS = [
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"),
    (re.compile(r"\b(?:sk|ghp|AKIA|key)[-_]?[A-Za-z0-9]{16,}\b"), "<secret>"),
    (re.compile(r"(?<!\w)\+?\d[\d ().-]{6,}\d(?!\w)"), "<number>"),
]


def masking_edits(text: str | None) -> list[dict]:
    """Edits that mask personal data in a text; where two masks meet, the one that begins first."""
    found = sorted((m.start(), m.end(), new) for pattern, new in MASKS for m in pattern.finditer(text or ""))
    out, at = [], 0
    for start, end, new in found:
        if start >= at:
            out.append({"start": start, "end": end, "text": new})
            at = end
    return out


def masking(text: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def edits(texts: pd.Series) -> pd.Series:
        return texts.map(masking_edits)

    return edits(text)


def masked_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token counts of all documents before and after masking personal data."""
    return edited_counts(docs.select("doc_id", "text", masking(F.col("text")).alias("edits")), tokenizer_path)
