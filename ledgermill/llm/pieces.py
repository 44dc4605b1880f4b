"""Whole texts through a public tokenizer, with the ids of repeated pieces kept."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import lru_cache

KEPT_PIECES = 600_000  # in each of two generations per worker, about 200 bytes each

# Signs that never merge with a letter before them in the word vocabulary's split rule.
_SIGNS = ".,;:!?*#%&$()"
_LAST_KNOWN_LETTER = "\u024f"  # letters up to here are letters in every Unicode version in use


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Kept(dict):
    """A store of computed values with a bound: what was not used for a generation goes."""

    def __init__(self, compute: Callable[[str], object], size: int = KEPT_PIECES):
        super().__init__()
        self._compute, self._size, self._older = compute, size, {}

    def __missing__(self, key: str):
        value = self._older.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._size:
            self._older = {}  # gone before the copy is made
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


def _plain_letters(piece: str) -> bool:
    """Letters that stay letters, one for one, when lower-cased."""
    return piece.isalpha() and (piece.isascii() or (max(piece) <= _LAST_KNOWN_LETTER and "\u0130" not in piece))


@lru_cache(maxsize=1)
def word_piece_encoder(path: str, kept: int = KEPT_PIECES) -> Callable[[str], bytes]:
    """A function from a text to its ids, equal to encoding the text in one call.

    Ids come as unsigned 16-bit numbers, or 32-bit ones if the vocabulary needs them. For
    tokenizers that lower-case, drop white space and never merge across it, such as the word
    BPE file: the pieces between spaces and line breaks are then independent. A piece of
    letters alone is one word of the model, so it skips the normalizer and the split rule.
    """
    tokenizer = load(path)
    tokenize, kind = tokenizer.model.tokenize, id_code(tokenizer.get_vocab_size())
    # What the byte-level step makes of each letter.
    as_bytes = {
        c: tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0]
        for c in range(128, ord(_LAST_KNOWN_LETTER) + 1) if chr(c).isalpha()
    }

    def compute(piece: str) -> bytes:
        if _plain_letters(piece):
            word = piece.lower()
            if word != piece:
                return pieces[word]
            found = [token.id for token in tokenize(word if word.isascii() else word.translate(as_bytes))]
        else:
            core = piece.rstrip(_SIGNS)
            if len(core) < len(piece) and _plain_letters(core):
                return pieces[core] + pieces[piece[len(core) :]]  # the split rule always cuts here
            found = tokenizer.encode(piece, add_special_tokens=False).ids
        return array(kind, found).tobytes()

    pieces = Kept(compute, kept)
    pieces[""] = b""

    def ids_of(text: str) -> bytes:
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(pieces.__getitem__, spaced.split(" ")))

    return ids_of


def id_code(vocabulary: int) -> str:
    """The array code of ids: 16 bits where all ids fit, else 32."""
    return "H" if vocabulary <= 1 << 16 else "I"
