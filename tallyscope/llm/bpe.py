"""Encoding through a cache of pre-tokens, equal to the tokenizers library on every text.

Both public vocabularies split a text into pre-tokens by a pattern and merge inside each of them, so
the ids of a text are those of its pre-tokens in turn. A pre-token met before costs one dictionary
lookup. Texts with characters beyond Latin, or with a special token's string, go to the library
whole: there the character classes of two Unicode versions could differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack

import numpy as np

from tallyscope.llm.common import held

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
#: Anything else sends the whole text to the library.
OTHER = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ſ]")
#: The vocabularies' own splitting patterns, fixed values, with the classes written out for Latin text.
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: A place where any text may be cut without changing its pre-tokens.
CUT = re.compile(r"[^\s](?= [A-Za-z])")
#: The same for every script: before a blank and a letter, around single line breaks, or after an
#: ideographic stop. Only letters that all Unicode versions know as such.
CUT_SCRIPTS = re.compile(
    r"[^\s](?= [A-Za-z\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u4e00-\u9fa5])|[^\s](?=\n[^\s])|[\u3001\u3002\uff0c](?=[\u4e00-\u9fa5\u3042\u30a2])"
)
CUT_EVERY = 1 << 20


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def cuts(text: str, at: re.Pattern = CUT) -> Iterator[str]:
    """Very long texts in slices, cut where pre-tokens end; together they are the whole text."""
    start = 0
    while len(text) - start > CUT_EVERY:
        found = at.search(text, start + CUT_EVERY)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


class Encoder(dict):
    """Maps a pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str, entries: int = 700_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the library takes these strings out of a text first, longest first
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.word_level = self.library.normalizer is not None
        self.pattern = WORD_LEVEL if self.word_level else BYTE_LEVEL
        self.entries = entries
        self.merge = self.library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        tokens = self.merged(piece)
        ids = self[piece] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def merged(self, piece: str) -> list:
        """The library's merges of one pre-token."""
        return self.merge(piece.encode().decode("latin-1").translate(BYTE_CHARS))

    def whole(self, text: str) -> bytes:
        """Straight from the library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bool:
        return not OTHER.search(text) and not any(s in text for s in self.specials)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a plain text, slice by slice."""
        if self.word_level:
            text = text.lower()
        for part in cuts(text):
            yield self.pattern.findall(part)

    def pieces_of_any(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text in any script, slice by slice, split by the library's own normalizer and
        pre-tokenizer, which know its character classes. The text holds no special token's string."""
        normalizer, split = self.library.normalizer, self.library.pre_tokenizer.pre_tokenize_str
        for part in cuts(text, CUT_SCRIPTS):
            if normalizer is not None:
                part = normalizer.normalize_str(part)
            yield [part[a:b] for _, (a, b) in split(part)]

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return self.whole(text)
        return b"".join(b"".join(map(self.__getitem__, pieces)) for pieces in self.pieces(text))


def encoder(file: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    encoders = held("encoders")
    if file not in encoders:
        encoders[file] = Encoder(file)
    return encoders[file]
