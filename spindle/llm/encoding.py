"""Exact token ids from the tokenizers library, a bounded number of units remembered per worker.

A text is cut only where the vocabulary's own pre-tokenizer always cuts, so the ids of the units
in a row are the ids of the text. Words repeat: a unit is encoded once and then looked up. The strings
of added tokens are cut out first, as the library does, and have their own ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: The id that ends a document, and the units' patterns. Latin letters not followed by
#: another letter or a mark end a pre-token; so does white space. \x1c-\x1f count as text, as there.
END_ID = 2
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_WORD = rf"[{_LATIN}]+(?![^\W\d_]|[̀-\U0010ffff])"
_SOLID, _SPACE = r"(?:\S|[\x1c-\x1f])", r"[^\S\x1c-\x1f]"
UNITS = {
    "byte_bpe_50k.json": rf" ?{_WORD}| ?{_SOLID}+|{_SPACE}+(?!{_SOLID})|{_SPACE}",
    "word_bpe_49k.json": rf"{_WORD}|{_SOLID}+",
}


def _around(units: str, added: str) -> str:
    """The units of a text that is first cut at the added tokens' strings: each is a unit, no other unit
    runs into one, and it ends what stands before as the end of a text does."""
    apart = units.replace(f"{_SOLID}+", f"(?:(?!{added}){_SOLID})+").replace(f"(?!{_SOLID})", f"(?:(?!{_SOLID})|(?={added}))")
    return f"{added}|{apart}"


#: A unit of this form is one pre-token, which the vocabulary's model can take by itself.
LETTERS = re.compile(rf" ?[{_LATIN}]+")
#: Texts of these characters may be lower-cased as a whole where the vocabulary lower-cases.
BEYOND_LATIN = re.compile(r"[^\x00-įı-ɏ]")
#: Byte-level vocabularies spell a byte that is not printable as the next free code point from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLED = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
SPACE = chr(SPELLED[0x20])
#: Units that a worker remembers at most (twice as many while it changes over), and their length.
KNOWN_UNITS, LONGEST_UNIT = 300_000, 64


class _Known(dict):
    """unit -> its ids, little-endian unsigned 32-bit."""

    def __init__(self, tokenizer, lower: bool, added: dict[str, int]) -> None:
        self.tokenizer, self.model, self.lower, self.older = tokenizer, tokenizer.model, lower, {}
        self.added = {string: struct.pack("<I", i) for string, i in added.items()}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= KNOWN_UNITS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(unit) or self.added.get(unit)
        if ids is None:
            word = unit.lower() if self.lower else unit
            if word.isascii() and word.isalpha():
                found = [t.id for t in self.model.tokenize(word)]
            elif word[0] == " " and word.isascii() and word[1:].isalpha():
                found = [t.id for t in self.model.tokenize(SPACE + word[1:])]
            elif LETTERS.fullmatch(unit):
                spelled = word.encode().decode("latin-1").translate(SPELLED)
                found = [t.id for t in self.model.tokenize(spelled)]
            else:
                found = self.tokenizer.encode(unit, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        return ids


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        units = UNITS.get(os.path.basename(path)) if plain else None
        # Of another vocabulary the whole text is the unit.
        self.pattern = self.pattern_around = re.compile(units) if units else None
        self.lower = os.path.basename(path) == "word_bpe_49k.json"
        self.known = _Known(self.tokenizer, self.lower, self.added) if units else None
        #: How far ahead of a unit's end it may depend on the text.
        self.reach = max([1, *map(len, self.added)])
        if units and self.added:
            self.pattern_around = re.compile(_around(units, f"(?:{'|'.join(map(re.escape, self.added))})"))

    def finder(self, text: str) -> re.Pattern:
        """What finds the units of this text, of each where it is."""
        return self.pattern_around if any(t in text for t in self.added) else self.pattern

    def ids(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        if self.pattern is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finder = self.finder(text)
        if self.lower and not BEYOND_LATIN.search(text):
            lowered = text.lower()
            if finder is self.finder(lowered) is self.pattern:  # no string of an added token comes about
                text = lowered
        return b"".join(map(self.known.__getitem__, finder.findall(text)))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.ids, texts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
