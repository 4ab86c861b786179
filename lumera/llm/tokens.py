"""Token ids of whole texts, fast enough for a corpus.

The tokenizers library encodes every distinct word once per Python worker; texts
are then put together from the words' ids. A byte-level BPE with the usual word
pattern never merges across a single space between two visible characters, so a
text may be cut there, each word keeping its leading space. Texts with other runs
of white space are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Words kept by one worker; more are encoded again when they come.
MAX_WORDS = 400_000
#: Pieces kept beside them.
MAX_PIECES = 20_000
#: Words of more characters are not kept.
LONG_WORD = 40
#: Fixed value: what the usual byte-level pre-tokenizer takes as a piece.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII, spelled out for the faster standard module.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def default_tokenizer() -> str:
    """Path of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer file, special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def byte_letters() -> list[str]:
    """The visible letter that byte-level BPE writes for each byte: itself if it has one, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + others.index(b)) for b in range(256)]


class _Words(dict):
    """Ids of words that follow a space, made when first asked for; None for those that can't be cut off."""

    def __init__(self, tokenizer, max_words: int) -> None:
        self.tokenizer, self.max_words = tokenizer, max_words
        setup = json.loads(tokenizer.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.plain = sys.byteorder == "little" and setup["normalizer"] is None and setup["model"]["type"] == "BPE" and usual.items() <= (setup["pre_tokenizer"] or {}).items()
        self.added = [x["content"] for x in setup["added_tokens"]]
        shown = byte_letters()
        self.space, self.letters, self.pattern, self.ascii = shown[0x20], {b: shown[b] for b in range(256)}, regex.compile(PIECES), re.compile(ASCII_PIECES)
        self.pieces: dict[str, bytes] = {}
        self.stops = {c: self.whole(c) for c in ".,;:!?|)"} if self.plain else {}
        self.model = tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # the words kept here serve instead
            self.model._resize_cache(0)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of one piece that the pre-tokenizer would make, by the library's model."""
        shown = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def make(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if not self.plain or any(a in word for a in self.added):
            return self.whole(" " + word)
        if word.isalpha():
            if word.isascii():
                return array("I", [t.id for t in self.model.tokenize(self.space + word)]).tobytes()
            return self.piece(" " + word)
        stop = self.stops.get(word[-1])
        if stop and word[:-1].isalpha():  # letters and a stop are two pieces
            return self[word[:-1]] + stop
        found = []
        for p in (self.ascii if word.isascii() else self.pattern).findall(" " + word):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(self.pieces) < MAX_PIECES and len(p) <= LONG_WORD:
                    self.pieces[p] = ids
            found.append(ids)
        return b"".join(found)

    def __missing__(self, word: str) -> bytes | None:
        ids = self.make(word)
        if len(self) < self.max_words and len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer, max_words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in order."""
        words = self.words
        cut = [t.split(" ") for t in texts]
        firsts = self.tokenizer.encode_batch([p[0] for p in cut], add_special_tokens=False)
        for text, parts, first in zip(texts, cut, firsts, strict=True):
            begin = parts.pop(0)
            try:
                rest = b"".join(map(words.__getitem__, parts))
                odd = bool(parts) and begin[-1:].isspace()
            except TypeError:  # white space that can't be cut at single spaces
                odd = True
            yield words.whole(text) if odd else np.array(first.ids, dtype="<u4").tobytes() + rest


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters or a single text each."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
