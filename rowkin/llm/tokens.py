"""Token ids of whole texts with a public tokenizer file of the tokenizers library, caches in front of its BPE model.

Byte-level BPE never joins across a space that stands before a non-space, so a text may be encoded piece by piece
between such spaces and the pieces' ids joined. Pieces repeat, so each worker keeps those it has seen, and of new ones
the pretokens, which the library's model turns into ids. Texts with other white space after a space, and files of
another kind of tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import regex

END_ID = 0
#: 32-bit unsigned ids; little-endian wherever the byte order of the machine is.
_IDS = partial(array, "I") if sys.byteorder == "little" and array("I").itemsize == 4 else partial(np.array, dtype="<u4")
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pattern by which byte-level BPE splits texts.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Together(ValueError):
    """A piece that may belong to the white space before it: a space alone, or before white space."""


def together(piece: str) -> bool:
    return piece[:1] == " " and (len(piece) == 1 or piece[1].isspace())


class Encoder(dict):
    """Encodes texts into little-endian uint32 bytes; as a dict, the ids of the pieces seen so far. ``cache_pieces`` bounds its memory, not the result.

    ``added_tokens``: an added token that a text spells out is that token, as the library has it by default; else it is text.
    """

    def __init__(self, path: str, added_tokens: bool = True, cache_pieces: int = 400_000, cache_length: int = 48):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.plain = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.letters, self.tokenize = byte_letters(), self.tokenizer.model.tokenize
        added = [re.escape(t["content"]) for t in kind.get("added_tokens") or () if added_tokens]
        self.added = re.compile("|".join(added)) if added else None
        self.cache_pieces, self.cache_length = cache_pieces, cache_length
        self.once, self.mask = bytearray(1 << 22), (1 << 22) - 1  # one byte for the hashes of pieces seen before
        self.marks = lru_cache(1024)(self._pretoken)

    def __missing__(self, piece: str) -> bytes:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) and len(piece) <= 1024:  # a word, what the pattern would find
            found = self._pretoken(piece)
        elif together(piece):
            raise Together(piece)
        else:
            found = self._encode(piece)
        at = hash(piece) & self.mask
        if not self.once[at]:  # most pieces that are seen once never come again
            self.once[at] = 1
        elif len(self) < self.cache_pieces and len(piece) <= self.cache_length:
            self[piece] = found
        return found

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that the text around it does not reach into."""
        return self._encode(piece) if together(piece) else self[piece]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pretoken(self, text: str) -> bytes:
        letters = "\u0120" + text[1:] if text[0] == " " and text.isascii() and text[1:].isalpha() else text.encode().decode("latin-1").translate(self.letters)
        return _IDS([t.id for t in self.tokenize(letters)]).tobytes()

    def _encode(self, piece: str) -> bytes:
        if "  " in piece or "\x00" in piece or len(piece) > 1024:
            return self._whole(piece)
        word = piece.rstrip(".,;:!?")
        if len(word) < len(piece) and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self[word] + self.marks(piece[len(word) :])
        return b"".join([self[x] if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else self.marks(x) for x in PRETOKEN.findall(piece)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; a null text has none."""
        if not text:
            return b""
        if not self.plain or "  " in text or "\x00" in text or (self.added and self.added.search(text)):
            return self._whole(text)
        try:
            return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00")))
        except Together:
            return self._whole(text)


def encoder(path: str, added_tokens: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = Encoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]


def slices(texts: list[str | None], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most_chars`` together, so that memory stays flat whatever the batch holds."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(texts: list[str | None], path: str, added_tokens: bool = True) -> Iterable[bytes]:
    """Ids of each text as bytes, in order."""
    return map(encoder(path, added_tokens).encode, texts)


def forget_pieces() -> None:
    """Empties the worker's memory of pieces, which outlives the tasks that encode: others call it as they begin, since they need the room for something else."""
    for own in _ENCODERS.values():
        own.clear()
