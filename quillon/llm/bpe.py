"""Byte-level BPE ids through the tokenizers library, with a per-process cache of pieces.

The library's own encode() spends most of its time on pre-tokenisation and alignment. Texts made of characters whose
class is beyond doubt are cut here instead, many at once, and each distinct piece goes to the library's BPE model once;
every other text goes whole to the library's encode().

The pre-tokenisation pattern of byte-level vocabularies takes contractions after an apostrophe; runs of letters, of
digits, or of other characters, each with a blank before it; and runs of white space, without the last one where more
text follows. Where its pieces begin follows from the classes of neighbouring characters, so whole arrays are cut.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each of the two generations of one worker process's cache, about 0.2 KB each, and characters of an entry at most.
CACHE, LONGEST = 300_000, 64
#: Characters of texts that are cut at once, about.
TOGETHER = 2_000_000

_held: dict[str, "Encoder"] = {}


_LETTER, _DIGIT, _OTHER, _SPACE, _END = range(5)
#: Stands between texts; no text that is cut here has it.
_STOP = "\0"


def _classes() -> tuple[np.ndarray, re.Pattern]:
    """The class of each character of a fixed range, and a search for any other character."""
    plain = [c for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)) if c != 0xAD]
    table = np.full(0x2060, _OTHER, np.uint8)
    for c in plain:
        table[c] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _OTHER)
    table[[9, 10, 13, 32]] = _SPACE
    table[ord(_STOP)] = _END
    return table, re.compile("[^\\t\\n\\r " + "".join(re.escape(chr(c)) for c in plain) + "]")


def _begins(chars: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts, each with _STOP behind it."""
    kind = table[chars]
    space = kind == _SPACE
    out = np.ones(len(chars), bool)
    out[1:] = kind[1:] != kind[:-1]
    out |= kind == _END
    solid = kind < _SPACE
    out[:-1] |= space[:-1] & solid[1:]  # the last of a run of white space before text
    out[1:] &= ~((chars[:-1] == 32) & solid[1:])  # which, if it is a blank, goes with the text
    for i in np.flatnonzero((chars[:-1] == 39) & out[:-1] & (kind[1:] == _LETTER)).tolist():
        size = _contraction(chars[i + 1 : i + 3])
        if size:
            out[i + 1 : i + 1 + size] = False
            out[i + 1 + size] = True
    return np.flatnonzero(out)


def _contraction(after: np.ndarray) -> int:
    """Letters that belong to an apostrophe before them."""
    text = "".join(map(chr, after.tolist()))
    return 1 if text[0] in "stmd" else 2 if text in ("re", "ve", "ll") else 0


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level BPE vocabularies use."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Cache(dict):
    """Ids of each piece. A full cache becomes the old generation, from which pieces that are met again come back."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
            if len(piece) > LONGEST:
                return got
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes, self.other = _classes()
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.table = str.maketrans(self.letters)
        self.blank = self.letters[" "]
        self.cache = _Cache(self._piece, cache)

    def _piece(self, piece: str) -> bytes:
        # the model works on a printable letter for each byte, which for most of ASCII is itself
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalnum():
            word = self.blank + word if word is not piece else word
        else:
            word = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _sure(self, text: str) -> bool:
        return not (self.other.search(text) or any(s in text for s in self.specials))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """encode() of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        sure = [self._sure(t) for t in texts]
        joined = "".join(t + _STOP for t, s in zip(texts, sure, strict=True) if s)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = _begins(chars, self.classes)
        stops = np.flatnonzero(chars[first] == 0)  # which pieces end a text
        data = joined.encode("utf-8")
        if len(data) != len(chars):
            width = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800)
            first = (np.cumsum(width) - width)[first]
        offsets = np.append(first, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cells = [b"" if p == _STOP else self.cache[p] for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        del chars, first, pieces, joined
        sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        table = np.frombuffer(b"".join(cells), "<u4")
        start = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = table[np.repeat(start[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = [0, *ends[stops].tolist()]
        out = memoryview(np.ascontiguousarray(ids)).cast("B")
        k = 0
        for text, s in zip(texts, sure, strict=True):
            if s:
                yield bytes(out[4 * bounds[k] : 4 * bounds[k + 1]])
                k += 1
            else:
                yield self._whole(text)


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder for each vocabulary file and process; of the last asked for, as to the size of its cache."""
    if path not in _held or _held[path].cache.size != cache:
        _held[path] = Encoder(path, cache)
    return _held[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
