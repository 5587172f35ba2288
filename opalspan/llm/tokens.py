"""Encoding of whole texts, with the pieces between spaces encoded once per worker."""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers in each of its two generations for a word-level vocabulary, pieces and words for a
#: byte-level one, where as many pieces again are those met once, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 80
BYTE_PIECES, BYTE_WORDS = 160_000, 40_000


class Memo(dict):
    """key -> what `make` gives for it. Two generations bound what is remembered; a long key is made each time."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Proven(Memo):
    """The same, but a key enters the generations when it is met again: the many keys met once, of which as many are
    held apart, don't push out the others."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__(make, limit)
        self.once: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.once.pop(key, None)
            if value is None:
                value = self.make(key)
                if len(key) <= LONGEST:
                    if len(self.once) >= self.limit:
                        self.once = {}
                    self.once[key] = value
                return value
        self.keep(key, value)
        return value


def library(path: str):
    """The tokenizer of a file; the strings of its special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable letter: itself where it is one, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: A space in such a vocabulary.
_SPACE = _byte_letters()[32]
#: White space for one engine's \\s, not for the other's: a text with one of these is left to the library.
_ODD = "\x1c\x1d\x1e\x1f"

#: What ends a word of letters without the pattern.
STOPS = (".", ",")


def odd(text: str) -> bool:
    return any(c in text for c in _ODD)


class Matches:
    """Ids of a tokenizer's pre-tokens, each merged by the library's model, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, pattern: str, limit: int) -> None:
        import regex

        self.whole, self.find, self.letters = tokenizer, regex.compile(pattern).findall, _byte_letters()
        self.tokenize = tokenizer.model.tokenize
        self.words = Memo(self._merge, limit)

    def _merge(self, word: str) -> bytes:
        raw = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
        return array("I", [t.id for t in self.tokenize(raw.translate(self.letters))]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def by_library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


#: How the two vocabularies cut text before they merge.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def simple(piece: str) -> bool:
    """Latin letters without combining marks: nothing to compose, and one rule of lower case for every engine."""
    return piece.isascii() or max(piece) < "\u0250" and "\u0130" not in piece


#: The same for Arrow's functions: what a simple piece does not have, and matches of WORD_PATTERN that are not letters,
#: white space of any engine's \\s left out.
_NOT_SIMPLE = r"[^\x{00}-\x{12f}\x{131}-\x{24f}]"
_NO_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\x{09}-\x{0d}\x{20}\x{85}\x{a0}\pL\pN]+)"


def ragged(parts: list[bytes]) -> pa.ListArray:
    """Ids of each part, little-endian unsigned 32-bit integers, as a list."""
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<u4")))


def inner(lists: pa.ListArray, of: pa.ListArray) -> pa.ListArray:
    """Lists of places in `of` -> lists of what stands there, end to end."""
    got = of.take(lists.flatten())
    return pa.ListArray.from_arrays(got.offsets.take(pc.subtract(lists.offsets, lists.offsets[0])), got.values)


class WordEncoder:
    """For a tokenizer that drops white space and never joins across it: pieces between spaces are independent. Simple
    ones only need lower case and the pattern; the others are encoded by the library, whose letters may be fewer than
    another engine's."""

    def __init__(self, path: str) -> None:
        self.matches = Matches(library(path), WORD_PATTERN, REMEMBERED)
        self.words = Memo(self._word, REMEMBERED)

    def _word(self, word: str) -> bytes:
        """Ids of a match of the pattern, or of a piece that is not simple. ASCII letters stand for themselves in the
        vocabulary."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.matches.tokenize(word)]).tobytes()
        return self.matches._merge(word) if not word or simple(word) else self.matches.by_library(word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. Different pieces are cut once, their different words
        looked up once."""
        left = pc.match_substring_regex(texts, f"[{_ODD}]")
        pieces = pc.split_pattern(pc.if_else(left, "", texts), " ")
        each = pieces.flatten().dictionary_encode()
        ids = inner(pa.ListArray.from_arrays(pieces.offsets, each.indices), self._pieces(each.dictionary))
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        if left.true_count:
            at = np.flatnonzero(left)
            whole = [np.frombuffer(self.matches.by_library(t), "<u4") for t in texts.filter(left).to_pylist()]
            more = list(map(len, whole))
            flat = np.insert(flat, np.repeat(ends[at], more), np.concatenate(whole))
            sizes[at] += more
        return flat, sizes

    def _pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece."""
        hard = pc.match_substring_regex(pieces, _NOT_SIMPLE)
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(pc.invert(hard))), _NO_LETTERS, r" \1 "))
        if hard.true_count:
            # simple ones first, then the others whole; `place` leads back
            place = np.argsort(np.argsort(hard, kind="stable"))
            cut = pa.concat_arrays([cut, pa.ListArray.from_arrays(pa.array(np.arange(hard.true_count + 1), pa.int32()), pieces.filter(hard))]).take(pa.array(place))
        words = cut.flatten().dictionary_encode()
        return inner(pa.ListArray.from_arrays(cut.offsets, words.indices), ragged(list(map(self.words.__getitem__, words.dictionary.to_pylist()))))


def cuts(text: str) -> tuple[str, list[str]]:
    """A text for a byte-level pattern, which lets a word take one space before it: its part before the first space,
    and each later part with the space before it left out.

    Single spaces end no run of white space early, so each part, with its space, is cut by the pattern as in the
    whole text. A text with two spaces in a row, or one at its end, is one part.
    """
    if "  " in text or text.endswith(" "):
        return text, []
    first, *rest = text.split(" ")
    return first, rest


class ByteEncoder:
    """For a byte-level tokenizer whose pattern lets a word take one space before it."""

    def __init__(self, path: str) -> None:
        self.matches = Matches(library(path), BYTE_PATTERN, BYTE_WORDS)
        self.pieces = Proven(self._piece, BYTE_PIECES)

    def _piece(self, k: str) -> bytes:
        """Ids of a piece with the space before it; a word of letters is remembered as a piece alone."""
        if k.isalpha():
            if k.isascii():
                return array("I", [t.id for t in self.matches.tokenize(_SPACE + k)]).tobytes()
            return self.matches._merge(" " + k)
        if k[-1:] in STOPS and k[:-1].isalpha():
            return self.pieces[k[:-1]] + self.matches.words[k[-1]]
        return self.matches.encode(" " + k)

    def encode(self, text: str) -> bytes:
        if odd(text):
            return self.matches.by_library(text)
        first, rest = cuts(text)
        return b"".join([self.matches.encode(first), *map(self.pieces.__getitem__, rest)])


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """A worker keeps its encoder, with what it remembers, from task to task."""
    return WordEncoder(path)


@functools.lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
