"""Encoding with the tokenizers library, each distinct piece of text once a worker.

A text is cut at spaces where the tokenizer cuts for certain; the ids of each chunk between two cuts come
from a table, or else from the ids of its pre-tokens, and only pre-tokens that are not in theirs go to the
library's model. Tables stop growing at a fixed number of entries, which bounds a worker's memory.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from itertools import chain

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Most entries of a worker's tables.
PIECES, MIDS, HEADS = 250_000, 750_000, 20_000
_CUT = re.compile(r"(?<=\S)(?= )")
_PLAIN = re.compile("[\t\n\x21-\x7e\xa1-\xac\xae-\xff]*")


def unicode_space(pattern: str) -> str:
    """The pattern with \\s as White_Space, which is what the tokenizers take it for."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def pre_tokens(split, lead: str, chunk: str) -> list[str]:
    """split(lead + chunk); letters alone, and letters before one mark, need no pattern."""
    if chunk.isalpha():
        return [lead + chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
        return [lead + chunk[:-1], chunk[-1]]
    return split(lead + chunk)


_SPACED = regex.compile(unicode_space(public_tokenizers.PATTERN)).findall


def spaced_pre_tokens(lead: str, chunk: str) -> list[str]:
    """Matches of public_tokenizers.PATTERN in lead + chunk; lead: a space or nothing."""
    return pre_tokens(_SPACED, lead, chunk)


def cut(texts: list[str], known: dict | frozenset = frozenset(), spaced: bool = True) -> tuple[list[list[str]], set[str], set[str]]:
    """Chunks of each text, the first as it is and the others without the space before them; the distinct
    chunks that are not known; and those of them that are empty or end in white space.

    Pre-tokens that keep their space are only cut for certain between a character that is no white space and
    a space: a text with other spaces is cut with a pattern.
    """
    parts = [t.split(" ") for t in texts]
    new: set[str] = set()
    for p in parts:
        new.update(set(p).difference(known))
    ends: set[str] = set()
    if spaced:
        ends = {c for c in new if not c or c[-1].isspace()}
        for k, p in enumerate(parts):
            if not ends.isdisjoint(p) and (not ends.isdisjoint(p[1:-1]) or (len(p) > 1 and p[0] and p[0] in ends)):
                again = _CUT.split(texts[k])
                parts[k] = [again[0], *(c[1:] for c in again[1:])]
                new.update(set(parts[k]).difference(known))
        ends = {c for c in new if not c or c[-1].isspace()}
    return parts, new, ends


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


class Memo(dict):
    """Values of a function; it stops growing at `limit` keys, and never keeps keys that `passing` is true of."""

    def __init__(self, limit: int, compute, passing=None):
        super().__init__()
        self.limit, self.compute, self.passing = limit, compute, passing

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if not (self.passing and self.passing(key)) and len(self) < self.limit:
            self[key] = value
        return value


class CachedEncoder:
    """ids of texts as little-endian uint16 bytes; the vocabulary must have at most 65536 ids.

    Added tokens such as <|endoftext|> that stand in a text are one id each, as in the library's plain call."""

    def __init__(self, file: str, spaced: bool, room: float = 1.0):
        self.library = Tokenizer.from_file(file)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        assert not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in self.library.get_added_tokens_decoder().values())
        self.added = {content: array("H", [i]).tobytes() for content, i in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.library.encode_special_tokens = True  # texts are cut at added tokens before they get there
        assert self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.model = self.library.model
        self.spaced = spaced
        # lower case, spaces dropped
        self.split = regex.compile(unicode_space(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")).findall
        self.doubtful = False  # a chunk was empty or ends in white space: the cut after it may be wrong
        piece = self.pieces = Memo(int(PIECES * room), self._of_piece)
        self.heads = Memo(int(HEADS * room), lambda c: b"".join(map(piece.__getitem__, self.pre_tokens("", c))), self._is_doubtful)
        self.lead = " " if spaced else ""
        self.lead_letter = self.lead.translate(_LETTERS)
        self.mids = Memo(int(MIDS * room), self._of_mid, self._is_doubtful)

    def _of_piece(self, piece: str) -> bytes:
        """One pre-token by the library's model; text that must be normalised first, by the whole library."""
        if self.spaced or piece.isascii() or _PLAIN.fullmatch(piece):
            return array("H", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        return array("H", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _of_mid(self, chunk: str) -> bytes:
        """A later chunk, with the space before it. Letters of ASCII are one pre-token, and with one mark after them two."""
        if chunk.isascii() or self.spaced:
            if chunk.isalpha():
                if chunk.isascii():
                    return array("H", [t.id for t in self.model.tokenize(self.lead_letter + (chunk if self.spaced else chunk.lower()))]).tobytes()
            elif chunk and chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return self.mids[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pre_tokens(self.lead, chunk)))

    def _is_doubtful(self, chunk: str) -> bool:
        if not chunk or chunk[-1].isspace():
            self.doubtful = True
            return True
        return False

    def pre_tokens(self, lead: str, chunk: str) -> list[str]:
        """Pieces of text whose ids, one after another, are those of lead + chunk."""
        if self.spaced:
            return spaced_pre_tokens(lead, chunk)
        if not chunk.isascii() and not _PLAIN.fullmatch(chunk):
            return [chunk]
        return pre_tokens(self.split, "", chunk.lower())

    def _join(self, parts: list[str]) -> bytes:
        return self.heads[parts[0]] + b"".join(map(self.mids.__getitem__, parts[1:]))

    def _encode(self, text: str) -> bytes:
        self.doubtful = False
        ids = self._join(text.split(" "))
        if self.doubtful and self.spaced:  # cut where it is certain instead
            first, *rest = _CUT.split(text)
            ids = self._join([first, *(c[1:] for c in rest)])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.at_added and any(content in text for content in self.added):
                parts = self.at_added.split(text)  # every other part is an added token
                out.append(b"".join(self.added[p] if k & 1 else self._encode(p) if p else b"" for k, p in enumerate(parts)))
            else:
                out.append(self._encode(text))
        return out


@cache
def encoder(name: str, room: float = 1.0) -> CachedEncoder:
    """One for each worker. name: a file of public_tokenizers, or a path. room: share of the tables' usual size."""
    file = name if "/" in name else public_tokenizers.path(name)
    return CachedEncoder(file, "byte" in name.rpartition("/")[2], room)
