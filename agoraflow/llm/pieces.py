"""Splitting many texts at once: by the public split pattern of byte-level vocabularies, or into words.

The pattern is applied to arrays of code points: runs of letters, of numbers, of white space and of all else are found
together for a whole slice of texts, and pieces begin where the pattern's matches do. Equal pieces are found by a hash
of each and then compared with each other code point by code point, so that no collision can mix two pieces up.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Code points in a slice, unless a text has more up to a place where it can be cut.
SLICE = 1 << 21
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: The characters with the property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


@functools.lru_cache(maxsize=1)
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each code point, and powers of the base for places within a piece."""
    return np.random.default_rng(7).integers(0, 1 << 63, 0x110000, np.uint64), np.cumprod(np.full(256, _BASE, np.uint64))


class Split(NamedTuple):
    """Pieces of a slice: the distinct ones as text, which of them each place has, and how many each text has."""

    distinct: list[str]
    which: np.ndarray
    counts: np.ndarray


def starts(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of some texts, which end at `ends`."""
    n = len(code)
    kind = kinds()[code]
    first = np.zeros(n + 1, bool)  # where texts begin
    first[0] = True
    first[ends] = True
    run = np.empty(n, bool)  # where runs of a kind begin
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:-1]
    begin = run.copy()
    at = np.flatnonzero(run)
    stop = np.append(at[1:], n)
    space = kind[at] == SPACE
    # white space before other text: its last character stands alone, or goes with what follows if it is a blank
    inner = space & ~first[stop]
    last = stop[inner] - 1
    begin[last] = True
    glued = last[code[last] == 32]
    begin[glued + 1] = False
    # an apostrophe by itself and the letters after it
    mark = at[(kind[at] == OTHER) & (stop - at == 1) & (code[at] == 39) & ~first[stop]]
    mark = mark[begin[mark]]
    if len(mark):
        c = np.append(code, [0, 0])
        room = ~first[np.minimum(mark + 2, n)]
        c1, c2 = c[mark + 1], np.where(room, c[mark + 2], 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        begin[mark[one | two] + 1] = False
        for some, size in ((one, 2), (two, 3)):
            after = mark[some] + size
            after = after[after < n]
            begin[after] = True  # what follows begins anew
    return np.flatnonzero(begin)


def distinct(code: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct pieces, which of them each piece is) for pieces of `size` code points from `at` on."""
    weights, powers = _weights()
    place = np.arange(len(code)) - np.repeat(at, size)
    h = weights[code] * powers[place & 255]
    total = np.add.reduceat(h, at) if len(at) else np.zeros(0, np.uint64)
    total = (total ^ (total >> np.uint64(29))) * _BASE + size.astype(np.uint64)
    found, which = np.unique(total, return_inverse=True)
    where = np.empty(len(found), np.int64)
    where[which] = np.arange(len(at))
    twin = where[which]
    same = size[twin] == size
    if same.all():
        shown = np.repeat(at[twin], size) + place
        same = code[shown] == code
    if not same.all():  # two pieces share a hash
        text = [code[a : a + s].tobytes() for a, s in zip(at.tolist(), size.tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(t, len(seen)) for t in text], np.int64)
        where = np.zeros(len(seen), np.int64)
        where[which[::-1]] = np.arange(len(at))[::-1]
    return where, which


def split(texts: list[str]) -> Split:
    """The pieces of some texts."""
    whole = "".join(texts)
    counts = np.zeros(len(texts), np.int64)
    if not whole:
        return Split([], np.zeros(0, np.int64), counts)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    at = starts(code, ends)
    size = np.diff(at, append=len(code))
    where, which = distinct(code, at, size)
    counts[:] = np.diff(np.searchsorted(at, ends), prepend=0)
    return Split([whole[a : a + s] for a, s in zip(at[where].tolist(), size[where].tolist(), strict=True)], which, counts)


@functools.lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and every byte with A-Z in lower case."""
    separators, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    separators[[9, 10, 11, 12, 13, 32]] = True
    lower[65:91] += 32
    return separators, lower


class Words(NamedTuple):
    """Words of a slice in UTF-8, A-Z in lower case: the distinct ones, which of them each place has, and how many each text has."""

    distinct: list[bytes]
    which: np.ndarray
    counts: np.ndarray


def words(texts: list[str]) -> Words:
    """The words of some texts."""
    separators, lower = _bytes()
    data = [t.encode() for t in texts]
    code = np.frombuffer(b" ".join(data), np.uint8)
    apart = separators[code]
    first = np.flatnonzero(~apart & np.append(True, apart[:-1])[: len(code)])
    if not len(first):
        return Words([], np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    stop = np.flatnonzero(apart & np.append(False, ~apart[:-1]))
    size = np.append(stop, len(code))[: len(first)] - first
    at = np.cumsum(size) - size
    letters = lower[code[~apart]]
    where, which = distinct(letters, at, size)
    spelt = letters.tobytes()
    ends = np.searchsorted(first, np.cumsum([len(d) + 1 for d in data]))
    return Words([spelt[a : a + s] for a, s in zip(at[where].tolist(), size[where].tolist(), strict=True)], which, np.diff(ends, prepend=0))


def cut(text: str, limit: int = SLICE) -> list[str]:
    """A text in parts of about `limit` characters, cut only before white space that follows other text, where no piece goes on."""
    out, at, n = [], 0, len(text)
    while n - at > limit:
        k = at + limit
        while k < n and not (ord(text[k]) in _WHITE and ord(text[k - 1]) not in _WHITE):
            k += 1
        out.append(text[at:k])
        at = k
    return [*out, text[at:]]


_WHITE = frozenset(WHITE)


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    """(first, last, texts): runs of texts of about `limit` characters together; a longer one comes by itself."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, k, held
            first, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, len(texts), held
