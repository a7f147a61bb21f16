"""Word and shingle hashes of many texts at once, over NumPy arrays.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII, after lower-casing. A
shingle is five words in a row; a text of one to four words has one shingle, of all its words; a text
without words has none. Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .common import SHINGLE_WORDS

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LETTER = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


SYMBOL = numbers(7, 256)
PLACE = numbers(11, 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the i and to the -i, modulo 2 to the 64, for i below n."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            line = np.full(n, b, dtype=np.uint64)
            line[0] = 1
            _powers[name] = np.cumprod(line)
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a sequence of 64-bit values: equal for equal spans, wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Hashes of all words of the texts; text k has those from offsets[k] to offsets[k + 1]."""

    hashes: np.ndarray
    offsets: np.ndarray


def words(texts: Sequence[str]) -> Words:
    raw = [x.lower().encode() for x in texts]
    data = np.frombuffer(b" ".join(raw).translate(LETTER) + b" ", dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = data != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    return Words(span_hashes(SYMBOL[data], starts, ends), np.searchsorted(starts, begins))


def shingle_hashes(w: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, first word of each) of all shingles, with repeats, in order."""
    n = np.diff(w.offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + w.offsets[:-1][owner]
    span = np.minimum(size, n)[owner]
    h = np.zeros(len(owner), dtype=np.uint64)
    if len(w.hashes):
        last = len(w.hashes) - 1
        for k in range(size):
            part = w.hashes[np.minimum(first + k, last)] * PLACE[k]
            h += part if (span > k).all() else np.where(span > k, part, np.uint64(0))
    return mixed(h + span.astype(np.uint64)), owner, first


#: Characters of text that are hashed at once; a longer text is hashed by itself.
CHUNK_CHARS = 1 << 18


def shingle_sets(texts: Sequence[str], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, ascending."""
    hashes, counts, begin, chars = [], [], 0, 0
    for k, x in enumerate(texts):
        if chars and chars + len(x) > CHUNK_CHARS:
            _add_sets(texts[begin:k], size, hashes, counts)
            begin, chars = k, 0
        chars += len(x)
    _add_sets(texts[begin:], size, hashes, counts)
    return np.concatenate(hashes), np.concatenate([[0], *counts]).cumsum().astype(np.int64)


def _add_sets(texts: Sequence[str], size: int, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
    h, owner, _ = shingle_hashes(words(texts), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    hashes.append(h[new])
    counts.append(np.bincount(owner[new], minlength=len(texts)))
