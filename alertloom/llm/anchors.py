"""Sampled suffixes of byte strings: where they start, and hashes of what stands around them.

Every string of K bytes has one anchor: of the m-byte grams inside it the one with the least hash, the
last of equals. Equal strings have their anchors at equal places, so matches of K bytes or more can be
looked for at anchors alone, which are dozens of times fewer than bytes. The strings of one text that
share an anchor stand side by side: they are a run, and its context is the bytes they cover together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

GRAM = 40
# Bytes that are worked on together; places in them fit the low bits of a packed hash.
BLOCK = 1 << 20
_PLACE = np.uint64(BLOCK * 2 - 1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Tables:
    letters = mix(np.arange(1, 257, dtype=np.uint64))
    powers = np.cumprod(np.append(np.uint64(1), np.full(2 * BLOCK, _BASE)))
    inverses = np.cumprod(np.append(np.uint64(1), np.full(2 * BLOCK, _INVERSE)))


class Hashes:
    """Hashes of any stretch of a byte block, in constant time each."""

    def __init__(self, data: np.ndarray):
        if len(data) > 2 * BLOCK:
            raise ValueError(f"{len(data)} bytes are hashed at once, the tables reach to {2 * BLOCK}")
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_Tables.letters[data] * _Tables.powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * _Tables.inverses[starts] + lengths * _BASE)


@dataclass
class Runs:
    """Runs of strings with one anchor: first and last string start, the anchor, and the text of each."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    text: np.ndarray


def pieces(texts: list[bytes], size: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Blocks of bytes with the texts in them: (number of the text, its place in the block, its offset, length).

    A text longer than a block comes in stretches that overlap by size - 1, so each string of that size
    is in one of them.
    """
    held, parts, total = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - size + 1, 1), BLOCK - size + 1):
            part = text[at : at + BLOCK]
            if total + len(part) > BLOCK:
                yield b"".join(held), parts
                held, parts, total = [], [], 0
            parts.append((k, total, at, len(part)))
            held.append(part)
            total += len(part)
    if parts:
        yield b"".join(held), parts


def runs(hashes: Hashes, parts: list[tuple[int, int, int, int]], size: int, gram: int = GRAM) -> Runs:
    """The runs of a block's texts; numbers of texts are places in parts."""
    n = len(hashes.sums) - 1
    window = size - gram + 1
    if n < size:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    starts = np.arange(n - gram + 1)
    packed = (hashes.of(starts, starts + gram) & ~_PLACE) | (_PLACE - starts.astype(np.uint64))
    # Least of each window: from minima up to and from the cuts between windows' lengths.
    filled = np.concatenate([packed, np.full(-len(packed) % window, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, window)
    up_to = np.minimum.accumulate(filled, axis=1).ravel()
    onward = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[: n - size + 1], up_to[window - 1 : window - 1 + n - size + 1])
    anchors = (_PLACE - (least & _PLACE)).astype(np.int64)
    owner = np.full(n - size + 1, -1, np.int32)
    for k, (_, at, _, length) in enumerate(parts):
        owner[at : max(at + length - size + 1, at)] = k
    new = np.append(True, (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    inside = owner[first] >= 0
    first, last = first[inside], last[inside]
    return Runs(first, last, anchors[first], owner[first].astype(np.int64))
