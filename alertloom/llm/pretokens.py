"""Splitting texts into the words a BPE tokenizer works on, a block of texts at a time in numpy.

Runs inside tasks. The character classes are asked of the tokenizers library itself, one code point
at a time as they turn up, so its Unicode tables are the ones that count.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

# Characters that are worked on together; a longer text is a block of its own.
BLOCK_CHARS = 500_000
# Words over this many characters are hashed one by one, as the vectorised hash is weak on long ones.
LONG_WORD = 256
# Words whose ids a worker keeps from task to task.
KNOWN_WORDS = 500_000

# Stands between words that are encoded together; a word that holds it is encoded alone.
_SEPARATOR = "\x00"
_TOGETHER = 2_000

_UNKNOWN, _LETTER, _NUMBER, _SPACE, _OTHER = range(5)
_CODE_POINTS = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Words:
    """Words of a block: their text, the half-open places in it, the row of each, and the length of each row."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray

    def distinct(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, their hashes, for each word its number among them)."""
        hashes, first, codes = np.unique(self.hashes, return_index=True, return_inverse=True)
        starts, ends = self.starts[first].tolist(), self.ends[first].tolist()
        return [self.text[a:b] for a, b in zip(starts, ends)], hashes, codes


class Splitter:
    """Words of one tokenizer file: byte-level with leading spaces, or lower-cased without white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        self.keeps_spaces = self.normalizer is None
        self._pre = self.tokenizer.pre_tokenizer
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Encodes words as they stand, many at a time: no normalizing, no special strings.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(_SEPARATOR, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self._cut = self.plain.encode(_SEPARATOR, add_special_tokens=False).ids[0]
        self._class = np.zeros(_CODE_POINTS, np.uint8)
        self._lower = np.arange(_CODE_POINTS, dtype=np.uint32)
        self._whole = np.zeros(_CODE_POINTS, bool)  # lower case is not one character
        mixed = np.arange(1, _CODE_POINTS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        self._mixed = mixed ^ (mixed >> np.uint64(32))
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _learn(self, points: np.ndarray) -> None:
        """Class and lower case of code points not met before."""
        for point in np.unique(points[self._class[points] == _UNKNOWN]).tolist():
            char = chr(point)
            if self.normalizer is not None:
                lower = self.normalizer.normalize_str(char)
                self._whole[point] = len(lower) != 1
                self._lower[point] = ord(lower) if len(lower) == 1 else point
            self._class[point] = self._classify(char)

    def _classify(self, char: str) -> int:
        pieces = self._pre.pre_tokenize_str
        if len(pieces("a" + char)) == 1 and (self.keeps_spaces or pieces(char)):
            return _LETTER
        if not self.keeps_spaces:
            if not pieces(char):
                return _SPACE
            # A number stands alone, other characters run together.
            return _NUMBER if len(pieces(char + char)) == 2 else _OTHER
        if len(pieces("1" + char)) == 1:
            return _NUMBER
        return _OTHER if len(pieces("!" + char)) == 1 else _SPACE

    def normalized(self, text: str) -> str:
        """The text before splitting; special strings are left to the caller."""
        return text if self.normalizer is None else self.normalizer.normalize_str(text)

    def _segments(self, texts: Sequence[str]) -> tuple[list[str], list[int], list[bool]]:
        """Stretches between special strings, and those strings, with the row of each."""
        parts, rows, special = [], [], []
        for row, text in enumerate(texts):
            if not any(s in text for s in self.specials):
                if text:
                    parts.append(text), rows.append(row), special.append(False)
                continue
            at = 0
            while at < len(text):
                found = [(text.find(s, at), -len(s), s) for s in self.specials if s in text[at:]]
                where, _, name = min(found) if found else (len(text), 0, "")
                if where > at:
                    parts.append(text[at:where]), rows.append(row), special.append(False)
                if name:
                    parts.append(name), rows.append(row), special.append(True)
                at = where + len(name)
        return parts, rows, special

    def split(self, texts: Sequence[str]) -> Words:
        """Words of each text, in order."""
        parts, rows, special = self._segments(texts)
        text = "".join(parts)
        if self.normalizer is not None and text:
            text, parts = self._lowered(text, parts, special)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            none = np.zeros(0, np.int64)
            return Words("", none, none, none, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64))
        self._learn(points)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[heads[sizes > 0]] = True
        kind = self._class[points]
        start = self._starts(points, kind, first)
        for k in np.flatnonzero(special).tolist():
            start[heads[k] + 1 : heads[k] + sizes[k]] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        if not self.keeps_spaces:
            solid = kind[starts] != _SPACE
            starts, ends = starts[solid], ends[solid]
        row_of = np.repeat(np.asarray(rows, np.int64), sizes)
        lengths = np.bincount(row_of, minlength=len(texts))
        return Words(text, starts, ends, row_of[starts], self._hash(text, points, starts, ends), lengths)

    def _lowered(self, text: str, parts: list[str], special: list[bool]) -> tuple[str, list[str]]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self._learn(points)
        if unicodedata.is_normalized("NFC", text) and not self._whole[points].any():
            lower = self._lower[points].tobytes().decode("utf-32-le")
            if any(special):
                at, kept = 0, []
                for part, is_special in zip(parts, special):
                    kept.append(part if is_special else lower[at : at + len(part)])
                    at += len(part)
                return "".join(kept), kept
            return lower, parts
        changed = [p if s else self.normalizer.normalize_str(p) for p, s in zip(parts, special)]
        return "".join(changed), changed

    def _starts(self, points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(points)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.keeps_spaces:
            # Of white space before a word the last character stands off; a blank joins the word.
            space = kind == _SPACE
            after = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:]) + 1
            start[after - 1] = True
            start[after] = points[after - 1] != 32
        else:
            start |= kind == _NUMBER
        # A lone apostrophe takes s, t, m, d, re, ve or ll with it.
        quote = np.flatnonzero(points[:-1] == 39)
        before = np.maximum(quote - 1, 0)
        alone = (first[quote] | (kind[before] != _OTHER) | (quote == 0)) & ~first[quote + 1] & (kind[quote + 1] == _LETTER)
        if self.keeps_spaces:
            alone &= first[quote] | (points[before] != 32)
        quote = quote[alone]
        one, next_ = points[quote + 1], np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[next_], points[next_], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        size = np.where(single, 2, np.where(double, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        end = quote + size
        start[end[end < n]] = True
        return start

    def _hash(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(points)
        if len(self._powers) <= n:
            grown = np.full(max(n, BLOCK_CHARS) + 1, _BASE)
            grown[0] = 1
            self._powers = np.cumprod(grown)
            grown[1:] = _BASE_INVERSE
            self._inverses = np.cumprod(grown)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._mixed[points] * self._powers[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self._inverses[starts]
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            word = text[starts[k] : ends[k]].encode()
            hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return hashes

    def encode(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of ids of each), as each stands between other words."""
        odd = [k for k, word in enumerate(words) if _SEPARATOR in word or word in self.specials]
        apart = {k: self._alone(words[k]) for k in odd}
        usual = [word for k, word in enumerate(words) if k not in apart] if apart else words
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(usual), _TOGETHER):
            some = usual[at : at + _TOGETHER]
            coded = self.plain.encode_batch_fast([_SEPARATOR.join(some)], add_special_tokens=False)[0]
            coded = np.array(coded.ids, np.uint32)
            cut = np.append(np.flatnonzero(coded == self._cut), len(coded))
            sizes.append(np.diff(cut, prepend=-1) - 1)
            ids.append(coded[coded != self._cut])
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        for k in odd:  # in ascending order, so the places before k are filled
            at = int(sizes[:k].sum())
            ids, sizes = np.insert(ids, at, apart[k]), np.insert(sizes, k, len(apart[k]))
        return ids, sizes

    def _alone(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        from tokenizers import pre_tokenizers

        several, self.plain.pre_tokenizer = self.plain.pre_tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        try:
            return self.plain.encode(word, add_special_tokens=False).ids
        finally:
            self.plain.pre_tokenizer = several


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One splitter per worker process and file."""
    return Splitter(path)


def blocks(column, chars: int = BLOCK_CHARS) -> Iterator[tuple[slice, list[str]]]:
    """(rows, their texts) of an Arrow column in parts of about so many bytes; each row is in one part, whole.

    Only one part is held as Python strings at a time. Nulls count as empty.
    """
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 100_000]), chars, "right")))
        yield slice(at, end), [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


class WordCache:
    """Numbers of words met in this worker, their ids by default, found by hash; emptied when it holds `most` words."""

    def __init__(self, split: Splitter, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None, most: int = 1_000_000):
        self.make, self.most = make or split.encode, most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.offsets = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return at, known

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words one after the other, how many each word has)."""
        if len(self.hashes) > self.most:
            self._clear()
        hashes, first, codes = np.unique(words.hashes, return_index=True, return_inverse=True)
        _, known = self._find(hashes)
        if not known.all():
            new = first[~known]
            spans = zip(words.starts[new].tolist(), words.ends[new].tolist())
            flat, sizes = self.make([words.text[a:b] for a, b in spans])
            everything = np.append(self.hashes, hashes[~known])
            order = np.argsort(everything, kind="stable")
            self.offsets = np.append(self.offsets, len(self.flat) + np.cumsum(sizes) - sizes)[order]
            self.sizes = np.append(self.sizes, sizes)[order]
            self.flat = np.append(self.flat, flat)
            self.hashes = everything[order]
        at, _ = self._find(hashes)
        at = at[codes]
        sizes = self.sizes[at]
        return gather(self.flat, self.offsets[at], sizes), sizes


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordCache:
    """One cache of words' ids per worker process and file: what a task has met the next one need not encode again."""
    return WordCache(splitter(path), most=KNOWN_WORDS)


def gather(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches flat[offset : offset + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    return flat[np.arange(total, dtype=np.int64) + np.repeat(offsets - (ends - sizes), sizes)]


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
