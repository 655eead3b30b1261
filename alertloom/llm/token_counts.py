"""Exact token counts at every prefix of a text, by dynamic programming over its words.

The ids of a BPE word end, at each prefix, in the one token that is compatible with what ends where it
starts: two neighbouring tokens are compatible if encoding their joined text gives just them. So the
count at a prefix is one more than the count where its last token starts, and all prefixes of a word
cost one pass. Counts of a text add up over its words. Budget and truncation questions are then reads
of a stored array. Positions are characters of the text as the tokenizer normalizes it; where that
keeps the number of characters, as it does for nearly all texts, they are those of the text itself.

A null text counts as empty: no tokens, an empty array.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .pretokens import Splitter, WordCache, blocks, splitter
from .tables import text_of

# Fixed value: the mark of a word's last symbol.
WORD_END = "</w>"
_CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])


class PrefixCounter:
    """Token counts at each character of a word, for a vocabulary that marks word ends."""

    def __init__(self, split: Splitter):
        model = json.loads(split.tokenizer.to_str())["model"]
        if model["end_of_word_suffix"] != WORD_END:
            raise ValueError("a vocabulary with word ends is needed")
        self._split = split
        self._ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        # Tokens inside a word, and at its end by what they spell.
        self._inner = frozenset(t for t in model["vocab"] if not t.endswith(WORD_END))
        self._final = {t.removesuffix(WORD_END): t for t in model["vocab"] if t.endswith(WORD_END)}
        self._longest = max(map(len, [*self._inner, *self._final]))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self._spelled = [spelled[b] for b in range(256)]
        self._made = {a + b: ((a, b), k) for (a, b), k in reversed(self._ranks.items())}
        self._edges: tuple[dict, dict] = ({}, {})
        self._own: dict[str, bool] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        # Of the last word: its text, the last token and the count at each place, and the counts at its ends.
        self._state: tuple[str, list[str], list[int], list[int]] = ("", [""], [0], [])

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(self._ranks.get(pair, 1 << 30) for pair in zip(symbols, symbols[1:]))
            if best == 1 << 30:
                break
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and self._ranks.get((symbols[k], symbols[k + 1])) == best:
                    out.append(symbols[k] + symbols[k + 1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def _stands(self, token: str) -> bool:
        """Whether encoding the piece's own text gives just it."""
        found = self._own.get(token)
        if found is None:
            letters = list(token.removesuffix(WORD_END))
            if token.endswith(WORD_END):
                letters[-1] += WORD_END
            found = self._own[token] = self._merged(letters) == [token]
        return found

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The symbols that stand at one edge of a token while it is merged: (symbol, rank it is made at, rank it goes at)."""
        found = self._edges[side].get(token)
        if found is None:
            found, gone = [], 1 << 30
            while True:
                pair, rank = self._made.get(token, (None, -1))
                found.append((token, rank, gone))
                if pair is None:
                    break
                token, gone = pair[side], rank
            self._edges[side][found[0][0]] = found
        return found

    def _fit(self, before: str, token: str) -> bool:
        """Whether encoding the two pieces' joined text gives just them; before is empty at a word's start.

        It does unless some symbol at the end of the one and some at the start of the other stand there
        at the same time and merge. Of equal merges the left one comes first.
        """
        found = self._fits.get((before, token))
        if found is None:
            found = self._stands(token)
            if before and found:
                for left, made, gone in self._edge(before, 1):
                    for right, made_too, gone_too in self._edge(token, 0):
                        rank = self._ranks.get((left, right), -1)
                        if made < rank < gone and made_too < rank <= gone_too:
                            found = False
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[before, token] = found
        return found

    def word(self, word: str) -> list[int]:
        """Counts at each character of one word, each as if the text ended there."""
        if word in self._split.specials:
            return [len(self._split.tokenizer.encode(word[: k + 1], add_special_tokens=False).ids) for k in range(len(word))]
        if word in _CONTRACTIONS:
            # Cut short, its letters are a word of their own behind the apostrophe.
            return [1, *[1 + c for c in self.word(word[1:-1])], self._run(word)[-1]]
        return self._run(word)

    def _run(self, word: str) -> list[int]:
        """Counts of a word; what it shares with the word before it is not worked out again."""
        fits, fit, inner, final, longest = self._fits, self._fit, self._inner, self._final, self._longest
        if word.isascii() and word.isprintable() and " " not in word:
            text, stops = word, None
        else:
            chars = ["".join([self._spelled[b] for b in c.encode()]) for c in word]
            text, stops = "".join(chars), set(accumulate(map(len, chars)))
        before, last, counts, ends = self._state
        shared = 0
        for one, two in zip(before, text):
            if one != two:
                break
            shared += 1
        del last[shared + 1 :], counts[shared + 1 :], ends[shared:]
        for i in range(shared + 1, len(text) + 1):
            first = i - longest if i > longest else 0
            # Tokens that could end here, longest first; the first that fits is the only one that does.
            for j in range(first, i):
                token = text[j:i]
                if token in inner:
                    pair = (last[j], token)
                    found = fits.get(pair)
                    if found if found is not None else fit(*pair):
                        last.append(token)
                        counts.append(counts[j] + 1)
                        break
            if stops is not None and i not in stops:
                ends.append(0)
                continue
            for j in range(first, i):
                token = final.get(text[j:i])
                if token is not None:
                    pair = (last[j], token)
                    found = fits.get(pair)
                    if found if found is not None else fit(*pair):
                        ends.append(counts[j] + 1)
                        break
        self._state = (text, last, counts, ends)
        return list(ends) if stops is None else [c for c in ends if c]

    def words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts at each character of the words one after the other, characters of each)."""
        listed: list[list[int]] = [[]] * len(words)
        # In this order words stand beside those that start alike.
        for k in sorted(range(len(words)), key=words.__getitem__):
            listed[k] = self.word(words[k])
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        return np.fromiter(chain.from_iterable(listed), np.uint32, int(sizes.sum())), sizes


def _after_specials(counter: PrefixCounter, words, at: np.ndarray, whole: np.ndarray) -> None:
    """Counts inside a special string whose cut-off start runs on from the word before it."""
    encode = counter._split.tokenizer.encode
    for special in counter._split.specials:
        for k in np.flatnonzero((words.ends - words.starts) == len(special)).tolist():
            a, b = words.starts[k], words.ends[k]
            if k and words.text[a:b] == special and words.ends[k - 1] == a and words.rows[k - 1] == words.rows[k]:
                before = words.text[words.starts[k - 1] : a]
                if before not in counter._split.specials:
                    base = int(whole[a - 1]) - len(encode(before, add_special_tokens=False).ids)
                    for p in range(a, b - 1):
                        at[p] = base + len(encode(before + words.text[a : p + 1], add_special_tokens=False).ids)


def prefix_counts(docs: DataFrame, path: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, `n_bytes` and `counts`: the number of tokens at each character, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        counter = PrefixCounter(split)
        cache = WordCache(split, counter.words)
        for batch in batches:
            for part, texts in blocks(batch.column("text")):
                words = split.split(texts)
                inside, sizes = cache.encode(words)
                ends_at = np.zeros(len(words.text), np.int64)
                if len(sizes):
                    ends_at[words.ends - 1] = inside[np.cumsum(sizes) - 1]
                whole = np.cumsum(ends_at)
                counts = whole.copy()
                if len(sizes):
                    before = np.where(words.starts > 0, whole[words.starts - 1], 0)
                    offsets = np.cumsum(sizes) - sizes
                    places = np.arange(len(inside)) + np.repeat(words.starts - offsets, sizes)
                    counts[places] = np.repeat(before, sizes) + inside
                    _after_specials(counter, words, counts, whole)
                limits = np.append(0, np.cumsum(words.lengths))
                heads = np.where(limits[:-1] > 0, whole[np.maximum(limits[:-1] - 1, 0)], 0) if len(whole) else 0 * limits[:-1]
                counts -= np.repeat(heads, words.lengths)
                listed = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(counts.astype(np.int32)))
                kept = [batch.column(f"k{i}").slice(part.start, part.stop - part.start) for i in range(len(carry) + 1)]
                yield pa.RecordBatch.from_arrays([*kept, listed], [*[f"k{i}" for i in range(len(carry) + 1)], "counts"])

    bytes_ = F.octet_length(text_of()).cast("long").alias(f"k{len(carry)}")
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], bytes_, text_of().alias("text"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([*fields, T.StructField(f"k{len(carry)}", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    counted = named.mapInArrow(run, schema)
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate((*carry, "n_bytes"))], "counts")


def tokens_in(counts: Column, chars: Column | None = None) -> Column:
    """Tokens of the first `chars` characters, or of the whole text."""
    place = F.size(counts) if chars is None else F.least(chars, F.size(counts))
    return F.when(place > 0, F.try_element_at(counts, place)).otherwise(F.lit(0)).cast("long")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    whole = F.size(counts)
    fits = F.filter(F.sequence(whole, F.lit(1)), lambda p: F.element_at(counts, p) <= budget)
    cut = F.when(tokens_in(counts) <= budget, whole).otherwise(F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0)))
    return cut.cast("long")
