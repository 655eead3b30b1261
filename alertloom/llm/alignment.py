"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by divide and conquer at shared cuts.

A text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Where a token of each ends at the
same byte there is a shared cut. An interval of a text is split at a shared cut near its middle: the ends
of A's tokens are tried from the middle outwards, each is looked up among B's ends by bisection, and both
halves go on alike. An interval with no cut inside is a leaf: a group of A's tokens and a group of B's
that cover the same bytes and nothing smaller does. All intervals of a block of texts are at one depth of
the recursion together, so a step is one bisection of many ends.

The tokens that end together at a cut are a link; how often an id pair is linked in the whole corpus says
how well they correspond. Of two tokens that end together one is a suffix of the other, so a token has no
more pairs than bytes and the two vocabularies bound the table of pairs, whatever the corpus: it is
checked against that bound and sent to all tasks.

Words are encoded once per worker and found again by hash. For B a word is a run of blanks and what
follows it up to the next blank; that is exact as no piece holds a blank behind anything else, which is
checked when the vocabulary is read.

Defined cases. A null or empty text, and one whose tokens do not spell a blank and the text byte for byte
(as B reads U+2581 as a blank), has no tokens. Special strings inside texts are plain text. Rows that
repeat are aligned each and count each; an empty table gives no rows. Carried columns may have any
names but those of the results. Of cuts equally near the middle the one before it is taken, which changes
nothing in the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import Pieces, pieces
from .pretokens import BLOCK_CHARS, LONG_WORD, Splitter, WordCache, Words, blocks, row_sums
from .tables import text_of

# A piece's sign for a blank.
_BLANK = "▁"


class ByteTokens:
    """A byte-level tokenizer file whose special strings are plain text."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.split.specials = {}
        self.bytes = pieces(path)

    def words(self, texts: Sequence[str]) -> Words:
        return self.split.split(texts)

    def make(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.split.encode(words)


class PieceTokens:
    """A piece tokenizer file, word by word."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        joined = [name for name in names if _BLANK in name.lstrip(_BLANK)]
        if joined:
            raise ValueError(f"{len(joined)} pieces hold a blank inside, so words cannot be encoded apart: {joined[:3]}")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(_BLANK, " ").encode() for k, n in enumerate(names)]
        self._lone = self.model.piece_to_id(_BLANK)
        mixed = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        self._mixed = mixed ^ (mixed >> np.uint64(31))
        base = 0xD6E8FEB86659FD93
        self._base, self._inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._powers = self._inverses = np.ones(1, np.uint64)

    def words(self, texts: Sequence[str]) -> Words:
        """Words of texts that each start with a blank."""
        text = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        blank = points == 32
        start = blank & ~np.append(False, blank[:-1])
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)[: len(starts)]
        rows = np.repeat(np.arange(len(texts)), sizes)[starts]
        if len(self._powers) <= n:
            grown = np.full(max(n, BLOCK_CHARS) + 1, self._base)
            grown[0] = 1
            self._powers = np.cumprod(grown)
            grown[1:] = self._inverse
            self._inverses = np.cumprod(grown)
        sums = np.append(np.uint64(0), np.cumsum(self._mixed[points] * self._powers[:n]))
        hashes = (sums[ends] - sums[starts]) * self._inverses[starts]
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[k] = int.from_bytes(hashlib.blake2b(text[starts[k] : ends[k]].encode(), digest_size=8).digest(), "little")
        return Words(text, starts, ends, rows, hashes, sizes)

    def make(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; a word that its ids do not spell has none, so that its text falls short."""
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        for k, word in enumerate(words):
            if len(word) == 1:
                found[k] = [self._lone]
            if b"".join([self.bytes[i] for i in found[k]]) != word.encode():
                found[k] = []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes


class Side:
    """Tokens of blocks of texts by one tokenizer."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens.bytes), np.int64, len(tokens.bytes))
        self.cache = WordCache(None, make=tokens.make, most=300_000)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row of each)."""
        words = self.tokens.words(texts)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, sizes = self.cache.encode(words)
        return ids, np.repeat(words.rows, sizes)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """Both tokenizers of a worker process."""
    return Side(ByteTokens(path_a)), Side(PieceTokens(path_b))


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places in ends_a of the cuts that end_b shares, by divide and conquer.

    Ends are byte places that rise over all texts of a block; heads has the first token of A of each text
    and the number of tokens of A. The last end of a text is always shared.
    """
    low, high = heads[:-1], heads[1:] - 1
    cuts = [high[high >= low]]
    # An interval is the tokens whose ends are inside it: [low, high), as the one at high is a cut already.
    low, high = low[high > low], high[high > low]
    while len(low):
        middle = (low + high) // 2
        found = np.full(len(low), -1)
        looking = np.arange(len(low))
        near, far = 0, 1
        while len(looking):
            # Ends at distances [near, far) of the middle, on both sides.
            lo, hi, mid = low[looking], high[looking], middle[looking]
            parts = []
            for a, b, sign in ((np.maximum(lo, mid - far + 1), np.maximum(mid - near + 1, lo), -1), (np.minimum(mid + max(near, 1), hi), np.minimum(mid + far, hi), 1)):
                count = np.maximum(b - a, 0)
                owner = np.repeat(np.arange(len(looking)), count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
                parts.append((owner, place, np.abs(place - mid[owner]) * 2 + (sign > 0)))
            owner, place, apart = (np.concatenate(c) for c in zip(*parts))
            at = np.searchsorted(ends_b, ends_a[place])
            shared = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[place]
            owner, place, apart = owner[shared], place[shared], apart[shared]
            order = np.lexsort((apart, owner))
            owner, place = owner[order], place[order]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            found[looking[owner[first]]] = place[first]
            # What has been tried to both ends without a cut is a leaf.
            more = (found[looking] < 0) & ((mid - far >= lo) | (mid + far < hi))
            looking, near, far = looking[more], far, far * 2
        cut = found >= 0
        cuts.append(found[cut])
        low, high = np.concatenate([low[cut], found[cut] + 1]), np.concatenate([found[cut], high[cut]])
        low, high = low[high > low], high[high > low]
    return np.sort(np.concatenate(cuts))


class _Block:
    """Aligned texts of a block: ids, groups and links."""

    def __init__(self, texts: Sequence[str], a: Side, b: Side):
        n = len(texts)
        spaced = [" " + t if t and _BLANK not in t else "" for t in texts]
        sizes = np.fromiter((len(t.encode()) for t in spaced), np.int64, n)
        (ids_a, rows_a), (ids_b, rows_b) = a.encode(spaced), b.encode(spaced)
        whole = (row_sums(rows_a, a.sizes[ids_a], n) == sizes) & (row_sums(rows_b, b.sizes[ids_b], n) == sizes)
        self.a, rows_a = ids_a[whole[rows_a]], rows_a[whole[rows_a]]
        self.b, rows_b = ids_b[whole[rows_b]], rows_b[whole[rows_b]]
        self.n_a, self.n_b = np.bincount(rows_a, minlength=n), np.bincount(rows_b, minlength=n)
        ends_a, ends_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        # Places of the last token of each group.
        self.cut_a = shared_cuts(ends_a, ends_b, np.append(0, np.cumsum(self.n_a)))
        self.cut_b = np.searchsorted(ends_b, ends_a[self.cut_a])
        self.n_groups = np.bincount(rows_a[self.cut_a], minlength=n)

    def links(self, pieces_b: int) -> np.ndarray:
        """The id pair that ends at each cut, as one number."""
        return (self.a[self.cut_a].astype(np.uint64) * np.uint64(pieces_b) + self.b[self.cut_b]).astype(np.uint64)


def _digits(most: int) -> np.ndarray:
    """Decimal digits of the numbers below `most` as right-aligned bytes, zeros before them."""
    width = len(str(max(most - 1, 1)))
    numbers = np.arange(most)
    table = np.zeros((most, width), np.uint8)
    for k in range(width):
        table[:, width - 1 - k] = np.where((numbers >= 10**k) | (k == 0), numbers // 10**k % 10 + 48, 0)
    return table


def listed_groups(block: _Block, digits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(`a1,a2|b1;a3|b2,b3` of all texts one after the other, a semicolon behind each group; length of each text's)."""
    groups = len(block.cut_a)
    in_a, in_b = np.diff(block.cut_a, prepend=-1), np.diff(block.cut_b, prepend=-1)
    before = np.cumsum(in_a + in_b) - (in_a + in_b)
    # Each group's tokens of A, then those of B.
    at_a = np.arange(len(block.a)) - np.repeat(np.cumsum(in_a) - in_a, in_a) + np.repeat(before, in_a)
    at_b = np.arange(len(block.b)) - np.repeat(np.cumsum(in_b) - in_b, in_b) + np.repeat(before + in_a, in_b)
    rows = np.zeros((len(at_a) + len(at_b), digits.shape[1] + 1), np.uint8)
    rows[at_a, :-1], rows[at_b, :-1] = digits[block.a], digits[block.b]
    rows[:, -1] = ord(",")
    rows[(before + in_a - 1)[:groups], -1] = ord("|")
    rows[(before + in_a + in_b - 1)[:groups], -1] = ord(";")
    there = rows != 0
    per_token = there.sum(axis=1)
    ends = np.append(0, np.cumsum(per_token))
    token_ends = np.cumsum(block.n_a + block.n_b)
    return rows[there].tobytes(), np.diff(ends[token_ends], prepend=0)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _aligned(path_a: str, path_b: str, carry: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        digits = _digits(max(len(a.sizes), len(b.sizes)))
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, texts in blocks(batch.column("text")):
                block = _Block(texts, a, b)
                part = batch.slice(rows.start, len(texts))
                columns = {f"k{i}": part.column(f"k{i}") for i in range(carry)}
                columns |= {"n_a": pa.array(block.n_a), "n_b": pa.array(block.n_b), "n_groups": pa.array(block.n_groups)}
                if digest:
                    written, lengths = listed_groups(block, digits)
                    ends = np.cumsum(lengths)
                    shown = [hashlib.sha256(written[e - n : e - 1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), lengths.tolist())]
                    links = block.links(len(b.sizes)).astype("<u4")
                    last = np.cumsum(block.n_groups).tolist()
                    packed = [press.compress(links[e - n : e].tobytes()) if n else b"" for e, n in zip(last, block.n_groups.tolist())]
                    columns |= {"groups_sha256": pa.array(shown, pa.string()), "links": pa.array(packed, pa.binary())}
                else:
                    heads_a = np.repeat(np.cumsum(block.n_a) - block.n_a, block.n_groups)
                    heads_b = np.repeat(np.cumsum(block.n_b) - block.n_b, block.n_groups)
                    columns |= {
                        "a_ids": _lists(block.a, block.n_a),
                        "b_ids": _lists(block.b, block.n_b),
                        "a_ends": _lists(block.cut_a + 1 - heads_a, block.n_groups),
                        "b_ends": _lists(block.cut_b + 1 - heads_b, block.n_groups),
                    }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, carry: Sequence[str] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The carried columns, n_a, n_b and n_groups, and the groups of every row of docs.

    Groups are `a_ids` and `b_ids`, all tokens, with `a_ends` and `b_ends`, how many tokens there are up to
    the end of each group. With digest the text form of the groups as a SHA-256 (empty without tokens) and
    the `links`, packed for link_counts and scored, take their place, so that the ids need not be moved.
    """
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], text_of().alias("text"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    if digest:
        fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())]
    else:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids", "a_ends", "b_ends")]
    out = named.mapInArrow(_aligned(path_a, path_b, len(carry), digest), T.StructType(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], *[f.name for f in fields[len(carry) :]])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(links of all rows, number of each row)."""
    open_ = zstandard.ZstdDecompressor()
    found = [np.frombuffer(open_.decompress(v), "<u4") if v else np.zeros(0, np.uint32) for v in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))


def _sizes(path_b: str) -> int:
    return len(sides_b(path_b).bytes)


@lru_cache(maxsize=2)
def sides_b(path: str) -> PieceTokens:
    return PieceTokens(path)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs, each once; the vocabularies bound how many it holds."""
    pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            links, _ = _unpacked(batch.column("links").slice(at, 2_000))
            new, n = np.unique(links, return_counts=True)
            pairs, code = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(code, weights=np.concatenate([counts, n])).astype(np.int64) if len(pairs) else counts
    yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])


def link_counts(found: DataFrame, path_b: str) -> DataFrame:
    """(a, b, n): how often each id pair is linked in all rows of aligned(..., digest=True)."""
    pieces_b = _sizes(path_b)
    sums = found.select("links").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select(F.expr(f"cast(pair div {pieces_b} as int)").alias("a"), (F.col("pair") % pieces_b).cast("int").alias("b"), "n")


def most_pairs(path_a: str, path_b: str) -> int:
    """More pairs cannot be linked: a token and its suffixes have one for each of its bytes."""
    return sum(map(len, pieces(path_a))) + sum(map(len, sides_b(path_b).bytes))


def scored(found: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of aligned(..., digest=True) with n_links, n_best and count_sum in place of `links`.

    A link is one of the best if no other pair with its B id has a higher count.
    """
    pieces_b, spark = _sizes(path_b), found.sparkSession
    table = counts.toArrow()
    if table.num_rows > most_pairs(path_a, path_b):
        raise ValueError("more id pairs than two vocabularies can link")
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    pair = a * pieces_b + b
    highest = np.zeros(pieces_b, np.int64)
    np.maximum.at(highest, b, n)
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order].astype(np.uint32), n[order], (n == highest[b])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                links, sizes = _unpacked(part.column("links"))
                rows, place = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(known, links)
                ends = np.append(0, np.cumsum(times[place]))
                last = np.cumsum(sizes)
                total = ends[last] - ends[last - sizes]
                kept = part.drop_columns(["links"])
                columns = [pa.array(sizes), pa.array(np.bincount(rows[best[place]], minlength=len(sizes))), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "n_links", "n_best", "count_sum"])

    fields = [f for f in found.schema.fields if f.name != "links"] + [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")]
    return found.mapInArrow(run, T.StructType(fields))
