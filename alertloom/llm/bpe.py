"""BPE encoding over a distinct-word table, and decoding by an id-to-piece join.

Tasks split their documents into words and number the distinct ones of a group of documents, so a
document becomes a list of word numbers. Each group sends its distinct words to buckets of words by
their hash. In a bucket the words of all groups meet, each distinct word is encoded once, and its ids
go back to the groups that hold it, where they take the words' places. A word is moved once per group
of documents, not once per occurrence, and the word table is never broadcast.

A group is named by a digest of its word list, so its documents and its words, which are two uses of
one split, fit whichever attempt of a task made them; a group without its words fails the job. `docs`
must give its rows in the same order each time, as a table that is read does.

Nulls and empty texts give no ids. Rows that are repeated are encoded like any other. Columns to
keep are named by the caller and may have any names but `ids`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .pretokens import Words, blocks, gather, row_sums, splitter

GROUP_CHARS = 8_000_000
# Buckets of words; more would only cut what a group sends into smaller pieces.
MAX_BUCKETS = 4_096
# The pieces go to every task: a vocabulary is a file of fixed size, and this is its bound.
MAX_VOCABULARY = 1 << 20


class _Numbers:
    """Numbers for the distinct words of one group, in the order they turn up."""

    def __init__(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words: list[str] = []

    def of(self, words: Words) -> np.ndarray:
        names, hashes, codes = words.distinct()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            numbers = np.arange(len(self.words), len(self.words) + len(new))
            self.words += [names[k] for k in new.tolist()]
            everything = np.append(self.hashes, hashes[new])
            order = np.argsort(everything, kind="stable")
            self.hashes, self.numbers = everything[order], np.append(self.numbers, numbers)[order]
        return self.numbers[np.searchsorted(self.hashes, hashes)][codes].astype(np.uint32)

    def name(self) -> str:
        digest = hashlib.blake2b(digest_size=16)
        for word in self.words:
            digest.update(f"{len(word)}:{word}".encode())
        return digest.hexdigest()


def _pack(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses small numbers well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _pack_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    sizes = np.fromiter(map(len, coded), "<u4", len(coded)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(coded)).tobytes() + sizes + b"".join(coded))


def _unpack_words(packed: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))).tolist()
    return [raw[a:b].decode() for a, b in zip([4 + 4 * n, *ends], ends)]


def _grouped(path: str, carry: int, group_chars: int, give):
    """Splits documents and gives out each group's rows or words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        numbers, kept, sizes, codes, chars = _Numbers(), [], [], [], 0
        for batch in batches:
            rows = pa.StructArray.from_arrays([batch.column(f"k{i}") for i in range(carry)], [f"k{i}" for i in range(carry)])
            for part, texts in blocks(batch.column("text")):
                words = split.split(texts)
                kept.append(rows.slice(part.start, len(texts)))
                sizes.append(np.bincount(words.rows, minlength=len(texts)))
                codes.append(numbers.of(words))
                chars += len(words.text)
                if chars >= group_chars:
                    yield give(numbers, kept, sizes, codes)
                    numbers, kept, sizes, codes, chars = _Numbers(), [], [], [], 0
        if kept:
            yield give(numbers, kept, sizes, codes)

    return run


def _give_rows(numbers: _Numbers, kept: list, sizes: list, codes: list) -> pa.RecordBatch:
    rows = pa.concat_arrays(kept)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([numbers.name()]),
            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            pa.array([_pack(np.concatenate(sizes))], pa.binary()),
            pa.array([_pack(np.concatenate(codes))], pa.binary()),
        ],
        ["group", "rows", "sizes", "codes"],
    )


def _give_words(buckets: int):
    def give(numbers: _Numbers, kept: list, sizes: list, codes: list) -> pa.RecordBatch:
        name, found = numbers.name(), []
        by_number = np.empty(len(numbers.words), np.uint64)
        by_number[numbers.numbers] = numbers.hashes
        bucket_of = (by_number % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket_of, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1):
            # An empty group still has a row, so that its documents find it.
            bucket = int(bucket_of[some[0]]) if len(some) else 0
            found.append((name, bucket, _pack(some), _pack_words([numbers.words[k] for k in some.tolist()])))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["group", "bucket", "numbers", "words"])

    return give


def _word_ids(path: str):
    """The word table of a task's buckets: each distinct word is encoded when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        place: dict[str, int] = {}
        flat, ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                words = _unpack_words(batch.column("words")[k].as_py())
                new = [w for w in words if w not in place]
                if new:
                    place.update(zip(new, range(len(place), len(place) + len(new))))
                    ids, sizes = split.encode(new)
                    flat, ends = np.append(flat, ids), np.append(ends, ends[-1] + np.cumsum(sizes))
                at = np.fromiter((place[w] for w in words), np.int64, len(words))
                sizes = ends[at + 1] - ends[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("group").slice(k, 1),
                        batch.column("numbers").slice(k, 1),
                        pa.array([_pack(sizes)], pa.binary()),
                        pa.array([_pack(gather(flat, ends[at], sizes))], pa.binary()),
                    ],
                    ["group", "numbers", "sizes", "ids"],
                )

    return run


def _in_places(names: Sequence[str]):
    """Ids of each row of a group from its word numbers and the ids of the words."""

    def run(groups: pa.Table, words: pa.Table) -> pa.Table:
        parts = [[_unpack(v.as_py()) for v in words.column(c)] for c in ("numbers", "sizes", "ids")]
        numbers, counts, flat = [np.concatenate([np.zeros(0, np.uint32), *p]) for p in parts]
        numbers, counts = numbers.astype(np.int64), counts.astype(np.int64)
        sizes = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        offsets = np.zeros(len(sizes), np.int64)
        sizes[numbers], offsets[numbers] = counts, np.cumsum(counts) - counts
        columns, ids, ends, total = [], [], [], 0
        for k in range(groups.num_rows):
            rows = groups.column("rows")[k].values
            per_row, codes = _unpack(groups.column("sizes")[k].as_py()), _unpack(groups.column("codes")[k].as_py())
            if len(codes) and (not len(sizes) or int(codes.max()) >= len(sizes)):
                raise ValueError("a group came without its words: the documents were not read alike twice")
            at = np.append(0, np.cumsum(per_row.astype(np.int64)))
            for a in range(0, len(per_row), 500):
                b = min(a + 500, len(per_row))
                part = codes[at[a] : at[b]]
                ids.append(gather(flat, offsets[part], sizes[part]).astype(np.int32))
                owners = np.repeat(np.arange(b - a), per_row[a:b])
                ends.append(total + np.cumsum(row_sums(owners, sizes[part], b - a)))
                total = int(ends[-1][-1])
            columns.append(rows)
        whole = pa.concat_arrays(columns)
        every = np.concatenate([np.zeros(1, np.int64), *ends])
        listed = pa.LargeListArray.from_arrays(pa.array(every), pa.array(np.concatenate(ids)))
        return pa.Table.from_arrays([*whole.flatten(), listed.cast(pa.list_(pa.int32()))], [*names, "ids"])

    return run


def encode(docs: DataFrame, path: str, carry: Sequence[str] = ("doc_id",), group_chars: int = GROUP_CHARS) -> DataFrame:
    """The carried columns and `ids`, one row per row of docs: the ids of its whole text."""
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], "text")
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    rows = T.StructType([T.StructField("group", T.StringType()), T.StructField("rows", T.ArrayType(T.StructType(fields)))])
    groups = named.mapInArrow(
        _grouped(path, len(carry), group_chars, _give_rows), rows.add("sizes", T.BinaryType()).add("codes", T.BinaryType())
    )
    buckets = min(MAX_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = named.mapInArrow(
        _grouped(path, len(carry), group_chars, _give_words(buckets)), "group string, bucket int, numbers binary, words binary"
    )
    back = words.repartition("bucket").mapInArrow(_word_ids(path), "group string, numbers binary, sizes binary, ids binary")
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    placed = (
        groups.groupBy("group")
        .cogroup(back.groupBy("group"))
        .applyInArrow(_in_places([f"k{i}" for i in range(len(carry))]), out)
    )
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], "ids")


def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, in id order."""
    split = splitter(path)
    size = split.tokenizer.get_vocab_size(with_added_tokens=True)
    if size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {size} pieces is over the bound of {MAX_VOCABULARY}")
    # Byte-level pieces spell bytes as printable characters: these stand for themselves, the rest from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}
    names = [split.tokenizer.id_to_token(i) or "" for i in range(size)]
    return [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names]


class Pieces:
    """The id-to-piece table as one stretch of bytes, for joins inside a task."""

    def __init__(self, listed: Sequence[bytes]):
        self.sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(listed), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The pieces of known ids in their order; ids outside the table have none."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return gather(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


# Rows that are decoded together.
_SLICE = 256


def _lists(batch: pa.RecordBatch, column: str = "ids") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the ids of their rows; null ids are empty."""
    for at in range(0, batch.num_rows, _SLICE):
        part = batch.slice(at, _SLICE)
        lists = part.column(column)
        flat = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy().tolist()
        valid = lists.is_valid().to_pylist()
        yield part, [flat[a:b] if there else flat[:0] for a, b, there in zip(ends, ends[1:], valid)]


def _with(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], [*part.schema.names, *columns])


def decode(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Adds `decoded`: the pieces of each row's `ids`, joined by id and read as UTF-8.

    The piece table has a bounded size and is joined map-side. Null ids decode to an empty text. With
    digest, `n_tokens` and `ids_sha256`, over the ids as little-endian unsigned 32-bit integers, take
    the place of `ids`, so that the ids need not be moved once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces(path))
        for batch in batches:
            for part, ids in _lists(batch):
                texts = pa.array([table.joined(i).decode("utf-8", "replace") for i in ids], pa.string())
                if not digest:
                    yield _with(part, decoded=texts)
                    continue
                digests = pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string())
                yield _with(part.drop_columns(["ids"]), decoded=texts, n_tokens=pa.array([len(i) for i in ids], pa.int64()), ids_sha256=digests)

    fields = [*encoded.schema.fields, T.StructField("decoded", T.StringType())]
    if digest:
        fields = [f for f in fields if f.name != "ids"] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]
    return encoded.mapInArrow(run, T.StructType(fields))
