"""Token ids in shards, each a wavelet matrix: bit planes with rank and select.

A shard holds the ids of consecutive documents. Plane k has bit k of every id, from the highest down,
in the order that the planes above leave: after each plane the ids with a 0 go before those with a 1,
otherwise in their order. With the number of ones before every block of bits, the file answers which
id stands at a place, how often an id occurs before it, and where its k-th occurrence is, reading a
few bytes of each plane and decoding nothing else.

A shard is one row of a compressed Parquet table: its first document, ends of its documents, and the
planes. Documents are written in ascending doc_id order, nulls first; rows that repeat a doc_id keep
their own entries. A null text is empty and still gets its end id. No rows give no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.durable import new_folder
from .pretokens import BLOCK_CHARS, blocks, row_sums, splitter, word_ids
from .tables import text_of

END_ID = 2
# Ids of a shard; one document is never cut, so a long one may make a larger shard.
SHARD_TOKENS = 1 << 20
# Rows and bytes of texts that a task takes in at a time.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
# Bytes of a row group of the files, a few shards, and so what a reader takes at once.
GROUP_BYTES = 16 << 20
# Bits between two entries of a plane's rank directory.
RANK_BITS = 512

SHARDS = (
    "part int, shard int, n_tokens long, doc_ids array<long>, ends array<long>, "
    "planes array<struct<zeros: bigint, bits: binary, ranks: binary>>"
)


class WaveletMatrix:
    """Ids as bit planes, highest bit first."""

    def __init__(self, n: int, zeros: list[int], bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.bits, self.ranks = n, zeros, bits, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = ids.astype(np.uint16 if len(ids) == 0 or int(ids.max()) < 1 << 16 else np.uint32)
        width = max(int(ids.max(initial=0)).bit_length(), 1)
        zeros, bits, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            # A whole number of blocks, so that blocks can be counted without a look at the rest.
            packed = np.append(packed, np.zeros(-len(packed) % (RANK_BITS // 8), np.uint8))
            per_block = np.bitwise_count(packed.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint64)
            bits.append(packed)
            ranks.append(np.append(0, np.cumsum(per_block)).astype(np.uint64))
            zeros.append(int(len(ids) - ranks[-1][-1]))
            # By places, which numpy gathers faster than by masks.
            ids = np.concatenate([ids[np.flatnonzero(~ones)], ids[np.flatnonzero(ones)]])
        return cls(int(len(ids)), zeros, bits, ranks)

    @classmethod
    def from_row(cls, n: int, planes: list[dict]) -> WaveletMatrix:
        bits = [np.frombuffer(p["bits"], np.uint8) for p in planes]
        ranks = [np.frombuffer(p["ranks"], "<u8") for p in planes]
        return cls(n, [p["zeros"] for p in planes], bits, ranks)

    def planes(self) -> list[dict]:
        rows = zip(self.zeros, self.bits, self.ranks)
        return [{"zeros": z, "bits": b.tobytes(), "ranks": r.astype("<u8").tobytes()} for z, b, r in rows]

    def _bit(self, level: int, at: int) -> int:
        return int(self.bits[level][at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block = at // RANK_BITS
        rest = self.bits[level][block * RANK_BITS // 8 : (at + 7) // 8]
        tail = np.unpackbits(rest, bitorder="little", count=at - block * RANK_BITS) if len(rest) else rest
        return int(self.ranks[level][block]) + int(tail.sum())

    def _down(self, level: int, at: int, bit: int) -> int:
        ones = self._ones(level, at)
        return self.zeros[level] + ones if bit else at - ones

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(len(self.bits)):
            bit = self._bit(level, at)
            at = self._down(level, at, bit)
            value = value << 1 | bit
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        """Where the id's occurrences start in the last order, and where those before a place end."""
        start, end = 0, at
        for level in range(len(self.bits)):
            bit = token >> (len(self.bits) - 1 - level) & 1
            start, end = self._down(level, start, bit), self._down(level, end, bit)
        return start, end

    def rank(self, token: int, at: int | None = None) -> int:
        """Occurrences of an id before a place, or in all."""
        if token < 0 or token >> len(self.bits):
            return 0
        start, end = self._range(token, self.n if at is None else min(max(at, 0), self.n))
        return end - start

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of a plane's k-th bit of a kind, by binary search over the directory."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level]), dtype=np.uint64) * np.uint64(RANK_BITS) - self.ranks[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        size = RANK_BITS // 8
        inside = np.unpackbits(self.bits[level][block * size : (block + 1) * size], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, from 0; -1 if there are not so many."""
        if k < 0 or k >= self.rank(token):
            return -1
        at = self._range(token, 0)[0] + k
        for level in range(len(self.bits) - 1, -1, -1):
            bit = token >> (len(self.bits) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids: the planes from the lowest up, each undoing its own order."""
        values = np.zeros(self.n, np.uint16 if len(self.bits) <= 16 else np.uint32)
        for level in range(len(self.bits) - 1, -1, -1):
            ones = np.unpackbits(self.bits[level], bitorder="little", count=self.n).view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~ones)] = values[: self.zeros[level]]
            above[np.flatnonzero(ones)] = values[self.zeros[level] :] | values.dtype.type(1 << (len(self.bits) - 1 - level))
            values = above
        return values


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        cache = word_ids(path)
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, docs, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            matrix = WaveletMatrix.of(np.concatenate(ids))
            values = {
                "part": part, "shard": shard, "n_tokens": matrix.n, "doc_ids": docs,
                "ends": np.cumsum(np.concatenate(sizes)).tolist(), "planes": matrix.planes(),
            }
            return pa.RecordBatch.from_pylist([values], SCHEMA)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for rows, texts in blocks(batch.column("text"), min(BLOCK_CHARS, 2 * shard_tokens)):
                words = split.split(texts)
                found, lengths = cache.encode(words)
                per_text = row_sums(words.rows, lengths, len(texts))
                # The end id goes in behind each document.
                ids.append(np.insert(found, np.cumsum(per_text), end_id))
                sizes.append(per_text + 1)
                docs += keys[rows]
                total += len(ids[-1])
                if total >= shard_tokens:
                    yield row()
                    ids, sizes, docs, total, shard = [], [], [], 0, shard + 1
        if docs:
            yield row()

    return run


SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.struct([("zeros", pa.int64()), ("bits", pa.binary()), ("ranks", pa.binary())]))),
    ]
)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, texts go to Python in small parts; ten thousand of them at a time are held several times over on the way."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write docs (doc_id, text) as shards in ascending doc_id order; gives the folder.

    Rows are dealt out by ranges of doc_id, so shards are numbered by task and in it, and a task that
    is run again writes the same shards.
    """
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranged = ranged.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # A row is a shard, so the size of a group of rows is looked at after each.
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
    with small_batches(docs.sparkSession):
        ranged.mapInArrow(_shards(path, end_id, shard_tokens), SHARDS).write.options(compression="zstd", **groups).parquet(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder, one row each."""
    return spark.read.schema(SHARDS).parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            n = batch.column("n_tokens")[k].as_py()
            ids = WaveletMatrix.from_row(n, batch.column("planes")[k].as_py()).all().astype("<u4").tobytes()
            doc_ids, ends = batch.column("doc_ids")[k].values, batch.column("ends")[k].values.to_numpy()
            starts = np.append(0, ends[:-1])
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            part, shard = batch.column("part")[k].as_py(), batch.column("shard")[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ends), part, np.int32)), pa.array(np.full(len(ends), shard, np.int32)), doc_ids,
                    pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64()),
                ],
                ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): ids of all shards before each, by running totals over tasks and then in them."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("all", F.lit(0))
    earlier = W.partitionBy("all").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return sizes.join(parts, "part").select(
        "part", "shard", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("before")
    )


def document_rows(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    schema = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = shards.mapInArrow(_documents, schema).join(starts(shards), ["part", "shard"])
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _asked(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix.from_row(batch.column("n_tokens")[k].as_py(), batch.column("planes")[k].as_py())
                places = [matrix.select(token, i) for i in range(matrix.rank(token))]
                head = {"part": batch.column("part")[k].as_py(), "shard": batch.column("shard")[k].as_py()}
                yield pa.RecordBatch.from_pylist(
                    [head | {"at": at} for at in places], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("at", pa.int64())])
                )

    return run


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(place): where an id stands in the whole sequence, by rank and select in each shard."""
    found = shards.mapInArrow(_asked(token), "part int, shard int, at long")
    return found.join(starts(shards), ["part", "shard"]).select((F.col("at") + F.col("before")).alias("place"))
