"""Near-duplicates by SimHash, found with pigeonring filtering.

A fingerprint's 64 bits are four segments in a ring. If two fingerprints differ in at most three bits,
then from some segment on every chain of consecutive segments keeps within its share of the budget:
no difference in the first, at most one in the first two, two in three, three in four. So they share a
first segment exactly and a second up to one bit: each fingerprint is put under its own 32 bits from
each of the four starts, and under those in which one 0 of the second segment is a 1. Of two that
differ there, one has the 0, so they meet. In a bucket the rest of the chain is checked before the
full distance, and instead of all pairs a spanning forest of the bucket's links is given out.

Equal fingerprints are one before this starts, so groups of copies, however large, cost a row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.durable import written_once
from .components import components
from .pretokens import blocks
from .tables import text_of

# Shingle size, hash seed and the number of bits in which linked fingerprints may differ.
SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 4
SEGMENT_BITS = 16
# Differing bits that a chain of one to four segments may have: the whole parts of its shares.
CHAIN_BUDGETS = tuple(k * MAX_BITS // SEGMENTS for k in range(1, SEGMENTS + 1))
# Fingerprints that are compared in one task at a time; larger buckets are cut into pairs of parts.
BUCKET_ROWS = 4_096


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is in over half the hashes of the text's shingles; 0 without words."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    last = max(len(words) - size + 1, 1)
    ends = (starts + lengths)[size - 1 :] if len(words) >= size else np.array([len(joined)])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends.tolist())), np.uint64, last)
    counts = np.zeros(64, np.int64)
    for at in range(0, last, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",), size: int = SHINGLE_WORDS) -> DataFrame:
    """The carried columns and `fingerprint`, a signed 64-bit integer; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, size) for _, texts in blocks(batch.column("text")) for text in texts]
            kept = [batch.column(f"k{i}") for i in range(len(carry))]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*kept, prints], [*[f"k{i}" for i in range(len(carry))], "fingerprint"])

    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], text_of().alias("text"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    out = named.mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], "fingerprint")


def _turned(value, by: int):
    """The ring seen from another segment."""
    return value if not by else (value << np.uint64(by)) | (value >> np.uint64(64 - by))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fingerprint, own) rows: four of a fingerprint's own, and one for each 0 of a second segment."""
    for batch in batches:
        every = batch.column("fingerprint").to_numpy().view(np.uint64)
        for at in range(0, len(every), 10_000):
            prints = every[at : at + 10_000]
            buckets, owners, own = [], [], []
            for start in range(SEGMENTS):
                head = _turned(prints, start * SEGMENT_BITS) >> np.uint64(32)
                # Two bits for the start are laid over the 32 of the segments.
                mark = np.uint64(start) << np.uint64(32)
                buckets.append(head | mark), owners.append(prints), own.append(np.ones(len(prints), bool))
                for bit in range(SEGMENT_BITS):
                    flag = np.uint64(1 << bit)
                    unset = (head & flag) == 0
                    buckets.append((head | flag | mark)[unset]), owners.append(prints[unset]), own.append(np.zeros(int(unset.sum()), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(own))],
                ["bucket", "fingerprint", "own"],
            )


def _linked(start: int, one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which pairs pass the chain from a start on and then the full distance."""
    apart = _turned(one[:, None] ^ many[None, :], start * SEGMENT_BITS)
    differing, within = np.zeros(apart.shape, np.uint8), np.ones(apart.shape, bool)
    for k in range(SEGMENTS):
        segment = (apart >> np.uint64(64 - SEGMENT_BITS * (k + 1))) & np.uint64((1 << SEGMENT_BITS) - 1)
        differing += np.bitwise_count(segment)
        within &= differing <= CHAIN_BUDGETS[k]
    return within


def _forest(n: int, links: np.ndarray) -> list[int]:
    """Of links (k, 2) those that join what was apart."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(links.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return kept


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        members, own = batch.column("members"), batch.column("owns")
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            prints = members[k].values.to_numpy().view(np.uint64)
            mine = own[k].values.to_numpy(zero_copy_only=False)
            start = (bucket >> 32) & 3
            at = np.flatnonzero(mine)
            found = []
            for a in range(0, len(at), 512):
                part = at[a : a + 512]
                i, j = np.nonzero(_linked(start, prints[part], prints))
                keep = part[i] != j
                found.append(np.stack([part[i][keep], j[keep]], axis=1))
            links = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            links = links[_forest(len(prints), links)]
            left.append(prints[links[:, 0]]), right.append(prints[links[:, 1]])
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _whole_buckets(entries: DataFrame, limit: int) -> DataFrame:
    """(bucket, members, owns): the members of each bucket that holds a possible pair.

    A bucket over the limit is cut into parts by a hash of the fingerprint, and each pair of parts
    is a row, so no task holds all of a large bucket and every two of its members still meet.
    """
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n > 1 AND n_own > 0")
    large = written_once(sizes.where(F.col("n") > limit).select("bucket", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "large-buckets")
    gathered = [F.collect_list("fingerprint").alias("members"), F.collect_list("own").alias("owns")]
    if large.isEmpty():
        whole = entries.groupBy("bucket").agg(*gathered)
    else:
        parted = entries.join(large, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.coalesce("parts", F.lit(1))))
        every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        pairs = F.transform(every, lambda other: F.struct(F.least("part", other).alias("x"), F.greatest("part", other).alias("y")))
        whole = parted.select("bucket", "fingerprint", "own", F.explode(pairs).alias("pair")).groupBy("bucket", "pair").agg(*gathered)
    return whole.select("bucket", "members", "owns").where((F.size("members") > 1) & F.exists("owns", lambda o: o))


def links(prints: DataFrame, limit: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect all that are within three bits."""
    entries = prints.select("fingerprint").mapInArrow(_entries, "bucket long, fingerprint long, own boolean")
    return _whole_buckets(entries, limit).mapInArrow(_bucket_links, "a long, b long").distinct()


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fingerprint, component): the smallest key that each fingerprint's rows can reach through links.

    Keys that are null count only where a component has no other.
    """
    distinct = written_once(prints.groupBy("fingerprint").agg(F.min(key).alias("first")), "fingerprints")
    reached = components(links(distinct)).withColumnRenamed("node", "fingerprint").withColumnRenamed("component", "class")
    joined = distinct.join(reached, "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint"))
    smallest = joined.groupBy("class").agg(F.min("first").alias("component"))
    return written_once(joined.join(smallest, "class").select("fingerprint", "component"), "fingerprint-classes")


def print_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs; the fingerprint is signed."""
    prints = written_once(fingerprints(docs, (key,)), "document-prints")
    return prints.join(classes(prints, key), "fingerprint").select(key, "fingerprint", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is their group's smallest, with their columns; groups are those of print_components.

    A null key is kept if its group has no other. Rows that repeat both key and text are one; rows that
    repeat a key with other texts stay as long as one of the texts is its group's.
    """
    found = print_components(docs, key)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("kept_key")).agg(F.count("*").alias("kept_rows"))
    # What is kept grows with the documents, so it is not sent to all tasks.
    joined = docs.alias("d").join(written_once(kept, "kept-keys").hint("merge").alias("k"), F.col(f"d.{key}").eqNullSafe(F.col("k.kept_key")))
    # Only rows of repeated keys are moved to be made one.
    once, again = joined.where("k.kept_rows = 1").select("d.*"), joined.where("k.kept_rows > 1").select("d.*")
    return once.unionByName(again.dropDuplicates([key, "text"]))


def as_hex(fingerprint_: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint_), 16, "0"))
