"""Exact repeats of K bytes and more, found with a logarithmic family of sampled suffix arrays.

A batch of texts gives a suffix array: the suffixes at its anchors (see anchors.py), each under the
hash of its gram and of its context, in their order, with the number of times it occurs. The index is
a family of such arrays. A new batch's array is merged with the level of its size, the result with the
next, as in a binary counter, so n batches are merged log n times. A dense array takes eight bytes and
more for each byte of text, many times the text itself; sampled suffixes are exact too, as every
string of K bytes has its anchor at the same place in it wherever it stands.

The scan of texts against the levels finds, of each run of strings with one anchor:
- its context occurs more than once: all its strings are repeats;
- its gram occurs in no other context: none is;
- else it is the edge of a match, or chance. The strings of the contexts of such a gram are compared by
  hash one by one: inside one row per gram, or, for a gram with very many contexts, in a grouping by
  string, so no task holds all contexts of a hot passage.
Hashes of gram and string or context together have 128 bits.

Texts are named by 128 bits of hash. A null text is empty. A text under K bytes loses nothing; of equal
texts of K bytes or more nothing is left. Rows that repeat are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.durable import written_once
from .anchors import BLOCK, Hashes, Runs, mix, pieces, runs
from .tables import text_of

SIZE = 200
# Batches that a whole table is indexed in.
BATCHES = 2
# Contexts of a gram that are compared in one row, some 3 MB of bytes; more are compared in a grouping of
# their strings.
GROUP_CONTEXTS = 8_192
# Bytes of contexts that a task compares at a time, whole grams always; it hashes a block of them at once.
GROUP_BYTES = 4 << 20
_TEXTS = 256

NAME = ("b1", "b2")


def named(docs: DataFrame) -> DataFrame:
    """(b1, b2, text): texts with their names."""
    text = text_of()
    return docs.select(F.xxhash64(text).alias("b1"), F.xxhash64(F.lit(1), text).alias("b2"), text.alias("text"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for at in range(0, batch.num_rows, _TEXTS):
        part = batch.slice(at, _TEXTS)
        yield part, [t.encode() for t in part.column("text").to_pylist()]


def _place(first: np.ndarray, found: Runs) -> np.ndarray:
    """First string start, strings in the run, and where in the first string the anchor is, in one number."""
    return (first << 20) | ((found.last - found.first) << 10) | (found.anchor - found.first)


def _contexts(hashes: Hashes, found: Runs, size: int) -> np.ndarray:
    shape = mix(((found.anchor - found.first).astype(np.uint64) << np.uint64(10)) | (found.last - found.first).astype(np.uint64))
    return hashes.of(found.first, found.last + size) ^ shape


def _entries(size: int):
    """(gram, context, b1, b2, place, n) of each run; equal texts met together are one with a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b1, b2 = (batch.column(c).to_numpy() for c in NAME)
            _, keep, times = np.unique(np.stack([b1, b2], axis=1), axis=0, return_index=True, return_counts=True)
            order = np.argsort(keep)
            keep, times = keep[order], times[order]
            distinct, at = batch.take(pa.array(keep)), 0
            for part, texts in _chunks(distinct):
                n = times[at : at + len(texts)]
                at += len(texts)
                one, two = (part.column(c).to_numpy() for c in NAME)
                for data, parts in pieces(texts, size):
                    hashes = Hashes(np.frombuffer(data, np.uint8))
                    found = runs(hashes, parts, size)
                    where = np.array(parts, np.int64).reshape(-1, 4)[found.text]
                    text = where[:, 0]
                    columns = [
                        _grams(hashes, found).view(np.int64),
                        _contexts(hashes, found, size).view(np.int64),
                        one[text],
                        two[text],
                        _place(found.first - where[:, 1] + where[:, 2], found),
                        n[text].astype(np.int64),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "context", *NAME, "place", "n"])

    return run


def _grams(hashes: Hashes, found: Runs) -> np.ndarray:
    from .anchors import GRAM

    return hashes.of(found.anchor, found.anchor + GRAM)


def entries(texts: DataFrame, size: int = SIZE) -> DataFrame:
    return texts.mapInArrow(_entries(size), "gram long, context long, b1 long, b2 long, place long, n long")


class Index:
    """Levels of suffix arrays (gram, context, n), the smallest last."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, texts: DataFrame) -> None:
        """Index a batch of named texts; levels of about one size are merged."""
        self._push(entries(texts, self.size).groupBy("gram", "context").agg(F.sum("n").alias("n")))
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (_, one), (_, two) = self.levels.pop(), self.levels.pop()
            self._push(one.unionByName(two).groupBy("gram", "context").agg(F.sum("n").alias("n")))

    def _push(self, rows: DataFrame) -> None:
        array = written_once(rows.sortWithinPartitions("gram", "context"), "suffix-array")
        self.levels.append((array.count(), array))

    def all(self) -> DataFrame:
        """(gram, context, n) over all levels."""
        first, *rest = [rows for _, rows in self.levels]
        if not rest:
            return first
        for rows in rest:
            first = first.unionByName(rows)
        return first.groupBy("gram", "context").agg(F.sum("n").alias("n"))

    def judged(self) -> DataFrame:
        """(gram, context, n, contexts) of contexts that occur more than once or share their gram with another."""
        everything = self.all()
        shared = everything.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
        return everything.join(shared, "gram", "left").where("n > 1 OR contexts > 1").select(
            F.col("gram").alias("g"), F.col("context").alias("c"), (F.col("n") > 1).alias("whole"), F.coalesce("contexts", F.lit(1)).alias("contexts")
        )


def _cut_out(size: int):
    """(gram, contexts, whole, b1, b2, place, bytes) of the runs a text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                rows = []
                for text, one, two, asked in zip(texts, part.column("b1").to_pylist(), part.column("b2").to_pylist(), part.column("asked").to_pylist()):
                    for a in asked:
                        first, more = a["place"] >> 20, a["place"] >> 10 & 1023
                        rows.append(a | {"b1": one, "b2": two, "data": text[first : first + more + size]})
                yield pa.RecordBatch.from_pylist(rows, _CUT)

    return run


_CUT = pa.schema(
    [("gram", pa.int64()), ("contexts", pa.int64()), ("whole", pa.bool_()), ("place", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("data", pa.binary())]
)
CUT = "gram long, contexts long, whole boolean, place long, b1 long, b2 long, data binary"


def _by_bytes(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring items of about so many bytes in all, at least one at a time."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        end = at + max(1, int(np.searchsorted(ends[at:] - done, most, "right")))
        yield slice(at, end)
        at = end


def _strings(datas: list[bytes], places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset from the run's first, hash) of every string of the rows' runs."""
    rows, offsets, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    every = np.fromiter(map(len, datas), np.int64, len(datas))
    for some in _by_bytes(every, BLOCK):
        data = np.frombuffer(b"".join(datas[some]), np.uint8)
        lengths = every[some]
        heads = np.cumsum(lengths) - lengths
        counts = lengths - size + 1
        row = np.repeat(np.arange(len(lengths)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = heads[row] + offset
        # Equal strings of one gram have it at one place in them; the place is part of what is compared.
        at = (places[some][row] & 1023) - offset
        rows.append(row + some.start), offsets.append(offset)
        found.append(Hashes(data).of(start, start + size) ^ mix(at.astype(np.uint64) + np.uint64(7)))
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(found)


def _spans(row: np.ndarray, offset: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under strings that stand side by side."""
    new = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], offset[first], offset[last] + size


def _compared(size: int):
    """Repeats among the contexts of each gram, a gram a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("members")
            ends = np.append(0, np.cumsum(pc.binary_length(held.flatten().field("data")).to_numpy().astype(np.int64)))
            of_gram = ends[np.cumsum(np.diff(held.offsets.to_numpy()))]
            for some in _by_bytes(np.diff(of_gram, prepend=0), GROUP_BYTES):
                part = batch.slice(some.start, some.stop - some.start)
                lists = part.column("members")
                members = lists.flatten()
                grams = np.repeat(part.column("gram").to_numpy(), np.diff(lists.offsets.to_numpy()))
                place, b1, b2 = (members.field(c).to_numpy() for c in ("place", "b1", "b2"))
                whole = members.field("whole").to_numpy(zero_copy_only=False)
                datas = members.field("data").to_pylist()
                row, offset, hashes = _strings(datas, place, size)
                pair = np.stack([grams[row].view(np.uint64), hashes], axis=1)
                _, code, times = np.unique(pair.view("u8,u8").ravel(), return_inverse=True, return_counts=True)
                twice = (times[code] > 1) & ~whole[row]
                r, a, b = _spans(row[twice], offset[twice], size) if twice.any() else (np.zeros(0, np.int64),) * 3
                first = place[r] >> 20
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (b1[r], b2[r], first + a, first + b)], [*NAME, "start", "end"])

    return run


def _listed(size: int):
    """(gram, string, whole, b1, b2, at) of every string of a cut-out run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_bytes(pc.binary_length(batch.column("data")).to_numpy().astype(np.int64), BLOCK):
                part = batch.slice(some.start, some.stop - some.start)
                place = part.column("place").to_numpy()
                row, offset, hashes = _strings(part.column("data").to_pylist(), place, size)
                kept = part.select(["gram", "whole", *NAME]).take(pa.array(row))
                columns = [kept.column("gram"), pa.array(hashes.view(np.int64)), *(kept.column(c) for c in ("whole", *NAME)), pa.array((place >> 20)[row] + offset)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "string", "whole", *NAME, "at"])

    return run


def _edges(texts: DataFrame, asked: DataFrame, size: int, group_contexts: int) -> DataFrame:
    """(b1, b2, start, end): repeats at the edges of matches."""
    wanted = asked.groupBy(*NAME).agg(F.collect_set(F.struct("gram", "contexts", "whole", "place")).alias("asked"))
    # One text stands for its copies.
    cut = texts.join(written_once(wanted, "edge-runs"), list(NAME)).dropDuplicates(list(NAME)).mapInArrow(_cut_out(size), CUT)
    cut = written_once(cut, "edge-contexts")
    member = F.struct("whole", "place", *NAME, "data")
    small = cut.where(F.col("contexts") <= group_contexts).groupBy("gram").agg(F.collect_list(member).alias("members"))
    found = small.mapInArrow(_compared(size), "b1 long, b2 long, start long, end long")
    large = cut.where(F.col("contexts") > group_contexts).mapInArrow(_listed(size), "gram long, string long, whole boolean, b1 long, b2 long, at long")
    twice = large.groupBy("gram", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "string")
    hot = large.where("NOT whole").join(twice, ["gram", "string"]).select(*NAME, F.col("at").alias("start"), (F.col("at") + size).alias("end"))
    return found.unionByName(hot)


def repeats(docs: DataFrame, index: Index, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(b1, b2, spans): the bytes of each text that lie in a string the index holds more than once.

    All rows of docs must be in the index. Spans may overlap.
    """
    size = index.size
    texts = named(docs)
    judged = written_once(index.judged(), "judged-contexts")
    hits = entries(texts, size).join(judged, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")))
    hits = written_once(hits.select("gram", "context", *NAME, "place", "whole", "contexts"), "repeat-runs")
    first = F.shiftright("place", 20)
    whole = hits.where("whole").select(*NAME, first.alias("start"), (first + F.shiftright("place", 10).bitwiseAND(1023) + size).alias("end"))
    # Of a context that occurs more than once, one place stands for all.
    shared = hits.where("contexts > 1")
    one = shared.where("whole").groupBy("gram", "context").agg(F.min(F.struct(*NAME, "place")).alias("p"), F.first("contexts").alias("contexts"))
    asked = shared.where("NOT whole").select("gram", "contexts", "whole", *NAME, "place").unionByName(
        one.select("gram", "contexts", F.lit(True).alias("whole"), "p.b1", "p.b2", "p.place")
    )
    spans = whole.unionByName(_edges(texts, asked, size, group_contexts))
    return spans.groupBy(*NAME).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, so that moving them moves less."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part, texts in _chunks(batch):
            packed = pa.array([press.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, packed], [*part.drop_columns(["text"]).schema.names, "packed"])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                rows = []
                for packed, spans in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist()):
                    text = open_.decompress(packed)
                    merged: list[list[int]] = []
                    for s in spans or ():
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    cuts = [0, *(x for m in merged for x in m), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                    row = (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    return run


def deduplicated(
    docs: DataFrame, key: str = "doc_id", size: int = SIZE, batches: int = BATCHES, with_text: bool = False, group_contexts: int = GROUP_CONTEXTS
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs, and `kept_text` if asked for.

    The kept text is read as UTF-8; a character that a cut splits is replaced in it, not in the digest.
    """
    index, texts = Index(size), named(docs)
    for k in range(batches):
        index.add(texts.where(F.pmod("b1", F.lit(batches)) == k))
    spans = written_once(repeats(docs, index, group_contexts), "repeat-spans")
    text = text_of()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("b1"), F.xxhash64(F.lit(1), text).alias("b2"), text.alias("text"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("b1", T.LongType()), T.StructField("b2", T.LongType()), T.StructField("packed", T.BinaryType())])
    joined = rows.mapInArrow(_packed, schema).join(spans, list(NAME), "left").select("key", "packed", "spans")
    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    fields += [("kept_text", T.StringType())] if with_text else []
    out = T.StructType([T.StructField("key", kind), *[T.StructField(n, t) for n, t in fields]])
    return joined.mapInArrow(_kept(with_text), out).withColumnRenamed("key", key)
