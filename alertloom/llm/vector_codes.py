"""Vectors as short codes: product quantization in whole numbers, with a GNAT over each codebook.

A component x is the integer floor(256 x). Vectors are cut into equal parts, each part position has a
codebook, and a code lists the nearest entry of every part. Codebooks start as the parts of the smallest
keys; each round assigns all parts and puts every used entry at the floor of its parts' mean. Sums and
distances are integers throughout, so results do not depend on the order in which tasks finish.

The nearest entry is looked for in a geometric near-neighbour access tree: some entries are split points,
each other entry is a child of its nearest one, and every split point knows between which distances the
entries of every child lie. A query that is at distance d from a split point and has a best distance r
needs no entry at distances outside [d - r, d + r], so a child whose range lies outside is left out whole.
Roots are rounded outwards and a child is left out only if its range is strictly outside, so an equal
distance is never lost; what is left is compared as integers, ties going to the lower index.

Defined cases. Rows whose vector is null or holds a null or non-finite component are dropped. Each length
of vector has codebooks of its own; a length that the parts do not divide is filled up with zeros, which
add no distance. With fewer rows than entries a codebook has as many entries as there are rows. Rows that
repeat a key are vectors of their own, ordered by their components; null keys come last. Integers beyond
the bound under which squared distances fit 62 bits (2 ** 27 at 64 components) count as that bound.
An empty table gives no rows. Carried columns may have any names but `codes`, `error` and `codebooks`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.durable import written_once

# Integer steps in one, parts of a vector, entries of a codebook, and rounds of fitting.
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Split points of a node of the tree; children of up to so many entries are leaves.
DEGREE = 8
# Vectors that are looked up together.
_ROWS = 4_096
# Widens a root, or a sum of two, beyond what rounding can do to it.
_OUT = 1e-12


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def integers(column: str, length: Column) -> Column:
    """floor(256 x) of each component, within the bound for the length."""
    bound = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(length, F.lit(1))) / 2).cast("double")
    return F.transform(column, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v.cast("double") * SCALE, -bound), bound)), -bound), bound).cast("int"))


def _squares(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as integers, (query, entry)."""
    found = np.zeros((len(queries), len(entries)), np.int64)
    for k in range(queries.shape[1]):
        apart = queries[:, k, None] - entries[None, :, k]
        found += apart * apart
    return found


@dataclass
class Node:
    """Split points by index, the subtree under each, and the least and greatest distance from each to each subtree."""

    splits: np.ndarray
    children: list["Node | None"]
    least: np.ndarray
    most: np.ndarray


class Gnat:
    """The tree over one codebook (entry, component)."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree = entries, degree
        self.root = self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray) -> Node | None:
        if not len(members):
            return None
        # Far-apart split points: each next one is farthest from those there are.
        splits = members[:1]
        away = _squares(self.entries[members], self.entries[splits])[:, 0]
        while len(splits) < min(self.degree, len(members)):
            far = np.where(np.isin(members, splits), -1, away)
            splits = np.append(splits, members[int(np.argmax(far))])
            away = np.minimum(away, _squares(self.entries[members], self.entries[splits[-1:]])[:, 0])
        rest = members[~np.isin(members, splits)]
        squares = _squares(self.entries[rest], self.entries[splits])
        home = np.argmin(squares, axis=1) if len(rest) else np.zeros(0, np.int64)
        least, most = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        children: list[Node | None] = []
        for j in range(len(splits)):
            roots = np.sqrt(squares[home == j].astype(np.float64))
            if len(roots):
                least[:, j], most[:, j] = roots.min(axis=0) * (1 - _OUT), roots.max(axis=0) * (1 + _OUT)
            children.append(self._build(rest[home == j]))
        return Node(splits, children, least, most)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each query, the lowest index of equals."""
        index = np.full(len(queries), len(self.entries), np.int64)
        square = np.full(len(queries), np.iinfo(np.int64).max)
        self._search(self.root, queries, np.arange(len(queries)), index, square)
        return index, square

    def _search(self, node: Node | None, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, square: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        squares = _squares(queries[rows], self.entries[node.splits])
        for k, split in enumerate(node.splits.tolist()):
            better = (squares[:, k] < square[rows]) | ((squares[:, k] == square[rows]) & (split < index[rows]))
            index[rows[better]], square[rows[better]] = split, squares[better, k]
        away = np.sqrt(squares.astype(np.float64))
        low, high = away * (1 - _OUT), away * (1 + _OUT)
        for j, child in enumerate(node.children):
            if child is None:
                continue
            # The best so far shrinks from child to child.
            reach = np.sqrt(square[rows].astype(np.float64))[:, None] * (1 + _OUT)
            outside = ((low - reach) * (1 - _OUT) > node.most[:, j]) | ((high + reach) * (1 + _OUT) < node.least[:, j])
            self._search(child, queries, rows[~outside.any(axis=1)], index, square)


@dataclass
class Codebooks:
    """The entries of one length of vectors: (part, entry, component)."""

    length: int
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def cut(self, column: pa.Array) -> np.ndarray:
        """(row, part, component) of vectors of this length."""
        rows = column.flatten().to_numpy().astype(np.int64).reshape(len(column), self.length)
        return _parts(rows, len(self.books))

    def trees(self) -> list[Gnat]:
        return [Gnat(book) for book in self.books]

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (row, part) stand for."""
        found = np.stack([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return found.reshape(len(codes), -1)[:, : self.length]


def _parts(rows: np.ndarray, parts: int) -> np.ndarray:
    filled = np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts)))
    return filled.reshape(len(rows), parts, filled.shape[1] // parts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _sums(books: Codebooks) -> Callable:
    """(part, entry, place, total) of a task's rows by their nearest entries; place -1 has the number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, shape = books.trees(), books.books.shape
        totals = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
        for part in _slices(batches):
            cut = books.cut(part.column("vector"))
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(cut[:, p])
                np.add.at(totals[p], (index, slice(1, None)), cut[:, p])
                totals[p, :, 0] += np.bincount(index, minlength=shape[1])
        used = np.nonzero(np.broadcast_to(totals[:, :, :1] > 0, totals.shape))
        columns = [used[0].astype(np.int32), used[1].astype(np.int32), used[2].astype(np.int32) - 1, totals[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total"])

    return run


def fitted(rows: DataFrame, length: int, first: Sequence[Sequence[int]], parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vector) of one length that start as the parts of the given vectors."""
    start = np.array(first, np.int64).reshape(len(first), length)
    books = Codebooks(length, np.ascontiguousarray(_parts(start, parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, place int, total long")
        # As many rows as the codebooks have numbers.
        found = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
        part, entry, place, total = (found.column(c).to_numpy() for c in ("part", "entry", "place", "total"))
        totals = np.zeros((*books.books.shape[:2], books.width + 1), np.int64)
        totals[part, entry, place + 1] = total
        counts = totals[:, :, :1]
        books = Codebooks(length, np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books.books))
    return books


def _coded(books: Codebooks, carry: int) -> Callable:
    digest = books.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for part in _slices(batches):
            cut = books.cut(part.column("vector"))
            found = [tree.nearest(cut[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            error = np.sum([square for _, square in found], axis=0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            kept = [part.column(f"k{i}") for i in range(carry)]
            yield pa.RecordBatch.from_arrays(
                [*kept, lists, pa.array(error), pa.array([digest] * len(codes), pa.string())], [*[f"k{i}" for i in range(carry)], "codes", "error", "codebooks"]
            )

    return run


def encoded(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", carry: Sequence[str] = (),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, dict[int, Codebooks]]:
    """((key, the carried columns, codes, error, codebooks), the codebooks by length of vector) of all usable rows.

    `codes` are 0-based entry numbers in part order, `error` the squared distance to what they stand for,
    `codebooks` the digest of the codebooks. Of rows only 64 a length, sums and codebooks come to the driver.
    """
    names = [key, *carry]
    good = vectors.where(finite(column)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(column).alias("given"))
    rows = good.select(*[f"k{i}" for i in range(len(names))], integers("given", F.size("given")).alias("vector"))
    rows = written_once(rows, "integer-vectors")
    fields = [T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(names)]
    schema = T.StructType([*fields, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType()), T.StructField("codebooks", T.StringType())])
    lengths = sorted(r["length"] for r in rows.select(F.size("vector").alias("length")).distinct().collect())
    books, found = {}, []
    for length in lengths:
        own = rows.where(F.size("vector") == length) if len(lengths) > 1 else rows
        first = own.orderBy(F.asc_nulls_last("k0"), "vector").limit(entries).select("vector").collect()
        books[length] = fitted(own, length, [r["vector"] for r in first], parts, rounds)
        found.append(own.mapInArrow(_coded(books[length], len(names)), schema))
    every = reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], schema)
    return every.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "codes", "error", "codebooks"), books


def summed_by(rows: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of a value over all rows of equal `column`, nulls together, as a long that stops at its limit.

    Sums combine before they are moved and meet the rows in a join, so no task holds all rows of a value.
    """
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy(F.col(column).alias("summed_by")).agg(total.alias(name))
    return rows.join(sums, F.col(column).eqNullSafe(F.col("summed_by"))).drop("summed_by")


def as_hex(codes: str = "codes") -> Column:
    """Codes in part order, two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
