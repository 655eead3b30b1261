"""Near-duplicates among vectors by spherical k-means and blocked cosine products.

Centres are fitted for each of the commonest lengths of vector on a bounded sample; those so near to a
larger one that they part what is linked are left out, so a group of near copies has one. Every vector
is in the cell of its nearest centre. A vector y within the threshold of x can lie in another cell only
if x is near the border between them: the two centres' bisecting plane through the origin parts x from
y, so the distance of x to it is at most that of x to y. So x also visits the next cells whose border is
that near, up to a number of cells in all. A link is lost only if both ends' cells are farther down each
other's order; without that number none is, but in many dimensions every border is near and each vector
would visit nearly every cell. Cells that are much too large get centres of their own, fitted on a
sample of theirs. In a cell, blocks of vectors are multiplied with blocks of vectors; each row gives its
number of links, and a block gives a spanning forest of its links, not all of them.

Equal vectors are one row with a count before this starts. Vectors are compared with those of their own
length; rarer lengths are a cell each. Vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing and stand for themselves. A null key is never the smallest. A cosine that just reaches the threshold links. An empty table gives no rows, and
columns beside the key and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import written_once
from .components import components

THRESHOLD = 0.95
# The sample for the centres, their number for so many vectors, and rounds of fitting.
SAMPLE_ROWS = 20_000
VECTORS_PER_CELL = 2_000
MAX_CELLS = 1_024
ROUNDS = 8
# Cells a vector is in, of each of at most two levels; and lengths that get centres.
PROBES = 3
FITTED_LENGTHS = 16
# A cell with so many times its vectors is split again, in so many rows a task.
SPLIT_FROM = 4
SPLIT_ROWS = 50_000
# Vectors of one side of a product.
BLOCK_ROWS = 8_192
# Added to the border distance, for what rounding may do to it.
SLACK = 1e-6


def usable(column: str) -> Column:
    """Whether a vector can link: there, all finite, and not zero."""
    vector = F.col(column)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> np.ndarray:
    """Unit centres by spherical k-means, the same for the same sample; none within the threshold of another."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        sizes = np.linalg.norm(sums, axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centres)
    held = np.bincount(np.argmax(sample @ centres.T, axis=1), minlength=len(centres))
    near, kept = centres @ centres.T >= threshold, []
    for k in np.argsort(-held, kind="stable"):
        if not near[k, kept].any():
            kept.append(k)
    return centres[kept]


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Cells:
    """Centres with what is needed to find a vector's cells."""

    def __init__(self, centres: np.ndarray, threshold: float, probes: int):
        self.centres, self.probes = centres, min(probes, len(centres))
        self.apart = np.linalg.norm(centres[:, None] - centres[None, :], axis=2)
        np.fill_diagonal(self.apart, 1.0)
        self.reach = np.sqrt(max(2 - 2 * threshold, 0.0)) + SLACK

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is the nearest) of each visit."""
        near = unit @ self.centres.T
        first = np.argsort(-near, axis=1, kind="stable")[:, : self.probes]
        value = np.take_along_axis(near, first, axis=1)
        border = (value[:, :1] - value) / self.apart[first[:, :1], first]
        rows, place = np.nonzero((border <= self.reach) | (np.arange(self.probes) == 0))
        return rows, first[rows, place], place == 0


def _vectors(unit: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32()), pa.array(unit.ravel()))


PLACED = "width int, cell int, part int, home boolean, node long, n long, vector array<double>"
_PLACED = ["width", "cell", "part", "home", "node", "n", "vector"]


def _first_cells(cells: dict[int, _Cells]):
    """Each vector at home and in the cells it visits; lengths without centres are one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                widths = part.column("width").to_numpy()
                for width in np.unique(widths):
                    mine = part.filter(pa.array(widths == width))
                    unit = _unit(_matrix(mine.column("vector"), int(width)))
                    if width in cells:
                        rows, cell, home = cells[width].of(unit)
                    else:
                        rows, cell, home = np.arange(len(unit)), np.zeros(len(unit), int), np.ones(len(unit), bool)
                    columns = [np.full(len(rows), width, np.int32), cell.astype(np.int32), np.zeros(len(rows), np.int32), home]
                    moved = [mine.column(c).take(pa.array(rows)) for c in ("node", "n")]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *moved, _vectors(unit[rows])], _PLACED)

    return run


def _fitted(vectors_per_cell: int, threshold: float):
    """The centres of a cell that is split, from its sample."""

    def run(table: pa.Table) -> pa.Table:
        width, size = table.column("width")[0].as_py(), table.column("size")[0].as_py()
        centres = centres_of(_matrix(table.column("vector").combine_chunks(), width), int(np.clip(size // vectors_per_cell, 1, MAX_CELLS)), threshold=threshold)
        return pa.table([table.column("width").slice(0, 1), table.column("cell").slice(0, 1), pa.array([len(centres)], pa.int32()), _vectors(centres.reshape(1, -1))], ["width", "cell", "parts", "centres"])

    return run


def _second_cells(threshold: float, probes: int):
    """The rows of a share of a split cell in its parts."""

    def run(rows: pa.Table, fitted: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        out = [pa.table([rows.column(c).slice(0, 0) for c in _PLACED], _PLACED)]
        if rows.num_rows and fitted.num_rows:
            width = rows.column("width")[0].as_py()
            cells = _Cells(_matrix(fitted.column("centres").combine_chunks(), width), threshold, probes)
            for at in range(0, rows.num_rows, 2_000):
                part = rows.slice(at, 2_000).combine_chunks()
                unit = _matrix(part.column("vector").combine_chunks(), width)
                found, cell, first = cells.of(unit)
                taken = part.take(pa.array(found))
                home = taken.column("home").to_numpy(zero_copy_only=False) & first
                columns = [taken.column("width"), taken.column("cell"), pa.array(cell.astype(np.int32)), pa.array(home), taken.column("node"), taken.column("n"), _vectors(unit[found])]
                out.append(pa.table(columns, _PLACED))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    return run


def _split(placed: DataFrame, vectors_per_cell: int, sample_rows: int, threshold: float, probes: int) -> DataFrame:
    """Placed vectors with cells that are much too large cut into parts of their own centres."""
    sizes = placed.where("home").groupBy("width", "cell").agg(F.count("*").alias("size"))
    # A row per cell at most, whose number is bounded.
    large = written_once(sizes.where(F.col("size") >= SPLIT_FROM * vectors_per_cell), "large-cells")
    if large.isEmpty():
        return placed
    key = ["width", "cell"]
    within = placed.join(F.broadcast(large), key)
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("size") / sample_rows)) == 0
    fitted = within.where("home").where(draw).select(*key, "size", "vector").groupBy(*key).applyInArrow(_fitted(vectors_per_cell, threshold), "width int, cell int, parts int, centres array<double>")
    # A group of near copies gives one centre, which parts nothing.
    fitted = written_once(fitted.where("parts > 1"), "cell-centres")
    shares = F.ceil(F.col("size") / SPLIT_ROWS).cast("int")
    asked = fitted.join(F.broadcast(large), key).withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = within.join(F.broadcast(fitted.select(*key)), key).withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int"))
    at = [*key, "share"]
    cut = dealt.select(*at, *_PLACED[2:]).groupBy(*at).cogroup(asked.select(*at, "centres").groupBy(*at)).applyInArrow(_second_cells(threshold, probes), PLACED)
    whole = placed.join(F.broadcast(fitted.select(*key)), key, "left_anti")
    return written_once(whole.select(*_PLACED).unionByName(cut), "cell-parts")


def _products(threshold: float):
    """Counts and a forest of links between the home rows of one block and all rows of another."""

    def run(table):
        table = table.combine_chunks()
        side = table.column("side").to_numpy(zero_copy_only=False)
        one, two = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        nodes, counts, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        is_count = [np.zeros(0, bool)]
        if one.num_rows and two.num_rows:
            width = len(table.column("vector")[0].as_py())
            a, b = (_matrix(t.column("vector").combine_chunks(), width) for t in (one, two))
            ia, ib = one.column("node").to_numpy(), two.column("node").to_numpy()
            many = two.column("n").to_numpy().astype(np.float64)
            # Each strip is folded into the labels at once, so no more than one strip of links is held.
            names, flat = np.unique(np.concatenate([ia, ib]), return_inverse=True)
            fa, fb, labels, pairs = flat[: len(ia)], flat[len(ia) :], np.arange(len(names)), []
            for at in range(0, len(a), 512):
                linked = (a[at : at + 512] @ b.T >= threshold) & (ia[at : at + 512, None] != ib[None, :])
                nodes.append(ia[at : at + 512])
                counts.append((linked @ many).astype(np.int64))
                is_count.append(np.ones(len(nodes[-1]), bool)), others.append(nodes[-1])
                for k in np.flatnonzero(linked.any(axis=1)):
                    mine, near = fa[at + k], fb[linked[k]]
                    while len(near := near[labels[near] != labels[mine]]):
                        pairs.append((ia[at + k], names[near[0]]))
                        labels[labels == labels[near[0]]] = labels[mine]
            if pairs:
                pairs = np.array(pairs, np.int64)
                nodes.append(pairs[:, 0]), others.append(pairs[:, 1]), counts.append(np.zeros(len(pairs), np.int64)), is_count.append(np.zeros(len(pairs), bool))
        columns = [np.concatenate(c) for c in (nodes, counts, others, is_count)]
        return pa.table([pa.array(c) for c in columns], ["node", "links", "other", "is_count"])

    return run


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    vectors_per_cell: int = VECTORS_PER_CELL,
    block_rows: int = BLOCK_ROWS,
    probes: int = PROBES,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors.

    Rows that repeat a key count as vectors of their own. `probes` trades recall for rows: with as many as
    there are cells no link is lost.
    """
    doubles = F.transform(F.col(column), lambda v: v.cast("double"))
    rows = vectors.select(F.col(key).alias("key"), doubles.alias("vector"))
    good = rows.where(usable("vector"))
    # The commonest lengths get centres; what is collected is their number.
    lengths = good.groupBy(F.size("vector").alias("width")).count().where(F.col("count") > vectors_per_cell)
    fitted = lengths.orderBy(F.desc("count"), F.desc("width")).limit(FITTED_LENGTHS).collect()
    fits = usable("vector")
    # 0.0 and -0.0 are one number, so equal vectors are one group. Its number is unique and stands once it is written.
    plain = F.transform("vector", lambda v: v + F.lit(0.0))
    distinct = rows.where(fits).groupBy(plain.alias("vector")).agg(F.count("*").alias("n"), F.min("key").alias("first"))
    distinct = distinct.withColumn("hash", F.xxhash64("vector")).withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector"))
    numbered = written_once(distinct, "distinct-vectors")
    cells = {}
    for length in fitted:
        width = length["width"]
        sample = numbered.where(F.col("width") == width).orderBy("hash", "vector").limit(sample_rows).select("vector").toArrow()
        unit = _unit(_matrix(sample.column("vector").combine_chunks(), width))
        cells[width] = _Cells(centres_of(unit, int(np.clip(length["count"] // vectors_per_cell, 1, MAX_CELLS)), threshold=threshold), threshold, probes)

    placed = written_once(numbered.select("width", "node", "n", "vector").mapInArrow(_first_cells(cells), PLACED), "cell-vectors")
    placed = _split(placed, vectors_per_cell, sample_rows, threshold, probes)
    # As many blocks as a cell needs; where that is one, a vector is moved once for each side.
    cell = ["width", "cell", "part"]
    blocks = written_once(placed.groupBy(*cell).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "cell-blocks")
    cut = placed.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    kept = [*cell, "one", "two", "side", "node", "n", "vector"]
    left = cut.where("home").withColumn("one", F.col("block")).withColumn("two", F.explode(every)).withColumn("side", F.lit(0)).select(*kept)
    right = cut.withColumn("two", F.col("block")).withColumn("one", F.explode(every)).withColumn("side", F.lit(1)).select(*kept)
    found = left.unionByName(right).groupBy(*cell, "one", "two").applyInArrow(_products(threshold), "node long, links long, other long, is_count boolean")
    found = written_once(found, "vector-links")
    counts = found.where("is_count").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("NOT is_count").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = joined.withColumnRenamed("component", "class")
    named = numbered.join(counts, "node", "left").join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    classed = written_once(named.join(smallest, "class").select("hash", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "vector-classes")
    # The hash is a short key in front of the vector; a row without a usable vector has neither.
    hashed = rows.select("key", F.when(fits, plain).alias("vector")).withColumn("hash", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    out = hashed.join(classed, ["hash", "vector"], "left").select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
