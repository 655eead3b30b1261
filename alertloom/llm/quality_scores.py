"""A quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each text becomes a few statistics of its characters, words and lines. Cosines of random directions of the
standardized statistics approximate a Gaussian kernel over them, so a linear fit on the cosines is a kernel
fit. The normal equations are sums over rows: each task sums its part, Spark adds the parts up, and only
the finished sums, whose size the number of features fixes, come to the driver. Cosines are rounded to
integers, so the sums are the same in whatever order they are added. A fold of the training rows that
the fit does not see calibrates the scores: labels are counted by score bin and pooled until they rise.

All documents count for the means and deviations, all labelled training rows for the fit.

Defined cases. A null text is empty, and an empty text has statistics, a score and a prediction like any
other. Labels that are null or have no document count for nothing; a label on several rows of a document,
and several labels of a document, count each. Rows whose key repeats are scored each; a null key has no
label. Without any training label every score is 0.5. Without rows there are none. Carried columns may
have any names but `score` and `predicted`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.durable import written_once
from .pretokens import BLOCK_CHARS, blocks, row_sums
from .tables import text_of

# Folds by a checksum of the key, of which one is held out, and the score from which the prediction is 1.
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
# The training fold that calibrates.
CALIBRATES = 1

FEATURES = 160
# Width of the Gaussian in standard deviations of a statistic, and the ridge as a share of the rows.
WIDTH = 4.0
RIDGE = 1e-4
SEED = 11
# Cosines are whole numbers of this part; sums of products then fit 63 bits for 2 ** 35 rows.
STEPS = 1 << 14
# Score bins in one.
BINS = 1_024
_ROWS = 4_096

STATISTICS = (
    "log_chars", "log_words", "log_word_chars", "letters", "capitals", "digits", "symbols_per_word", "stops_per_word", "shouts_per_word",
    "commas_per_word", "distinct_words", "doubled_words", "repeated_windows", "repeated_lines", "log_line_chars", "bare_words",
)

_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _SHOUT, _COMMA, _SYMBOL, _LINE, _KNOWN = (1 << k for k in range(10))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Characters:
    """What each code point counts as, learned as they turn up, and hashes of stretches."""

    def __init__(self) -> None:
        self.kinds = np.zeros(0x110000, np.uint16)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, points: np.ndarray) -> np.ndarray:
        for point in np.unique(points[self.kinds[points] == 0]).tolist():
            c = chr(point)
            kind = _KNOWN | _LETTER * c.isalpha() | _UPPER * (c.isalpha() and c.isupper()) | _DIGIT * c.isdigit() | _SPACE * c.isspace() | _LINE * (c == "\n")
            kind |= _STOP * (c in ".!?") | _SHOUT * (c in "!?") | _COMMA * (c in ",;:")
            self.kinds[point] = kind | _SYMBOL * (not c.isalnum() and not c.isspace() and c not in ".!?,;:'\"-()’“”«»¿¡")
        return self.kinds[points]

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(points):
            grown = np.full(max(len(points), BLOCK_CHARS) + 1, _BASE)
            grown[0] = 1
            self.powers = np.cumprod(grown)
            grown[1:] = _INVERSE
            self.inverses = np.cumprod(grown)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * _MIX
        sums = np.append(np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * self.powers[: len(points)]))
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of a row's hashes equal another one of that row before it."""
    if not len(rows):
        return np.zeros(n, np.int64)
    mark = (hashes + rows.astype(np.uint64) * _BASE) * _MIX
    _, first = np.unique(mark ^ (mark >> np.uint64(31)), return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def measured(texts: Sequence[str], characters: _Characters) -> np.ndarray:
    """(text, statistic) of whole texts."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    # A line end behind each text keeps words and lines apart.
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = characters.of(points)
    row = np.repeat(np.arange(n), sizes + 1)

    def count(flag: int) -> np.ndarray:
        return np.bincount(row[(kinds & flag) != 0], minlength=n).astype(np.float64)

    space = (kinds & _SPACE) != 0
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    of_word = row[starts]
    words = np.bincount(of_word, minlength=n).astype(np.float64)
    hashes = characters.hashes(points, starts, ends)
    doubled = (of_word[1:] == of_word[:-1]) & (hashes[1:] == hashes[:-1])
    inside = (of_word[2:] == of_word[:-2]) if len(starts) > 2 else np.zeros(0, bool)
    windows = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) * _BASE + hashes[2:] * np.uint64(7) * _MIX if len(starts) > 2 else hashes[:0]
    letters_to = np.append(0, np.cumsum((kinds & (_LETTER | _DIGIT)) != 0))
    bare = letters_to[ends] == letters_to[starts]
    # Lines that hold a word.
    line_ends = np.flatnonzero((kinds & _LINE) != 0)
    line_starts = np.append(0, line_ends[:-1] + 1)[: len(line_ends)]
    solid_to = np.append(0, np.cumsum(~space))
    solid = solid_to[line_ends] > solid_to[line_starts]
    line_starts, line_ends = line_starts[solid], line_ends[solid]
    of_line = row[line_starts]
    lines = np.bincount(of_line, minlength=n).astype(np.float64)
    visible = np.bincount(row[~space], minlength=n).astype(np.float64)
    letters = count(_LETTER)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    return np.stack(
        [
            np.log1p(sizes),
            np.log1p(words),
            np.log1p(share(visible, words)),
            share(letters, visible),
            share(count(_UPPER), letters),
            share(count(_DIGIT), visible),
            np.log1p(share(count(_SYMBOL), words)),
            np.log1p(share(count(_STOP), words)),
            np.log1p(share(count(_SHOUT), words)),
            np.log1p(share(count(_COMMA), words)),
            1 - share(_repeats(of_word, hashes, n), words),
            share(np.bincount(of_word[1:][doubled], minlength=n), words),
            share(_repeats(of_word[2:][inside], windows[inside], n), words),
            share(_repeats(of_line, characters.hashes(points, line_starts, line_ends), n), lines),
            np.log1p(share(row_sums(of_line, line_ends - line_starts, n), lines)),
            share(np.bincount(of_word[bare], minlength=n), words),
        ],
        axis=1,
    )


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def statistics(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and `statistics`, an array in the order of STATISTICS, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = _Characters()
        for batch in batches:
            for rows, texts in blocks(batch.column("text")):
                part = batch.slice(rows.start, len(texts)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(measured(texts, characters))], [*part.schema.names, "statistics"])

    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], text_of().alias("text"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    out = named.mapInArrow(run, T.StructType([*fields, T.StructField("statistics", T.ArrayType(T.DoubleType()))]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], "statistics")


def fold_of(key: str) -> Column:
    """The fold of a row: a checksum of its key as text; a null key is in none."""
    return F.crc32(F.col(key).cast("string")) % FOLDS


@dataclass
class Kernel:
    """Random directions over standardized statistics."""

    means: np.ndarray
    deviations: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def over(cls, rows: DataFrame, features: int = FEATURES, seed: int = SEED) -> "Kernel":
        """Fitted to the means and deviations of all rows' statistics."""
        n = len(STATISTICS)
        figures = [f(F.col("statistics")[k]) for f in (F.avg, F.stddev_pop) for k in range(n)]
        found = np.array([0.0 if v is None else v for v in rows.agg(*figures).first()])
        rng = np.random.default_rng(seed)
        deviations = np.where(found[n:] > 1e-9, found[n:], 1.0)
        return cls(found[:n], deviations, rng.standard_normal((n, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features))

    def cosines(self, column: pa.Array) -> np.ndarray:
        """Whole numbers in double precision; the last column is constant."""
        given = column.flatten().to_numpy().reshape(len(column), -1)
        standard = np.clip((given - self.means) / self.deviations, -8, 8)
        cosines = np.rint(np.cos(standard @ self.directions + self.phases) * STEPS)
        return np.concatenate([cosines, np.full((len(cosines), 1), float(STEPS))], axis=1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _equations(kernel: Kernel):
    """(i, j, total) of a task's products of cosines, i <= j, and of cosine and label, j one beyond the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(kernel.phases) + 1
        totals = np.zeros((size, size + 1), np.int64)
        for part in _slices(batches):
            cosines = kernel.cosines(part.column("statistics"))
            labels = part.column("label").to_numpy().astype(np.float64)
            # Whole numbers below 2 ** 53, so exact.
            totals += (cosines.T @ np.concatenate([cosines, STEPS * labels[:, None]], axis=1)).astype(np.int64)
        i, j = np.triu_indices(size, 0, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(totals[i, j])], ["i", "j", "total"])

    return run


def ridge(labelled: DataFrame, kernel: Kernel) -> np.ndarray:
    """Weights of the cosines from the summed normal equations; zeros without rows."""
    size = len(kernel.phases) + 1
    sums = labelled.select("statistics", "label").mapInArrow(_equations(kernel), "i int, j int, total long")
    found = sums.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j, total = (found.column(c).to_numpy() for c in ("i", "j", "total"))
    whole = np.zeros((size, size + 1))
    whole[i, j] = total / STEPS**2
    products, rows = whole[:, :size], whole[size - 1, size - 1]
    if not rows:
        return np.zeros(size)
    products = products + np.triu(products, 1).T
    penalty = np.full(size, RIDGE * rows)
    penalty[-1] = 1e-9 * rows  # the constant is not drawn to zero
    return np.linalg.solve(products + np.diag(penalty), whole[:, size])


def _raw(kernel: Kernel, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Score bins: fitted values between -1 and 2 as whole numbers of BINS."""
    return np.rint(np.clip(kernel.cosines(column) @ weights / STEPS, -1, 2) * BINS).astype(np.int64)


@dataclass
class Calibration:
    """Scores at bins, rising; between them a straight line."""

    bins: np.ndarray
    scores: np.ndarray

    @classmethod
    def pooled(cls, bins: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> "Calibration":
        """Pools neighbouring bins, given in ascending order, until the share of ones rises."""
        held: list[list[float]] = []
        for bin_, count, one in zip(bins.tolist(), counts.tolist(), ones.tolist()):
            held.append([bin_, bin_, count, one])
            while len(held) > 1 and held[-2][3] * held[-1][2] >= held[-1][3] * held[-2][2]:
                _, last, count, one = held.pop()
                held[-1][1], held[-1][2], held[-1][3] = last, held[-1][2] + count, held[-1][3] + one
        if not held:
            return cls(np.zeros(1), np.full(1, 0.5))
        at = [x for first, last, _, _ in held for x in (first, last)]
        score = [one / count for _, _, count, one in held for _ in range(2)]
        return cls(np.array(at, float), np.array(score))

    def of(self, bins: np.ndarray) -> np.ndarray:
        return np.interp(bins, self.bins, self.scores)


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    calibration: Calibration

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.calibration.of(_raw(self.kernel, self.weights, column))


def _binned(kernel: Kernel, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_raw(kernel, weights, part.column("statistics"))), part.column("label")], ["bin", "label"])

    return run


def fitted(measured_rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """A model of the rows of statistics() whose labels are not in the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("labelled"), F.col(label).cast("int").alias("label"))
    known = known.where(fold_of("labelled") != HELD_OUT)
    rows = measured_rows.select(F.col(key).alias("row_key"), "statistics")
    labelled = rows.join(known, F.col("row_key") == F.col("labelled")).select(fold_of("labelled").cast("int").alias("fold"), "statistics", "label")
    labelled = written_once(labelled, "labelled-statistics")
    kernel = Kernel.over(measured_rows)
    weights = ridge(labelled.where(F.col("fold") != CALIBRATES), kernel)
    # As many rows as there are bins.
    counted = labelled.where(F.col("fold") == CALIBRATES).select("statistics", "label").mapInArrow(_binned(kernel, weights), "bin long, label int")
    counted = counted.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toArrow()
    bins, n, ones = (counted.column(c).to_numpy() for c in ("bin", "n", "ones"))
    return Model(kernel, weights, Calibration.pooled(bins, n, ones))


def scored(measured_rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of statistics() with `score` and `predicted` in place of the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            scores = model.scores(part.column("statistics"))
            kept = part.drop_columns(["statistics"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*kept.schema.names, "score", "predicted"])

    fields = [f for f in measured_rows.schema.fields if f.name != "statistics"]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return measured_rows.mapInArrow(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, the carried columns, held_out, score, predicted) for every row of docs; each text is read once."""
    rows = written_once(statistics(docs, (key, *carry)), "text-statistics")
    found = scored(rows, fitted(rows, labels, key))
    return found.select(key, *carry, F.coalesce(fold_of(key) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
