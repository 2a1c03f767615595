"""Linear support vector machine on the squared hinge loss, which Spark's own does not offer.

Minimises ``(|w|^2 + b^2) / 2 + C * sum(weight * max(0, 1 - y (w x + b))^2)`` with ``y`` -1 or 1.  The
intercept is regularised like any coefficient.  The objective is smooth and strongly convex, so
a limited-memory quasi-Newton method on whole-table gradients converges to its one minimum.

A pass is one job: every task reduces its rows to at most one number a feature, those are added up
by feature, and the driver gets a row a feature.  What it keeps are a few vectors of that length.
The rows are stored once in packs, the entries of many vectors as bytes, which a pass reads as arrays
without a conversion of vectors.

The number of passes would grow with the table, as the loss is a sum and the regularisation is not.
So the direction of a step goes by the curvature.  A table of few rows is held by the driver for that;
of a larger one the curvature is that of all rows: conjugate gradients, each product one pass.  (A sample
of fewer rows than features misjudges it: steps had to be cut again and again.)  Only the direction of a
step depends on that; loss, gradient and the end of the search are those of all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import stage

LOSS = -1  # stands for the loss among the positions of a pass
REMEMBERED_STEPS = 10
SPARSE = 0  # the mark of a sparse vector in Spark's form of vectors
PACK_ENTRIES = 1 << 16  # a pack is a run of rows with about so many entries
PACK = "at binary, x binary, ends binary, y binary, weight binary"

# Tables that the driver holds, or a sample of one with few features: rows, and entries of their vectors,
# at most; and how far its equations are solved.
SAMPLE_ROWS, SAMPLE_ENTRIES = 4096, 1 << 20
SOLVED, MOST_TURNS = 1e-2, 100
# How far the equations over all rows are solved, at the beginning.
ROUGHLY = 0.1


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature and value of every entry; place behind its last entry, class -1 or 1 and weight of every row."""
    for batch in batches:
        kind, _, indices, values = batch.column(0).flatten()
        if not pc.all(pc.equal(kind, SPARSE), min_count=0).as_py():
            raise ValueError("vectors must be sparse")
        ends = np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False).astype(np.int64))
        at = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        y = 2.0 * batch.column(1).to_numpy(zero_copy_only=False) - 1.0
        weight = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = np.flatnonzero(np.diff(ends // PACK_ENTRIES)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(ends)], strict=True):
            if start == stop:
                continue
            first = int(ends[start - 1]) if start else 0
            entries = slice(first, int(ends[stop - 1]))
            parts = at[entries], x[entries], ends[start:stop] - first, y[start:stop], weight[start:stop]
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], PACK_COLUMNS)


PACK_COLUMNS = [column.split()[0] for column in PACK.split(", ")]
PACK_TYPES = (np.int32, np.float64, np.int64, np.float64, np.float64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, feature and value of every entry; class and weight of every row; a pack at a time."""
    for batch in batches:
        for pack in zip(*batch.columns, strict=True):
            at, x, ends, y, weight = (np.frombuffer(p.as_buffer(), t) for p, t in zip(pack, PACK_TYPES, strict=True))
            yield np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), at, x, y, weight


def _pass(packs: DataFrame, solution: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """Summed loss of all rows and its gradient; the intercept is the last component."""

    def of_pack(rows, at, x, y, weight):
        short = np.maximum(0.0, 1.0 - y * _margin(rows, at, x, len(y), solution))
        pull = -2.0 * c * weight * y * short
        return float(c * weight @ short**2), x * pull[rows], pull

    return _summed(packs, len(solution) - 1, of_pack)


def _products(packs: DataFrame, solution: np.ndarray, c: float, vector: np.ndarray) -> np.ndarray:
    """The curvature of the summed loss at ``solution``, times a vector."""

    def of_pack(rows, at, x, y, weight):
        inside = _inside(rows, at, x, y, weight, solution, c)
        pull = inside * _margin(rows, at, x, len(y), vector)
        return 0.0, x * pull[rows], pull

    return _summed(packs, len(solution) - 1, of_pack)[1]


def _diagonal(packs: DataFrame, solution: np.ndarray, c: float) -> np.ndarray:
    """The curvature of the summed loss by each coefficient alone."""

    def of_pack(rows, at, x, y, weight):
        inside = _inside(rows, at, x, y, weight, solution, c)
        return 0.0, x * x * inside[rows], inside

    return _summed(packs, len(solution) - 1, of_pack)[1]


def _margin(rows, at, x, n: int, solution: np.ndarray) -> np.ndarray:
    return np.bincount(rows, weights=x * solution[at], minlength=n) + solution[-1]


def _inside(rows, at, x, y, weight, solution: np.ndarray, c: float) -> np.ndarray:
    """Twice the weight of rows that lose, none for others."""
    return np.where(1.0 - y * _margin(rows, at, x, len(y), solution) > 0, 2.0 * c * weight, 0.0)


def _summed(packs: DataFrame, size: int, of_pack: Callable) -> tuple[float, np.ndarray]:
    """The sum of a number a pack, and by feature of a number an entry; that of a number a row comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by_feature = 0.0, np.zeros(size + 1)
        for pack in _unpacked(batches):
            number, of_entries, of_rows = of_pack(*pack)
            total += number
            by_feature[:size] += np.bincount(pack[1], weights=of_entries, minlength=size)
            by_feature[size] += of_rows.sum()
        held = np.flatnonzero(by_feature)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, LOSS), pa.int64()), pa.array(np.append(by_feature[held], total), pa.float64())],
            ["position", "part"],
        )

    parts = packs.mapInArrow(run, "position long, part double")
    summed = parts.groupBy("position").agg(F.sum("part").alias("part")).toArrow()  # a row a feature
    position, part = summed["position"].to_numpy(), summed["part"].to_numpy()
    by_feature = np.zeros(size + 1)
    by_feature[position[position != LOSS]] = part[position != LOSS]
    return float(part[position == LOSS].sum()), by_feature


def fit_squared_hinge(
    data: DataFrame, size: int, features_col: str, c: float = 1.0, max_iter: int = 2000, tolerance: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for rows of a sparse vector, a ``label`` 0 or 1 and a ``weight``.

    ``data`` is read once.  The result is that at which the gradient has fallen to ``tolerance`` of
    its length at zero; without rows it is zero.
    """
    packs = stage(data.select(features_col, "label", "weight").mapInArrow(_packs, PACK), "packs")

    def objective(solution: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _pass(packs, solution, c)
        return loss + float(solution @ solution) / 2, gradient + solution

    sample = _sample(packs, size, c)
    start = np.zeros(size + 1)
    if sample is None or sample.whole or len(sample.y) >= size:
        solution = minimise(objective, start, max_iter, tolerance, sample and sample.solve)
    else:
        solution = minimise(objective, start, max_iter, tolerance, _newton(packs, c), 0)
    return solution[:-1], float(solution[-1])


def _newton(packs: DataFrame, c: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Solves for a gradient by the curvature of all rows, the closer the nearer the end is."""
    first: list[float] = []

    def solve(solution: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        length = float(np.linalg.norm(gradient))
        first.append(length)
        return conjugate_gradients(
            lambda v: v + _products(packs, solution, c, v), 1.0 + _diagonal(packs, solution, c), gradient,
            min(ROUGHLY, (length / first[0]) ** 0.5),
        )

    return solve


def conjugate_gradients(
    curved: Callable[[np.ndarray], np.ndarray], scale: np.ndarray, vector: np.ndarray, solved: float
) -> np.ndarray:
    """``vector`` times the inverse of what ``curved`` multiplies by, whose diagonal is ``scale``."""
    result, rest = np.zeros(len(vector)), vector.copy()
    ahead = toward = rest / scale
    goal, product = solved * np.linalg.norm(vector), float(rest @ ahead)
    for _ in range(MOST_TURNS):
        if np.linalg.norm(rest) <= goal:
            break
        change = curved(toward)
        length = product / float(toward @ change)
        result, rest = result + length * toward, rest - length * change
        ahead = rest / scale
        product, before = float(rest @ ahead), product
        toward = ahead + product / before * toward
    return result


def _sample(packs: DataFrame, size: int, c: float) -> Sample | None:
    """A bounded sample of the rows with the share of the table it stands for; none of no rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.array([(len(y), len(at)) for _, at, _, y, _ in _unpacked(batches)], np.int64).reshape(-1, 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(counts[i : i + 1]) for i in range(2)], ["n", "entries"])

    total = packs.mapInArrow(measure, "n long, entries long").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries")).first()
    if not total["n"]:
        return None
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_ENTRIES * total["n"] // max(total["entries"], 1)))
    share = wanted / total["n"]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, x, y, weight in _unpacked(batches):
            chosen = np.random.default_rng([1, len(y), len(at), zlib.crc32(at)]).random(len(y)) < share
            of_chosen = chosen[rows]
            ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(y))[chosen]))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[of_chosen])) for v in (at, x)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(y[chosen]), pa.array(weight[chosen])], ["at", "x", "y", "weight"])

    got = packs.mapInArrow(flat, "at array<int>, x array<double>, y double, weight double").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    at, x = got["at"].combine_chunks(), got["x"].combine_chunks()
    return Sample(
        np.repeat(np.arange(got.num_rows), pc.list_value_length(at).to_numpy(zero_copy_only=False)),
        at.flatten().to_numpy(), x.flatten().to_numpy(), got["y"].to_numpy(),
        2.0 * c * got["weight"].to_numpy() * (total["n"] / got.num_rows), size, share >= 1,
    )


@dataclass
class Sample:
    """Rows that stand for all of them: row, feature and value of every entry, class and twice the
    weight in the objective of every row."""

    rows: np.ndarray
    at: np.ndarray
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    size: int
    whole: bool

    def solve(self, solution: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """``vector`` times the inverse of the sample's curvature at ``solution``, by conjugate
        gradients."""
        size, n = self.size, len(self.y)
        margin = np.bincount(self.rows, weights=self.x * solution[self.at], minlength=n) + solution[size]
        weight = np.where(1.0 - self.y * margin > 0, self.weight, 0.0)
        used = weight[self.rows] > 0
        rows, at, x = self.rows[used], self.at[used], self.x[used]

        def curved(v: np.ndarray) -> np.ndarray:
            pull = weight * (np.bincount(rows, weights=x * v[at], minlength=n) + v[size])
            return v + np.append(np.bincount(at, weights=x * pull[rows], minlength=size), pull.sum())

        scale = 1.0 + np.append(np.bincount(at, weights=x * x * weight[rows], minlength=size), weight.sum())
        return conjugate_gradients(curved, scale, vector, SOLVED)


def minimise(
    objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tolerance: float,
    solve: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, remembered: int = REMEMBERED_STEPS,
) -> np.ndarray:
    """Minimum of a smooth, strongly convex function, given with its gradient.  ``solve`` may give
    an estimate of the inverse curvature at a point, times a vector; the last steps correct it, if any
    are remembered."""
    at = start
    value, gradient = objective(at)
    goal = tolerance * np.linalg.norm(gradient)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= goal:
            break
        estimate = solve and partial(solve, at)
        direction = -_curved(gradient, steps, estimate)
        slope = float(gradient @ direction)
        if slope >= 0:  # the estimate changes from point to point
            estimate, steps = None, []
            direction, slope = -gradient, -float(gradient @ gradient)
        length = 1.0 if steps or estimate else 1.0 / np.linalg.norm(gradient)
        while True:
            ahead = at + length * direction
            new_value, new_gradient = objective(ahead)
            if new_value <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        if new_value >= value:
            break  # as near as doubles get
        steps = [*steps, (ahead - at, new_gradient - gradient)][-remembered:] if remembered else []
        at, value, gradient = ahead, new_value, new_gradient
    return at


def _curved(
    gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], estimate: Callable[[np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps have shown, or an estimate where
    they have not."""
    result, shares = gradient.copy(), []
    for moved, change in reversed(steps):
        share = float(moved @ result) / float(moved @ change)
        result -= share * change
        shares.append(share)
    if estimate:
        result = estimate(result)
    elif steps:
        moved, change = steps[-1]
        result *= float(moved @ change) / float(change @ change)
    for (moved, change), share in zip(steps, reversed(shares), strict=True):
        result += (share - float(change @ result) / float(moved @ change)) * moved
    return result
