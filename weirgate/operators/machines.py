"""Many linear machines at once: one quasi-Newton loop whose weights are one matrix.

Every step is a single aggregation over the rows: each task multiplies its rows with the weights of all machines and
returns one loss and one gradient per machine. Machines that share a feature map share its product. Rows that fit into a
task are sent to one task per feature map instead, which takes all steps of its machines: a step is then no job of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half the width of the parabola that rounds the hinge at 1: a row's loss is at most a quarter of it above the hinge.
ROUND = 0.1
#: Pairs of steps and gradient changes that shape the next direction; accepted steps over which progress is judged.
MEMORY, WATCHED = 10, 10
#: Results of so many tasks are summed on the driver; those of more by Spark first. Rows multiplied at once.
DIRECT_TASKS, BATCH = 64, 4_096
#: Most features (rows times the width of the widest map) that one task holds to take all steps by itself: 64 MB.
HELD = 1 << 23
PARTS = "machine int, value array<double>"
FITTED = "machine int, weights array<double>, loss double, steps int, converged boolean"


@dataclass(frozen=True)
class Machine:
    """What one machine is fitted on: a feature map, a penalty, and all folds but ``held`` (all if None)."""
    lift: int
    penalty: float
    held: int | None = None


@dataclass
class Fitted:
    weights: np.ndarray  # the last one is the intercept
    loss: float
    steps: int
    converged: bool


def rounded_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope at a margin: the hinge with its corner rounded over 1 - ROUND to 1 + ROUND."""
    gap = np.clip(1 + ROUND - margin, 0, 2 * ROUND)
    below = np.maximum(1 - ROUND - margin, 0)
    return gap * gap / (4 * ROUND) + below, -gap / (2 * ROUND)


@dataclass
class _Search:
    """One machine's limited-memory quasi-Newton search, told loss and gradient at the points it asks for."""
    machine: Machine
    point: np.ndarray
    tol: float
    loss: float = np.inf
    slope: np.ndarray | None = None
    direction: np.ndarray | None = None
    size: float = 1.0
    pairs: list = field(default_factory=list)
    losses: list = field(default_factory=list)
    steps: int = 0
    done: bool = False
    converged: bool = False

    @property
    def asked(self) -> np.ndarray:
        return self.point if self.direction is None else self.point + self.size * self.direction

    def told(self, loss: float, slope: np.ndarray) -> None:
        point = self.asked
        if self.direction is not None:
            downhill = float(self.slope @ self.direction)
            if not loss <= self.loss + 1e-4 * self.size * downhill:
                bend = loss - self.loss - self.size * downhill
                best = -downhill * self.size / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.5
                self.size *= min(0.5, max(0.1, best))
                if self.size < 1e-10:
                    self._stalled()
                return
            moved, changed = point - self.point, slope - self.slope
            if moved @ changed > 1e-12 * (moved @ moved):
                self.pairs = [*self.pairs, (moved, changed)][-MEMORY:]
            self.steps += 1
        self.point, self.loss, self.slope = point, loss, slope
        self.losses.append(loss)
        flat = np.abs(slope).max() <= 1e-9
        if len(self.losses) > WATCHED:
            flat |= self.losses[-WATCHED - 1] - loss <= self.tol * max(loss, 1e-12)
        if flat:
            self.done = self.converged = True
            return
        self._turn()

    def _stalled(self) -> None:
        if self.pairs:
            self.pairs = []
            self._turn()
        else:  # no downhill step from the steepest direction is left at this precision
            self.done = self.converged = True

    def _turn(self) -> None:
        rest, shares = self.slope.copy(), []
        for moved, changed in reversed(self.pairs):
            share = (moved @ rest) / (moved @ changed)
            shares.append(share)
            rest -= share * changed
        if self.pairs:
            moved, changed = self.pairs[-1]
            rest *= (moved @ changed) / (changed @ changed)
        for (moved, changed), share in zip(self.pairs, reversed(shares)):
            rest += moved * (share - (changed @ rest) / (moved @ changed))
        self.direction = -rest
        self.size = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(rest)))


Lift = Callable[[np.ndarray], np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH):
            rows = batch.slice(first, BATCH)
            x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            yield x, rows.column("y").to_numpy(), rows.column("fold").to_numpy()


def _with_intercept(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def _grouped(machines: list[Machine], points: dict[int, np.ndarray]) -> list[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Per feature map the machines that ask, the folds they hold out and their weights as columns."""
    groups = []
    for lift in sorted({machines[i].lift for i in points}):
        numbers = [i for i in points if machines[i].lift == lift]
        held = np.array([-1 if machines[i].held is None else machines[i].held for i in numbers])
        groups.append((lift, numbers, held, np.stack([points[i] for i in numbers], 1)))
    return groups


def _add(sums: dict[int, np.ndarray], numbers, values) -> None:
    for number, value in zip(numbers, values):
        sums[number] = sums[number] + value if number in sums else value


def _per_task(shared_lifts, shared_points, measure) -> Callable:
    """A task's sum of ``measure`` per machine over its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifts, groups, sums = shared_lifts.value, shared_points.value, {}
        for x, y, folds in _blocks(batches):
            for lift, numbers, held, weights in groups:
                z = _with_intercept(lifts[lift](x))
                _add(sums, numbers, measure(z, y, folds, held, z @ weights))
        yield pa.RecordBatch.from_pydict({
            "machine": pa.array(list(sums), pa.int32()), "value": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    return run


def _loss_and_slope(z, y, folds, held, raw) -> np.ndarray:
    """Per machine the loss, the rows it is over and the gradient."""
    loss, slope = rounded_hinge(y[:, None] * raw)
    mine = folds[:, None] != held[None, :]
    slope = np.where(mine, slope * y[:, None], 0.0)
    return np.concatenate([np.where(mine, loss, 0.0).sum(0)[:, None], mine.sum(0)[:, None], (z.T @ slope).T], 1)


def _advance(searches: dict[int, _Search], max_steps: int, summed: Callable) -> None:
    """Searches taken to their ends, or so many steps far. ``summed`` gives loss, rows and gradient of the points asked for."""
    for _ in range(max_steps):
        asked = {i: s.asked for i, s in searches.items() if not s.done}
        if not asked:
            break
        sums = summed(asked)
        for i, point in asked.items():
            loss, n, slope = sums[i][0], max(1.0, sums[i][1]), sums[i][2:]
            plain = np.append(point[:-1], 0.0)  # the intercept is not penalised
            penalty = searches[i].machine.penalty
            searches[i].told(loss / n + penalty / 2 * (plain @ plain), slope / n + penalty * plain)


def _all_steps(shared_lifts, shared_rows, machines: list[Machine], tol: float, max_steps: int) -> Callable:
    """The machines of a feature map, fitted on all rows; sums are formed as they are over the rows' own partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lift in (k for batch in batches for k in batch.column(0).to_pylist()):
            parts = [[(_with_intercept(shared_lifts.value[lift](x)), y, folds) for x, y, folds in _blocks([part])]
                     for part in shared_rows.value]
            width = next(z.shape[1] for part in parts for z, _, _ in part)
            searches = {i: _Search(m, np.zeros(width), tol) for i, m in enumerate(machines) if m.lift == lift}

            def summed(points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
                (_, numbers, held, weights), = _grouped(machines, points)
                sums: dict[int, np.ndarray] = {}
                for part in parts:
                    own: dict[int, np.ndarray] = {}
                    for z, y, folds in part:
                        _add(own, numbers, _loss_and_slope(z, y, folds, held, z @ weights))
                    _add(sums, own, own.values())
                return sums

            _advance(searches, max_steps, summed)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(searches), pa.int32()), pa.array([s.point.tolist() for s in searches.values()], pa.list_(pa.float64())),
                pa.array([float(s.loss) for s in searches.values()]), pa.array([s.steps for s in searches.values()], pa.int32()),
                pa.array([s.converged for s in searches.values()])], ["machine", "weights", "loss", "steps", "converged"])

    return run


def _hits(z, y, folds, held, raw) -> np.ndarray:
    """Per machine the held-out rows it gets right, and all of them."""
    theirs = folds[:, None] == held[None, :]
    right = theirs & ((raw > 0) == (y[:, None] > 0))
    return np.stack([right.sum(0), theirs.sum(0)], 1).astype(float)


class Machines:
    """Rows, feature maps and machines that are fitted side by side.

    ``rows`` holds x (array<double>), y (-1.0 or 1.0) and fold (int); beyond ``held`` features it is read once per step, so pass a
    persisted or written table. ``lifts`` turn a matrix of x into one of features.
    """

    def __init__(self, rows: DataFrame, lifts: list[Lift], machines: list[Machine], direct_tasks: int = DIRECT_TASKS,
                 held: int = HELD) -> None:
        self.rows, self.machines, self.held = rows.select("x", "y", "fold"), machines, held
        self.context = rows.sparkSession.sparkContext
        self.lifts = self.context.broadcast(lifts)
        self.direct = rows.rdd.getNumPartitions() <= direct_tasks

    def _summed(self, points: dict[int, np.ndarray], measure) -> dict[int, np.ndarray]:
        shared = self.context.broadcast(_grouped(self.machines, points))
        found = self.rows.mapInArrow(_per_task(self.lifts, shared, measure), PARTS)
        if not self.direct:
            total = Summarizer.sum(array_to_vector("value"))
            found = found.groupBy("machine").agg(vector_to_array(total).alias("value"))
        sums: dict[int, np.ndarray] = {}
        for r in found.collect():  # one row per machine, and per task while those are few
            value = np.array(r["value"])
            sums[r["machine"]] = sums[r["machine"]] + value if r["machine"] in sums else value
        shared.destroy()
        return sums

    def fit(self, tol: float = 1e-4, max_steps: int = 1_000) -> list[Fitted]:
        """Every machine at the least of its rounded hinge plus half its penalty times the squared weights.

        A machine has converged when its loss fell by no more than ``tol`` of itself over the last ten steps, or its gradient
        is zero. ``max_steps`` bounds the passes; a machine stopped by it says so. Raises ValueError without rows.
        """
        first = self.rows.select("x").first()
        if first is None:
            raise ValueError("no rows to train on")
        probe = np.array([first["x"]])
        widths = [lift(probe).shape[1] + 1 for lift in self.lifts.value]
        if self.rows.count() * max(widths) <= self.held:
            return self._fit_in_tasks(len(widths), tol, max_steps)
        searches = {i: _Search(m, np.zeros(widths[m.lift]), tol) for i, m in enumerate(self.machines)}
        _advance(searches, max_steps, lambda points: self._summed(points, _loss_and_slope))
        return [Fitted(s.point, float(s.loss), s.steps, s.converged) for s in searches.values()]

    def _fit_in_tasks(self, lifts: int, tol: float, max_steps: int) -> list[Fitted]:
        local = self.rows.withColumn("_part", F.spark_partition_id()).toArrow()
        each = [local.filter(pc.equal(local["_part"], k)).combine_chunks().to_batches() for k in pc.unique(local["_part"]).to_pylist()]
        shared = self.context.broadcast([part for part, in each])
        found = self.rows.sparkSession.range(0, lifts, 1, lifts) \
            .mapInArrow(_all_steps(self.lifts, shared, self.machines, tol, max_steps), FITTED).collect()
        shared.destroy()
        return [Fitted(np.array(r["weights"]), r["loss"], r["steps"], r["converged"]) for r in sorted(found, key=lambda r: r["machine"])]

    def accuracies(self, fitted: list[Fitted]) -> list[float | None]:
        """Share of held-out rows each machine gets right; None where it holds out none."""
        sums = self._summed({i: f.weights for i, f in enumerate(fitted)}, _hits)
        return [sums[i][0] / sums[i][1] if i in sums and sums[i][1] else None for i in range(len(fitted))]

    def close(self) -> None:
        self.lifts.destroy()
