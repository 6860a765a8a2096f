"""Linear support vector machines, one against the rest, by Newton steps over all classes at once.

The hinge loss max(0, u) is smoothed to (u + sqrt(u^2 + width^2)) / 2, which is above it by at most half a width. A pass
over the rows adds up, for every class, the gradient and the curvature in each task; a task for each class adds up
tasks and solves for the next step. The width is halved with each whole step, down to ``LAST_WIDTH``, so the solution
is reached in a few dozen passes. A solver that follows gradients of the hinge itself takes thousands for each
class, as most rows of a learned rule lie right at its corner. A pass also tells the losses of other parts of its
step; one of them is taken where it gains clearly more.

Blocks of rows keep columns of zeros and ones as bits, all others as doubles.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.config import FIT_PARTITION_ROWS, FIT_PARTITIONS

#: Width of the smoothing at first, what a step leaves of it, and at last.
FIRST_WIDTH, SHRINK, LAST_WIDTH = 1.0, 0.5, 1e-3
#: Parts of a step whose losses a pass tells, the whole step first, and what gain of the best part that must have.
PARTS, ENOUGH = np.r_[1.0, 2.0, 4.0, 0.5 ** np.arange(1, 10)], 0.7
#: Least gain of a step at the last width, as a part of the loss or, below it, of a loss that doesn't matter.
LEAST_GAIN, NO_LOSS = 1e-6, 0.05
#: Bytes of curvature, over all classes of a pass, that a task holds at most.
CURVATURE_BYTES = 1 << 26
#: Features up to which the curvature is added up; wider vectors go to Spark ML's gradient solver.
MOST_FEATURES = 2_000
#: Rows in one partition beyond ``FIT_PARTITIONS`` of them.
PARTITION_ROWS = 100_000
#: Values of a block.
BLOCK_VALUES = 1 << 19
_BLOCKS = "plain binary, bits binary, of_bits binary, label binary, weight binary"
_SUMS = "part int, position int, losses binary, gradient binary, curvature binary"
_STEP = "position int, losses binary, step binary"


@dataclass
class _State:
    """Where a class is: its coefficients, intercept last, the step to try, and the loss without it if that is known."""

    at: np.ndarray
    step: np.ndarray
    width: float = FIRST_WIDTH
    loss: float | None = None

    @property
    def next_width(self) -> float:
        return self.width if self.loss is None else max(self.width * SHRINK, LAST_WIDTH)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
        label, weight = batch["label"].to_numpy().astype(np.int32), batch["weight"].to_numpy()
        size = max(1, BLOCK_VALUES // max(values.shape[1], 1))
        for a in range(0, len(values), size):
            x = values[a : a + size]
            of_bits = ((x == 0) | (x == 1)).all(axis=0)
            parts = x[:, ~of_bits], np.packbits(x[:, of_bits].astype(bool), axis=1), of_bits, label[a : a + size], weight[a : a + size]
            columns = [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, names=["plain", "bits", "of_bits", "label", "weight"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values with a one at the end, label, weight) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            kept = {n: batch[n][i].as_buffer() for n in batch.schema.names}
            label, weight = np.frombuffer(kept["label"], dtype=np.int32), np.frombuffer(kept["weight"])
            of_bits, n = np.frombuffer(kept["of_bits"], dtype=bool), len(label)
            x = np.ones((n, len(of_bits) + 1))
            x[:, :-1][:, ~of_bits] = np.frombuffer(kept["plain"]).reshape(n, -1)
            if of_bits.any():
                bits = np.frombuffer(kept["bits"], dtype=np.uint8).reshape(n, -1)
                x[:, :-1][:, of_bits] = np.unpackbits(bits, axis=1, count=int(of_bits.sum()))
            yield x, label, weight


def _loss(u: np.ndarray, width: float) -> np.ndarray:
    return (u + np.sqrt(u * u + width * width)) / 2


def _added(x: np.ndarray, label: np.ndarray, weight: np.ndarray, states: dict[int, _State]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each class the losses of all parts of its step and, at the next width, behind it, with gradient and curvature there."""
    here = x @ np.stack([s.at for s in states.values()], axis=1)
    more = x @ np.stack([s.step for s in states.values()], axis=1)
    for k, (position, state) in enumerate(states.items()):
        sign, width = np.where(label == position, 1.0, -1.0), state.next_width
        base, gained = 1 - sign * here[:, k], sign * more[:, k]
        losses = [weight @ _loss(base - part * gained, state.width) for part in PARTS] if state.loss is not None else [0.0] * len(PARTS)
        behind = base - gained
        root = np.sqrt(behind * behind + width * width)
        gradient = -(weight * sign * (1 + behind / root) / 2) @ x
        curvature = (x.T * (weight * width * width / (2 * root**3))) @ x
        yield np.array([*losses, weight @ _loss(behind, width)]), gradient, curvature


def _sums(states: dict[int, _State]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for block in _rows(batches):
            own = list(_added(*block, states))
            sums = own if sums is None else [tuple(a + b for a, b in zip(x, y, strict=True)) for x, y in zip(sums, own, strict=True)]
        if sums:
            part = pa.array([TaskContext.get().partitionId()] * len(states), pa.int32())
            columns = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*sums, strict=True)]
            names = ["part", "position", "losses", "gradient", "curvature"]
            yield pa.RecordBatch.from_arrays([part, pa.array(list(states), pa.int32()), *columns], names=names)

    return run


def _solved(state: _State, sums: tuple[np.ndarray, ...], total: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses with the penalty, the one at the next width last, and the next step of a class."""
    losses, gradient, curvature = (x / total for x in sums)
    held = np.append(np.full(len(state.at) - 1, penalty), 0.0)
    tried = state.at + np.append(PARTS, 1.0)[:, None] * state.step
    curvature = curvature.reshape(len(held), -1) + np.diag(held)
    # A class that all rows have bends its intercept hardly at all.
    curvature[np.diag_indices(len(held))] += 1e-12 * curvature.diagonal().max()
    return losses + tried**2 @ held / 2, -np.linalg.solve(curvature, gradient + held * tried[0])


def _steps(states: dict[int, _State], total: float, penalty: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        position, order = key[0].as_py(), np.argsort(rows["part"].to_numpy())
        sums = (sum(np.frombuffer(rows[n][int(i)].as_buffer()) for i in order) for n in ("losses", "gradient", "curvature"))
        found = _solved(states[position], tuple(sums), total, penalty)
        columns = [pa.array([position], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in found)]
        return pa.table(columns, names=["position", "losses", "step"])

    return run


def _moved(state: _State, losses: np.ndarray, step: np.ndarray) -> bool:
    """Whether a class is done; else it goes on from where its step has led."""
    if state.loss is None:
        state.loss, state.step = losses[-1], step
        return False
    gains = state.loss - losses[:-1]
    best = int(gains.argmax())
    if gains[0] >= ENOUGH * gains[best]:
        best = 0
    if gains[best] > 0:
        state.at = state.at + PARTS[best] * state.step
    if state.width <= LAST_WIDTH and gains[best] <= LEAST_GAIN * max(state.loss, NO_LOSS):
        return True
    if best == 0 and gains[0] > 0:
        state.width, state.loss, state.step = state.next_width, losses[-1], step
    else:
        # Nothing is known yet behind another part of the step.
        state.width, state.loss, state.step = state.width if gains[best] > 0 else state.next_width, None, np.zeros_like(step)
    return False


class OneVsRestMarginsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Margins of all classes and the position of the largest, the first among equals."""

    payload = Param(Params._dummy(), "payload", "coefficients by class, intercept last, packed")

    @keyword_only
    def __init__(self, *, payload: str | None = None):
        super().__init__()
        if payload is not None:
            self._set(payload=payload)

    @property
    def coefficients(self) -> np.ndarray:
        return np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.payload))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = self.coefficients

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                margins = batch.flatten().to_numpy().reshape(len(batch), -1) @ own[:, :-1].T + own[:, -1]
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(own))
                yield pa.ListArray.from_arrays(ends, pa.array(margins.ravel()))

        found = dataset.withColumn("__margins", scored(vector_to_array("features")))
        best = (F.array_position("__margins", F.array_max("__margins")) - 1).cast("double")
        return found.withColumns({"rawPrediction": array_to_vector("__margins"), "prediction": best}).drop("__margins")


@dataclass(frozen=True)
class NewtonSvm:
    """Settings; ``fit`` takes (features, label_position[, weight]). At most ``max_iter`` passes for a class.

    The mean loss, by weight, has ``reg_param / 2`` times the squared coefficients added, intercepts left out.
    """

    max_iter: int
    reg_param: float
    weighted: bool = True

    @staticmethod
    def partitions(n_rows: int) -> int:
        """Tasks bring sums by class, not by node, so their number may grow with the rows."""
        return max(1, min(-(-n_rows // FIT_PARTITION_ROWS), FIT_PARTITIONS), -(-n_rows // PARTITION_ROWS))

    def fit(self, vectors: DataFrame) -> OneVsRestMarginsModel | OneVsRestModel:
        weight = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        rows = vectors.select(
            vector_to_array("features").alias("x"), F.col("label_position").cast("int").alias("label"), weight.alias("weight")
        )
        n_features, n_classes, total = rows.agg(F.max(F.size("x")), F.max("label") + 1, F.sum("weight")).first()
        if n_features > MOST_FEATURES:
            options = dict(maxIter=self.max_iter, regParam=self.reg_param, standardization=False)
            known = dict(labelCol="label_position", featuresCol="features", **({"weightCol": "weight"} if self.weighted else {}))
            return OneVsRest(classifier=LinearSVC(**options), parallelism=4, **known).fit(vectors)
        at_once = max(1, CURVATURE_BYTES // (8 * (n_features + 1) ** 2))
        state = rows.mapInArrow(_packed, _BLOCKS).persist()
        try:
            found = []
            for first in range(0, n_classes, at_once):
                found += self._classes(state, range(first, min(first + at_once, n_classes)), n_features, total)
        finally:
            state.unpersist()
        packed = io.BytesIO()
        np.save(packed, np.stack(found))
        return OneVsRestMarginsModel(payload=base64.b64encode(packed.getvalue()).decode())

    def _classes(self, state: DataFrame, positions: range, n_features: int, total: float) -> list[np.ndarray]:
        every = {k: _State(np.zeros(n_features + 1), np.zeros(n_features + 1)) for k in positions}
        open_ = dict(every)
        for _ in range(self.max_iter):
            sums = state.mapInArrow(_sums(open_), _SUMS)
            found = sums.groupBy("position").applyInArrow(_steps(open_, total, self.reg_param), _STEP).collect()
            for row in found:
                if _moved(every[row["position"]], np.frombuffer(row["losses"]), np.frombuffer(row["step"])):
                    del open_[row["position"]]
            if not open_:
                break
        return [s.at for s in every.values()]
