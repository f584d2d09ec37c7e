"""The logistic regressions of all labels, fitted together.

Every label has its own independent model, as in ``training.fit_label_models``, but all are
fitted in the same passes: a pass multiplies the examples' sparse features with a block of
weights, one row per label, and adds up a block of gradients.  So the number of passes is that
of the slowest label and not the sum over labels, and the examples are tokenised and read once
a pass whatever the number of labels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from palaver.fixed import EMOTIONS
from palaver.operators.training import (
    MAX_FEATURES,
    MAX_ITERATIONS,
    MIN_DOCUMENTS,
    fit_tfidf,
)

# Norm of the gradient of the mean penalised loss at which a label is done.
GRADIENT = 1e-5
# Steps that the curvature is estimated from: the more, the fewer passes.  At least, at most, and
# bytes that those of all labels may take of the driver beyond the least.
MEMORY, MOST_MEMORY = 10, 100
MEMORY_BYTES = 256_000_000
# Entries of a block that are multiplied at a time, least entries of a task for each number it
# returns, and partial sums added by one task.
ENTRIES = 100_000
CELLS_EACH = 2
FAN_IN = 8
# Entries of a task from which on it takes longer than it takes to start, least tasks of a core,
# and bytes of partial sums that the driver adds itself.
TASK_ENTRIES = 4_000_000
TASKS_EACH = 2
SENT_BYTES = 32_000_000
# Blocks that are handed to Python at a time; few stay in a core's cache.
BLOCKS_SENT = 4


@dataclass(frozen=True)
class MultiLabelModel:
    """Fitted features, and a weight row and an intercept per label.

    ``constant`` has the labels that all or no examples had, with that answer; their
    weights are 0.  ``passes`` is how often the examples were read for the fit.
    """

    features: PipelineModel
    labels: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    constant: dict[str, bool] = field(default_factory=dict)
    passes: int = 0

    def margins(self, df: DataFrame, output: str = "margins") -> DataFrame:
        """Append ``array<double>``, per label the log-odds; infinite for constant ones."""
        rows = self.features.transform(df).withColumn("features", F.unwrap_udt("features"))
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.intercepts))
        fixed = [self.constant.get(n) for n in self.labels]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, intercepts = shared.value
            for batch in batches:
                vectors = batch.column(batch.num_columns - 1)
                out = np.concatenate(
                    [np.empty((0, len(intercepts))), *_margins(*_sparse(vectors), weights)]
                )
                out += intercepts
                for i, value in enumerate(fixed):
                    if value is not None:
                        out[:, i] = np.inf if value else -np.inf
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]
                lists = pa.ListArray.from_arrays(ends, out.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, lists], names=[*batch.schema.names, output]
                )

        kept = rows.select(*df.columns, "features")
        added = T.StructField(output, T.ArrayType(T.DoubleType()))
        return kept.mapInArrow(run, T.StructType([*kept.schema.fields, added]))

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """Append the labels of probability above one half, in the model's order."""
        named = F.lit(list(self.labels)) if self.labels else F.array().cast("array<string>")
        chosen = F.filter(
            F.transform(named, lambda name, i: F.when(F.get("_margins", i) > 0, name)),
            lambda name: name.isNotNull(),
        )
        return self.margins(df, "_margins").select(*df.columns, chosen.alias(output))


def _sparse(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, columns and values of the rows of an array of sparse or dense vectors."""
    kinds = vectors.field("type").to_numpy(zero_copy_only=False)
    if (kinds == 0).all() and len(kinds):
        columns, values = vectors.field("indices"), vectors.field("values")
        ends = values.offsets.to_numpy() - values.offsets[0].as_py()
        return ends.astype(np.int64), columns.flatten().to_numpy(), values.flatten().to_numpy()
    rows = [
        (v["indices"] if v["type"] == 0 else range(len(v["values"])), v["values"])
        for v in vectors.to_pylist()
    ]
    ends = np.concatenate([[0], np.cumsum([len(v) for _, v in rows])]).astype(np.int64)
    columns = np.fromiter((i for c, _ in rows for i in c), dtype=np.int64)
    return ends, columns, np.fromiter((x for _, v in rows for x in v), dtype=np.float64)


def _margins(
    ends: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray
) -> Iterator[np.ndarray]:
    """Products of the rows with every label's weights, some rows at a time."""
    at, by_term = 0, weights.T
    while at < len(ends) - 1:
        to = int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1
        to = max(to, at + 1)
        a, b = ends[at], ends[to]
        cells = by_term[columns[a:b]] * values[a:b, None]
        out = np.zeros((to - at, weights.shape[0]))
        filled = np.flatnonzero(np.diff(ends[at : to + 1]))
        if len(filled):
            out[filled] = np.add.reduceat(cells, ends[at:to][filled] - a, axis=0)
        yield out
        at = to


def _example_blocks(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Examples as binary blocks of about ``ENTRIES`` entries: rows, entries and truth."""
    names = {name: i for i, name in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, columns, values = _sparse(batch.column(0))
            truth = np.zeros((batch.num_rows, len(names)), dtype=np.uint8)
            for i, labels in enumerate(batch.column(1).to_pylist()):
                truth[i, [names[x] for x in labels or () if x in names]] = 1
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1
                to = max(to, at + 1)
                part = slice(ends[at], ends[to])
                parts = [
                    (ends[at : to + 1] - ends[at]).astype(np.int64),
                    columns[part].astype(np.int32),
                    values[part].astype(np.float64),
                    truth[at:to],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes()], type=pa.binary()) for p in parts],
                    names=["ends", "columns", "values", "truth"],
                )
                at = to

    schema = "ends binary, columns binary, values binary, truth binary"
    return rows.mapInArrow(run, schema)


def _loss_and_gradient(
    blocks: DataFrame, tasks: int, points: np.ndarray, active: np.ndarray, labels: int
) -> tuple[np.ndarray, np.ndarray]:
    """Summed losses and gradients of the active labels; the last column is the intercept."""
    session = blocks.sparkSession
    shared = session.sparkContext.broadcast((points, active))
    schema = "slot int, loss binary, gradient binary"

    def packed(slot: int, loss: np.ndarray, gradient: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([slot], type=pa.int32()),
                pa.array([loss.tobytes()], type=pa.binary()),
                pa.array([gradient.tobytes()], type=pa.binary()),
            ],
            names=["slot", "loss", "gradient"],
        )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, chosen = shared.value
        loss, gradient = np.zeros(len(chosen)), np.zeros(weights.shape)
        for batch in batches:
            for ends, columns, values, truth in zip(*batch.columns, strict=True):
                ends = np.frombuffer(ends.as_buffer(), dtype=np.int64)
                columns = np.frombuffer(columns.as_buffer(), dtype=np.int32).astype(np.intp)
                values = np.frombuffer(values.as_buffer(), dtype=np.float64)
                truth = np.frombuffer(truth.as_buffer(), dtype=np.uint8)
                truth = truth.reshape(-1, labels)[:, chosen].astype(np.float64)
                rows, width = len(ends) - 1, weights.shape[1] - 1
                row = np.repeat(np.arange(rows), np.diff(ends))
                for i, weight in enumerate(weights):
                    cells = values * weight[columns]
                    margin = np.bincount(row, cells, minlength=rows) + weight[-1]
                    loss[i] += (np.logaddexp(0, margin) - truth[:, i] * margin).sum()
                    error = 0.5 * (1 + np.tanh(margin / 2)) - truth[:, i]
                    cells = values * error[row]
                    gradient[i, :-1] += np.bincount(columns, cells, minlength=width)
                    gradient[i, -1] += error.sum()
        yield packed(TaskContext.get().partitionId(), loss, gradient)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        sums = [
            sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for x in table.column(c))
            for c in ("loss", "gradient")
        ]
        return pa.Table.from_batches([packed(key[0].as_py(), *sums)])

    parts, slots = blocks.mapInArrow(judge, schema), tasks
    while slots > FAN_IN and slots * points.nbytes > SENT_BYTES:
        up = F.floor(F.col("slot") / FAN_IN).cast("int")
        parts = parts.withColumn("slot", up).groupBy("slot").applyInArrow(add, schema)
        slots = -(-slots // FAN_IN)
    found = parts.toArrow()
    shared.destroy()
    loss = sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for x in found.column("loss"))
    flat = sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for x in found.column("gradient"))
    return loss, flat.reshape(points.shape)


@contextmanager
def _batches_of(session: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile Arrow batches have at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = session.conf.get(name)
    session.conf.set(name, str(rows))
    try:
        yield
    finally:
        session.conf.set(name, before)


# From points and the numbers of the problems they belong to: values and gradients.
Evaluate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Descent:
    """L-BFGS of one convex problem, fed one evaluation at a time."""

    def __init__(self, width: int, tolerance: float, memory: int = MEMORY) -> None:
        self.point, self.trial = np.zeros(width), np.zeros(width)
        self.tolerance = tolerance
        self.value, self.gradient = np.inf, None
        self.pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
        self.step, self.done = 1.0, False

    def tell(self, value: float, gradient: np.ndarray) -> None:
        """The trial's value and gradient; sets the next trial, or is done."""
        if self.gradient is not None:
            slope = float(self.gradient @ self.direction)
            if not value <= self.value + 1e-4 * self.step * slope + 1e-14 * abs(self.value):
                # Too far: the least of the parabola through what is known, within bounds.
                rise = value - self.value - self.step * slope
                best = -slope * self.step**2 / (2 * rise) if rise > 0 else 0.0
                self.step = min(max(best, 0.1 * self.step), 0.5 * self.step)
                self.done = self.step < 1e-12
                self.trial = self.point + self.step * self.direction
                return
            moved, bent = self.trial - self.point, gradient - self.gradient
            curvature = float(moved @ bent)
            if curvature > 1e-16 * float(bent @ bent):
                self.pairs.append((moved, bent, curvature))
        self.point, self.value, self.gradient = self.trial, value, gradient
        size = float(np.linalg.norm(gradient))
        if size <= self.tolerance:
            self.done = True
            return
        self.direction = self._direction()
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / size)
        self.trial = self.point + self.step * self.direction

    def _direction(self) -> np.ndarray:
        out, kept = -self.gradient, []
        for moved, bent, curvature in reversed(self.pairs):
            share = float(moved @ out) / curvature
            kept.append(share)
            out = out - share * bent
        if self.pairs:
            _, bent, curvature = self.pairs[-1]
            out = out * (curvature / float(bent @ bent))
        for (moved, bent, curvature), share in zip(self.pairs, reversed(kept), strict=True):
            out = out + (share - float(bent @ out) / curvature) * moved
        return out


def minimise(
    evaluate: Evaluate, problems: int, width: int, tolerance: float, passes: int
) -> tuple[np.ndarray, int]:
    """The least points of independent convex problems, and the passes it took.

    Each problem has its own step length and curvature; a pass evaluates one trial of every
    problem that is not done yet.
    """
    # A step is kept as two rows of doubles.
    memory = min(MOST_MEMORY, MEMORY_BYTES // max(16 * width * problems, 1))
    all_ = [_Descent(width, tolerance, max(memory, MEMORY)) for _ in range(problems)]
    used = 0
    while used < passes:
        active = np.array([i for i, d in enumerate(all_) if not d.done], dtype=np.int64)
        if not len(active):
            break
        values, gradients = evaluate(np.stack([all_[i].trial for i in active]), active)
        used += 1
        for i, value, gradient in zip(active, values, gradients, strict=True):
            all_[i].tell(float(value), gradient)
    points = [d.point for d in all_]
    return np.stack(points) if points else np.empty((0, width)), used


def fit_multilabel(
    examples: DataFrame,
    vocabulary: Sequence[str] = EMOTIONS,
    text: str = "text",
    labels: str = "labels",
    c: float = 1.0,
    max_passes: int = MAX_ITERATIONS,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    tolerance: float = GRADIENT,
) -> MultiLabelModel:
    """Fit one binary model per label, all in the same passes over the examples.

    The penalty is C = ``c`` in the sum-of-losses convention, none on the intercept.  A label
    that all or no examples have is constant.  The driver holds ``MEMORY`` weight rows of each
    label twice over, which ``max_features`` bounds, or up to ``MOST_MEMORY`` of them in
    ``MEMORY_BYTES``; examples never reach it.
    """
    features = fit_tfidf(examples, text, max_features, min_documents)
    width = len(features.stages[3].vocabulary)
    rows = features.transform(examples).select(
        F.unwrap_udt("features").alias("features"), F.col(labels).alias("labels")
    )
    # Kept as they are, so that a pass does not unpack them.
    blocks = _example_blocks(rows, vocabulary).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        *totals, n, entries = map(int, _label_counts(blocks, len(vocabulary)))
        varied = np.array([i for i, t in enumerate(totals) if 0 < t < n], dtype=np.int64)
        # Every task returns a block of gradients, so it should have more entries than that.
        tasks = max(1, entries // max(CELLS_EACH * width * len(varied), ENTRIES))
        cores = examples.sparkSession.sparkContext.defaultParallelism
        tasks = min(tasks, max(TASKS_EACH * cores, entries // TASK_ENTRIES))
        packed = blocks.coalesce(tasks)

        def evaluate(points: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            loss, gradient = _loss_and_gradient(
                packed, tasks, points, varied[active], len(vocabulary)
            )
            held = points.copy()
            held[:, -1] = 0.0
            return loss / n + (held**2).sum(axis=1) / (2 * c * n), gradient / n + held / (c * n)

        with _batches_of(examples.sparkSession, BLOCKS_SENT):
            found, passes = minimise(evaluate, len(varied), width + 1, tolerance, max_passes)
    finally:
        blocks.unpersist()
    weights = np.zeros((len(vocabulary), width + 1))
    weights[varied] = found
    constant = {
        name: total > 0 for name, total in zip(vocabulary, totals, strict=True) if total in (0, n)
    }
    return MultiLabelModel(
        features, tuple(vocabulary), weights[:, :-1].copy(), weights[:, -1].copy(), constant, passes
    )


def _label_counts(blocks: DataFrame, labels: int) -> np.ndarray:
    """Examples with each label, then all examples, then all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(labels + 2, dtype=np.int64)
        for batch in batches:
            for ends, truth in zip(batch.column(0), batch.column(1), strict=True):
                ends = np.frombuffer(ends.as_buffer(), dtype=np.int64)
                total[-2:] += len(ends) - 1, ends[-1]
                if labels:
                    found = np.frombuffer(truth.as_buffer(), dtype=np.uint8)
                    total[:-2] += found.reshape(-1, labels).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(labels + 2), type=pa.int32()), pa.array(total)], names=["i", "n"]
        )

    counted = blocks.select("ends", "truth").mapInArrow(run, "i int, n bigint")
    out = np.zeros(labels + 2, dtype=np.int64)
    for row in counted.groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[row["i"]] = row["n"]
    return out


def optimality(
    model: MultiLabelModel, examples: DataFrame, labels: str = "labels", c: float = 1.0
) -> DataFrame:
    """``(label, n, positives, constant, gradient)`` of a model on the rows it was fitted on.

    ``gradient`` is the norm of the mean penalised loss's gradient, 0 for a constant label;
    near 0 the fit is optimal.  It is added up from the features' entries, term by term.
    """
    spark = examples.sparkSession
    names = model.labels
    judged = model.margins(examples.select("*"), "_margins")
    errors = [
        (
            1 / (1 + F.exp(-F.get("_margins", F.lit(i))))
            - F.array_contains(labels, name).cast("double")
        ).alias(f"_e{i}")
        for i, name in enumerate(names)
    ]
    rows = judged.select("features", *errors, labels).persist(StorageLevel.MEMORY_AND_DISK)
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.array_contains(labels, x)).alias(f"_{i}") for i, x in enumerate(names)],
        *[F.sum(f"_e{i}").alias(f"_s{i}") for i in range(len(names))],
    ).first()
    n = totals["n"]
    sums = [f"_e{i}" for i in range(len(names))]
    cells = rows.select(
        F.inline(F.arrays_zip(F.col("features.indices").alias("term"), F.col("features.values").alias("v"))),
        *sums,
    )
    slopes = cells.groupBy("term").agg(*[F.sum(F.col("v") * F.col(s)).alias(s) for s in sums])
    table = pa.table(
        {"term": np.arange(model.weights.shape[1], dtype=np.int32)}
        | {f"_w{i}": model.weights[i] for i in range(len(names))}
    )
    joined = spark.createDataFrame(table).join(slopes, "term", "left")
    norms = joined.agg(
        *[
            F.sum(
                (F.coalesce(f"_e{i}", F.lit(0.0)) / n + F.col(f"_w{i}") / (c * n)) ** 2
            ).alias(f"_{i}")
            for i in range(len(names))
        ]
    ).first()
    rows.unpersist()
    out = []
    for i, name in enumerate(names):
        constant = name in model.constant
        norm = 0.0 if constant else (norms[f"_{i}"] + (totals[f"_s{i}"] / n) ** 2) ** 0.5
        out.append((name, n, totals[f"_{i}"], constant, norm))
    schema = "label string, n bigint, positives bigint, constant boolean, gradient double"
    return spark.createDataFrame(out, schema)
