"""Iterative training with evaluation steps (M04-M06): joint heads on a shared
projection, checkpoints, resumption, reload of the best.

The model is small and dense: hashed words with inverse document frequencies
and extra numbers are projected to ``hidden`` values, which all tasks share,
and one logistic head per task reads them.  All parameters are fitted together
under the weighted sum of the tasks' cross-entropies (A12) by L-BFGS.

One evaluation of loss and gradient is one Spark job.  Every task sums its rows'
gradients; the sums are added in a tree of small groups (:func:`task_sums`), as
fixed-point integers, so the total does not hang on the order in which they
arrive and a resumed run gives the same model as one that was never stopped.
The driver holds the parameters and a few gradients, whose size is that of
the model, not of the data.

A checkpoint is all that a run needs to go on.  Two are kept, in two places: a
new one overwrites the place that does not hold the best.  The log has an entry per
checkpoint, written behind it; the best is chosen from the log by M06.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.metrics import EPS, TASK_WEIGHTS, select_checkpoint
from textlens.session import scratch_dir

_UNIT = 2.0**32  # fixed-point units of a sum
_FAN = 32  # sums added in one task
_MEMORY = 8  # pairs that L-BFGS remembers
_LOG = "run_id STRING, step INT, eval_loss DOUBLE, place INT"


# ---------------------------------------------------------------- features
def word_numbers(text_col: str, n_words: int):
    """The words of a text (Unicode word characters, lower case) as hashed numbers, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_words)).cast("int"))


@dataclass
class Features:
    """How rows become numbers: inverse document frequencies of the hashed
    words, mean and scale of the extra columns."""

    n_words: int
    extra_cols: tuple[str, ...]
    idf: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, text_col: str, extra_cols: Sequence[str], n_words: int) -> Features:
        one = rows.select(F.explode(F.array_distinct(word_numbers(text_col, n_words))).alias("w"))
        seen = {r.w: r.n for r in one.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # n_words rows at most
        extra = [F.col(c).cast("double") for c in extra_cols]
        s = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(extra)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(extra)]).first()
        held = np.array([seen.get(i, 0) for i in range(n_words)])
        k = range(len(extra))
        return cls(n_words, tuple(extra_cols), np.log((s.n + 1) / (held + 1)) + 1e-3,
                   np.array([s[f"m{i}"] or 0.0 for i in k]), np.array([s[f"s{i}"] or 1.0 for i in k]))

    def columns(self, text_col: str) -> list:
        extra = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.extra_cols]).cast("array<double>")
        return [word_numbers(text_col, self.n_words).alias("words"), extra.alias("extra")]

    def matrix(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of every word, its weight (rows have length 1), and the scaled extra columns."""
        words = batch.column("words")
        word = words.flatten().to_numpy()
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        weight = self.idf[word]
        length = np.sqrt(np.bincount(row, weight * weight, len(words)))
        extra = batch.column("extra").flatten().to_numpy().reshape(len(words), len(self.extra_cols))
        return row, word, weight / length[row], (extra - self.mean) / self.scale


# ---------------------------------------------------------------- model
@dataclass
class TextNet:
    """A shared projection and a logistic head per task."""

    features: Features
    tasks: tuple[str, ...]
    hidden: int
    theta: np.ndarray = field(repr=False)

    @classmethod
    def start(cls, features: Features, tasks: Sequence[str], hidden: int, seed: int) -> TextNet:
        n = features.n_words + len(features.extra_cols)
        rnd = np.random.default_rng(seed)
        theta = np.concatenate([rnd.normal(0, 0.3, n * hidden), np.zeros(hidden),
                                rnd.normal(0, 1 / np.sqrt(hidden), hidden * len(tasks)), np.zeros(len(tasks))])
        return cls(features, tuple(tasks), hidden, theta)

    def parts(self, theta: np.ndarray) -> list[np.ndarray]:
        """Views: projection of words and extra columns, its offsets, heads, their offsets."""
        f, m, t = self.features, self.hidden, len(self.tasks)
        sizes = [(f.n_words, m), (len(f.extra_cols), m), (m,), (m, t), (t,)]
        at = np.cumsum([0, *[int(np.prod(s)) for s in sizes]])
        return [theta[a:b].reshape(s) for a, b, s in zip(at, at[1:], sizes)]

    def _forward(self, x, n: int) -> tuple[np.ndarray, np.ndarray]:
        words, extras, offset, heads, bias = self.parts(self.theta)
        row, word, weight, extra = x
        h = np.stack([np.bincount(row, weight * words[word, j], n) for j in range(self.hidden)], 1)
        a = np.tanh(h + extra @ extras + offset)
        return a, a @ heads + bias

    def probabilities(self, batch: pa.RecordBatch) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(self.features.matrix(batch), batch.num_rows)[1]))

    def loss_and_gradient(self, batch: pa.RecordBatch, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the rows of ``batch`` of the weighted cross-entropies
        (labels ``y`` per task, nan for none) and of their gradient."""
        x = self.features.matrix(batch)
        a, z = self._forward(x, batch.num_rows)
        known = ~np.isnan(y)
        label = np.where(known, y, 0)
        loss = float((weight * np.where(known, np.logaddexp(0, z) - label * z, 0)).sum())
        dz = weight * np.where(known, 1 / (1 + np.exp(-z)) - label, 0)
        heads = self.parts(self.theta)[3]
        dh = dz @ heads.T * (1 - a * a)
        row, word, w, extra = x
        grad = np.zeros_like(self.theta)
        g = self.parts(grad)
        for j in range(self.hidden):
            g[0][:, j] = np.bincount(word, w * dh[row, j], self.features.n_words)
        g[1][:], g[2][:], g[3][:], g[4][:] = extra.T @ dh, dh.sum(0), a.T @ dz, dz.sum(0)
        return loss, grad

    # ------------------------------------------------------------ use
    def predict(self, df: DataFrame, id_col: str, text_col: str = "text", label_cols: Mapping[str, str] | None = None) -> DataFrame:
        """Long predictions ``(id, task, y, p, yhat)``: features are computed
        once for all tasks.  ``y`` is the label column's value, null without one."""
        labels = [(label_cols or {}).get(t) for t in self.tasks]
        rows = df.select(F.col(id_col).alias("id"), *self.features.columns(text_col),
                         F.array(*[F.col(c).cast("int") if c else F.lit(None).cast("int") for c in labels]).alias("y"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self.probabilities(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(list(p), pa.list_(pa.float64()))], ["id", "y", "p"])

        out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y array<int>, p array<double>")
        each = F.arrays_zip(F.array(*[F.lit(t) for t in self.tasks]).alias("task"), F.col("y"), F.col("p"))
        one = out.select(F.col("id").alias(id_col), F.explode(each).alias("e"))
        return one.select(id_col, "e.task", "e.y", "e.p", (F.col("e.p") > 0.5).cast("int").alias("yhat"))

    # ------------------------------------------------------------ storage
    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        f = self.features
        return ({"n_words": f.n_words, "extra_cols": list(f.extra_cols), "tasks": list(self.tasks), "hidden": self.hidden},
                {"idf": f.idf, "mean": f.mean, "scale": f.scale, "theta": self.theta})

    @classmethod
    def of_state(cls, meta: Mapping, arrays: Mapping[str, np.ndarray]) -> TextNet:
        f = Features(meta["n_words"], tuple(meta["extra_cols"]), arrays["idf"], arrays["mean"], arrays["scale"])
        return cls(f, tuple(meta["tasks"]), meta["hidden"], arrays["theta"])

    def save(self, spark: SparkSession, path: str) -> None:
        """The whole model as one Parquet row, so any file system of Spark's will do."""
        _write(spark, path, *self.state())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextNet:
        return cls.of_state(*_read(spark, path))


def _write(spark: SparkSession, path: str, meta: Mapping, arrays: Mapping[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    row = [(json.dumps(meta), bytearray(out.getvalue()))]
    spark.createDataFrame(row, "meta STRING, arrays BINARY").coalesce(1).write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    row = spark.read.schema("meta STRING, arrays BINARY").parquet(path).first()
    if row is None:
        raise ValueError(f"no model in {path}")
    with np.load(io.BytesIO(bytes(row["arrays"]))) as held:
        return json.loads(row["meta"]), {k: held[k] for k in held.files}


# ---------------------------------------------------------------- sums
def task_sums(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``per_batch`` (``width`` numbers) over all batches of
    ``rows``: added up in each task, then in groups of 32 sums until few are
    left for the driver.  In fixed point from the tasks on: exact in any order."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        units = np.round(total * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([units.tobytes()], pa.binary())],
                                         ["part", "units"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for value in table.column("units"):
            total += np.frombuffer(value.as_py(), np.int64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // _FAN], pa.int64()), "units": pa.array([total.tobytes()], pa.binary())})

    left = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(partial, "part long, units binary")
    while left > _FAN:
        sums = sums.groupBy(F.expr(f"part div {_FAN}")).applyInArrow(added, "part long, units binary")
        left = -(-left // _FAN)
    total = np.zeros(width, np.int64)
    for r in sums.collect():  # _FAN rows of the model's size at most
        total += np.frombuffer(bytes(r.units), np.int64)
    return total / _UNIT


# ---------------------------------------------------------------- training
@dataclass
class Run:
    """A training run in ``folder``: its model so far, the log and the checkpoints."""

    spark: SparkSession
    folder: str
    run_id: str = "run"

    def log(self) -> DataFrame:
        """``(run_id, step, eval_loss, place)`` of the checkpoints written so far."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log/*")
        except AnalysisException:  # none yet
            return self.spark.createDataFrame([], _LOG)

    def _entries(self) -> list:
        return sorted(self.log().collect(), key=lambda r: r.step)  # one small row a checkpoint

    def place(self, k: int) -> str:
        return f"{self.folder}/checkpoint-{k}"

    def best(self) -> TextNet:
        """The model of the lowest evaluation loss (the earlier step, if equal), read back."""
        r = select_checkpoint(self.log(), keep=1).first()
        if r is None:
            raise ValueError(f"no checkpoint in {self.folder}")
        meta, arrays = _read(self.spark, self.place(r.place))
        if meta["step"] != r.step:
            raise ValueError(f"{self.place(r.place)} holds step {meta['step']}, not {r.step}")
        return TextNet.of_state(meta, arrays)

    def last(self) -> tuple[dict, dict[str, np.ndarray]] | None:
        """The state of the latest step that can be read whole: the last
        checkpoint, or the best where the last was lost while it was written."""
        found = []
        for k in (0, 1):
            try:
                found.append(_read(self.spark, self.place(k)))
            except (PySparkException, ValueError, KeyError):  # not there, or not whole
                continue
        return max(found, key=lambda f: f[0]["step"], default=None)

    def keep(self, step: int, eval_loss: float, meta: dict, arrays: dict[str, np.ndarray]) -> None:
        """Write a checkpoint over the one that is not the best, then its entry."""
        before = [r for r in self._entries() if r.step < step]
        best = min(before, key=lambda r: (r.eval_loss, r.step), default=None)
        place = 1 - best.place if best else 0
        _write(self.spark, self.place(place), meta | {"step": step, "eval_loss": eval_loss}, arrays)
        entry = self.spark.createDataFrame([(self.run_id, step, eval_loss, place)], _LOG)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/step-{step}")


def _rows(net_features: Features, df: DataFrame, text_col: str, labels: Sequence[str], name: str) -> DataFrame:
    """Features and labels, computed once and written to the shared folder."""
    path = scratch_dir(df.sparkSession, name)
    df.select(*net_features.columns(text_col), F.array(*[F.col(c).cast("double") for c in labels]).alias("y")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _labels(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


class _Objective:
    """Weighted mean cross-entropies over all rows plus the penalty, with their gradient."""

    def __init__(self, net: TextNet, rows: DataFrame, weights: Mapping[str, float], reg: float):
        self.net, self.rows, self.reg = net, rows, reg
        n = rows.agg(*[F.count(F.get("y", i)).alias(t) for i, t in enumerate(net.tasks)]).first()
        self.n = max(1, max(n))
        # a task's mean is over its own labelled rows
        self.weight = np.array([weights.get(t, 0.0) * self.n / max(1, c) for t, c in zip(net.tasks, n)])
        self.bare = np.ones(len(net.theta), bool)  # offsets bear no penalty
        sizes = [p.size for p in net.parts(net.theta)]
        at = np.cumsum([0, *sizes])
        for k in (2, 4):
            self.bare[at[k]:at[k + 1]] = False

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        net = TextNet(self.net.features, self.net.tasks, self.net.hidden, theta)
        weight = self.weight

        def one(batch: pa.RecordBatch) -> np.ndarray:
            loss, grad = net.loss_and_gradient(batch, _labels(batch, len(net.tasks)), weight)
            return np.append(grad, loss)

        total = task_sums(self.rows, one, len(theta) + 1) / self.n
        held = np.where(self.bare, theta, 0)
        return total[-1] + self.reg / 2 * float(held @ held), total[:-1] + self.reg * held


def _eval_loss(net: TextNet, rows: DataFrame, weights: Mapping[str, float]) -> float:
    """A12's total over ``rows``, in one job."""

    def one(batch: pa.RecordBatch) -> np.ndarray:
        y = _labels(batch, len(net.tasks))
        p = np.clip(net.probabilities(batch), EPS, 1 - EPS)
        known = ~np.isnan(y)
        each = -np.where(known, np.log(np.where(y == 1, p, 1 - p)), 0)
        return np.concatenate([each.sum(0), known.sum(0)])

    s = task_sums(rows, one, 2 * len(net.tasks))
    t = len(net.tasks)
    return float(sum(weights.get(k, 0.0) * s[i] / s[t + i] for i, k in enumerate(net.tasks) if s[t + i]))


def _direction(grad: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The L-BFGS direction from the remembered moves and turns of the gradient."""
    q = -grad
    factor = []
    for s, y in zip(reversed(moves), reversed(turns)):
        a = (s @ q) / (s @ y)
        q = q - a * y
        factor.append(a)
    if moves:
        q = q * (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
    for (s, y), a in zip(zip(moves, turns), reversed(factor)):
        q = q + (a - (y @ q) / (s @ y)) * s
    return q


def train_joint(train: DataFrame, evaluation: DataFrame, label_cols: Mapping[str, str], folder: str, *,
                weights: Mapping[str, float] = TASK_WEIGHTS, text_col: str = "text", extra_cols: Sequence[str] = (),
                n_words: int = 1 << 12, hidden: int = 8, steps: int = 30, eval_every: int = 10, reg: float = 1e-4,
                seed: int = 5, run_id: str = "run", after_checkpoint: Callable[[int], None] | None = None) -> Run:
    """Fit all tasks of ``label_cols`` (task -> 0/1 column, null for none)
    together, and keep the best and the last model in ``folder``.

    Every ``eval_every`` steps the loss over ``evaluation`` is logged and a
    checkpoint written.  Called again with the same folder, a run goes on from its
    last checkpoint, whether it ended or was lost; with the same rows it
    gives the same model.  ``Run.best()`` reads the best back."""
    spark = train.sparkSession
    run = Run(spark, folder.rstrip("/"), run_id)
    tasks = list(label_cols)
    held = run.last()
    if held is None:
        net = TextNet.start(Features.fit(train, text_col, extra_cols, n_words), tasks, hidden, seed)
        step, moves, turns, value, grad = 0, [], [], None, None
    else:
        meta, arrays = held
        net, step = TextNet.of_state(meta, arrays), meta["step"]
        moves, turns = list(arrays["moves"]), list(arrays["turns"])
        value, grad = float(arrays["value"]), arrays["grad"]
        if meta["ended"] or step >= steps:
            return run
    rows = _rows(net.features, train, text_col, list(label_cols.values()), "training-rows")
    against = _rows(net.features, evaluation, text_col, list(label_cols.values()), "evaluation-rows")
    objective = _Objective(net, rows, weights, reg)
    theta = net.theta
    if value is None:
        value, grad = objective(theta)
    while step < steps:
        way = _direction(grad, moves, turns)
        slope = float(grad @ way)
        if slope >= 0:  # not downhill any more: forget, go straight
            moves, turns, way, slope = [], [], -grad, -float(grad @ grad)
        size = 1.0 if moves else min(1.0, 1 / max(1e-12, float(np.abs(grad).sum())))
        ended = True
        for _ in range(20):
            tried, its_grad = objective(theta + size * way)
            if tried <= value + 1e-4 * size * slope:
                ended = False
                break
            size /= 2
        if not ended:
            move, turn = size * way, its_grad - grad
            if move @ turn > 1e-12 * float(turn @ turn):
                moves, turns = [*moves, move][-_MEMORY:], [*turns, turn][-_MEMORY:]
            theta, grad = theta + move, its_grad
            ended = value - tried < 1e-9 * max(1.0, abs(value))
            value = tried
            step += 1
        if ended or step % eval_every == 0 or step == steps:
            net = TextNet(net.features, net.tasks, net.hidden, theta)
            meta, arrays = net.state()
            empty = np.zeros((0, len(theta)))
            run.keep(step, _eval_loss(net, against, weights), meta | {"ended": bool(ended)}, arrays | {
                "moves": np.array(moves) if moves else empty, "turns": np.array(turns) if turns else empty,
                "value": np.array(value), "grad": grad})
            if after_checkpoint:
                after_checkpoint(step)
        if ended:
            break
    return run
