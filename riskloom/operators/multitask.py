"""One model for several tasks: a shared hidden layer, a head for each task, trained together.

The features go through one layer of tanh units that all tasks share. A task with two classes has a head of one
sigmoid unit, a task with more a softmax; a task of one class is not trained and predicts it. The loss is the mean
over rows of the weighted cross entropies; a row whose task is NULL, or of a class unseen in training, does not
count for that task.

Training is full-batch L-BFGS. A step is one pass over the written training table: every task sums the gradient of
its rows, the sums are added up by one aggregation, and the driver sees as many numbers as the model has. So
rows never leave their tasks, and memory does not depend on their number. The model is small enough for a
closure (inputs times hidden units, and hidden units times classes).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.vectors import as_array
from riskloom.session import materialise

HIDDEN, STEPS, PENALTY, SEED = 32, 60, 1e-4, 42
MEMORY = 10  # steps that L-BFGS remembers


@dataclass
class Shape:
    """Sizes of the model: inputs, hidden units, and the logits of each trained task."""

    inputs: int
    hidden: int
    logits: list[int]

    def parts(self, theta: np.ndarray) -> list[np.ndarray]:
        """Hidden weights and offsets, then weights and offsets of each head, as views of ``theta``."""
        sizes = [(self.inputs, self.hidden), (self.hidden,)]
        for c in self.logits:
            sizes += [(self.hidden, c), (c,)]
        out, at = [], 0
        for size in sizes:
            n = int(np.prod(size))
            out.append(theta[at : at + n].reshape(size))
            at += n
        return out

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.hidden + sum((self.hidden + 1) * c for c in self.logits)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        theta = np.zeros(self.size)
        for part in self.parts(theta):
            if part.ndim == 2:
                part[:] = rng.normal(size=part.shape) / np.sqrt(part.shape[0])
        return theta


def loss_and_gradient(theta: np.ndarray, shape: Shape, x: np.ndarray, y: np.ndarray, weights: Sequence[float]) -> tuple[float, np.ndarray]:
    """Sums over the rows of ``x``; ``y`` has a class number for each task, negative where it does not count."""
    gradient = np.zeros_like(theta)
    parts, slopes = shape.parts(theta), shape.parts(gradient)
    hidden = np.tanh(x @ parts[0] + parts[1])
    back = np.zeros_like(hidden)
    loss = 0.0
    for t, (logits, weight) in enumerate(zip(shape.logits, weights, strict=True)):
        at = np.flatnonzero(y[:, t] >= 0)
        truth, h = y[at, t], hidden[at]
        z = h @ parts[2 + 2 * t] + parts[3 + 2 * t]
        if logits == 1:  # the sigmoid of one logit is the softmax of (0, logit)
            z = np.hstack([np.zeros((len(at), 1)), z])
        z -= z.max(axis=1, keepdims=True)
        norm = np.log(np.exp(z).sum(axis=1))
        loss += weight * float((norm - z[np.arange(len(at)), truth]).sum())
        error = np.exp(z - norm[:, None])
        error[np.arange(len(at)), truth] -= 1.0
        error = weight * (error[:, 1:] if logits == 1 else error)
        slopes[2 + 2 * t] += h.T @ error
        slopes[3 + 2 * t] += error.sum(axis=0)
        back[at] += error @ parts[2 + 2 * t].T
    back *= 1.0 - hidden * hidden
    slopes[0] += x.T @ back
    slopes[1] += back.sum(axis=0)
    return loss, gradient


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with a halving line search; stops when a step gains less than ``tol`` of the loss."""
    loss, gradient = evaluate(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, scales = -gradient, []
        for s, g in reversed(moves):
            a = (s @ direction) / (s @ g)
            scales.append(a)
            direction = direction - a * g
        if moves:
            s, g = moves[-1]
            direction = direction * (s @ g) / (g @ g)
        else:
            direction = direction / max(1.0, float(np.linalg.norm(gradient)))
        for (s, g), a in zip(moves, reversed(scales), strict=True):
            direction = direction + s * (a - (g @ direction) / (s @ g))
        slope, length = gradient @ direction, 1.0
        for _ in range(20):
            new_loss, new_gradient = evaluate(theta + length * direction)
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length /= 2
        else:
            return theta
        s, g = length * direction, new_gradient - gradient
        if s @ g > 1e-12:
            moves = [*moves[-MEMORY + 1 :], (s, g)]
        gained = loss - new_loss
        theta, loss, gradient = theta + s, new_loss, new_gradient
        if gained <= tol * abs(loss):
            break
    return theta


@dataclass
class SharedModel:
    """A fitted model; ``classes`` has the names of every task's classes, trained ones first in ``shape``."""

    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    shape: Shape
    classes: dict[str, list[str]]

    def probabilities(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Class probabilities of each task, in the order of ``classes``."""
        parts = self.shape.parts(self.theta)
        hidden = np.tanh(((x - self.mean) / self.scale) @ parts[0] + parts[1])
        out, t = {}, 0
        for task, names in self.classes.items():
            if len(names) < 2:
                out[task] = np.ones((len(x), len(names)))
                continue
            z = hidden @ parts[2 + 2 * t] + parts[3 + 2 * t]
            z = np.hstack([np.zeros((len(x), 1)), z]) if self.shape.logits[t] == 1 else z
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[task] = z / z.sum(axis=1, keepdims=True)
            t += 1
        return out


def shared_fit(
    train: DataFrame, tasks: Sequence[str], features: str = "features", hidden: int = HIDDEN,
    weights: dict[str, float] | None = None, steps: int = STEPS, penalty: float = PENALTY, seed: int = SEED,
) -> SharedModel:
    """Fit all ``tasks`` (label columns) at once on one feature column.

    ``weights`` of tasks count relative to the largest; a task without one weighs 1. ``penalty`` is for the squares of
    all weights. Features are brought to mean 0 and deviation 1 first.
    """
    rows = as_array(train.select(features, *[F.col(t).cast("string").alias(t) for t in tasks]), features)
    # A row per class; classes of a task are few.
    seen = rows.select(F.inline(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks]))).dropna().distinct()
    names: dict[str, list[str]] = {t: [] for t in tasks}
    for r in seen.orderBy("task", "label").collect():
        names[r["task"]].append(r["label"])
    trained = [t for t in tasks if len(names[t]) > 1]
    place = lambda t: F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names[t]]), F.col(t)) - 1, F.lit(-1)).cast("int")
    data = materialise(rows.select(F.col(features).alias("x"), F.array(*[place(t) for t in trained]).cast("array<int>").alias("y")), "multitask")

    moments = data.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("sd"))
    found = {r["pos"]: r for r in moments.collect()}
    if not found:
        raise ValueError("no training rows")
    width, n = len(found), data.count()
    mean = np.array([found[i]["mean"] for i in range(width)])
    scale = np.array([found[i]["sd"] or 1.0 for i in range(width)])
    shape = Shape(width, hidden, [1 if len(names[t]) == 2 else len(names[t]) for t in trained])
    given = [(weights or {}).get(t, 1.0) for t in trained]
    factors = [w / max(given) for w in given]

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            total = np.zeros(len(theta) + 1)
            for batch in batches:
                if len(batch):
                    x = (np.stack(batch["x"]) - mean) / scale
                    loss, gradient = loss_and_gradient(theta, shape, x, np.stack(batch["y"]), factors)
                    total[0] += loss
                    total[1:] += gradient
            yield batch_of(total)

        def batch_of(total):
            import pandas as pd

            return pd.DataFrame({"sums": [total.tolist()]})

        partial = data.mapInPandas(sums, "sums array<double>").select(F.posexplode("sums"))
        got = partial.groupBy("pos").agg(F.sum("col").alias("v")).toPandas().sort_values("pos")["v"].to_numpy()
        return got[0] / n + penalty * float(theta @ theta), got[1:] / n + 2 * penalty * theta

    theta = minimise(evaluate, shape.start(seed), steps) if trained else shape.start(seed)
    return SharedModel(mean, scale, theta, shape, names)


def shared_predict(model: SharedModel, df: DataFrame, id: str, features: str = "features") -> DataFrame:
    """id, the task columns and ``<task>_pred``: the likeliest class, the first by name of equals."""
    tasks = list(model.classes)
    data = as_array(df.select(id, features, *[F.col(t).cast("string").alias(t) for t in tasks]), features)

    def run(batches):
        for batch in batches:
            if len(batch):
                found = model.probabilities(np.stack(batch[features]))
                named = {f"{t}_pred": np.array(model.classes[t] or [None], dtype=object)[p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)] for t, p in found.items()}
                yield batch.drop(columns=[features]).assign(**named)

    schema = [f"`{id}` {df.schema[id].dataType.simpleString()}", *[f"`{t}` string" for t in tasks], *[f"`{t}_pred` string" for t in tasks]]
    return data.mapInPandas(run, ", ".join(schema))
