"""Word and word-beginning features of texts, and sparse linear models over them.

A feature is present in a text or absent. Features are hashed to 32 bits; a model keeps the few that
tell classes apart, so scoring a text looks up its distinct words and adds weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside the word itself.
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose features a task remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    raw = [f"={word}"] + [word[:k] for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(x.encode()) for x in raw]


def text_features(words: Iterable[str]) -> np.ndarray:
    """Sorted distinct features of a set of words, as int64."""
    return np.array(sorted({f for w in words for f in word_features(w)}), dtype=np.int64)


@dataclass
class SparseModel:
    """Linear scores for K outputs: ``ids`` (sorted feature hashes), ``weights`` (ids x K), ``bias`` (K)."""

    ids: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    _row: dict = field(default_factory=dict, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"ids": self.ids, "weights": self.weights, "bias": self.bias, "_row": {}, "_known": {}}

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        """One row of K scores for each text; an empty or missing text scores the bias."""
        if not self._row:
            self._row.update({int(f): i for i, f in enumerate(self.ids)})
        row, known = self._row, self._known
        docs, cols = [], []
        n = 0
        for text in texts:
            found: set[int] = set()
            for w in words_of(text or ""):
                hit = known.get(w)
                if hit is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    hit = known[w] = tuple(row[f] for f in word_features(w) if f in row)
                if hit:
                    found.update(hit)
            docs.extend([n] * len(found))
            cols.extend(sorted(found))
            n += 1
        out = np.tile(self.bias, (n, 1))
        for k in range(len(self.bias)):
            out[:, k] += np.bincount(docs, self.weights[cols, k], minlength=n) if docs else 0.0
        return out


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of ragged rows."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    values = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), lengths), values


def telling(sample: DataFrame, k: int, least_df: int, chi2: float, most: int = 20_000) -> np.ndarray:
    """Features that at least ``least_df`` rows hold and whose chi-square against some class reaches ``chi2``;
    of more than ``most`` those with the largest.

    ``sample`` has label (0 to k - 1) and features (distinct within a row). Counting is a Spark aggregation;
    only the chosen features come to the driver.
    """
    size = dict(sample.groupBy("label").count().collect())
    n = sum(size.values())
    held = sample.select("label", F.explode("features").alias("f")).groupBy("f")
    counts = held.agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in range(k)])
    df = sum((F.col(f"n{c}") for c in range(1, k)), F.col("n0"))
    stats = [F.lit(0.0)]
    for c in range(k):
        n1, a = float(size.get(c, 0)), F.col(f"n{c}").cast("double")
        if 0 < n1 < n:
            off = a * (n - n1 - df + a) - (df - a) * (n1 - a)
            stats.append(off * off * n / (n1 * (n - n1) * df * (n - df)))
    held = counts.where((df >= least_df) & (df < n)).select("f", F.greatest(*stats, F.lit(0.0)).alias("stat"))
    chosen = held.where(F.col("stat") >= chi2).orderBy(F.desc("stat"), "f").limit(most).select("f").collect()
    return np.array(sorted(r.f for r in chosen), dtype=np.int64)


def restricted(sample: DataFrame, ids: np.ndarray, names: list[str]) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """Labels, and per column of ``names`` the rows' features that are among ``ids``, on the driver."""

    def cut(batches):
        for pdf in batches:
            for name in names:
                pdf[name] = [np.asarray(x, np.int64)[np.isin(x, ids)].tobytes() for x in pdf[name]]
            yield pdf

    blobs = ", ".join(f"{n} binary" for n in names)
    got = sample.select("label", *names).mapInPandas(cut, f"label int, {blobs}").collect()
    rows = {n: [np.frombuffer(bytes(r[n]), np.int64) for r in got] for n in names}
    return np.array([r.label for r in got], dtype=np.int64), rows


def columns(rows: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the features in ``rows`` that are among the sorted ``ids``."""
    r, f = _flat(rows)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids, f), len(ids) - 1)
    ok = ids[at] == f
    return r[ok], at[ok]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(
    rows: list[np.ndarray],
    y: np.ndarray,
    k: int,
    ids: np.ndarray,
    l2: float = 1e-3,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None,
    pair_weight: float = 0.0,
    steps: int = 300,
) -> SparseModel:
    """Logistic regression over the features ``ids``, by accelerated gradient steps.

    ``pairs`` = (pair, column, sign, number of pairs) lists the features in which a text and its changed
    copy differ; ``pair_weight`` times the mean squared change of the scores is added to the loss.
    """
    r, c = columns(rows, ids)
    n, m = len(rows), len(ids)
    onehot = np.eye(k)[y]
    w, b = np.zeros((m, k)), np.log((onehot.sum(0) + 0.5) / (n + 0.5 * k))
    held = np.bincount(c, minlength=m) / max(n, 1)
    # Each feature's curvature bounds its step; a row holds several, so the bound is times that many.
    many = max(1.0, np.bincount(r, minlength=n).mean() if len(r) else 1.0)
    step_w = 1.0 / (0.5 * held * many + l2 + 1e-9)
    if pairs is not None and pairs[3]:
        p, pc, sign, n_pairs = pairs
        step_w = 1.0 / (1.0 / step_w + 2 * pair_weight * np.bincount(pc, minlength=m) / n_pairs * many)
    vw, vb, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):
        z = np.tile(vb, (n, 1))
        for j in range(k):
            z[:, j] += np.bincount(r, vw[c, j], minlength=n)
        err = (softmax(z) - onehot) / n
        grad = l2 * vw
        for j in range(k):
            grad[:, j] += np.bincount(c, err[r, j], minlength=m)
            if pairs is not None and pairs[3]:
                change = np.bincount(p, sign * vw[pc, j], minlength=n_pairs)
                grad[:, j] += 2 * pair_weight / n_pairs * np.bincount(pc, sign * change[p], minlength=m)
        new_w, new_b = vw - step_w[:, None] * grad, vb - err.sum(0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((vw - new_w) * (new_w - w)).sum() > 0:  # the momentum points uphill
            t_next = 1.0
        vw, vb = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return SparseModel(ids, w, b)
