"""Periodic runs of words: stretches in which a block of words repeats at least ``EXPONENT`` times.

A run is a stretch of consecutive words with smallest period q that is at least ``LENGTH`` words and
``EXPONENT`` * q words long and that no neighbouring word extends with the same period.

Every run of period p holds two equal words p apart on a grid whose step grows with p (a harmonic grid:
the steps' inverses add up to a logarithm). From such a pair the run is as long as the words after it and
before it stay equal: two longest-common-extension (LCE) queries. They are answered by a difference cover:
of every ``MODULUS`` positions four are sampled so that any two positions reach samples after the same small
step. Only the sampled suffixes are sorted (by doubling), the common prefixes of neighbours in that order go
into a sparse table of range minima, and a query compares the few words up to the samples and looks up one
minimum. Words before a position are compared in the reversed text. Pairs that fail within a few words never
get that far, and a text without other pairs is not sorted at all.

``collapsed`` is the text with one period of each run: words that lie in a run after its first period are
dropped, the rest is joined by single spaces.

Texts are worked through in blocks of ``SLICE`` bytes, or one text; they are put in one array with a mark
of its own between neighbours, so no run crosses texts. Memory is bounded by that and by the longest text.
There is no shuffle. NULL and empty texts have no words, no runs and an empty collapsed text. Every row gives
a row, repeated ids and texts too; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.llm.common import split_words, table

# A run's least length and number of periods; a difference cover of 13 (1, 3 and 9 words apart
# and the like: any difference modulo 13 is one of two members).
LENGTH, EXPONENT = 24, 3
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a block, and pairs of positions extended at a time.
SLICE, PAIRS = 2 << 20, 1 << 20

OUT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

#: Member of the cover from which a step of the given difference leads to a member.
STEP_FROM = np.array([next(a for a in COVER if (a + d) % MODULUS in COVER) for d in range(MODULUS)])


class Extensions:
    """LCE queries on an array of words (non-negative numbers below 2^31).

    Any two different suffixes must differ before one of them ends, as they do if the last word is unique.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        held = np.isin(np.arange(MODULUS), COVER)
        self.at = np.flatnonzero(held[np.arange(n) % MODULUS])  # sampled positions
        self.sample = np.full(n + MODULUS, -1)  # position -> number of the sample
        self.sample[self.at] = np.arange(len(self.at))
        ranks = self._sorted()
        self.rank = ranks[-1]
        order = np.argsort(self.rank)
        self.minima = self._range_minima(self._neighbours(ranks, order))

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first MODULUS, 2 MODULUS, 4 MODULUS, ... words."""
        m = len(self.at)
        padded = np.concatenate([self.words, np.zeros(MODULUS + 1, self.words.dtype)]).astype(np.int64)
        keys = [padded[self.at + i] << 32 | (padded[self.at + i + 1] if i + 1 < MODULUS else 0) for i in range(0, MODULUS, 2)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = [self._dense(order, new)]
        step = MODULUS
        while ranks[-1].max(initial=0) < m - 1:
            follower = self._sample_of(self.at + step)
            second = np.where(follower >= 0, ranks[-1][follower], -1) + 1
            key = ranks[-1] * (m + 1) + second
            order = np.argsort(key, kind="stable")
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            ranks.append(self._dense(order, new))
            step *= 2
        return ranks

    def _sample_of(self, positions: np.ndarray) -> np.ndarray:
        return self.sample[np.minimum(positions, len(self.words))]

    @staticmethod
    def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbouring suffixes: whole steps where ranks agree, then single words."""
        a, b = self.at[order[:-1]], self.at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = self._sample_of(a + common), self._sample_of(b + common)
            same = (x >= 0) & (y >= 0)
            same[same] = ranks[level][x[same]] == ranks[level][y[same]]
            common[same] += MODULUS << level
        open_ = np.arange(len(a))
        while len(open_):
            open_ = open_[self.words[a[open_] + common[open_]] == self.words[b[open_] + common[open_]]]
            common[open_] += 1
        return common

    @staticmethod
    def _range_minima(values: np.ndarray) -> list[np.ndarray]:
        out = [values]
        while len(out[-1]) > 1 << (len(out) - 1):
            width = 1 << (len(out) - 1)
            out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b`` (never the same)."""
        steps = (STEP_FROM[(b - a) % MODULUS] - a) % MODULUS
        out = np.zeros(len(a), np.int64)
        open_, synchronised = np.arange(len(a)), []
        for t in range(MODULUS):
            there = steps[open_] == t
            synchronised.append(open_[there])
            open_ = open_[~there]
            open_ = open_[self.words[a[open_] + t] == self.words[b[open_] + t]]
            out[open_] += 1
        at = np.concatenate(synchronised)
        x, y = self.rank[self.sample[a[at] + steps[at]]], self.rank[self.sample[b[at] + steps[at]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            of = level == k
            row = self.minima[k]
            out[at[of]] += np.minimum(row[low[of]], row[high[of] - (1 << int(k))])
        return out


def _equal_words(words: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on, in steps of 1 or -1, counted up to ``most``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for t in range(most):
        open_ = open_[words[a[open_] + step * t] == words[b[open_] + step * t]]
        out[open_] += 1
    return out


def runs_of(texts: list[np.ndarray] | np.ndarray, starts: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Runs of ``texts`` (word numbers of all texts, one after the other), where text t is ``starts[t]`` to ``starts[t + 1]``.

    A row for each run: text, start (in its text), length, period; in order of text, start and period.
    """
    n_texts, sizes = len(starts) - 1, np.diff(starts)
    longest = int(sizes.max(initial=0))
    none = np.zeros((0, 4), np.int64)
    if longest < max(length, exponent):
        return none
    # One array; text t begins after its mark. Marks are numbers that no word has.
    begins = starts[:-1] + np.arange(n_texts) + 1
    words = np.empty(len(texts) + n_texts + 1, np.int64)
    base = int(texts.max(initial=0)) + 1
    marks = np.append(begins - 1, len(words) - 1)
    inner = np.ones(len(words), bool)
    inner[marks] = False
    words[marks], words[inner] = base + np.arange(n_texts + 1), texts

    need = lambda p: max(length - p, (exponent - 1) * p)
    few = min(need(p) for p in range(1, max(length, 2))) // 2  # fewer equal words both ways are no run
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int]] = []
    count = 0

    def extend() -> None:
        nonlocal count
        if not waiting:
            return
        a = np.concatenate([x for x, _ in waiting])
        p = np.repeat([q for _, q in waiting], [len(x) for x, _ in waiting])
        waiting.clear()
        count = 0
        b = a + p
        t = np.searchsorted(begins, a, "right") - 1
        same = t == np.searchsorted(begins, b, "right") - 1
        a, b, p, t = a[same], b[same], p[same], t[same]
        long = _equal_words(words, a, b, 1, max(few, 1)) >= few
        long |= _equal_words(words, a - 1, b - 1, -1, max(few, 1)) >= few
        a, b, p, t = a[long], b[long], p[long], t[long]
        if not len(a):
            return
        # The texts that hold such pairs, closed up, with their marks.
        held = np.zeros(n_texts, bool)
        held[t] = True
        keep = np.zeros(len(words), bool)
        for x in np.flatnonzero(held):
            keep[begins[x] - 1 : begins[x] + sizes[x] + 1] = True
        place = np.cumsum(keep) - 1
        core = words[keep]
        forward, backward = Extensions(core), Extensions(core[::-1].copy())
        x, y = place[a], place[b]
        after = forward.common(x, y)
        before = backward.common(len(core) - x, len(core) - y)
        total = after + before
        is_run = total >= np.maximum(length - p, (exponent - 1) * p)
        a, p, t, before, total = (v[is_run] for v in (a, p, t, before, total))
        rows = np.stack([t, a - before - begins[t], p + total, p], axis=1)
        if len(rows):
            found.append(np.unique(rows, axis=0))

    for p in range(1, longest // exponent + 1):
        step = need(p)
        hits = np.flatnonzero(words[: len(words) - p : step] == words[p::step])
        if len(hits):
            waiting.append((hits * step, p))
            count += len(hits)
            if count > PAIRS:
                extend()
    extend()
    if not found:
        return none
    rows = np.unique(np.concatenate(found), axis=0)  # in order of text, start, length, period
    first = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
    rows = rows[first]  # the other periods of a stretch are multiples of its smallest
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))


def _collapsed(batch: pa.RecordBatch, length: int, exponent: int) -> pa.RecordBatch:
    n = len(batch)
    texts = pc.fill_null(batch.column("text"), "")
    parts = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.not_equal(words, "")  # splitting leaves empty parts at the ends
    words, rows = pc.filter(words, real), pc.filter(rows, real).to_numpy()
    starts = np.searchsorted(rows, np.arange(n + 1))
    numbers = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int64)
    runs = runs_of(numbers, starts, length, exponent)
    # Words after the first period of a run go: +1 where such a part begins, -1 where it ends.
    depth = np.zeros(len(words) + 1, np.int64)
    begin = starts[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, begin + runs[:, 3], 1)
    np.add.at(depth, begin + runs[:, 2], -1)
    kept = np.cumsum(depth)[:-1] == 0
    lists = pa.ListArray.from_arrays(_offsets(rows[kept], n), pc.filter(words, pa.array(kept)))
    spans = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(np.diff(starts)),
            pa.ListArray.from_arrays(_offsets(runs[:, 0], n), spans), pc.binary_join(lists, " "),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE`` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        below = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, below + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The columns ``OUT`` for each row of ``docs`` (doc_id, text); runs are in order of start, then period."""
    if length < 1 or exponent < 2:
        raise ValueError("a run has at least one word and two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _collapsed(part, length, exponent)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def strongest(runs: Column) -> Column:
    """The run with the most periods; of equals the first."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the texts of a tenth of the ids, by their crc32, become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("_h div 10")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        start = (g % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        at = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")

    rows = docs.select("doc_id", "text", h.alias("_h"))
    changed = bind(split_words(F.col("text")), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.col("text")))
    return rows.select("doc_id", F.when(F.col("_h") % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs after the planting: how many, the strongest, and checksums of all and of the collapsed text."""
    found = with_runs(planted(table(spark, sf_dir, "documents")))
    written = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(written, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", "runs", strongest(F.col("runs")).alias("_best"), listed.alias("_listed"), "collapsed")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        digest(F.col("_listed")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
