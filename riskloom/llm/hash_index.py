"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes. Vectors are centred and turned by learned rotations, and the signs are the bits. A rotation is fitted
by alternating between signs and the orthogonal matrix that brings the vectors closest to them (iterative
quantisation), from a random start; several rotations, one after the other, fill ``BITS`` bits. Fitting takes a
sample of at most ``SAMPLE`` rows, drawn by the hash of the ids; every row is indexed.

Radius. Pairs of sample rows tell within how many bits of each other ``WITHIN`` of the pairs of a given distance
lie. A query is compared with the sample; its k-th nearest row there is at least as far as its k-th nearest of
all, so the bits for that distance are the query's radius. With fewer than k others in the sample, the radius
is all bits and the answer exact.

Search. A code is cut into substrings of ``PART`` bits, and rows are indexed by each of them. If two codes differ
in at most r = a * parts + c bits, one of the first c + 1 substrings differs in at most a bits or one of the
others in at most a - 1: probing all values so near retrieves every code within the radius. Codes found are
compared whole, a pair counts at the first substring that finds it, and the distances of the pairs left are
measured on the original vectors in double precision.

Rows and queries are dealt by hash of their ids to tiles of bounded size; each tile of rows is indexed and
probed by each tile of queries, and gives back at most k rows a query. So a large group of equal or close
vectors spreads over all tiles, no pair is written out before it has been measured, and nothing is left out
for size. Recall depends on the codes and is measured (``recall``).

Vectors that are NULL, empty or zero, hold a NULL or non-finite component, or have another length than most
(the smaller of equally common lengths), take no part, nor do rows without an id. An id with several vectors
counts once, with the smallest. Equal distances rank by id. Without rows there are no neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import table
from riskloom.session import materialise

BITS, PART, K = 256, 8, 10
#: Rows that codes and radii are learned from at most, share of pairs within the radius, and rounds of a rotation.
SAMPLE, WITHIN, ROUNDS = 8192, 0.98, 25
#: Rows and queries in a tile, and code pairs compared at a time.
ROWS, ASKED, PAIRS = 16_384, 4096, 1 << 21
SEED = 13

WORDS, PARTS = BITS // 64, BITS // PART
CODE = [f"c{i}" for i in range(WORDS)]
#: Number of differing bits of two substrings.
APART = np.bitwise_count(np.arange(1 << PART)[:, None] ^ np.arange(1 << PART)[None, :])


@dataclass
class Codes:
    """Learned centre and rotations, the sample, and bits by distance."""

    centre: np.ndarray
    turn: np.ndarray
    ids: np.ndarray
    sample: np.ndarray
    distances: np.ndarray
    bits: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows of ``x`` as unsigned 64-bit words."""
        signs = np.packbits((x - self.centre) @ self.turn > 0, axis=1, bitorder="little")
        return np.ascontiguousarray(signs).view(np.uint64)

    def radius(self, distance: np.ndarray) -> np.ndarray:
        """Bits within which codes at ``distance`` lie; all bits where that is not finite."""
        if not len(self.distances):
            return np.full(len(distance), BITS)
        near, far = self.distances[0], self.distances[-1]
        # Below the nearest pairs seen, deviations shrink as roots; beyond the farthest, bits grow in proportion.
        bits = np.interp(distance, self.distances, self.bits)
        bits = np.where(distance < near, self.bits[0] * np.sqrt(distance / max(near, 1e-300)), bits)
        bits = np.where(distance > far, self.bits[-1] * distance / max(far, 1e-300), bits)
        return np.where(np.isfinite(distance), np.ceil(np.minimum(bits, BITS)), BITS).astype(np.int64)

    def reach(self, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Distance of each row of ``x`` to its k-th nearest sample row but itself; infinite if there is none."""
        out = np.full(len(x), np.inf)
        for at in range(0, len(x), 256):
            far = distances(x[at : at + 256], self.sample)
            far[self.ids[None, :] == ids[at : at + 256, None]] = np.inf
            if far.shape[1] >= k:
                out[at : at + 256] = np.partition(far, k - 1, axis=1)[:, k - 1]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` from all rows of ``b``, by one matrix product."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all codes of ``a`` from all codes of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


def _rotation(x: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns whose products with ``x`` are close to their signs."""
    turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1], width)))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0), full_matrices=False)
        turn = left @ right
    return turn


def learned(ids: np.ndarray, sample: np.ndarray) -> Codes:
    """Codes and radii from the rows of a sample."""
    rng = np.random.default_rng(SEED)
    centre, width = sample.mean(axis=0), sample.shape[1]
    parts = [_rotation(sample - centre, min(width, BITS - at), rng) for at in range(0, BITS, width)]
    codes = Codes(centre, np.hstack(parts), ids, sample, np.zeros(0), np.zeros(0))
    # The nearest rows of some rows, in order of distance, in bins: a bin's distance and bits.
    asked = np.arange(min(len(sample), 512))
    far = distances(sample[asked], sample)
    far[asked, asked] = np.inf
    near = np.argsort(far, axis=1)[:, : min(64, len(sample) - 1)]
    if not near.size:
        return codes
    d = np.take_along_axis(far, near, axis=1).ravel()
    h = np.take_along_axis(differing(codes.of(sample[asked]), codes.of(sample)), near, axis=1).ravel()
    bins = np.array_split(np.argsort(d), max(1, len(d) // 500))
    codes.distances = np.array([d[b].mean() for b in bins])
    codes.bits = np.maximum.accumulate([np.quantile(h[b], WITHIN) for b in bins]).astype(float)
    return codes


def vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the rows that take part, one for each id."""
    x = F.col(vector).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = (F.size("x") > 0) & ~F.exists("x", bad) & F.exists("x", lambda v: v != 0)
    rows = df.select(F.col(id).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & whole)
    rows = materialise(rows.groupBy("id").agg(F.min("x").alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == lengths[0]["n"]) if lengths else rows


def fit(rows: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Codes for ``rows`` (id, x); None if there are none."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    return learned(drawn["id"].to_numpy(), np.stack(drawn["x"])) if len(drawn) else None


def coded(rows: DataFrame, codes: Codes, k: int | None = None) -> DataFrame:
    """``rows`` (id, x) with their codes, and with their radius as queries for k neighbours if ``k`` is given."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"])
                code = codes.of(x).view(np.int64)
                out = batch.assign(**{c: code[:, i] for i, c in enumerate(CODE)})
                yield out if k is None else out.assign(radius=codes.radius(codes.reach(x, batch["id"].to_numpy(), k)))

    extra = [f"{c} bigint" for c in CODE] + (["radius bigint"] if k is not None else [])
    return rows.mapInPandas(run, ", ".join(["id bigint, x array<double>", *extra]))


class Tables:
    """The multi-index of a tile: for every substring the rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.view(np.uint8)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.ends = [np.searchsorted(self.parts[self.order[:, j], j], np.arange((1 << PART) + 1)) for j in range(PARTS)]

    def within(self, asked: np.ndarray, radius: np.ndarray):
        """All (query, row) whose codes differ in at most the query's radius, each once, in arrays."""
        parts = asked.view(np.uint8)
        # The first (radius mod parts) + 1 substrings may differ in one bit more than the others.
        reach = (radius // PARTS)[:, None] - (np.arange(PARTS)[None, :] > (radius % PARTS)[:, None])
        for j in range(PARTS):
            ends = self.ends[j]
            for value in np.flatnonzero(np.diff(ends)):
                probing = np.flatnonzero(APART[parts[:, j], value] <= reach[:, j])
                rows = self.order[ends[value] : ends[value + 1], j]
                step = max(1, PAIRS // len(rows))
                for at in range(0, len(probing), step):
                    some = probing[at : at + step]
                    q, r = np.nonzero(differing(asked[some], self.codes[rows]) <= radius[some][:, None])
                    q, r = some[q], rows[r]
                    earlier = np.bitwise_count(parts[q, :j] ^ self.parts[r, :j]) <= reach[q, :j]
                    first = ~earlier.any(axis=1)
                    yield q[first], r[first]


def _best(q: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query."""
    order = np.lexsort((ids, far, q))
    starts = np.flatnonzero(np.append(True, np.diff(q[order]) != 0))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


def _answers(k: int):
    columns = ["query_id", "vec_id", "score"]

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        code = lambda df: np.ascontiguousarray(df[CODE].to_numpy(np.int64)).view(np.uint64)
        x, ids, tables = np.stack(rows["x"]), rows["id"].to_numpy(), Tables(code(rows))
        points, own, codes, radius = np.stack(asked["x"]), asked["id"].to_numpy(), code(asked), asked["radius"].to_numpy()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        waiting, count = [], 0

        def measured() -> tuple:
            q, r = (np.concatenate(c) for c in zip(*waiting, strict=True))
            other = own[q] != ids[r]
            q, r = q[other], r[other]
            far = np.concatenate([np.sqrt(((points[q[i : i + 65536]] - x[r[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, max(len(q), 1), 65536)])
            q, r, far = np.append(held[0], q), np.append(held[1], r), np.append(held[2], far)
            best = _best(q, far, ids[r], k)
            return q[best], r[best], far[best]

        for q, r in tables.within(codes, radius):
            waiting.append((q, r))
            count += len(q)
            if count > PAIRS:  # measured and cut to k a query before more are gathered
                held, count = measured(), 0
                waiting.clear()
        if waiting:
            held = measured()
        return pd.DataFrame({"query_id": own[held[0]], "vec_id": ids[held[1]], "score": held[2]})

    return run


def search(rows: DataFrame, queries: DataFrame, codes: Codes, k: int = K, tile: int = ROWS, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``rows`` for each of ``queries`` (both id, x)."""
    rows, queries = materialise(coded(rows, codes), "coded"), materialise(coded(queries, codes, k), "asked")
    tiles, slices = max(1, -(-rows.count() // tile)), max(1, -(-queries.count() // asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    at = rows.withColumn("_tile", own(tiles)).withColumn("_slice", every(slices)).groupBy("_tile", "_slice")
    by = queries.withColumn("_slice", own(slices)).withColumn("_tile", every(tiles)).groupBy("_tile", "_slice")
    near = by.cogroup(at).applyInPandas(_answers(k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of ``exact`` (query_id, vec_id) that are in ``found``; 1 if there are none."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def neighbours(df: DataFrame, id: str, vector: str, asked, k: int = K) -> DataFrame:
    """The k nearest found of all rows for the rows whose id fulfils ``asked`` (a function of the id column)."""
    rows = vectors(df.withColumn(id, F.col(id).cast("bigint")), id, vector)
    codes = fit(rows)
    if codes is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(rows, rows.where(asked(F.col("id"))), codes, k)


def op13_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of all embeddings for every hundredth id."""
    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)
