"""Nearest neighbours at scale: exact in square blocks, or among candidates from cells around pivots.

Exact mode (``nearest``). Training rows of a group are dealt by hash to tiles of bounded size, queries to slices, and every slice
meets every tile of its group once, so a row is copied as often as the other side has parts. A block compares
in small numbers (l2: one product in single precision, l1: sums of bytes) with a bound of their error, keeps
what can be among the k nearest within it, measures that exactly and gives back at most k rows per query. No row is left out and nothing is collected:
the numbers of tiles stay a table with a row per group.

Candidate mode (``Cells``). A few hundred pivots, drawn from a bounded sample, cut the space into cells, once
for each table. A training row goes to the cell of its nearest pivot in every table, a query to the cells of
its nearest pivots; how many, the sample tells: as many as hold ``target`` of the exact neighbours there. Inside
a cell the blocks of the exact mode measure everything. Rows and queries are shuffled a fixed number of times,
whatever the table holds; cells of any size are cut into tiles. What is found is measured exactly; what is missed
is the share ``recall`` measures against the exact mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.vectors import as_array
from riskloom.session import materialise

BLOCK_VALUES, ROWS = 2_000_000, 16_384  # numbers and queries in one slice at most
TILE_VALUES, TILE_ROWS = 4_200_000, 65_536  # numbers and training rows in one tile at most
QUERY_STEP = 64  # queries whose distances are held at a time
LEAST_QUERIES = 256  # slices get no smaller to make enough blocks for all cores
CHUNK, HEAD = 4096, 2048  # rows compared with a query at a time; rows that give the first bound
LEVELS = 127  # of a coordinate of a tile in steps of one size

NORMS = {"l1": 1, "l2": 2}


def _distances(rows: np.ndarray, point: np.ndarray, norm: int) -> np.ndarray:
    """Distance of each row from ``point``, which may be a point for each row."""
    diff = rows - point
    return np.abs(diff).sum(axis=1) if norm == 1 else np.sqrt((diff * diff).sum(axis=1))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in column])


def _candidates(asked: np.ndarray, rows: np.ndarray, k: int, norm: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be among the k nearest of each query, k at least: places of queries, and of rows, in this order.
    Measured in double precision."""
    if norm == 1:
        far = np.stack([_distances(rows, x, 1) for x in asked])
        slack = 1e-9
    else:
        own, theirs = (asked * asked).sum(axis=1)[:, None], (rows * rows).sum(axis=1)[None, :]
        far = own + theirs - 2.0 * (asked @ rows.T)
        slack = 1e-9 * (own + theirs.max(initial=0.0))  # rounding of the product
    if far.shape[1] <= k:
        return np.nonzero(np.ones(far.shape, bool))
    bound = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(far <= bound + 2 * slack)


def _pairs(may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the true cells of a large matrix with few of them, row by row."""
    return np.divmod(np.flatnonzero(may), may.shape[1])


class _Squares:
    """The candidates of ``_candidates`` for l2 by a product in single precision, wider by a bound of its rounding."""

    def __init__(self, rows: np.ndarray, k: int):
        self.k, self.centre = k, rows.mean(axis=0)
        shifted = rows - self.centre
        half = (shifted * shifted).sum(axis=1) / 2
        self.longest = float(np.sqrt(2 * half.max()))
        self.rows = np.hstack([shifted, half[:, None]]).astype("float32").T

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shifted = asked - self.centre
        # Half the squared distance less half the query's own square.
        far = np.hstack([-shifted, np.ones((len(asked), 1))]).astype("float32") @ self.rows
        size = np.sqrt((shifted * shifted).sum(axis=1)) + self.longest
        slack = len(self.rows) * 2.0**-20 * size * size
        bound = np.partition(far[:, :HEAD], self.k - 1, axis=1)[:, self.k - 1 : self.k] + 2 * slack[:, None]
        query, at = _pairs(far <= np.nextafter(bound.astype("float32"), np.float32(np.inf)))
        if len(at) <= 4 * self.k * len(asked):
            return query, at
        near, keep = far[query, at], np.zeros(len(at), bool)
        ends = np.searchsorted(query, np.arange(len(asked) + 1)).tolist()
        for a, b, wide in zip(ends, ends[1:], (2 * slack).tolist(), strict=False):
            keep[a:b] = near[a:b] <= float(np.partition(near[a:b], self.k - 1)[self.k - 1]) + wide
        return query[keep], at[keep]


class _Steps:
    """The candidates of ``_candidates`` for l1 by coordinates in 127 steps of a tile's widest one.

    Differences of steps are sums of bytes. A row's distance is at least that of the steps, less what rounding to
    steps has moved the row and the query; the k rows fewest steps away, measured, bound it from above.
    """

    def __init__(self, rows: np.ndarray, k: int):
        self.k, self.exact = k, rows
        self.low, high = rows.min(axis=0), rows.max(axis=0)
        self.step = float((high - self.low).max()) / LEVELS or 1.0
        steps = np.rint((rows - self.low) / self.step)
        self.moved = float(np.abs(rows - (self.low + steps * self.step)).sum(axis=1).max())
        self.moved += rows.size / len(rows) * 2.0**-48 * float(np.abs(rows).max())  # rounding of these sums themselves
        steps = np.hstack([steps, np.zeros((len(steps), steps.shape[1] % 2))]).astype("int8")
        self.chunks = [np.ascontiguousarray(steps[i : i + CHUNK].T) for i in range(0, len(steps), CHUNK)]
        self.sum = np.uint16 if LEVELS * steps.shape[1] < 1 << 16 else np.uint32

    def _counts(self, steps: np.ndarray) -> np.ndarray:
        """Steps between every query and every row."""
        out, width = np.empty((len(steps), len(self.exact)), self.sum), steps.shape[1]
        for i, chunk in enumerate(self.chunks):
            gap = np.empty(chunk.shape, "int8")
            two = gap.view("uint8")[: width // 2]  # two coordinates in a byte
            for one, to in zip(steps, out[:, i * CHUNK : (i + 1) * CHUNK], strict=True):
                np.subtract(chunk, one[:, None], out=gap)
                np.abs(gap, out=gap)
                np.add(two, gap.view("uint8")[width // 2 :], out=two)
                np.add.reduce(two, axis=0, dtype=self.sum, out=to)
        return out

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A query outside the tile's box is no nearer to its rows than the nearest point of the box.
        steps = np.clip(np.rint((asked - self.low) / self.step), 0, LEVELS)
        boxed = np.clip(asked, self.low, self.low + LEVELS * self.step)
        moved = np.abs(boxed - (self.low + steps * self.step)).sum(axis=1) + self.moved
        counts = self._counts(np.hstack([steps, np.zeros((len(steps), steps.shape[1] % 2))]).astype("int8"))
        head = np.argpartition(counts[:, :HEAD], self.k - 1, axis=1)[:, : self.k]
        bound = self._farthest(asked, head)
        query, at = _pairs(counts <= self._most(bound, moved)[:, None])
        if len(at) <= 4 * self.k * len(asked) or len(self.exact) <= HEAD:
            return query, at
        near = counts[query, at]
        ends = np.searchsorted(query, np.arange(len(asked) + 1)).tolist()
        head = np.stack([at[a + np.argpartition(near[a:b], self.k - 1)[: self.k]] for a, b in zip(ends, ends[1:], strict=False)])
        keep = near <= self._most(np.minimum(bound, self._farthest(asked, head)), moved)[query]
        return query[keep], at[keep]

    def _farthest(self, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distance from each query to the farthest of its rows ``at``."""
        return _distances(self.exact[at.ravel()], np.repeat(asked, at.shape[1], axis=0), 1).reshape(at.shape).max(axis=1)

    def _most(self, bound: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Steps that a row nearer than ``bound`` can be away; the factor covers rounding."""
        return np.minimum((bound + wide) * (1 + 1e-9) / self.step + 1, np.iinfo(self.sum).max).astype(self.sum)


def _finder(rows: np.ndarray, k: int, norm: int):
    """The candidates of ``_candidates`` among ``rows``, by the fastest way that bounds them."""
    limit = 1e15  # squares of larger numbers leave single precision

    def plain(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _candidates(asked, rows, k, norm)

    if min(len(rows), HEAD) <= k or not rows.shape[1] or not np.abs(rows).max() < limit:
        return plain
    fast = (_Steps if norm == 1 else _Squares)(rows, k)
    return lambda asked: fast.candidates(asked) if np.abs(asked).max() < limit else plain(asked)


def _top_of_block(k: int, norm: int, payload: Sequence[str], skip_same: bool):
    columns = ["_qid", "_id", "distance", *payload]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame(columns=columns)
        t = t.sort_values("_id", kind="stable").reset_index(drop=True)
        rows, ids = _stack(t["_x"]), t["_id"].to_numpy()
        points, asked = _stack(q["_x"]), q["_qid"].to_numpy()
        picked, again, far = [], [], []
        find = _finder(rows, k + skip_same, norm)
        for start in range(0, len(points), QUERY_STEP):
            part = points[start : start + QUERY_STEP]
            query, at = find(part)
            if skip_same:
                other = ids[at] != asked[start + query]
                query, at = query[other], at[other]
            steps = [slice(i, i + CHUNK) for i in range(0, len(at), CHUNK)]
            d = np.concatenate([np.zeros(0), *[_distances(rows[at[i]], part[query[i]], norm) for i in steps]])
            order = np.lexsort((d, query))  # stable: rows equally far stay in the order of their ids
            query, at, d = query[order], at[order], d[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            picked.append(at[best])
            again.append(asked[start + query[best]])
            far.append(d[best])
        found = t.iloc[np.concatenate(picked)].reset_index(drop=True)
        return found.assign(_qid=np.concatenate(again), distance=np.concatenate(far))[columns]

    return run


def _each(count: str) -> Column:
    """One row per number below ``count``."""
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    id: str = "id",
    vector: str = "x",
    metric: str = "l2",
    group: str | None = None,
    payload: Sequence[str] = (),
    skip_same: bool = False,
    block: int | None = None,
) -> DataFrame:
    """The k nearest training rows of every query; ties go to the smaller id.

    Columns: ``id``, ``neighbour``, ``distance``, ``rank`` (from 1) and the ``payload`` columns of
    the training row. ``group`` limits neighbours to rows of the same group; ``skip_same`` leaves
    out the row with the query's own id.
    """
    t, q = _sides(queries, train, id, vector, group, payload)
    return _ranked(_near(q, materialise(t, "train"), k, NORMS[metric], payload, skip_same, block), k, id, payload)


def _sides(queries: DataFrame, train: DataFrame, id: str, vector: str, group: str | None, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows (_id, _x, _group, payload) and queries (_qid, _x, _group)."""
    # NULL groups are a group of their own.
    group_col = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    t = train.select(F.col(id).alias("_id"), F.col(vector).alias("_x"), group_col.alias("_group"), *payload)
    q = queries.select(F.col(id).alias("_qid"), F.col(vector).alias("_x"), group_col.alias("_group"))
    return as_array(t, "_x"), as_array(q, "_x")


def _near(q: DataFrame, t: DataFrame, k: int, norm: int, payload: Sequence[str], skip_same: bool, block: int | None) -> DataFrame:
    """At most k rows per query and block (_qid, _id, distance, payload); ``t`` is a written table."""
    first = t.select(F.size("_x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    width = max(1, first["n"])
    tile = block or min(TILE_ROWS, max(32, TILE_VALUES // width))
    most = block or min(ROWS, max(32, BLOCK_VALUES // width))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("_group").agg(F.count(F.lit(1)).alias(name))

    # A row per group; Spark broadcasts it as long as it is small and joins by group beyond.
    plan = materialise(sizes(t, "_rows").join(sizes(q, "_asked"), "_group"), "sizes")
    pairs = plan.agg(F.sum(F.col("_rows") * F.col("_asked").cast("double"))).first()[0] or 0.0
    # Smaller slices where there would be too few blocks for all cores.
    cores = t.sparkSession.sparkContext.defaultParallelism
    share = max(pairs / (4 * cores), 1.0)
    even = F.least(F.col("_asked") / LEAST_QUERIES, F.col("_asked") * F.least("_rows", F.lit(tile)) / F.lit(share))
    plan = plan.select(
        "_group", F.ceil(F.col("_rows") / tile).cast("int").alias("_tiles"), F.ceil(F.greatest(F.col("_asked") / most, even)).cast("int").alias("_slices")
    )
    many = plan.agg(F.sum(F.col("_tiles") * F.col("_slices").cast("bigint"))).first()[0] or 1
    # Blocks are few and heavy: Spark's own counts, which go by bytes, would put several of them in a task.
    many = max(min(2 * many, 16 * cores), many // 16)
    blocks = (
        t.join(plan, "_group")
        .withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int"))
        .withColumn("_slice", _each("_slices"))
        .select("_group", "_tile", "_slice", "_id", "_x", *payload)
    )
    asked = (
        q.join(plan, "_group")
        .withColumn("_slice", F.pmod(F.xxhash64("_qid"), F.col("_slices")).cast("int"))
        .withColumn("_tile", _each("_tiles"))
        .select("_group", "_tile", "_slice", "_qid", "_x")
    )
    keys = ["_group", "_tile", "_slice"]
    schema = T.StructType(
        [
            T.StructField("_qid", q.schema["_qid"].dataType),
            T.StructField("_id", t.schema["_id"].dataType),
            T.StructField("distance", T.DoubleType()),
            *[t.schema[p] for p in payload],
        ]
    )
    asked, blocks = (side.repartition(many, *keys) for side in (asked, blocks))
    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_top_of_block(k, norm, payload, skip_same), schema)


def _ranked(near: DataFrame, k: int, id: str, payload: Sequence[str]) -> DataFrame:
    # Row-number limits are applied before the shuffle as well, so k rows per query and task move.
    place = F.row_number().over(W.partitionBy("_qid").orderBy("distance", "_id"))
    return (
        near.withColumn("rank", place)
        .filter(F.col("rank") <= k)
        .select(F.col("_qid").alias(id), F.col("_id").alias("neighbour"), "distance", "rank", *payload)
    )


# What the candidate mode learns from, at most: pivots of a table, tables, and rows of the sample.
PIVOTS, TABLES, SAMPLE = 1024, 2, 4096
SEED = 42


@dataclass
class Cells:
    """A candidate index: pivots of each table, and in how many cells of each a query looks.

    ``nearest`` of the index takes the arguments of the exact ``nearest`` and gives the same columns, so either
    can be handed to an operator that searches.
    """

    pivots: list[np.ndarray]
    probes: int
    norm: int

    def _column(self, most: int):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(list(_cells(_stack(x), self.pivots, most, self.norm))) if len(x) else pd.Series([], dtype=object)

        return of("_x")

    def nearest(
        self, queries: DataFrame, train: DataFrame, k: int, id: str = "id", vector: str = "x", metric: str = "l2",
        group: str | None = None, payload: Sequence[str] = (), skip_same: bool = False, block: int | None = None,
    ) -> DataFrame:
        """The k nearest candidates of every query; fewer where its cells hold fewer. Ties go to the smaller id."""
        if NORMS[metric] != self.norm:
            raise ValueError("the index was built for another metric")
        t, q = _sides(queries, train, id, vector, group, payload)
        in_cell = F.concat_ws("|", F.col("_cell").cast("string"), "_group")
        t = t.withColumn("_cell", F.explode(self._column(1))).withColumn("_group", in_cell).drop("_cell")
        q = q.withColumn("_cell", F.explode(self._column(self.probes))).withColumn("_group", in_cell).drop("_cell")
        near = _near(materialise(q, "probes"), materialise(t, "cells"), k, self.norm, payload, skip_same, block)
        # A row may be found in a cell of every table.
        return _ranked(near.dropDuplicates(["_qid", "_id"]), k, id, payload)


def _measured(a: np.ndarray, b: np.ndarray, norm: int) -> np.ndarray:
    """Distances (squares for l2) of all rows of ``a`` from all rows of ``b``."""
    if norm == 1:
        return np.stack([np.abs(b - x).sum(axis=1) for x in a])
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _cells(x: np.ndarray, pivots: list[np.ndarray], most: int, norm: int) -> np.ndarray:
    """Numbers of the ``most`` nearest cells of every table, nearest first."""
    out, first = [], 0
    for p in pivots:
        order = [np.argsort(_measured(x[i : i + 1024], p, norm), axis=1, kind="stable")[:, :most] for i in range(0, len(x), 1024)]
        out.append(np.concatenate(order) + first)
        first += len(p)
    return np.hstack(out).astype("int32")


def build_cells(
    train: DataFrame, k: int, id: str = "id", vector: str = "x", metric: str = "l2", group: str | None = None,
    target: float = 0.95, pivots: int | None = None, tables: int = TABLES, sample: int = SAMPLE,
) -> Cells:
    """A candidate index for ``train``, learned from at most ``sample`` rows drawn by the hash of their ids.

    There are as many pivots as the root of the number of rows, PIVOTS at most, so that queries look in few
    cells and cells hold few rows. Data in clusters need few probes; where no row is much nearer than others,
    half of the cells may be needed, and the exact mode is the cheaper one. The number of probed cells is the least with which ``target`` of the k nearest sample rows (of the same
    group, but the row itself) share a cell with a probe in some table.
    """
    t, _ = _sides(train, train, id, vector, group, ())
    drawn = t.orderBy(F.xxhash64("_id"), "_id").limit(sample).toPandas()
    if not len(drawn):
        raise ValueError("no training rows")
    x, groups, norm = _stack(drawn["_x"]), pd.factorize(drawn["_group"])[0], NORMS[metric]
    pivots = pivots or min(PIVOTS, round(train.count() ** 0.5))
    rng = np.random.default_rng(SEED)
    sets = [x[rng.choice(len(x), min(max(pivots, 1), len(x)), replace=False)] for _ in range(tables)]
    own = _cells(x, sets, 1, norm)
    asked = rng.choice(len(x), min(512, len(x)), replace=False)
    places = []  # how many cells a query has to look in until it meets a neighbour in some table
    ordered = _cells(x[asked], sets, max(len(s) for s in sets), norm)
    width = ordered.shape[1] // tables
    for row, at in enumerate(asked):
        far = _measured(x[at : at + 1], x, norm)[0]
        far[(groups != groups[at]) | (np.arange(len(x)) == at)] = np.inf
        near = [i for i in np.argsort(far, kind="stable")[:k] if np.isfinite(far[i])]
        if near:
            met = [(ordered[row, j * width : (j + 1) * width][:, None] == own[near, j][None, :]).argmax(axis=0) for j in range(tables)]
            places.extend(np.min(met, axis=0) + 1)
    probes = int(np.quantile(places, target, method="higher")) if places else 1
    return Cells(sets, probes, norm)


def recall(found: DataFrame, exact: DataFrame, id: str = "id") -> float:
    """Share of the exact mode's (query, neighbour) pairs that ``found`` has; 1 if there are none."""
    truth = materialise(exact.select(id, "neighbour"), "truth")
    n = truth.count()
    return truth.join(found, [id, "neighbour"], "left_semi").count() / n if n else 1.0


def knn_vote(neighbours: DataFrame, id: str = "id", label: str = "label", weights: str = "uniform") -> DataFrame:
    """Predicted label per query. ``distance`` weighs by inverse distance, and rows at distance 0
    outvote all others; ties go to the smaller label."""
    if weights == "uniform":
        zero, weight = F.lit(0), F.lit(1.0)
    elif weights == "distance":
        zero = F.when(F.col("distance") == 0, 1).otherwise(0)
        weight = F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(0.0)
    else:
        raise ValueError(f"unknown weights: {weights}")
    votes = neighbours.groupBy(id, label).agg(F.sum(zero).alias("_z"), F.sum(weight).alias("_w"))
    best = F.min(F.struct((-F.col("_z")).alias("z"), (-F.col("_w")).alias("w"), F.col(label).alias("v")))
    return votes.groupBy(id).agg(best.alias("_b")).select(id, F.col("_b.v").alias("pred"))
