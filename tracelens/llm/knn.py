"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are made whole numbers, floor(SCALE * x).  Queries and data are grouped by their nearest pivot; there are as
many pivots as the root of the rows (PIVOTS at most), those of least hash.  Every group of data has a
summary: its count, its radius R (the largest distance to the pivot p), the largest angle to p, and its least and
largest norm.  For a query q the scores of a group lie in q.p -+ |q| R, and within what the angles allow:
|q| |x| cos(angle(q, p) -+ angle); the narrower of both counts.  So
  - groups with the largest lower bounds that together hold k vectors give a first bound for the k-th score,
  - the query is solved in its home tile, which raises the bound to a real k-th score,
  - and it is sent only to groups whose upper bound reaches it.
Small groups that lie near each other are put together to tiles of BLOCK vectors, so a query is copied once a tile;
larger ones are cut in blocks of BLOCK vectors, and what is sent to a tile in blocks of BLOCK queries.  Each pair of blocks
is one product of matrices, exact in whole numbers.  How many groups a query is sent to is the data's doing: few if they form clusters, nearly
all if they point in every direction of many dimensions, for then no bound by a group's summary is near its best score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

SCALE, K, EVERY, PIVOTS, BLOCK, SEED = 256.0, 5, 50, 4096, 4096, 13
#: Products of whole numbers are exact in doubles while their sums stay below this.
EXACT = 2.0**53


def whole(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """vec_id, v (array<double> of whole numbers); rows with null ids or vectors, or null or non-finite components, are left out."""
    v = F.col(vector_column)
    # doubles from 2 ** 53 on are whole numbers
    down = lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)
    x = F.transform(v, lambda e: down(e.cast("double") * scale))
    sound = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_column).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("v"))


def matrix(column) -> np.ndarray:
    """A list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64; beyond what doubles hold, in Python's whole numbers, of which those beyond 64 bits count as the nearest number of 64 bits."""
    if q.size and x.size and not np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        exact = np.frompyfunc(int, 1, 1)(q) @ np.frompyfunc(int, 1, 1)(x.T)
        return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return (q @ x.T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of scores its k largest, ties to the smaller id, without the row's own id: row, id, score."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    rows, cols = [], []
    keep = min(k + 1, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= floor[r])
        at = at[ids[at] != own[r]]
        at = at[np.argsort(-scores[r][at], kind="stable")][:k]
        rows.append(np.full(len(at), r))
        cols.append(at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    return row, ids[col], scores[row, col]


def _norms(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(1, initial=1.0)
    return largest * np.sqrt(((x / largest[:, None]) ** 2).sum(1))


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angles between the rows of x and of p; pi where one is zero."""
    a, b = _norms(x), _norms(p)
    cos = (x / np.maximum(a, 1e-300)[:, None] * (p / np.maximum(b, 1e-300)[:, None])).sum(1)
    return np.where((a > 0) & (b > 0), np.arccos(np.clip(cos, -1, 1)), np.pi)


def _near(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each row, a distance and an angle to it that are not too small, and the row's norm."""
    out, far, wide = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.nan_to_num((part**2).sum(1)[:, None] - 2 * part @ pivots.T + (pivots**2).sum(1)[None, :], nan=np.inf)
        at = d.argmin(1)
        out[lo : lo + 2048] = at
        far[lo : lo + 2048] = _norms(part - pivots[at])
        wide[lo : lo + 2048] = _angles(part, pivots[at])
    return out, far * (1 + 1e-9) + 1e-6, wide + 1e-7, _norms(x)


def score_bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each query's inner products with the vectors of each group."""
    size, p = _norms(q), _norms(pivots)
    with np.errstate(over="ignore", invalid="ignore"):
        mid = q @ pivots.T
        cos = np.clip(mid / np.maximum(size[:, None] * p[None, :], 1e-300), -1, 1)
        error = 1 + 1e-9 * size[:, None] * (p + high)[None, :]
        slack = size[:, None] * radius[None, :] * (1 + 1e-9) + error
        between = np.arccos(cos)
        most = np.cos(np.maximum(0, between - angle[None, :] - 1e-7))
        least = np.cos(np.minimum(np.pi, between + angle[None, :] + 1e-7))
        above = size[:, None] * np.where(most > 0, high[None, :], low[None, :]) * most + error
        below = size[:, None] * np.where(least > 0, low[None, :], high[None, :]) * least - error
    down = np.nan_to_num(np.maximum(mid - slack, below), nan=-np.inf)
    return down, np.nan_to_num(np.minimum(mid + slack, above), nan=np.inf, posinf=np.inf)


def tiles_of(centers: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The tile of each group, from 0: groups in the order of their pivots' main direction, as many as hold `most` vectors together, one at least."""
    scale = np.abs(centers).max(initial=1.0)
    middle = centers / scale - (centers / scale).mean(0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    tile, held, out = 0, 0, np.zeros(len(count), np.int64)
    for i in np.argsort(along, kind="stable"):
        if held and held + count[i] > most:
            tile, held = tile + 1, 0
        out[i], held = tile, held + count[i]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = SCALE, pivots: int = PIVOTS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (id divisible by `every`) with all other rows.

    Ties go to the smaller vec_id; fewer than k if there are fewer.  Vectors of fewer dimensions than the largest
    count as if zeros followed.  Of repeated ids the row of least vector counts.  Rows with a null id, and vectors that are
    null or hold null or non-finite components, take no part; scores beyond 64 bits count as the nearest number of 64 bits.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    C.batches(spark, 8192)
    ddl = "query_id long, rank int, vec_id long, score long"
    data = C.saved(whole(vectors, id_column, vector_column, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, most, least = data.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not n or not most:
        return spark.createDataFrame([], ddl)
    if least < most:
        data = data.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))
    chosen = data.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(min(pivots, math.isqrt(n) + 1)).collect()
    centers = np.unique(np.array([r["v"] for r in chosen]), axis=0)
    shared = spark.sparkContext.broadcast(centers)

    def assign(parts):
        for part in parts:
            x = matrix(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c) for c in _near(x, shared.value)]], names=["vec_id", "v", "cell", "far", "wide", "norm"])

    placed = C.saved(data.mapInArrow(assign, "vec_id long, v array<double>, cell long, far double, wide double, norm double"), "placed")
    summary = placed.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("wide"), F.min("norm"), F.max("norm")).collect()  # a row for each pivot at most
    cells, count, radius, angle, low, high = (np.array(c) for c in zip(*summary))
    tile = tiles_of(centers[cells], count, BLOCK)
    blocks = np.ceil(np.bincount(tile, count) / BLOCK).astype(int).tolist()
    home_of = dict(zip(cells.tolist(), tile.tolist()))
    in_tile = F.element_at(F.lit([home_of.get(c, 0) for c in range(len(centers))]), (F.col("cell") + 1).cast("int")).cast("long")
    tiled = placed.select("vec_id", "v", in_tile.alias("tile"))
    queries = tiled.filter(F.col("vec_id") % every == 0)

    def of_tile(numbers: list):
        return F.element_at(F.lit(numbers), (F.col("tile") + 1).cast("int"))

    spot = lambda blocks: F.pmod(F.xxhash64("vec_id", F.lit(seed)), blocks).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))

    def local(key, q: pa.Table, x: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and x.num_rows:
            xs, ids = matrix(x.column("x")), x.column("id").to_numpy()
            qs, own, reach = matrix(q.column("v")), q.column("vec_id").to_numpy(), q.column("low").to_numpy()
            for lo in range(0, len(qs), 256):
                row, vec, score = best(products(qs[lo : lo + 256], xs), ids, own[lo : lo + 256], k)
                good = score >= reach[lo : lo + 256][row]
                found.append(np.stack([own[lo : lo + 256][row][good], vec[good], score[good]]))
        out = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    def solve(sent: DataFrame) -> DataFrame:
        """sent, a work table: tile, vec_id, v, low; each block of a tile's queries with each block of its vectors."""
        asked = {r["tile"]: math.ceil(r["count"] / BLOCK) for r in sent.groupBy("tile").count().collect()}  # a row for each pivot at most
        parts = [asked.get(t, 0) for t in range(len(blocks))]
        left = sent.withColumn("part", spot(of_tile(parts))).withColumn("block", upto(of_tile(blocks)))
        right = tiled.filter(of_tile(parts) > 0).select("tile", spot(of_tile(blocks)).alias("block"), F.col("vec_id").alias("id"), F.col("v").alias("x")).withColumn("part", upto(of_tile(parts)))
        keys = ["tile", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, q, x: local(key, q, x), "query_id long, vec_id long, score long")

    def first(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    home = C.saved(first(solve(queries.select("tile", "vec_id", "v", F.lit(float("-inf")).alias("low")))), "home")
    real = home.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    known = queries.join(real, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "tile", "kth")

    by_tile = np.argsort(tile, kind="stable")
    begins = np.searchsorted(tile[by_tile], np.arange(len(blocks)))

    def send(parts):
        schema = pa.schema([("tile", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("low", pa.float64())])
        for part in parts:
            for lo in range(0, part.num_rows, 256):
                some = part.slice(lo, 256)
                q = matrix(some.column(1))
                down, up = score_bounds(q, shared.value[cells], radius, angle, low, high)
                order = np.argsort(-down, axis=1)
                held = np.cumsum(count[order], 1)
                enough = np.minimum((held < k + 1).sum(1), len(cells) - 1)
                reach = np.where(held[:, -1] > k, np.take_along_axis(down, order, 1)[np.arange(len(q)), enough], -np.inf)
                # the k-th score is a long, which a double holds within its rounding
                kth = np.nan_to_num(some.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                reach = np.maximum(reach, kth - np.abs(kth) * 2.0**-50)
                wanted = np.logical_or.reduceat((up >= reach[:, None])[:, by_tile], begins, axis=1)
                wanted[np.arange(len(q)), some.column(2).to_numpy()] = False
                row, at = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(at), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(reach[row])], schema=schema)

    sent = C.saved(known.mapInArrow(send, "tile long, vec_id long, v array<double>, low double"), "sent")
    every_found = solve(sent).unionByName(home.select("query_id", "vec_id", "score"))
    return first(every_found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
