"""Hard negatives: every anchor's scores against all rows, sorted by score and id, and read below each positive's upper limit.

Vectors are made whole numbers, floor(SCALE * x), so scores are exact.  Anchors are a stated set of rows; anchors and rows are dealt in
blocks, and each pair of blocks is one product of matrices, so no task holds more than two blocks and one slice of their scores.
A block's scores of an anchor are sorted by score and id, whole; then
  - the first rows of the anchor's label are its positives of the block, and the first of all blocks its positives,
  - and for each positive a binary search finds its upper limit among the rows of other labels; from there on `negatives` of them are
    read, as far as the lower limit, and the first of all blocks are its hard negatives.
The order of all rows is the merge of the blocks' orders, so the result is that of one sort of all of an anchor's scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .knn import EXACT, SCALE, matrix, products

EVERY, POSITIVES, NEGATIVES, SEED = 100, 5, 10, 13
#: A negative scores from LOW to HIGH of what the positive scores, in hundredths.
LOW, HIGH = 30, 90
#: Rows of a block, and anchors of a part: what is shuffled falls with both, so they are large where there are blocks for all tasks.
LEAST_BLOCK, MOST_BLOCK = 4096, 32_768
#: Anchors whose scores of a block are held at once.
SLICE = 64
SCHEMA = "anchor_id long, rank int, positive_id long, negative_id long, positive_score long, negative_score long"


def whole(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, label: Column | None, scale: float) -> DataFrame:
    """vec_id, label (long), v (array<double> of whole numbers) of the rows that take part."""
    v = F.col(f"`{vector_column}`")
    # doubles from 2 ** 53 on are whole numbers
    down = lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)
    sound = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    own = F.col(f"`{label_column}`").cast("long") if label is None else label.cast("long")
    rows = vectors.filter(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label_column}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), own.alias("label"), F.transform(v, lambda e: down(e.cast("double") * scale)).alias("v")).filter(F.col("label").isNotNull())


def limits(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the largest whole number s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


class Block:
    """A block of rows in the order of their ids, and the sorted scores of anchors against it."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("id").to_numpy(), kind="stable")
        self.ids, self.labels, self.x = rows.column("id").to_numpy()[order], rows.column("of").to_numpy()[order], matrix(rows.column("x"))[order]

    def sorted(self, vectors: np.ndarray):
        """For each anchor its scores, best first, and the places of the rows; ties in the order of ids."""
        for lo in range(0, len(vectors), SLICE):
            down = ~products(vectors[lo : lo + SLICE], self.x)  # -score - 1, which no score is too small for
            order = np.argsort(down, axis=1, kind="stable")
            for row, at in zip(down, order):
                yield ~row[at], at


def first_of_label(block: Block, anchors: pa.Table, k: int):
    """(anchor, id, score) of the k best rows of each anchor's label, without itself."""
    own, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    for i, (score, at) in enumerate(block.sorted(matrix(anchors.column("v")))):
        same = np.flatnonzero((block.labels[at] == labels[i]) & (block.ids[at] != own[i]))[:k]
        for j in same:
            yield int(own[i]), int(block.ids[at[j]]), int(score[j])


def within_limits(block: Block, anchors: pa.Table, k: int, low: int, high: int):
    """(anchor, positive, its score, id, score) of the k best rows of other labels within the limits of each positive."""
    own, labels, positives = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("positives").to_pylist()
    for i, (score, at) in enumerate(block.sorted(matrix(anchors.column("v")))):
        other = block.labels[at] != labels[i]
        at, up = at[other], score[other][::-1]  # ascending, for the searches
        for p in positives[i]:
            least, largest = limits(p["score"], low, high)
            begin = len(up) - int(np.searchsorted(up, largest, "right"))
            stop = min(begin + k, len(up) - int(np.searchsorted(up, least, "left")))
            for j in range(begin, stop):
                yield int(own[i]), p["id"], p["score"], int(block.ids[at[j]]), int(up[len(up) - 1 - j])


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_column: str = "vec_id",
    vector_column: str = "embedding", label_column: str = "label", label: Column | None = None, scale: float = SCALE, block: int | None = None, seed: int = SEED,
) -> DataFrame:
    """anchor_id, rank, positive_id, negative_id, positive_score, negative_score: for each anchor (id divisible by `every`) and each of its positives
    (its best other rows of the same label) the best rows of other labels that score from low to high hundredths of the positive.

    label, if given, is what label_column counts as.  Ties go to the smaller id; fewer rows if there are fewer.  Rows with a null id, a null label or a
    vector that is null or holds null or non-finite components take no part.  Vectors of fewer dimensions than the largest count as if zeros
    followed.  Of repeated ids the row of least label, then least vector counts.  Scores beyond 64 bits count as the nearest number of 64 bits.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    C.batches(spark, 8192)
    single = whole(vectors, id_column, vector_column, label_column, label, scale).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    data = C.saved(single.select("vec_id", "r.label", "r.v"), "labelled")
    n, asked, most, least = data.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not asked or not most:
        return spark.createDataFrame([], SCHEMA)
    if least < most:
        data = data.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(n / C.width(spark))))
    blocks, parts = math.ceil(n / block), math.ceil(asked / block)
    spot = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    copied = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = data.select(spot(blocks).alias("block"), F.col("vec_id").alias("id"), F.col("label").alias("of"), F.col("v").alias("x")).withColumn("part", copied(parts))
    anchors = data.filter(F.col("vec_id") % every == 0).withColumn("part", spot(parts))

    def met(sent: DataFrame, names: list[str], found) -> DataFrame:
        """found(block, anchors) of each block of rows with each part of the anchors."""
        schema = pa.schema([(name, pa.int64()) for name in names])

        def local(key, a: pa.Table, x: pa.Table) -> pa.Table:
            out = list(found(Block(x), a)) if a.num_rows and x.num_rows else []
            return pa.table(dict(zip(names, map(list, zip(*out)))) if out else {name: [] for name in names}, schema=schema)

        left = sent.withColumn("block", copied(blocks)).groupBy("block", "part")
        return left.cogroup(rows.groupBy("block", "part")).applyInArrow(lambda key, a, x: local(key, a, x), ", ".join(f"{name} long" for name in names))

    def best(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), row))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    same = met(anchors, ["anchor_id", "id", "score"], lambda x, a: first_of_label(x, a, positives))
    known = best(same, ["anchor_id"], "score", "id", positives).groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asking = C.saved(anchors.join(known, F.col("vec_id") == F.col("anchor_id")).select("part", "vec_id", "label", "v", "positives"), "asking")
    other = met(asking, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], lambda x, a: within_limits(x, a, negatives, low, high))
    return best(other, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", F.col("rank").cast("int").alias("rank"), "positive_id", "negative_id", "positive_score", "negative_score")


#: All scores of all anchors in one sort; labels of every seventh row are moved on by one.
SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
      FROM e a, e x WHERE a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, rank, positive_id, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
