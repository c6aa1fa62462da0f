"""Greedy chunks of keys of any size: a key's rows are spread over tasks, though each chunk begins where the one before ends.

Rows are sorted by key and order in ranges, so a large key lies in many.  With running sums a chunk that begins at a row ends at a
threshold of the sum, whatever came before; so each range can tell, for every threshold at which a chunk may reach it, at which it
leaves again and how many chunks begin in between.  Those steps from threshold to threshold are few (the rows within one chunk of a
range's end).  They are doubled, as pointers are, until the steps from the key's first row are known, and then each range numbers its own rows.

Sums are doubled whole numbers, so that a threshold can lie just below one: 2 * sum > threshold is the first row of the next chunk.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..model.stage import work_root, written

#: Thresholds before a key's first row, and after its last.
BEGIN, END = -1, (1 << 63) - 1


def starts(size: np.ndarray, before: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a range whose rows follow `before` bytes: doubled running sums, and of each row the row at which the chunk that it begins ends, and that end's threshold."""
    upto = before + np.cumsum(size)
    threshold = np.maximum(2 * (upto - size + limit), 2 * upto - 1)
    following = np.maximum(np.searchsorted(2 * upto, threshold, "right"), np.arange(1, len(size) + 1))
    return 2 * upto, following, threshold


def steps(size: np.ndarray, before: int, limit: int, entries: np.ndarray) -> list[tuple[int, int, int]]:
    """(entry, exit, chunks that begin in between) for each threshold at which a chunk may reach the range."""
    upto, following, threshold = starts(size, before, limit)
    n = len(size)
    leave, count = threshold.tolist(), [1] * n
    later = following.tolist()
    for i in range(n - 1, -1, -1):
        if later[i] < n:
            leave[i], count[i] = leave[later[i]], count[later[i]] + 1
    out = []
    for t in entries.tolist():
        i = int(np.searchsorted(upto, t, "right"))
        out.append((t, leave[i], count[i]) if i < n else (t, t, 0))
    return out


def numbered(size: np.ndarray, before: int, limit: int, entry: int, begun: int) -> np.ndarray:
    """The chunk of each row of a range that a chunk reaches at `entry`, when `begun` chunks have begun."""
    upto, following, _ = starts(size, before, limit)
    out = np.zeros(len(size), np.int64)
    at = int(np.searchsorted(upto, entry, "right"))
    while at < len(size):
        out[at] = 1
        at = int(following[at])
    return begun - 1 + np.cumsum(out)


def fill_spread(rows: DataFrame, key: list[str], order: list[str], size: str, limit: int, ranges: int | None = None) -> DataFrame:
    """Adds `chunk` to rows as fill_ordered() does, with a key's rows spread over up to `ranges` tasks.

    Rows are read five times from one written table.  Rows of one key that tie in `order` are put in the order of their sizes.
    """
    spark = rows.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    root = f"{work_root(spark)}/spread-{uuid.uuid4().hex[:12]}"
    by = ["__who", "__part"]
    placed = rows.repartitionByRange(ranges, *key, *order, size).sortWithinPartitions(*key, *order, size)
    placed = placed.withColumns({"__who": F.to_json(F.struct(*key)), "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = written(placed, f"{root}/placed")
    sums = placed.groupBy(*by).agg(F.sum(size).cast("long").alias("bytes"))
    along = W.partitionBy("__who").orderBy("__part")  # a row for each range at most
    before = F.coalesce(F.sum("bytes").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select(*by, before.alias("before"), "bytes", F.row_number().over(along).alias("nth")).withColumn("upto", (F.col("before") + F.col("bytes")) * 2)
    parts = written(parts.withColumns({"next": F.lead("__part").over(along), "next_upto": F.lead("upto").over(along)}), f"{root}/parts")
    sized = placed.select(*by, "__at", F.col(size).cast("long").alias("size")).join(parts, by)

    def sizes(t: pa.Table) -> tuple[np.ndarray, int]:
        return t.column("size").to_numpy()[np.argsort(t.column("__at").to_numpy(), kind="stable")], t.column("before")[0].as_py()

    def leaving(key_, t: pa.Table) -> pa.Table:
        """The thresholds at which chunks may leave a range, with the next range where it holds the row that they lead to."""
        _, following, threshold = starts(*sizes(t), limit)
        out = np.unique(threshold[following == t.num_rows])
        later, upto = t.column("next")[0].as_py(), t.column("next_upto")[0].as_py()
        same = lambda value, kind: pa.array([value] * len(out), kind)
        return pa.table({"__who": same(key_[0].as_py(), pa.string()), "__from": same(key_[1].as_py(), pa.int32()), "threshold": pa.array(out), "__part": pa.array([later if x < upto else None for x in out.tolist()], pa.int32())})

    ends = sized.filter("next IS NOT NULL").groupBy(*by).applyInArrow(lambda k, t: leaving(k, t), "__who string, __from int, threshold long, __part int")
    begin = parts.filter("nth = 1").select("__who", F.lit(BEGIN).cast("long").alias("threshold"), "__part")
    ends = written(ends, f"{root}/ends")
    bounds = parts.groupBy("__who").agg(F.array_sort(F.collect_list(F.struct("__part", "upto"))).alias("bounds"))
    inside = F.get(F.filter("bounds", lambda b: (b["__part"] > F.col("__from")) & (b["upto"] > F.col("threshold"))), F.lit(0))  # the first later range that a threshold does not pass
    far = ends.filter("__part IS NULL").join(bounds, "__who").select("__who", "threshold", inside["__part"].alias("__part")).filter("__part IS NOT NULL")  # few pass a whole range
    reached = ends.filter("__part IS NOT NULL").select("__who", "threshold", "__part").unionByName(far).distinct()
    entries = written(begin.unionByName(reached), f"{root}/entries")

    def stepping(key_, t: pa.Table, e: pa.Table) -> pa.Table:
        found = steps(*sizes(t), limit, e.column("threshold").to_numpy()) if t.num_rows and e.num_rows else []
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({"__who": pa.array([key_[0].as_py()] * len(found), pa.string())} | {c: pa.array(v, pa.int64()) for c, v in zip("abn", columns)})

    jump = written(sized.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(lambda k, t, e: stepping(k, t, e), "__who string, a long, b long, n long"), f"{root}/jump")
    known = begin.select("__who", "threshold", F.lit(0).cast("long").alias("begun"))
    most = parts.agg(F.max("nth")).first()[0] or 1
    for k in range(math.ceil(math.log2(most + 1))):
        ahead = known.join(jump.withColumnRenamed("a", "threshold"), ["__who", "threshold"]).select("__who", F.col("b").alias("threshold"), (F.col("begun") + F.col("n")).alias("begun"))
        known = written(known.unionByName(ahead).distinct(), f"{root}/known{k}")
        twice = jump.select("__who", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        jump = written(jump.join(twice, ["__who", "b"]).select("__who", "a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n")), f"{root}/jump{k}")

    totals = known.groupBy("__who").agg(F.max("begun").alias("total"))
    real = known.join(entries, ["__who", "threshold"])
    begun = F.coalesce(F.first("begun", ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing)), "total")  # a range that a chunk passes over: as the next one
    told = parts.join(real, by, "left").join(totals, "__who").select(*by, "before", F.coalesce("threshold", F.lit(END)).alias("entry"), begun.alias("begun"))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())])

    def number(t: pa.Table, e: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("__at").to_numpy(), kind="stable")))
        one = {c: e.column(c)[0].as_py() for c in ("before", "entry", "begun")} if t.num_rows else {"before": 0, "entry": END, "begun": 0}
        chunk = numbered(t.column(size).cast(pa.int64()).to_numpy(), one["before"], limit, one["entry"], one["begun"])
        return t.select(names).append_column("chunk", pa.array(chunk, pa.int32()))

    return placed.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(lambda t, e: number(t, e), schema)
