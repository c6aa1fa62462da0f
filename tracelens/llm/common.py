"""What the operators share: work tables in the shared folder, ordering without one big task, Arrow batches."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Rows and bytes of an Arrow batch that goes to Python; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

_own_root: list[str] = []
_tables: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); an own one only where that is unset and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="tracelens-"))
    return _own_root[0]


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", compression).parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def held(path: str) -> None:
    """Counts a folder among the work tables."""
    _tables.append(path)


def mark() -> int:
    """How many work tables there are; for taken()."""
    return len(_tables)


def taken(since: int = 0) -> list[str]:
    """The work tables made after mark() returned `since`, for delete(); they are no longer kept track of here."""
    out = _tables[since:]
    del _tables[since:]
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes work tables; call it once nothing reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p.rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the batches that go to Python small, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """run(batches), and then what it has freed goes back to the system: Python workers outlive their tasks."""

    def wrapped(parts):
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def width(spark: SparkSession) -> int:
    """Partitions that spread a small keyed set over the cluster."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the key, by binary search; null keys: 0."""
    if not bounds:
        return F.lit(0)
    n = 1 << math.ceil(math.log2(len(bounds) + 1))
    filled = F.lit(list(bounds) + [None] * (n - len(bounds)))
    at = F.lit(0)
    step = n >> 1
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), at,
        lambda lo, s: F.when(F.coalesce(F.element_at(filled, (lo + s).cast("int")) <= key, F.lit(False)), lo + s).otherwise(lo),
    )


def quantile_bounds(df: DataFrame, key: str, rows_each: int, least: int = 64, most: int = 4096) -> list:
    """Distinct values of the numeric key that cut df in ranges of about rows_each rows; their number is bounded."""
    n = df.count()
    parts = min(most, max(least, n // rows_each))
    if n == 0 or parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20000).alias("c")).first()["c"] or []
    return sorted(set(cuts))


def with_running_sum(df: DataFrame, key: str, ties: list[str], value: str, out: str, rows_each: int = 20000) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows before in the order of key (nulls first), then ties.

    Ranges of the key are summed apart; only their totals (4,096 at most) meet in one task.  df is read
    three times, so it should be a work table.
    """
    bounds = quantile_bounds(df.filter(F.col(key).isNotNull()), key, rows_each)
    ranged = df.withColumn("__range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(bucket_of(F.col(key), bounds)))
    order = [F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties]]
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    before = totals.select(
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__total").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(before), F.col("__range") == F.col("__r"))
        .withColumn(out, (F.col("__before") + F.col("__inside")).cast("long"))
        .drop("__range", "__r", "__before", "__inside")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b), by minimum labels and pointer jumps.

    Edges and labels are tables of two numbers; each round is written, so its lineage is one join deep.
    A hub's edges meet in a join that Spark may split, and in sums that are made before the shuffle.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels0")
    for i in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("n")).agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.n).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        step = saved(step, f"step{i}")
        up = step.select(F.col("node").alias("p"), F.col("label").alias("up"))
        nxt = saved(step.join(up, step.label == up.p).select("node", F.least("label", "up").alias("label"), "old"), f"labels{i + 1}")
        changed = nxt.filter("label != old").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def arrow(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type, from_pandas=False) for f in schema], schema=schema)


LONG, STRING, DOUBLE = T.LongType(), T.StringType(), T.DoubleType()
