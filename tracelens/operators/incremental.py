"""What has to be computed anew, and keyed tables that take updates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import ranked


#: Buckets of each partition of a table that takes updates, if its first batch names no other number.
BUCKETS = 16


def without(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not done."""
    return rows.join(done.select(*key), key, "left_anti")


def stale(rows: DataFrame, done: DataFrame, key: list[str], fingerprint: str = "fp") -> DataFrame:
    """Rows that are not done, or were done under another fingerprint."""
    old = done.select(*key, F.col(fingerprint).alias("__old"))
    return rows.join(old, key, "left").filter(~F.col(fingerprint).eqNullSafe(F.col("__old"))).drop("__old")


def changed_since(found: DataFrame, stored: DataFrame, key: list[str], updated: str = "updated_at", modified: str = "last_modified") -> DataFrame:
    """Adds `status`: new, changed (updated after what is stored) or same."""
    old = stored.select(*key, F.col(modified).alias("__at"))
    status = F.when(F.col("__at").isNull(), "new").when(F.col(updated) > F.col("__at"), "changed").otherwise("same")
    return found.join(old, key, "left").withColumn("status", status).drop("__at")


def upload_totals(compared: DataFrame, by: str = "source", size: str = "size_bytes") -> DataFrame:
    """by, discovered, uploaded, skipped, bytes (of what is uploaded) of rows with a `status` of changed_since()."""
    sent = F.col("status") != "same"
    return compared.groupBy(by).agg(
        F.count("*").alias("discovered"), F.count_if(sent).alias("uploaded"), F.count_if(~sent).alias("skipped"),
        F.coalesce(F.sum(F.when(sent, F.col(size))), F.lit(0)).cast("long").alias("bytes"),
    )


def hits(rows: DataFrame, done: DataFrame, key: list[str], fingerprint: str = "fp") -> DataFrame:
    """One row: hit, rows that are done under their fingerprint, and miss, the others."""
    known = done.select(*key, F.col(fingerprint).alias("__old"))
    hit = F.col("__old").eqNullSafe(F.col(fingerprint))
    return rows.join(known, key, "left").agg(F.count_if(hit).alias("hit"), F.count_if(~hit).alias("miss"))


def per_source(rows: DataFrame, count: str, size: str | None = None, by: str = "source") -> DataFrame:
    """by, `count` rows, and the sum of `size` if it is given."""
    return rows.groupBy(by).agg(F.count("*").alias(count), *([F.sum(size).alias("n_bytes")] if size else []))


def remaining(rows: DataFrame, limit: int) -> DataFrame:
    """One row: total, processed (limit at most; 0: all) and remaining rows."""
    most = F.lit(limit).cast("long") if limit else F.count("*")
    return rows.agg(F.count("*").alias("total"), F.least(most, F.count("*")).alias("processed")).withColumn("remaining", F.col("total") - F.col("processed"))


def unfetched(listed: DataFrame, cached: DataFrame, key: list[str], updated: str = "updated_at") -> DataFrame:
    """Listed rows that are not cached, or were updated after their cached copy."""
    old = cached.groupBy(*key).agg(F.max(updated).alias("__at"))
    return listed.join(old, key, "left").filter(F.col("__at").isNull() | (F.col("__at") < F.col(updated))).drop("__at")


def search_segments(counts: DataFrame, most: int = 1000) -> DataFrame:
    """first, last (months), n of counts(month, n): years, newest first, and a year of more than `most` hits by months; empty ones go.

    For a search that shows `most` hits at most.  A month of more is a segment still.
    """
    year = F.trunc("month", "year")
    years = counts.groupBy(year.alias("y")).agg(F.sum("n").alias("total"))
    told = counts.join(years, year == F.col("y"))
    cut = F.col("total") > most
    first, last = F.when(cut, F.col("month")).otherwise(F.col("y")), F.when(cut, F.col("month")).otherwise(F.add_months("y", 11))
    return told.groupBy(first.alias("first"), last.alias("last")).agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("first"))


def next_sync(states: DataFrame) -> DataFrame:
    """Adds `since` (from when to search; null: all) and `then` (the state to keep) to states(identity, last_sync, user, started, complete).

    Another identity makes the cache void; only a complete sync moves the state on, to when it started.
    """
    same = (F.coalesce("identity", F.lit("")) == "") | (F.col("identity") == F.col("user"))
    since = F.when(same, F.col("last_sync"))
    return states.withColumn("since", since).withColumn("void", ~same).withColumn("then", F.when(F.col("complete"), F.col("started")).otherwise(since))


def rejects(rows: DataFrame, required: list[str]) -> DataFrame:
    """Adds `missing`: the first required column that is null or empty; null for rows that are good."""
    first = F.coalesce(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required])
    return rows.withColumn("missing", first)


def newest(rows: DataFrame, n: int, modified: str, key: list[str]) -> DataFrame:
    """The n newest, ties by key; 0: all."""
    return rows.orderBy(F.desc(modified), *key).limit(n) if n else rows


def dispatch(rows: DataFrame, buckets: int, size: str, key: list[str]) -> DataFrame:
    """Adds `bucket`: largest first, dealt in turn."""
    return ranked(rows, size, key, "__rank").withColumn("bucket", ((F.col("__rank") - 1) % buckets).cast("int")).drop("__rank")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def merged(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """All keys of both; where both have one, theirs.  Nothing is deleted."""
    return ours.join(theirs.select(*key), key, "left_anti").unionByName(theirs)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version (ts, content) that has content."""
    return versions.filter(F.coalesce("content", F.lit("")) != "").agg(F.max("ts").alias("ts"), F.max_by("content", "ts").alias("content"))


def _files(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def forget(spark, path: str) -> bool:
    """Deletes a file or folder; says whether there was one."""
    files, at = _files(spark, path)
    return files.delete(at, True)


def subfolders(spark, path: str) -> list[str]:
    """The names of the folders in a folder; none if it doesn't exist."""
    files, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


def table_rows(spark, path: str, schema: str) -> DataFrame:
    """The rows of a table that upsert() keeps, in the columns of the schema; a table that doesn't exist has none."""
    settle(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows.select(*spark.createDataFrame([], schema).columns)


def settle(spark, path: str) -> None:
    """Finishes or drops what an upsert that was cut off has left beside the table: partitions of a whole batch are moved in, parts of one go."""
    files, aside = _files(spark, path.rstrip("/") + "__next")
    if not files.exists(aside):
        return
    for found in sorted(str(s.getPath()) for s in files.listStatus(aside)):
        if exists(spark, f"{found}/_SUCCESS"):
            for value in subfolders(spark, found):
                for bucket in subfolders(spark, f"{found}/{value}"):
                    at, to = (_files(spark, f"{root.rstrip('/')}/{value}/{bucket}")[1] for root in (found, path))
                    files.delete(to, True)
                    files.mkdirs(to.getParent())
                    files.rename(at, to)
        files.delete(_files(spark, found)[1], True)


def buckets_of(spark, path: str) -> int | None:
    """In how many buckets each value's rows are dealt, as the folders say; None for a table that doesn't exist."""
    for value in subfolders(spark, path):
        for bucket in subfolders(spark, f"{path.rstrip('/')}/{value}"):
            return int(bucket.rpartition("-")[2])
    return None


def staged(path: str, batch: DataFrame, key: list[str], by: str = "source", buckets: int = BUCKETS) -> str:
    """Writes the partitions of the table at path that a batch touches, as they will be, to a folder beside it, for settle(); the folder."""
    spark = batch.sparkSession
    known = buckets_of(spark, path)
    if known is None and subfolders(spark, path):
        raise ValueError(f"{path} has no buckets: it was not written by upsert()")
    buckets = known or buckets
    batch = batch.withColumn("bucket", F.format_string(f"%04d-{buckets}", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")))
    if exists(spark, path):
        touched = batch.select(F.col(by).cast("string"), "bucket").distinct().collect()  # a row for each partition
        there = [t for t in (f"{path.rstrip('/')}/{by}={quote(value)}/bucket={bucket}" for value, bucket in touched) if exists(spark, t)]
        if there:
            old = spark.read.schema(batch.schema).option("basePath", path).parquet(*there).select(*batch.columns)
            batch = merged(old, batch, key)
    aside = f"{path.rstrip('/')}__next/{uuid.uuid4().hex}"
    batch.repartition(by, "bucket").write.partitionBy(by, "bucket").parquet(aside)
    return aside


def upsert(path: str, batch: DataFrame, key: list[str], by: str = "source", buckets: int = BUCKETS) -> None:
    """Merges a batch into the Parquet table at path: all rows of the batch's keys are replaced by the batch's.

    The table is partitioned by `by` and by a hash of the key in `buckets`, which a table keeps from its first batch on.  Only
    the partitions that the batch touches are read and written, once: whole to a folder beside the table, and then moved in, so that the
    table is never read while it is overwritten, and settle() can finish the work after a crash.  One writer at a time.
    """
    settle(batch.sparkSession, path)
    staged(path, batch, key, by, buckets)
    settle(batch.sparkSession, path)


def delete(spark, path: str, value: str | None = None, by: str = "source") -> bool:
    """Deletes the table at path, or its rows of one value of the column that partitions it; says whether there were any."""
    settle(spark, path)
    files, at = _files(spark, path if value is None else f"{path.rstrip('/')}/{by}={quote(value)}")
    return files.delete(at, True) if files.exists(at) else False


def quote(value: str | None) -> str:
    """A partition's value as its folder is named."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{}[]^' or ord(c) < 32 or ord(c) == 127 else c for c in value)
