"""Conversations as they arrive: a file stream whose batches are merged into the table of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import changed_since, first_of, upsert


def ingest(spark: SparkSession, folder: str, schema: str, path: str, checkpoint: str, key: list[str] = ["source", "conversation_id"]):
    """Starts a query that reads new Parquet files of the folder and merges each batch by key, the newest updated_at of a key; available files, then it ends."""

    def merge(batch: DataFrame, _: int) -> None:
        newest = first_of(batch, key, [F.desc("updated_at")])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.parquet(path).select(*key, F.col("updated_at").alias("last_modified"))
            newest = changed_since(newest, old, key).filter("status <> 'same'").drop("status")
        if not newest.isEmpty():
            upsert(path, newest, key)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
