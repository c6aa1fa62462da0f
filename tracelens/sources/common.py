"""What the source readers share: JSON lines with their place in a file, and the common conversation schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import byte_cut, trim_space

MESSAGE = "struct<role:string,content:string,timestamp:timestamp,model:string,tools:array<struct<name:string,input:string,output:string>>>"
COLUMNS = ["source", "conversation_id", "project", "title", "created_at", "updated_at", "parent_id", "messages"]
TITLE_BYTES = 100


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, v: each line that is JSON, as a VARIANT, with its place in its file; other lines are skipped.

    Large files are read in parts; a place is the part's offset and the row in it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line"), F.col("value").alias("text"))
    return lines.filter(trim_space("text") != "").select("path", "line", F.try_parse_json("text").alias("v")).filter("v IS NOT NULL")


def get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def text_of(v: Column, kinds: list[str] = ["text"]) -> Column:
    """Text of a content that is a string, or of the blocks of the kinds, joined by line feeds."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(kinds)), lambda b: F.try_variant_get(b, "$.text", "string"))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n"))


def title_from(x: Column) -> Column:
    return byte_cut(trim_space(x), TITLE_BYTES)


def gathered(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, messages: a conversation's messages in order."""
    fields = [F.col(c) for c in ("role", "content", "timestamp", "model", "tools")]
    g = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("m")))).alias("l"))
    return g.select(key, F.transform("l", lambda x: x["m"]).alias("messages"))


def merged_roles(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Successive messages of one role as one, contents joined by line feeds, the first one's place and time."""
    w = W.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))
    island = messages.withColumn("island", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = island.groupBy(key, "island", "role").agg(
        F.min(order).alias(order), F.min("timestamp").alias("timestamp"), F.max_by("model", order).alias("model"),
        F.array_sort(F.collect_list(F.struct(order, "content", "tools"))).alias("l"),
    )
    content = F.array_join(F.filter(F.transform("l", lambda x: x["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), "\n")
    return g.select(key, order, "role", content.alias("content"), "timestamp", "model", F.flatten(F.transform("l", lambda x: F.coalesce(x["tools"], F.expr("cast(array() AS array<struct<name:string,input:string,output:string>>)")))).alias("tools"))


NO_TOOLS = "cast(array() AS array<struct<name:string,input:string,output:string>>)"
