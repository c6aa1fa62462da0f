"""Views of the test tables that the operators read: sources, times, stored copies and a model's answers, made by rule.

Each is told twice, as a DataFrame here and as SQL in VIEWS; the SQL of a query starts with the views it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.turns import is_human_source, turn_pairs

SOURCES = ["claude-code", "opencode", "codex", "kiro", "slack", "github-prs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(conv: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (conv % len(SOURCES) + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("source", source_of(F.col("conv_id")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: source, conv_id, last_modified (hours), size_bytes."""
    return messages(spark, sf_dir).groupBy("source", "conv_id").agg(F.sum(F.octet_length("text")).cast("long").alias("size_bytes")).withColumn("last_modified", F.col("conv_id").cast("long"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation has been computed; every ninth under an old state."""
    stale = F.when(F.col("conv_id") % 9 == 0, F.col("last_modified") - 1).otherwise(F.col("last_modified"))
    return entries(spark, sf_dir).filter("conv_id % 3 = 0").select("source", "conv_id", stale.alias("last_modified"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(messages(spark, sf_dir), ["source", "conv_id"], is_human_source("source"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, conv_id, idx, text, label: one observation an owner message, labelled by a hash."""
    t = turns(spark, sf_dir)
    text = F.regexp_replace(F.left("human", F.lit(80)), "\n", " ")
    number = F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % 97
    return t.select("source", "conv_id", F.col("turn").alias("idx"), text.alias("text"), F.concat(F.lit("pattern "), number.cast("string")).alias("label"), number.alias("number"))


def theme_of() -> Column:
    return F.when(F.col("number") < 60, F.concat(F.lit("theme "), (F.col("number") % 15).cast("string")))




def fenced() -> Column:
    t = F.col("text")
    return F.when(F.col("turn") % 5 == 0, F.concat(F.lit("```py\n"), t, F.lit("\n```\nafter"))).when(F.col("turn") % 5 == 1, F.concat(t, F.lit("\n```open"))).otherwise(t)


_SOURCE = "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES)) + " END"
VIEWS = f"""
WITH msg AS (SELECT *, {_SOURCE} AS source FROM conversations),
entries AS (SELECT source, conv_id, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, CAST(conv_id AS BIGINT) AS last_modified FROM msg GROUP BY source, conv_id),
stored AS (SELECT source, conv_id, CASE WHEN conv_id % 9 = 0 THEN last_modified - 1 ELSE last_modified END AS last_modified FROM entries WHERE conv_id % 3 = 0),
spoken AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS owners
    FROM msg WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
replies AS (SELECT conv_id, seg, arg_max(text, turn) AS assistant FROM spoken WHERE role = 'assistant' GROUP BY conv_id, seg),
turns AS (SELECT s.source, s.conv_id, s.turn, coalesce(r.assistant, '') AS assistant, s.text AS human
    FROM spoken s LEFT JOIN replies r ON s.conv_id = r.conv_id AND s.seg = r.seg
    WHERE s.role = 'user' AND s.owners >= CASE WHEN s.source IN ('slack', 'github-prs') THEN 1 ELSE 2 END),
obs0 AS (SELECT source, conv_id, turn AS idx, replace(left(human, 80), chr(10), ' ') AS text FROM turns),
obs AS (SELECT *, CAST('0x' || substr(md5(text), 1, 4) AS INT) % 97 AS number, 'pattern ' || (CAST('0x' || substr(md5(text), 1, 4) AS INT) % 97) AS label FROM obs0),
themed AS (SELECT *, CASE WHEN number < 60 THEN 'theme ' || (number % 15) ELSE label END AS theme FROM obs),
sizes AS (SELECT theme, count(*) AS members FROM themed GROUP BY theme HAVING count(*) >= 3),
clustered AS (SELECT t.*, s.theme AS cluster FROM themed t LEFT JOIN sizes s ON t.theme = s.theme)
"""
