"""Questions for the evaluation: built-in ones, a folder of texts, and (Profile.questions) those that a model makes of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category, and what to ask.
UNIVERSAL = [
    ("architecture", "A service has grown to the point where every change touches five modules. Where do you start?"),
    ("architecture", "Two teams want to share a table. What would you agree on before the first row is written?"),
    ("architecture", "When is a queue between two components worth its cost?"),
    ("architecture", "How do you decide what a library should leave out?"),
    ("tradeoff", "A simple design misses one rare case that a complex one covers. Which do you take, and why?"),
    ("tradeoff", "You can ship today with a manual step, or next month without. What do you weigh?"),
    ("tradeoff", "When would you choose consistency over speed, and when not?"),
    ("tradeoff", "Is duplicated code ever the better choice?"),
    ("scoping", "A request is three sentences long and means three things. What do you do first?"),
    ("scoping", "Half the time is gone and a third of the work is done. What changes?"),
    ("scoping", "How do you tell a requirement from a preference?"),
    ("scoping", "What would you cut from a project that everyone likes?"),
    ("meta", "How do you notice that you are solving the wrong problem?"),
    ("meta", "What makes an explanation a good one for you?"),
    ("meta", "Which of your own habits do you distrust?"),
    ("meta", "How do you find out that you have changed your mind?"),
    ("failure", "A release broke something that no test covers. What do you do that day, and that month?"),
    ("failure", "An incident has no clear cause. When do you stop looking?"),
    ("failure", "What did a failure teach you that a success could not?"),
    ("people", "A colleague's review is right in substance and harsh in tone. How do you answer?"),
    ("people", "How do you disagree with someone who knows more than you?"),
    ("people", "What do you ask for when you hand work over?"),
]


def universal(spark: SparkSession) -> DataFrame:
    """id, category, prompt of the built-in questions."""
    return spark.createDataFrame([(f"u{i + 1}", c, p) for i, (c, p) in enumerate(UNIVERSAL)], "id string, category string, prompt string")


def custom(spark: SparkSession, folder: str) -> DataFrame:
    """id, category, prompt: a question of each text (*.md) directly in the folder, by the file's name."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    return rows.select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1)).alias("id"), F.lit("custom").alias("category"), F.col("value").alias("prompt"))
