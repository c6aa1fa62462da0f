"""Blind evaluation: assignment, means, transfer, preferences, order; usage and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranked

#: USD per million tokens, input and output, by model family.
PRICES = [
    ("claude-sonnet-4", 3.0, 15.0), ("claude-opus-4", 5.0, 25.0), ("gpt-4.1", 2.0, 8.0), ("gpt-4.1-mini", 0.4, 1.6), ("gpt-4.1-nano", 0.1, 0.4),
    ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("o3", 2.0, 8.0), ("o4-mini", 1.1, 4.4),
]


def blinded(cases: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds `ours_is_a` by a hash of the key, so that reruns agree."""
    return cases.withColumn("ours_is_a", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 1).isin(list("01234567")))


def dimension_means(scores: DataFrame) -> DataFrame:
    """dimension, base, ours, delta, n of scores(base map, ours map) over the dimensions that both have."""
    long = scores.select(F.explode("base").alias("dimension", "b"), "ours").withColumn("o", F.try_element_at("ours", "dimension")).filter("o IS NOT NULL")
    out = long.groupBy("dimension").agg(F.avg("b").alias("base"), F.avg("o").alias("ours"), F.count("*").alias("n"))
    return out.select("dimension", "base", "ours", (F.col("ours") - F.col("base")).alias("delta"), "n")


def transfer(scores: DataFrame, question: str, group: str) -> DataFrame:
    """group, delta, n: the mean of questions' mean deltas."""
    long = scores.select(question, group, F.explode("base").alias("dimension", "b"), "ours").withColumn("o", F.try_element_at("ours", "dimension")).filter("o IS NOT NULL")
    each = long.groupBy(question, group).agg(F.avg(F.col("o") - F.col("b")).alias("d"))
    return each.groupBy(group).agg(F.avg("d").alias("delta"), F.count("*").alias("n"))


def preferences(results: DataFrame) -> DataFrame:
    """n_ours, n_base, n_neither over results(preferred, ours_is_a) without an error."""
    ours = ((F.col("preferred") == "A") & F.col("ours_is_a")) | ((F.col("preferred") == "B") & ~F.col("ours_is_a"))
    return results.agg(F.count_if(ours).alias("n_ours"), F.count_if(~ours & F.col("preferred").isin("A", "B")).alias("n_base"), F.count_if(F.col("preferred") == "neither").alias("n_neither"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """stage (null: all), input_tokens, output_tokens, cost of usage rows, in one pass."""
    return usage.rollup("stage").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def priced(models: DataFrame, model: str = "model") -> DataFrame:
    """Adds input_price and output_price (a million tokens): of the longest family name in the model's, else 0."""
    found = F.filter(F.lit([p[0] for p in PRICES]), lambda k: F.contains(F.col(model), k))
    best = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    out = models.withColumn("__k", best)
    for name, i in (("input_price", 1), ("output_price", 2)):
        price = F.lit(0.0)
        for p in PRICES:
            price = F.when(F.col("__k") == p[0], F.lit(p[i])).otherwise(price)
        out = out.withColumn(name, price)
    return out.drop("__k")


def summary_order(results: DataFrame, key: str) -> DataFrame:
    """key, outcome (0: ours, 1: neither, 2: the baseline), place: results(key, preferred, ours_is_a) by outcome, then key."""
    outcome = F.when(F.col("preferred") == "neither", 1).when((F.col("preferred") == "A") == F.col("ours_is_a"), 0).otherwise(2)
    own = results.select(key, outcome.alias("outcome"), (-outcome).alias("__up"))
    return ranked(own, "__up", [key], "place").select(key, "outcome", F.col("place").cast("int").alias("place"))


#: The dimensions that are scored, in the order they are shown.
DIMENSIONS = ["reasoning", "voice", "awareness"]


def summary_grid(results: DataFrame, key: str = "id") -> DataFrame:
    """place, id, mark, scores, verdict of results(id, base, ours, preferred, ours_is_a, error): ours first, then neither, base and errors, each by id.

    scores has base>ours for each of DIMENSIONS, 0 where one is missing; rows with an error have none.
    """
    bad = F.col("error").isNotNull()
    ours = (F.col("preferred") == "A") == F.col("ours_is_a")
    outcome = F.when(bad, 3).when(F.coalesce("preferred", F.lit("neither")) == "neither", 1).when(ours, 0).otherwise(2)
    value = lambda side, d: F.coalesce(F.try_element_at(F.col(side), F.lit(d)), F.lit(0)).cast("string")
    scores = F.concat_ws("  ", *[F.concat(value("base", d), F.lit(">"), value("ours", d)) for d in DIMENSIONS])
    told = results.select(F.col(key).cast("string").alias("id"), outcome.alias("outcome"), F.when(bad, "").otherwise(scores).alias("scores"), (-outcome).alias("__up"))
    name = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("outcome") + 1)
    return ranked(told, "__up", ["id"], "place").select(F.col("place").cast("int").alias("place"), "id", name("+~-!").alias("mark"), "scores", name(["ours", "neither", "base", "error"]).alias("verdict"))
