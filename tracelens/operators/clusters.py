"""Labels to clusters, noise, samples under a budget, and their numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import budget_prefix, ranked

LEAST_MEMBERS, SAMPLE_TOKENS, NOISE_TOKENS = 3, 10_000, 10_000


def themed(observations: DataFrame, labels: DataFrame, themes: DataFrame | None, key: list[str]) -> DataFrame:
    """Observations with their label, and the theme that it is mapped to, or the label itself; without a label: empty."""
    out = observations.join(labels, key, "left").withColumn("label", F.coalesce("label", F.lit("")))
    if themes is not None:
        out = out.join(themes, "label", "left").withColumn("theme", F.coalesce("theme", "label"))
    else:
        out = out.withColumn("theme", F.col("label"))
    return out


def clustered(rows: DataFrame, least: int = LEAST_MEMBERS, theme: str = "theme") -> DataFrame:
    """Adds `cluster`: the theme if it has `least` members, else null (noise).  Sizes are summed before any shuffle of rows."""
    sizes = rows.filter(F.col(theme) != "").groupBy(theme).agg(F.count("*").alias("members")).filter(F.col("members") >= least)
    return rows.join(sizes, theme, "left").withColumn("cluster", F.when(F.col("members").isNotNull(), F.col(theme)))


def sampled(clustered_rows: DataFrame, key: list[str], tokens: str, seed: int = 42, budget: int = SAMPLE_TOKENS) -> DataFrame:
    """Each cluster's members in the order of a hash of seed and key, within the budget, one at least."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    members = clustered_rows.filter("cluster IS NOT NULL").withColumn("mixed", mixed)
    return budget_prefix(members, ["cluster"], [F.col("mixed"), *[F.col(k) for k in key]], tokens, budget, True, F.left("mixed", F.lit(3)))


def numbered(samples: DataFrame) -> DataFrame:
    """cluster, n, number: clusters by sampled members, most first, ties by name."""
    n = samples.groupBy("cluster").agg(F.count("*").alias("n"))
    return ranked(n, "n", ["cluster"], "number").withColumn("number", F.col("number").cast("int"))


def missing_from(outline: DataFrame, clusters: int, text: str = "text") -> DataFrame:
    """Adds `missing`: the first i of 1..clusters whose "Cluster i" the text lacks, or null."""
    gone = F.filter(F.sequence(F.lit(1), F.lit(clusters)), lambda i: ~F.contains(F.col(text), F.concat(F.lit("Cluster "), i.cast("string"))))
    return outline.withColumn("missing", F.try_element_at(gone, F.lit(1)))


def vocabulary(labels: DataFrame, label: str = "label") -> DataFrame:
    """label: each label that is not empty, once."""
    return labels.filter(F.coalesce(F.col(label), F.lit("")) != "").select(F.col(label).alias("label")).distinct()


def label_prompt(system: str, words: DataFrame) -> DataFrame:
    """One row, `system`: the prompt, and the labels in use, if there are any, in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: F.concat(F.lit("- "), x)), "\n")
    return words.agg(F.concat(F.lit(system), F.when(F.count("*") > 0, F.concat(F.lit("\n\nLabels in use:\n"), listed)).otherwise("")).alias("system"))


def summary_inputs(samples: DataFrame) -> DataFrame:
    """cluster, input: what the model reads of each cluster's sample, in the sample's order."""
    own = samples.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("mixed", "text"))).alias("s"))
    told = F.array_join(F.transform("s", lambda x: F.concat(F.lit("---\n"), x["text"])), "\n")
    return own.select("cluster", F.concat(F.lit("Cluster theme: "), "cluster", F.lit("\n\nObservations:\n"), told).alias("input"))
