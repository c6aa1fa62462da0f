"""Ranks and budgets along an order, without one task that sees all rows.

Rows are dealt in ranges of the order's first key.  Only the ranges' totals, RANGES at most for a group, meet in
one place; what is ordered row by row is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGES = 256


def range_bounds(rows: DataFrame, key: str, parts: int = RANGES) -> list:
    """At most parts - 1 distinct values of a numeric key that cut rows in ranges of about equal numbers; one pass over rows."""
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the key, by nested comparisons; null keys: 0."""
    if not bounds:
        return F.lit(0)

    def within(lo: int, hi: int) -> Column:  # the answer is in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(bounds[mid]), within(mid + 1, hi)).otherwise(within(lo, mid))

    return F.when(key.isNull(), F.lit(0)).otherwise(within(0, len(bounds)))


def ranked(rows: DataFrame, key: str, ties: list[str], out: str) -> DataFrame:
    """Adds `out`, the rank from 1 by the numeric key, largest first (nulls last), then ties.  rows is read three times."""
    bounds = range_bounds(rows, key)
    ranged = rows.withColumn("__range", range_of(F.col(key), bounds))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    above = W.orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)  # one row a range
    before = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(F.desc_nulls_last(key), *ties))
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return placed.withColumn(out, (F.col("__inside") + F.col("__before")).cast("long")).drop("__range", "__r", "__before", "__inside")


def budget_prefix(rows: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int, at_least_one: bool, coarse: Column | None = None) -> DataFrame:
    """Rows of each group in order until their tokens would pass the budget; the first even so, if at_least_one.

    coarse never falls along the order and has few values: ranges of it that begin above the budget are left out by
    their totals, so a group with most of the rows is not ordered in one task.
    """
    kept = rows.withColumn("__coarse", coarse if coarse is not None else F.lit(0)).withColumn("__by", F.struct(*by) if by else F.struct(F.lit(0)))
    totals = kept.groupBy("__by", "__coarse").agg(F.sum(tokens).alias("__tokens"))
    before = F.coalesce(F.sum("__tokens").over(W.partitionBy("__by").orderBy("__coarse").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = totals.withColumn("__before", before).filter(F.col("__before") <= budget).select(F.col("__by").alias("__b"), F.col("__coarse").alias("__c"))
    near = kept.join(open_, F.col("__by").eqNullSafe(F.col("__b")) & F.col("__coarse").eqNullSafe(F.col("__c")), "left_semi")
    w = W.partitionBy("__by").orderBy(*order)
    fits = F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)) <= budget
    fits = fits | (F.row_number().over(w) == 1) if at_least_one else fits
    return near.withColumn("__fits", fits).filter("__fits").drop("__fits", "__by", "__coarse")
