"""Mixing sources to target weights by Pareto order sampling.

A source's target says how many words the mix takes of it.  A document is due by the weight of its size class, in
proportion within the source: the water level at which all of the source's documents, none more than `most` times, make
up the target.  The whole part of what a document is due is allocated as certain copies.  The rest, p, differs from
document to document: every document draws U from a hash of its id and the seed and is ranked by random odds over
inclusion odds, U / (1 - U) / (p / (1 - p)); the first in that order are taken until their words are the
source's rest, a size that is fixed, the last one if that is nearer.  The cut is found from sums over bins of the
ranks; only the bin in which it falls is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

SHARE, MOST, WEIGHTS, BINS, SEED = 1.5, 2.0, (3.0, 1.0, 2.0), 4096, 7


def words_in(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Binary digits of a size: 1 for 0 and 1, 2 for 2 and 3, and so on."""
    return F.length(F.bin(size))


def class_weight(size_class: Column) -> Column:
    """A text of a word weighs 1, one of a thousand words 2: fragments are repeated less."""
    return (size_class + 8) / F.lit(9.0)


def name_of(doc_id: Column, text: Column) -> Column:
    """What a document's draw is made from: its id, or without one its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text.cast("string"), F.lit(""))))


def draw(name: Column, seed: int) -> Column:
    """A number between 0 and 1 (neither of them) from 52 bits of a digest that SQL has too."""
    digest = F.md5(F.concat(name, F.lit(f"-{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target for each row of sizes(source, source_size): one row a source.

    `share` times all sizes is dealt by weight; no target passes `most` times its source's size, and what
    is over goes to the others by weight until none is above.  That is one water level: sources ordered by
    the level at which they are full, and the first one that the level of the rest does not fill sets it.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    up, down = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1), W.orderBy(*by).rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down)
    open_ = ranked.withColumn("level", level)
    found = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    return open_.withColumn("found", found).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("found") * F.col("w")), F.col("cap")).alias("target")
    )


def dues(sizes: DataFrame, plan: DataFrame, most: float = MOST) -> DataFrame:
    """s, class_size, source_size, target, certain, p, rest for each source and size class.

    sizes(source, class, class_size) and plan(source, source_size, target): within a source the same water level as
    between sources, over its classes (64 at most).  rest: words of the source beyond its certain copies.
    """
    w = class_weight(F.col("class"))
    rows = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("w", w)
    order = W.partitionBy("s").orderBy(F.desc("class"))
    whole, up, down = W.partitionBy("s"), order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    full = F.lit(float(most)) * F.coalesce(F.sum("class_size").over(up), F.lit(0))
    open_ = F.sum(F.col("w") * F.col("class_size")).over(down)
    rows = rows.withColumn("level", F.when(open_ > 0, (F.col("target") - full) / open_))
    level = F.max(F.when(F.col("level") * F.col("w") <= float(most), F.col("level"))).over(whole)
    due = F.when(F.col("source_size") > 0, F.coalesce(F.least(F.lit(float(most)), F.col("found") * F.col("w")), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("found", level).withColumn("due", due).withColumn("certain", F.floor("due")).withColumn("p", F.col("due") - F.col("certain"))
    rest = F.col("target") - F.sum(F.col("certain") * F.col("class_size")).over(whole)
    return rows.withColumn("rest", rest).select("s", F.col("class").alias("c"), "source_size", "target", "certain", "p", "rest")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs(doc_id, text, source).

    Null texts have size 0; a null source is a source, the last; a row of size 0 is taken 0 times unless
    its copies are certain.  Rows with equal ids share one draw and are ordered by size, rows without an id draw by their
    text.  Reruns agree.  An empty table gives an empty result.
    """
    return _mix(docs, [], name_of(F.col("doc_id"), F.col("text")), share, most, weights, seed)


def _mix(docs: DataFrame, key: list[str], drawn: Column, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """mix() with the columns `key`, which also order equal rows, and draws by `drawn`."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), draw(drawn, seed).alias("u"), *key)
    base = C.saved(base.withColumn("class", size_class(F.col("size"))), "sizes")
    sizes = C.saved(base.groupBy("source", "class").agg(F.sum("size").alias("class_size")), "classes")
    wanted = targets(sizes.groupBy("source").agg(F.sum("class_size").alias("source_size")), share, most, weights)
    plan = C.saved(dues(sizes, wanted, most), "plan")
    odds = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p")))
    ranked = base.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c").withColumn("rank", odds)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))
    bins = ranked.filter("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("before", before).filter("before < rest").groupBy("source").agg(F.max(F.struct("bin", "before")).alias("c"))
    cut = C.saved(cut.select(F.col("source").alias("s"), F.col("c.bin").alias("last"), "c.before"), "cut")
    placed = ranked.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "size", *key).rowsBetween(W.unboundedPreceding, 0))
    at = placed.filter("bin = last").withColumn("more", (inside - F.col("size") / 2 <= F.col("rest")).cast("long"))
    rest = placed.filter("NOT (bin <=> last) OR bin IS NULL").withColumn("more", F.coalesce((F.col("bin") < F.col("last")).cast("long"), F.lit(0)))
    copies = (F.col("certain") + F.col("more")).cast("long")
    return at.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *key)


#: mix() of `documents` with the parameters above, in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, '')) || '-{SEED}'), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE) AS u FROM documents),
e AS (SELECT *, length(bin(size)) AS class FROM d),
k AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS class_size FROM e GROUP BY ALL),
s AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST({list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w, CAST({MOST} AS DOUBLE) * source_size AS cap FROM s),
l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, m * w), cap) AS target FROM (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS m FROM l)),
c AS (SELECT k.class, k.class_size, t.*, (k.class + 8) / CAST(9 AS DOUBLE) AS w FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CAST({MOST} AS DOUBLE) * coalesce(sum(class_size) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w * class_size) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c),
g AS (SELECT *, CASE WHEN open > 0 THEN (target - filled) / open END AS level FROM f),
h AS (SELECT *, max(CASE WHEN level * w <= CAST({MOST} AS DOUBLE) THEN level END) OVER (PARTITION BY source) AS found FROM g),
i AS (SELECT *, CASE WHEN source_size > 0 THEN coalesce(least(CAST({MOST} AS DOUBLE), found * w), CAST({MOST} AS DOUBLE)) ELSE 0 END AS due FROM h),
p AS (SELECT source, class, source_size, target, floor(due) AS certain, due - floor(due) AS p, target - sum(floor(due) * class_size) OVER (PARTITION BY source) AS rest FROM i),
r AS (SELECT e.*, p.* EXCLUDE (source, class), CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END AS rank FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.class = p.class),
x AS (SELECT *, certain + CASE WHEN p > 0 AND sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM x
"""


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.  Rows are told apart by a written number; those without an id have draws of their own."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = C.saved(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    own = rows.select("row.doc_id", "row.text", "row.source", "at")
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("at").cast("string")))
    chosen = _mix(own, ["at"], drawn, **parameters).filter("copies > 0").select(F.col("at").alias("taken_at"), F.col("copies").alias("times"))
    return rows.join(chosen, F.col("at") == F.col("taken_at")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
