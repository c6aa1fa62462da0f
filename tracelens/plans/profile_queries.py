"""The pipelines end to end with the stand-in model."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .profile import Profile, fresh_folder
from .registry import query


def _messages(spark, sf_dir):
    return X.messages(spark, sf_dir).withColumn("last_modified", F.col("conv_id"))


#: What the stand-in makes of the conversations, told in SQL: the document's pieces by its rules, joined as the prompts are.
_SAME = "SELECT 1::BIGINT AS ts, md5(doc) AS digest, CAST(length(doc) AS INTEGER) AS n_chars FROM"
_MAP_REDUCE = f"""{X.VIEWS}
{_SAME} (SELECT trim('# Profile' || chr(10) || string_agg('Observation: ' || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY source, conv_id, idx)) AS doc FROM obs WHERE trim(text) <> '')"""
_CLUSTERED = f"""{X.VIEWS},
e AS (SELECT source, conv_id, row_number() OVER (PARTITION BY source, conv_id ORDER BY idx) - 1 AS idx, trim(text) AS text, strlen(trim(text)) * 2 // 9 AS tok FROM obs WHERE strlen(trim(text)) >= 20),
l AS (SELECT *, 'pattern ' || CAST('0x' || substr(md5(text), 1, 4) AS INT) % 97 AS tag FROM e),
t AS (SELECT *, CASE WHEN (SELECT count(DISTINCT tag) FROM l) > 50 THEN 'theme ' || CAST('0x' || substr(md5(tag), 1, 4) AS INT) % 20 ELSE tag END AS topic FROM l),
c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY topic) >= 3 THEN topic END AS grp, md5('42:' || source || ':' || conv_id || ':' || idx) AS mx FROM t),
r AS (SELECT *, sum(tok) OVER w AS total, row_number() OVER w AS rn FROM c WHERE grp IS NOT NULL WINDOW w AS (PARTITION BY grp ORDER BY mx, source, conv_id, idx ROWS UNBOUNDED PRECEDING)),
n AS (SELECT grp, count(*) AS n FROM r WHERE total <= 10000 OR rn = 1 GROUP BY grp),
o AS (SELECT n, row_number() OVER (ORDER BY n DESC, grp) AS number FROM n),
outline AS (SELECT string_agg('Cluster ' || number, chr(10) ORDER BY number) AS thesis, string_agg('### Cluster ' || number || chr(10) || (2 * n + 3) || ' lines', chr(10) || chr(10) ORDER BY number) AS input FROM o),
q AS (SELECT *, sum(tok) OVER (ORDER BY source, conv_id, idx ROWS UNBOUNDED PRECEDING) AS total FROM c WHERE grp IS NULL),
noise AS (SELECT coalesce(string_agg(text, chr(10) ORDER BY source, conv_id, idx), '') AS noise FROM q WHERE total <= 10000)
{_SAME} (SELECT rtrim('# Profile' || chr(10) || thesis || chr(10) || chr(10) || input || chr(10) || chr(10) || noise, ' ' || chr(10)) AS doc FROM outline, noise)"""


@query(_MAP_REDUCE)
def pipeline_map_reduce(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    p.map_reduce(_messages(spark, sf_dir), 1)
    return p.versions().select("ts", F.md5("content").alias("digest"), F.length("content").alias("n_chars"))


@query(_CLUSTERED)
def pipeline_clustered(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    p.clustered(_messages(spark, sf_dir), 1)
    return p.versions().select("ts", F.md5("content").alias("digest"), F.length("content").alias("n_chars"))


@query(X.VIEWS + "SELECT source, count(DISTINCT conv_id) AS conversations, count(*) AS observations FROM obs WHERE strlen(text) >= 20 GROUP BY source")
def pipeline_observations(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    p.observe(_messages(spark, sf_dir))
    return p.entries().groupBy("source").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("observations"))


@query("SELECT 0::BIGINT AS calls")
def pipeline_second_run_is_noop(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    p.observe(_messages(spark, sf_dir))
    p.usage.clear()
    p.observe(_messages(spark, sf_dir))
    return spark.range(1).select(F.lit(sum(u[1] for u in p.usage)).cast("long").alias("calls"))


@query(f"""{X.VIEWS}, n AS (SELECT count(DISTINCT conv_id) AS n FROM turns)
SELECT 0 AS seq, 'observe' AS stage, n AS requests, 0::BIGINT AS failed, 100 * n AS input_tokens, 50 * n AS output_tokens FROM n
UNION ALL SELECT 1, 'refine', n, 0, 100 * n, 50 * n FROM n UNION ALL SELECT 2, 'compose', 1, 0, 100, 50""")
def run_metrics(spark, sf_dir):
    """What was observed of each stage while a run wrote its answers."""
    p = Profile(spark, fresh_folder(spark))
    p.map_reduce(_messages(spark, sf_dir), 1)
    return p.run_metrics().select("seq", "stage", "requests", "failed", "input_tokens", "output_tokens")


_FOLDED = f"""{X.VIEWS}, e AS (SELECT source, conv_id, row_number() OVER (PARTITION BY source, conv_id ORDER BY idx) - 1 AS idx, trim(text) AS text FROM obs WHERE strlen(trim(text)) >= 20),
o AS (SELECT *, row_number() OVER (ORDER BY conv_id DESC, source DESC, idx DESC) AS back FROM e)
{_SAME.replace('1::BIGINT', '2::BIGINT')} (SELECT string_agg(text, chr(10) ORDER BY back DESC) AS doc FROM o WHERE back <= 40)"""


@query(_FOLDED)
def pipeline_incremental(spark, sf_dir):
    """Two runs, the second with conversations that came later; the stand-in keeps the last forty lines of what was folded."""
    p = Profile(spark, fresh_folder(spark))
    m = _messages(spark, sf_dir)
    half = m.agg(F.percentile_approx("conv_id", 0.5)).first()[0]
    p.incremental(m.filter(F.col("conv_id") <= half), 1)
    p.incremental(m, 2)
    return p.versions().filter("ts = 2").select("ts", F.md5("content").alias("digest"), F.length("content").alias("n_chars"))
