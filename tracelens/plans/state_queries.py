"""Sources, searches, syncs, deletions, versions and sessions over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model.client import StubClient
from ..operators import clusters as C
from ..operators import incremental as I
from ..operators import sessions as S
from . import fixtures as X
from .profile import Profile, fresh_folder
from .questions import universal
from .registry import query


@query(X.VIEWS + ", r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(o).lower()}, {i}::INTEGER)" for i, (n, o) in enumerate(S.BUILTIN)) + ") AS v(source, opt_in, place)) SELECT source, opt_in, place, count(conv_id) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes FROM r LEFT JOIN entries USING (source) GROUP BY ALL")
def source_registry(spark, sf_dir):
    """The built-in sources with what is stored of each."""
    stored = X.entries(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("n_bytes"))
    return S.registry(spark).join(stored, "source", "left").fillna(0, ["n", "n_bytes"])


@query(X.VIEWS + "SELECT * FROM entries WHERE source IN ('codex', 'slack')")
def entries_of_sources(spark, sf_dir):
    return S.of_sources(X.entries(spark, sf_dir), ["slack", "codex", "none of them"])


@query(X.VIEWS + "SELECT DISTINCT 'mine-' || conv_id % 4 AS source FROM entries WHERE source = 'kiro'")
def imported_sources(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    return S.imported(e.withColumn("source", F.when(F.col("source") == "kiro", F.concat(F.lit("mine-"), (F.col("conv_id") % 4).cast("string"))).otherwise(F.col("source"))))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT date_trunc('year', month)::DATE AS y, sum(n) AS total FROM c GROUP BY 1),
t AS (SELECT CASE WHEN total > 2200 THEN month ELSE y END AS first, CASE WHEN total > 2200 THEN month ELSE (y + INTERVAL 11 MONTH)::DATE END AS last, n FROM c JOIN y ON date_trunc('year', month) = y)
SELECT first, last, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY first, last""")
def search_segments(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return I.search_segments(o.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n")), 2200)


@query(X.VIEWS + "SELECT e.* FROM entries e LEFT JOIN stored s USING (source, conv_id) WHERE s.conv_id IS NULL OR s.last_modified < e.last_modified")
def unfetched_threads(spark, sf_dir):
    return I.unfetched(X.entries(spark, sf_dir), X.stored(spark, sf_dir), ["source", "conv_id"], "last_modified")


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS identity, c_custkey * 10 AS last_sync, c_custkey % 2 = 0 AS complete FROM customer)
SELECT c_custkey, CASE WHEN identity <> 'b' THEN last_sync END AS since, identity = 'b' AS void, CASE WHEN complete THEN c_custkey * 10 + 5 WHEN identity <> 'b' THEN last_sync END AS "then" FROM s""")
def sync_states(spark, sf_dir):
    k = F.col("c_custkey")
    identity = F.when(k % 3 == 0, "").when(k % 3 == 1, "a").otherwise("b")
    s = X.table(spark, sf_dir, "customer").select("c_custkey", identity.alias("identity"), (k * 10).alias("last_sync"), F.lit("a").alias("user"), (k * 10 + 5).alias("started"), (k % 2 == 0).alias("complete"))
    return I.next_sync(s).select("c_custkey", "since", "void", "then")


@query(X.VIEWS + "SELECT source, count(*) AS n FROM entries WHERE source <> 'slack' GROUP BY source")
def deleted_source(spark, sf_dir):
    path = f"{fresh_folder(spark)}/entries"
    I.upsert(path, X.entries(spark, sf_dir), ["source", "conv_id"])
    I.delete(spark, path, "slack")
    return I.per_source(spark.read.parquet(path), "n")


@query(X.VIEWS + ", v AS (SELECT source, conv_id, size_bytes + CASE WHEN source = 'codex' THEN 1 ELSE 0 END AS size_bytes FROM entries) SELECT source, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM v GROUP BY source")
def settled_upsert(spark, sf_dir):
    """A batch that was written whole beside the table before a crash is merged when the table is next written; part of one is not."""
    path = f"{fresh_folder(spark)}/entries"
    e = X.entries(spark, sf_dir).select("source", "conv_id", "size_bytes")
    I.upsert(path, e, ["source", "conv_id"])
    more = e.withColumn("size_bytes", F.col("size_bytes") + 1)
    I.staged(path, more.filter("source = 'codex'"), ["source", "conv_id"])
    I.forget(spark, f"{I.staged(path, more.filter("source = 'kiro'"), ['source', 'conv_id'])}/_SUCCESS")
    I.settle(spark, path)
    return spark.read.parquet(path).groupBy("source").agg(F.sum("size_bytes").alias("n_bytes"))


@query(X.VIEWS + ", l AS (SELECT DISTINCT label FROM obs) SELECT 'Label.' || chr(10) || chr(10) || 'Labels in use:' || chr(10) || string_agg('- ' || label, chr(10) ORDER BY label) AS system FROM l")
def label_prompt(spark, sf_dir):
    return C.label_prompt("Label.", C.vocabulary(X.observations(spark, sf_dir)))


@query("""WITH v AS (SELECT turn AS ts, string_agg(role, chr(10) ORDER BY conv_id) AS content, count(*) AS n FROM conversations GROUP BY turn)
SELECT ts, CASE WHEN ts = (SELECT min(ts) FROM v) THEN 'Initial version.' ELSE n || ' lines' END AS diff FROM v""")
def version_diffs(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    m = X.table(spark, sf_dir, "conversations")
    rows = m.groupBy(F.col("turn").alias("ts")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "role"))), lambda x: x["role"]), "\n").alias("content"))
    I.upsert(f"{p.folder}/versions", rows.select(F.lit("document").alias("source"), "ts", "content", F.lit(None).cast("string").alias("diff")), ["source", "ts"])
    for ts in sorted(r["ts"] for r in p.versions().select("ts").collect()):  # a row a version
        p.diff(ts)
    return p.versions().select("ts", "diff")


@query(X.VIEWS + ", v AS (SELECT * FROM (VALUES ('architecture', 4), ('tradeoff', 4), ('scoping', 4), ('meta', 4), ('failure', 3), ('people', 3)) AS v(category, n)), d AS (SELECT source, string_agg(text, chr(10) ORDER BY conv_id, idx) AS doc FROM obs GROUP BY source) SELECT source, category, n::BIGINT AS n, CAST(n * strlen(doc) AS BIGINT) AS n_bytes FROM v, d")
def universal_questions(spark, sf_dir):
    """The built-in questions, asked of a document of each source: calls and bytes of documents that they send."""
    lines = F.array_sort(F.collect_list(F.struct("conv_id", "idx", "text")))
    documents = X.observations(spark, sf_dir).groupBy("source").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("document"))
    asked = universal(spark).join(documents)  # every question of every document is a call
    return asked.groupBy("source", "category").agg(F.count("*").alias("n"), F.sum(F.octet_length("document")).cast("long").alias("n_bytes"))


@query("SELECT 'q' || i AS id, 'domain' AS category FROM (SELECT unnest(range(1, CAST(least(10, count(*)) AS BIGINT) + 1)) AS i FROM conversations)")
def domain_questions(spark, sf_dir):
    p = Profile(spark, fresh_folder(spark))
    document = "\n".join("line" for _ in range(min(10, X.table(spark, sf_dir, "conversations").count())))
    p.questions(document)
    calls = len(p.usage)
    again = p.questions(document)
    assert len(p.usage) == calls, "asked twice for one document"
    return again.select("id", "category")


@query("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, 2 * n AS seq, 'user' AS role, strlen(text) AS n_bytes FROM u UNION ALL SELECT conv_id, 2 * n + 1, 'assistant', strlen('1 lines') FROM u),
last AS (SELECT max(conv_id) AS conv_id FROM u)
SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n_turns, max(seq) AS last_seq, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, conv_id = (SELECT conv_id FROM last) AS latest FROM t GROUP BY conv_id""")
def session_turns(spark, sf_dir):
    """The owners' messages as questions of sessions, a session a conversation, with answers of one line; the latest goes on when it is resumed, and a new one is left out."""
    u = X.table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("n", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long"))
    asked = u.select(F.col("conv_id").cast("string").alias("id"), (2 * F.col("n")).alias("seq"), F.lit("user").alias("role"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("at"))
    told = asked.select("id", (F.col("seq") + 1).alias("seq"), F.lit("assistant").alias("role"), F.lit("1 lines").alias("content"), "at")
    folder = f"{fresh_folder(spark)}/sessions"
    asked.unionByName(told).write.parquet(folder)
    s = S.Sessions(spark, folder, StubClient(), iter(range(10**15, 10**15 + 9)).__next__)
    latest = s.latest()
    new, _ = s.ask("Anything else?", "document")
    assert new != latest and s.latest() in (latest, new)
    rows = s.rows().filter(F.col("id") != new)
    return rows.groupBy("id").agg(F.count("*").alias("n_turns"), F.max("seq").alias("last_seq"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes")).withColumn("latest", F.col("id") == latest)
