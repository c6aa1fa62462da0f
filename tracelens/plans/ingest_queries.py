"""Uploads from sources and chunks of one large channel, over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import redact as R
from ..operators import turns as U
from ..operators.evaluate import DIMENSIONS, summary_grid
from ..operators.incremental import table_rows
from ..sources import network as N
from ..sources import providers as P
from ..sources.common import COLUMNS, NO_TOOLS
from . import fixtures as X
from .flow_queries import _fill_sql
from .profile import fresh_folder
from .registry import query

NAMES = ["claude-code", "codex", "opencode", "slack"]


def sessions(spark: SparkSession, sf_dir: str, name: str, moved: bool) -> DataFrame:
    """Every fourth conversation as a source's reader gives it; moved: every ninth was updated, its texts end in a mark."""
    m = X.table(spark, sf_dir, "conversations").filter(F.col("conv_id") % len(NAMES) == NAMES.index(name))
    new = F.lit(moved) & (F.col("conv_id") % 9 == 0)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") + F.when(new, 60).otherwise(0))
    text = F.when(new, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    message = F.struct("role", text.alias("content"), at.alias("timestamp"), F.lit(None).cast("string").alias("model"), F.expr(NO_TOOLS).alias("tools"))
    g = m.withColumn("at", at).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"), F.first("at").alias("at"))
    none = F.lit(None).cast("string")
    g = g.withColumns({"source": F.lit(name), "conversation_id": F.concat(F.lit(f"{name}|"), F.col("conv_id").cast("string")), "project": none, "title": none, "parent_id": none, "created_at": F.col("at"), "updated_at": F.col("at"), "messages": F.transform("l", lambda x: x["m"])})
    return g.select(*COLUMNS)


@query("""WITH m AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'slack' END AS source, conv_id % 9 = 0 AS moved FROM conversations),
c AS (SELECT source, conv_id, any_value(moved) AS moved, sum(strlen(text) + CASE WHEN moved THEN 1 ELSE 0 END) AS size, count(*) AS n FROM m GROUP BY source, conv_id),
u AS (SELECT *, moved OR conv_id % 3 <> 0 AS sent FROM c)
SELECT source, count(*) AS discovered, count_if(sent) AS uploaded, count_if(NOT sent) AS skipped, CAST(coalesce(sum(size) FILTER (sent), 0) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS n_messages, CAST(sum(size) AS BIGINT) AS n_bytes,
    0::BIGINT AS uploaded_again, 'bad: ValueError: unreadable' AS warnings FROM u GROUP BY source""")
def source_upload(spark, sf_dir):
    """Four sources are read side by side, a fifth can't be; a third of what they have is stored, some of it older; then all once more."""
    home = fresh_folder(spark)

    def broken(spark, root):
        raise ValueError("unreadable")

    made = tuple(P.Provider(n, lambda s, root, n=n: sessions(s, root, n, True), slow=n == "slack") for n in NAMES) + (P.Provider("bad", broken),)
    for n in NAMES:
        P.store(spark, f"{home}/conversations", sessions(spark, sf_dir, n, False).filter(F.split("conversation_id", r"\|")[1].cast("long") % 3 == 0))
    roots = {p.name: sf_dir for p in made}
    first = P.upload(spark, home, roots, providers=made)
    again = P.upload(spark, home, roots, providers=made)
    totals = spark.createDataFrame([(s, t["discovered"], t["uploaded"], t["skipped"], t["bytes"], again["totals"][s]["uploaded"], "; ".join(first["warnings"])) for s, t in first["totals"].items()], "source string, discovered long, uploaded long, skipped long, bytes long, uploaded_again long, warnings string")  # a row a source
    kept = table_rows(spark, f"{home}/conversations", P.MESSAGES).groupBy("source").agg(F.count("*").alias("n_messages"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))
    return totals.join(kept, "source")


@query(f"""WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS ts, role, (turn % 7 = 3) AS noise, '@' || role || ': ' || text AS content FROM conversations),
kept AS (SELECT 'all' AS channel, ts, strlen(content) AS n, row_number() OVER (ORDER BY ts) AS rn FROM m WHERE NOT noise),
{_fill_sql('kept', 'channel', 20000)}
SELECT CAST(w.chunk AS INTEGER) AS chunk, count(*) AS n, CAST(sum(k.n) AS BIGINT) AS n_bytes, min(k.ts) AS created, max(k.ts) AS updated FROM walk w JOIN kept k USING (channel, rn) GROUP BY w.chunk""")
def hot_channel_chunks(spark, sf_dir):
    """All messages as one channel, whose chunks are found in ranges of it side by side."""
    at = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    m = X.table(spark, sf_dir, "conversations").select(F.lit("all").alias("channel"), at.alias("pos"), at.alias("ts"), "role", (F.col("turn") % 7 == 3).alias("noise"), F.concat(F.lit("@"), "role", F.lit(": "), "text").alias("content"), F.col("text").alias("raw"))
    return U.channel_chunks(m, spread=True).drop("channel", "title")


_SCORES = "(1 + (o_orderkey + {0}) % 5)"


@query(f"""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, o_orderkey % 11 = 0 AS bad, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'neither' END AS preferred, o_custkey % 2 = 0 AS ours_is_a FROM orders),
o AS (SELECT *, CASE WHEN bad THEN 3 WHEN preferred = 'neither' THEN 1 WHEN (preferred = 'A') = ours_is_a THEN 0 ELSE 2 END AS outcome FROM r)
SELECT CAST(row_number() OVER (ORDER BY outcome, id) AS INTEGER) AS place, id, substr('+~-!', outcome + 1, 1) AS mark,
    CASE WHEN bad THEN '' ELSE {" || '  ' || ".join(f"(1 + (k + {i}) % 5) || '>' || " + ("0" if i == 1 else f"(1 + (k + {i + 3}) % 5)") for i in range(3))} END AS scores,
    ['ours', 'neither', 'base', 'error'][outcome + 1] AS verdict FROM o""")
def eval_grid(spark, sf_dir):
    """A question an order; the second dimension lacks a score of ours."""
    k = F.col("o_orderkey")
    score = lambda i: (F.lit(1) + (k + i) % 5).cast("int")
    both = lambda at, names: F.map_from_arrays(F.array(*[F.lit(d) for d in names]), F.array(*[score(i + at) for i, d in enumerate(DIMENSIONS) if d in names]))
    preferred = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("neither")
    r = X.table(spark, sf_dir, "orders").select(k.alias("id"), both(0, DIMENSIONS).alias("base"), both(3, [DIMENSIONS[0], DIMENSIONS[2]]).alias("ours"), preferred.alias("preferred"), (F.col("o_custkey") % 2 == 0).alias("ours_is_a"), F.when(k % 11 == 0, "no answer").alias("error"))
    return summary_grid(r)


_HITS = "h AS (SELECT o_orderkey AS number, o_orderdate AS day FROM orders WHERE o_orderstatus <> 'P')"


@query(f"""WITH {_HITS}, s AS (SELECT *, count(*) OVER (PARTITION BY year(day)) AS ny, count(*) OVER (PARTITION BY year(day), month(day)) AS nm, count(*) OVER (PARTITION BY day) AS nd FROM h),
c AS (SELECT *, CASE WHEN ny <= 250 THEN make_date(year(day), 1, 1) WHEN nm <= 250 THEN make_date(year(day), month(day), 1) ELSE CAST(day AS DATE) END AS first,
    CASE WHEN ny <= 250 THEN make_date(year(day), 12, 31) WHEN nm <= 250 THEN last_day(day) ELSE CAST(day AS DATE) END AS last, ny > 250 AND nm > 250 AND nd > 250 AS cut FROM s)
SELECT first, last, any_value(cut) AS cut, count(*) AS n, CAST(sum(number) AS BIGINT) AS numbers FROM c GROUP BY first, last""")
def thread_search(spark, sf_dir):
    """A search that shows 250 hits of those of each range: years, months or days, read in pages of 50."""
    path = f"{fresh_folder(spark)}/hits"
    o = X.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    text = lambda s: F.lit(s)
    hits = o.select(text("issues").alias("kind"), text("o").alias("owner"), text("r").alias("repo"), F.col("o_orderkey").cast("int").alias("number"), text("t").alias("title"), text("me").alias("author"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderdate").cast("date").alias("day"))
    N.record_hits(hits, path)
    first, last = hits.agg(F.min("day"), F.max("day")).first()
    found = N.search(spark, N.RecordedHits(path), "issues", "me", f"{first.year}-01-01", f"{last.year}-12-31", most=250, page=50)
    return found.groupBy("first", "last").agg(F.first("cut").alias("cut"), F.count("*").alias("n"), F.sum(F.col("number").cast("long")).alias("numbers"))


@query("""WITH m AS (SELECT 'c' || (conv_id % 12) AS channel, conv_id * 1000 + turn AS ts, CASE WHEN turn % 3 = 2 THEN conv_id * 1000 + turn - 2 END AS thread_ts, text FROM conversations)
SELECT channel, count(*) AS n, count(thread_ts) AS n_replies, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(ts) AS BIGINT) AS times FROM m GROUP BY channel""")
def channel_stream(spark, sf_dir):
    """Every third message is a reply to the one two before.  Half of the messages are there when the stream first runs, the others when it is started again, and a third run finds nothing new."""
    home = fresh_folder(spark)
    at = F.col("conv_id") * 1000 + F.col("turn")
    ts = lambda x: x.cast("long").cast("string")
    none = F.lit(None).cast("string")
    reply = F.col("turn") % 3 == 2
    m = X.table(spark, sf_dir, "conversations").withColumn("threads", F.count_if(reply).over(W.partitionBy("conv_id", F.floor(F.col("turn") / 3))))
    m = m.select(F.concat(F.lit("c"), (F.col("conv_id") % 12).cast("string")).alias("channel"), ts(at).alias("ts"), F.when(reply, ts(at - 2)).alias("thread_ts"), F.col("role").alias("user"), "text", none.alias("subtype"), none.alias("bot_id"), F.when(reply, 0).otherwise(F.col("threads")).cast("long").alias("reply_count"))
    half = m.agg(F.percentile_approx(F.col("ts").cast("long"), 0.5)).first()[0]
    for part in (F.col("ts").cast("long") <= half, F.col("ts").cast("long") > half, F.lit(False)):
        N.record_messages(m.filter(part), f"{home}/recorded")
        N.follow(spark, N.RecordedChannels(f"{home}/recorded"), f"{home}/messages", f"{home}/checkpoint")
    kept = table_rows(spark, f"{home}/messages", N.MESSAGE)
    return kept.groupBy("channel").agg(F.count("*").alias("n"), F.count("thread_ts").alias("n_replies"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(F.col("ts").cast("long")).alias("times"))


@query(r"""WITH t AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE length(w) >= 8),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n_terms, sum(length(w)) AS chars FROM w JOIN t ON w.w = t.term GROUP BY doc_id)
SELECT doc_id, coalesce(n_terms, 0) AS n_terms, length(text) - CAST(coalesce(chars, 0) AS BIGINT) + 6 * coalesce(n_terms, 0) AS n_chars FROM documents LEFT JOIN n USING (doc_id)""")
def redacted_terms(spark, sf_dir):
    """The long words of the benchmark as a user's terms, in all documents."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    terms = X.table(spark, sf_dir, "benchmark").select(words.alias("term")).filter(F.length("term") >= 8)
    out = R.without_terms(X.table(spark, sf_dir, "documents").select("doc_id", "text"), terms)
    return out.select("doc_id", "n_terms", F.length("text").cast("long").alias("n_chars"))
