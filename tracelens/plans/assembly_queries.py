"""Assembly of conversations from logs, threads and chats, and answers of services, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as H
from ..operators import incremental as I
from ..operators import sessions as S
from ..operators.turns import is_human_source
from ..sources.coding import payload, synthetic
from ..sources.common import NO_TOOLS, merged_roles
from . import fixtures as X
from .registry import query
from .text_queries import trim


def _said(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations")


@query(X.VIEWS + "SELECT conv_id, source, source IN ('slack', 'github-prs') OR conv_id % 12 = 1 AS human FROM entries")
def human_sources(spark, sf_dir):
    own = F.when(F.col("source") == "opencode", F.lit("plugin")).otherwise(F.col("source"))
    return X.entries(spark, sf_dir).select("conv_id", "source", is_human_source(own, F.col("conv_id") % 12 == 1).alias("human"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE '[GitHub comment by @dev' || turn || ']' || chr(10) END || '[Auto-generated PR description — not authored by the user]' || chr(10) || text AS body FROM conversations")
def described_requests(spark, sf_dir):
    author = F.when(F.col("turn") % 2 == 0, "OWNER").otherwise(F.concat(F.lit("dev"), F.col("turn").cast("string")))
    return _said(spark, sf_dir).select("conv_id", "turn", H.described(author, F.lit("owner"), "text").alias("body"))


@query("SELECT conv_id, turn, '@' || role || ': ' || text AS line, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS said_by FROM conversations")
def chat_lines(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", H.chat_line("role", "text").alias("line"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("said_by"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 5 = 4 OR (turn % 5 = 3 AND text <> '')")
def synthetic_messages(spark, sf_dir):
    starts = F.element_at(F.array(*[F.lit(x) for x in ("# AGENTS.md instructions", "\n<environment_context>", "  <INSTRUCTIONS>")]), (F.col("turn") % 5 + 1).cast("int"))
    text = F.when(F.col("turn") % 5 < 3, F.concat(starts, F.col("text"))).otherwise(F.concat(F.lit("see # AGENTS.md "), F.col("text")))
    return _said(spark, sf_dir).filter(~synthetic(text)).select("conv_id", "turn")


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"a": ' || turn || '}' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '"call ' || turn || '"' ELSE '[1, 2]' END AS payload FROM conversations""")
def tool_payloads(spark, sf_dir):
    k, t = F.col("turn") % 5, F.col("turn").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(' {"a": '), t, F.lit("}\n"))).when(k == 1, "  ").when(k == 2, F.repeat(F.lit("x"), F.lit(16385))).when(k == 3, F.concat(F.lit("call "), t)).otherwise("[1, 2]")
    return _said(spark, sf_dir).select("conv_id", "turn", payload(raw).alias("payload"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(url || '&amp;lt;a&gt;&quot;&#39;&apos;', '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&apos;', '''') AS url FROM pages")
def html_unescape(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.html_unescape(F.concat("url", F.lit("&amp;lt;a&gt;&quot;&#39;&apos;"))).alias("url"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 60 WHEN 1 THEN 30 ELSE 0 END AS seconds, CASE WHEN event_id % 6 IN (0, 1, 4, 5) THEN true ELSE false END AS slow FROM events")
def rate_limits(spark, sf_dir):
    i = F.col("event_id")
    header = F.when(i % 4 == 0, (i % 60).cast("string")).when(i % 4 == 1, "soon").otherwise("")
    reset = F.when(i % 4 == 1, "1030").when(i % 4 == 2, "900")
    status = F.when(i % 6 == 0, 429).when(i % 6 <= 2, 403).otherwise(500)
    remaining = F.when(i % 6 == 1, "0").otherwise("12")
    message = F.when(i % 6 == 4, "rate_limit_error").when(i % 6 == 5, "Too many tokens, please wait").otherwise("failed")
    return X.table(spark, sf_dir, "events").select("event_id", T.retry_after(header, reset, F.lit(1000)).alias("seconds"), T.throttled(status, message, remaining).alias("slow"))


@query("SELECT event_id, CASE WHEN event_id < 10 THEN (event_id * 100) || 'ms' ELSE (event_id // 10) || '.' || (event_id % 10) || 's' END AS took FROM events")
def format_duration(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", T.format_duration(F.col("event_id") * 100).alias("took"))


@query(r"SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: CASE WHEN strlen(string_split(a, chr(10))[-1]) + 1 + strlen(x) > 60 THEN a || chr(10) || '  ' || x ELSE a || ' ' || x END, '  ' || w0) END AS wrapped FROM (SELECT conv_id, turn, v[2:] AS w, v[1] AS w0 FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> '') AS v FROM conversations))")
def word_wrap(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", T.word_wrap("text", 60, "  ").alias("wrapped"))


@query(X.VIEWS + "SELECT source, count(*) AS discovered, count(*) FILTER (w) AS uploaded, count(*) FILTER (NOT w) AS skipped, CAST(coalesce(sum(size_bytes) FILTER (w), 0) AS BIGINT) AS bytes FROM (SELECT e.*, s.conv_id IS NULL OR e.last_modified > s.last_modified AS w FROM entries e LEFT JOIN stored s USING (source, conv_id)) GROUP BY source")
def upload_totals(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    return I.upload_totals(I.changed_since(e, X.stored(spark, sf_dir), ["source", "conv_id"], updated="last_modified"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'conversation_id' WHEN conv_id % 4 = 0 THEN 'source' END AS missing FROM conversations")
def rejected_rows(spark, sf_dir):
    m = _said(spark, sf_dir).withColumn("conversation_id", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("conv_id").cast("string"))).withColumn("source", F.when(F.col("conv_id") % 4 != 0, "codex"))
    return I.rejects(m, ["conversation_id", "source"]).select("conv_id", "turn", "missing")


@query("WITH c AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 5 <> 0 THEN conv_id // 5 * 5 END AS parent FROM conversations) SELECT p.id AS conversation_id, coalesce((SELECT list_sort(list(k.id)) FROM c k WHERE k.parent = p.id), []) AS subagent_ids FROM c p")
def parents_and_children(spark, sf_dir):
    c = _said(spark, sf_dir).select(F.col("conv_id").alias("conversation_id")).distinct()
    c = c.withColumn("parent_id", F.when(F.col("conversation_id") % 5 != 0, F.expr("conversation_id div 5 * 5")))
    return S.with_children(c).select("conversation_id", "subagent_ids")


@query(f"""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' OR turn % 4 = 3 THEN 'assistant' ELSE 'user' END AS role, text FROM conversations),
edge AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS e FROM m),
isle AS (SELECT *, sum(e) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM edge)
SELECT conv_id, min(turn) AS turn, role, string_agg(text, chr(10) ORDER BY turn) AS content FROM isle GROUP BY conv_id, i, role""")
def merged_messages(spark, sf_dir):
    role = F.when((F.col("role") == "assistant") | (F.col("turn") % 4 == 3), "assistant").otherwise("user")
    m = _said(spark, sf_dir).select("conv_id", "turn", role.alias("role"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("model"), F.expr(NO_TOOLS).alias("tools"))
    return merged_roles(m, "conv_id", "turn").select("conv_id", "turn", "role", "content")


@query("WITH t AS (SELECT event_type AS first FROM events ORDER BY event_type LIMIT 1), a AS (SELECT user_id AS channel, min(event_id) AS lo, max(event_id) AS hi FROM events, t WHERE event_type = first GROUP BY user_id) SELECT e.event_id FROM events e JOIN a ON e.user_id = a.channel AND e.event_id BETWEEN a.lo - 5 AND a.hi + 5")
def near_activity(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("ts"), "event_type")
    first = e.agg(F.min("event_type")).first()[0]
    found = e.filter(F.col("event_type") == F.lit(first)).withColumn("thread_ts", F.col("ts"))
    return H.in_activity(e, H.channel_activity(found), 5).select(F.col("ts").alias("event_id"))
