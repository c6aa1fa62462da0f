"""Logs of coding agents: JSON-line sessions with subagents, rollout files with an index, and chat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import trim_space
from .common import COLUMNS, NO_TOOLS, gathered, get, json_lines, merged_roles, text_of, title_from

PAYLOAD_BYTES = 16_384
#: How messages begin that no person wrote.
SYNTHETIC = r"^(# AGENTS\.md instructions|<environment_context>|<INSTRUCTIONS>)"


def payload(x) -> Column:
    """What a tool got or gave: JSON as it is, other text as a JSON string; null if blank or above PAYLOAD_BYTES."""
    t = trim_space(x)
    quoted = F.to_json(F.array(t))
    return F.when((t == "") | (F.octet_length(t) > PAYLOAD_BYTES), F.lit(None).cast("string")).when(F.try_parse_json(t).isNotNull(), t).otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))


def synthetic(x) -> Column:
    """Whether a user's message is blank or begins as no person's does."""
    t = trim_space(x)
    return (t == "") | t.rlike(SYNTHETIC)


def claude_code(spark: SparkSession, root: str) -> DataFrame:
    """Sessions under root/projects, a file each; files under {id}/subagents are children.  Titles from root/history.jsonl.

    Assistant events without a stop reason are partial and go, as do events without text and tools.  Times are of all events.
    """
    history = json_lines(spark, f"{root}").filter(F.col("path").endswith("/history.jsonl"))
    return claude_sessions(json_lines(spark, f"{root}/projects"), history)


def claude_sessions(v: DataFrame, history: DataFrame) -> DataFrame:
    """claude_code() of the lines (path, line, v) of session files and of the history."""
    file = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    v = v.withColumn("conversation_id", F.url_decode(file)).withColumn("parent_id", F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/[^/]+$", 1), F.lit("")))
    v = v.withColumn("timestamp", get("v", "$.timestamp", "timestamp")).withColumn("content", get("v", "$.message.content", "variant"))
    times = v.groupBy("conversation_id").agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.min_by(F.nullif(get("v", "$.cwd"), F.lit("")), F.when(F.coalesce(get("v", "$.cwd"), F.lit("")) != "", F.col("line"))).alias("project"), F.first("parent_id").alias("parent_id"))
    kept = v.filter(get("v", "$.type").isin("user", "assistant") & ((get("v", "$.type") == "user") | get("v", "$.message.stop_reason").isNotNull()))
    tools = F.transform(F.filter(F.try_variant_get("content", "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"), lambda b: F.struct(F.try_variant_get(b, "$.name", "string").alias("name"), F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input"), F.lit(None).cast("string").alias("output")))
    m = kept.select("conversation_id", "line", get("v", "$.type").alias("role"), text_of(F.col("content")).alias("content"), "timestamp", get("v", "$.message.model").alias("model"), F.coalesce(tools, F.expr(NO_TOOLS)).alias("tools"))
    m = m.filter((F.coalesce("content", F.lit("")) != "") | (F.size("tools") > 0))
    first = m.filter((F.col("role") == "user") & (trim_space("content") != "")).groupBy("conversation_id").agg(F.min_by("content", "line").alias("opening"))
    out = gathered(m, "conversation_id", ["line"]).join(times, "conversation_id").join(first, "conversation_id", "left")
    h = history.select(get("v", "$.sessionId").alias("conversation_id"), get("v", "$.display").alias("display"), "line")
    h = h.filter(F.coalesce("display", F.lit("")) != "").groupBy("conversation_id").agg(F.min_by("display", "line").alias("display"))
    out = out.join(h, "conversation_id", "left").withColumn("title", title_from(F.coalesce("display", "opening", F.lit(""))))
    return out.withColumn("source", F.lit("claude-code")).select(*COLUMNS)


def codex(spark: SparkSession, root: str) -> DataFrame:
    """Rollout files under root/sessions and root/archived_sessions, titles and times from root/session_index.jsonl.

    Events' texts, or response items' where a file has no events; the same id twice: the newer, then the longer.
    """
    return codex_sessions(json_lines(spark, root))


def codex_sessions(lines: DataFrame) -> DataFrame:
    """codex() of the lines (path, line, v) of all files."""
    v = lines.filter(F.col("path").rlike("/(sessions|archived_sessions)/"))
    v = v.select("path", "line", get("v", "$.timestamp", "timestamp").alias("timestamp"), get("v", "$.type").alias("type"), get("v", "$.payload", "variant").alias("p")).withColumn("kind", get("p", "$.type"))
    model = F.last(F.when(F.col("type") == "turn_context", get("p", "$.model")), ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    v = v.withColumn("model", model)
    meta = v.groupBy("path").agg(F.min_by(get("p", "$.id"), F.when(F.col("type") == "session_meta", F.col("line"))).alias("id"), F.min_by(get("p", "$.cwd"), F.when(F.col("type") == "session_meta", F.col("line"))).alias("project"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("seen_at"))
    events = v.filter((F.col("type") == "event_msg") & F.col("kind").isin("user_message", "agent_message")).withColumn("role", F.when(F.col("kind") == "user_message", "user").otherwise("assistant")).withColumn("content", get("p", "$.message")).withColumn("tools", F.expr(NO_TOOLS))
    items = v.filter((F.col("type") == "response_item") & (F.col("kind") == "message") & get("p", "$.role").isin("user", "assistant")).withColumn("role", get("p", "$.role")).withColumn("content", text_of(get("p", "$.content", "variant"), ["input_text", "output_text", "text"])).withColumn("tools", F.expr(NO_TOOLS))
    items = items.filter((F.col("role") == "assistant") | ~synthetic("content")).join(events.select("path").distinct(), "path", "left_anti")

    calls = v.filter(F.col("kind").isin("function_call", "custom_tool_call"))
    outs = v.filter(F.col("kind").isin("function_call_output", "custom_tool_call_output")).select(F.col("path").alias("op"), get("p", "$.call_id").alias("oc"), "line", payload(get("p", "$.output")).alias("output")).groupBy("op", "oc").agg(F.max_by("output", "line").alias("output"))
    calls = calls.join(outs, (F.col("path") == F.col("op")) & (get("p", "$.call_id") == F.col("oc")), "left").withColumn("role", F.lit("assistant")).withColumn("content", F.lit(""))
    calls = calls.withColumn("tools", F.array(F.struct(get("p", "$.name").alias("name"), payload(F.coalesce(get("p", "$.arguments"), get("p", "$.input"))).alias("input"), F.col("output").alias("output"))))
    cols = ["path", "line", "role", "content", "timestamp", "model", "tools"]
    m = events.select(*cols).unionByName(items.select(*cols)).filter(trim_space("content") != "").unionByName(calls.select(*cols))
    msgs = gathered(merged_roles(m, "path", "line"), "path", ["line"])
    index = lines.filter(F.col("path").endswith("/session_index.jsonl")).groupBy(get("v", "$.id").alias("iid")).agg(F.max_by(get("v", "$.thread_name"), "line").alias("named"), F.max_by(get("v", "$.updated_at", "timestamp"), "line").alias("indexed_at"))
    out = msgs.join(meta, "path").join(index, F.col("id") == F.col("iid"), "left").withColumn("conversation_id", F.coalesce("id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)))
    opening = F.try_element_at(F.filter("messages", lambda x: trim_space(x["content"]) != ""), F.lit(1))["content"]
    out = out.withColumn("title", F.coalesce(F.nullif("named", F.lit("")), title_from(opening), F.lit(""))).withColumn("updated_at", F.greatest("seen_at", "indexed_at"))
    best = F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc("updated_at"), F.desc(F.size("messages")), F.desc(F.octet_length("title")), "path"))
    return out.withColumn("n", best).filter("n = 1").withColumn("source", F.lit("codex")).withColumn("parent_id", F.lit(None).cast("string")).select(*COLUMNS)


def kiro(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of root/workspace-sessions/*/sessions.json; messages of the last chat file a session's history names, or the session file's own.

    The system prompt, the answer to it, notices of the editor, tool rows and blanks go; environment blocks are cut out.
    """
    def whole(glob):
        return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")

    return kiro_sessions(whole("sessions.json"), whole("*.json").filter(~F.col("path").endswith("/sessions.json")), whole("*.chat"))


def kiro_sessions(listed: DataFrame, sessions: DataFrame, chats: DataFrame) -> DataFrame:
    """kiro() of the files (path, v) that list sessions, hold them, and hold their chats."""
    index = listed.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("s"))
    index = index.select(get("s", "$.sessionId").alias("conversation_id"), get("s", "$.title").alias("title"), get("s", "$.workspaceDirectory").alias("project"), F.timestamp_millis(get("s", "$.dateCreated").try_cast("long")).alias("created_at"))
    session = sessions.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("sid"), F.posexplode(F.try_variant_get("v", "$.history", "array<variant>")).alias("pos", "h"))
    chats = chats.select(get("v", "$.executionId").alias("eid"), get("v", "$.metadata.modelId").alias("model"), F.timestamp_millis(get("v", "$.metadata.endTime", "long")).alias("ended"), F.try_variant_get("v", "$.chat", "array<variant>").alias("chat"))
    named = session.join(chats, get("h", "$.executionId") == F.col("eid")).groupBy("sid").agg(F.max_by(F.struct("chat", "model", "ended"), "pos").alias("c"))
    rows = named.select("sid", F.col("c.model").alias("model"), F.col("c.ended").alias("timestamp"), F.posexplode("c.chat").alias("line", "m"))
    text = trim_space(F.coalesce(get("m", "$.content"), F.lit("")))
    rows = rows.withColumn("role", F.when(get("m", "$.role") == "human", "user").when(get("m", "$.role") == "bot", "assistant")).withColumn("raw", text).filter("role IS NOT NULL")
    noise = ((F.col("line") == 0) & F.col("raw").rlike("^(# Identity|<identity>)")) | ((F.col("line") == 1) & (F.col("raw") == "I will follow these instructions.")) | ((F.col("role") == "user") & F.contains("raw", F.lit("<kiro-ide-message>")))
    clean = trim_space(F.regexp_replace("raw", r"(?s)<EnvironmentContext>.*?(?:</EnvironmentContext>|$)", ""))
    rows = rows.filter(~noise).withColumn("content", F.when(F.col("role") == "user", clean).otherwise(F.col("raw"))).filter("content <> ''").withColumn("tools", F.expr(NO_TOOLS))
    users, bots = rows.filter("role = 'user'"), rows.filter("role = 'assistant'")
    w = W.partitionBy("sid").orderBy("line")
    marked = users.unionByName(bots).withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = marked.filter("role = 'assistant'").groupBy("sid", "turn").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("content"), F.first("timestamp").alias("timestamp"), F.first("model").alias("model"), F.first("tools").alias("tools")).withColumn("role", F.lit("assistant"))
    cols = ["sid", "line", "role", "content", "timestamp", "model", "tools"]
    chat = gathered(marked.filter("role = 'user'").select(*cols).unionByName(joined.select(*cols)), "sid", ["line"])
    own = session.select("sid", F.col("pos").alias("line"), get("h", "$.message.role").alias("role"), text_of(get("h", "$.message.content", "variant")).alias("content"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("model"), F.expr(NO_TOOLS).alias("tools"))
    own = gathered(own.filter(F.col("role").isin("user", "assistant") & (trim_space("content") != "")), "sid", ["line"]).withColumnRenamed("messages", "own").withColumnRenamed("sid", "oid")
    out = index.join(chat, F.col("conversation_id") == F.col("sid"), "left").join(own, F.col("conversation_id") == F.col("oid"), "left").withColumn("messages", F.coalesce("messages", "own")).filter("messages IS NOT NULL")
    out = out.withColumn("updated_at", F.coalesce(F.array_max(F.transform("messages", lambda m: m["timestamp"])), "created_at"))
    return out.withColumn("source", F.lit("kiro")).withColumn("parent_id", F.lit(None).cast("string")).select(*COLUMNS)
