"""Logs of agents, threads and plugins as their readers get them, made of the test conversations, and assembled again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import coding, people, sqlite
from . import fixtures as X
from .registry import query


def quoted(x) -> Column:
    """A JSON string."""
    array = F.to_json(F.array(F.col(x) if isinstance(x, str) else x))
    return array.substr(F.lit(2), F.length(array) - 2)


def text_of(number: str) -> Column:
    return F.col(number).cast("string")


def said(spark, sf_dir) -> DataFrame:
    """Messages, a second apart: conv_id, turn, role, text, id, at, ms."""
    m = X.table(spark, sf_dir, "conversations").withColumn("id", text_of("conv_id")).withColumn("ms", (F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")) * 1000)
    return m.withColumn("at", F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def lines(rows: DataFrame, path: Column, line: Column, text: Column) -> DataFrame:
    return rows.select(path.alias("path"), line.cast("long").alias("line"), F.try_parse_json(text).alias("v"))


def shown(sessions: DataFrame, *more: Column) -> DataFrame:
    """conversation_id, title, n_messages, n_tools, a digest of roles and contents, the first and last second."""
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    tools = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.size(m["tools"]))
    return sessions.select(
        "conversation_id", "title", F.size("messages").cast("long").alias("n_messages"), tools.alias("n_tools"), F.md5(told).alias("digest"),
        F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"), *more,
    )


#: A title is the first message of the owner, trimmed and cut at 100 bytes.
_CUT = "CASE WHEN strlen(t) <= 100 THEN t ELSE left(t, list_max(list_filter(range(0, 101), lambda k: strlen(left(t, k)) <= 100))) || '...' END"
_TRIM = r"regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')"
_SAID = f"""WITH said AS (SELECT *, CAST(conv_id AS VARCHAR) AS id, 1700000000 + conv_id * 1000 + turn AS secs, {_TRIM} AS t FROM conversations),
opening AS (SELECT conv_id, {_CUT} AS opening FROM (SELECT conv_id, arg_min(t, turn) AS t FROM said WHERE role = 'user' AND t <> '' GROUP BY conv_id)),
span AS (SELECT conv_id, min(secs) AS created, max(secs) AS updated FROM said GROUP BY conv_id)"""
_DIGEST = "md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest"


@query(f"""{_SAID}
SELECT id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'Shown ' || id ELSE coalesce(any_value(opening), '') END AS title, count(*) AS n_messages,
    CAST(count_if(turn % 2 = 1) AS BIGINT) AS n_tools, {_DIGEST}, any_value(created) AS created, any_value(updated) AS updated, CASE WHEN conv_id % 5 = 4 THEN CAST(conv_id - 4 AS VARCHAR) END AS parent_id
FROM said LEFT JOIN opening USING (conv_id) JOIN span USING (conv_id) WHERE role = 'user' OR (role = 'assistant' AND turn % 4 <> 3) GROUP BY id, conv_id""")
def source_json_sessions(spark, sf_dir):
    """Assistant messages of every fourth turn are partial; odd turns are blocks with a tool; every fifth session is a subagent's."""
    m = said(spark, sf_dir)
    blocks = F.concat(F.lit('[{"type":"text","text":'), quoted("text"), F.lit('},{"type":"tool_use","name":"run","input":{"n":'), text_of("turn"), F.lit("}}]"))
    content = F.when(F.col("turn") % 2 == 1, blocks).otherwise(quoted("text"))
    stop = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), F.lit("")).otherwise(F.lit(',"stop_reason":"end"'))
    text = F.concat(F.lit('{"type":"'), "role", F.lit('","cwd":"/w","timestamp":"'), "at", F.lit('","message":{"content":'), content, stop, F.lit("}}"))
    child = F.concat(F.lit("/projects/p/"), (F.col("conv_id") - 4).cast("string"), F.lit("/subagents/"), "id", F.lit(".jsonl"))
    path = F.when(F.col("conv_id") % 5 == 4, child).otherwise(F.concat(F.lit("/projects/p/"), "id", F.lit(".jsonl")))
    heads = m.filter("conv_id % 3 = 0").select("conv_id", "id").distinct()
    history = lines(heads, F.lit("/history.jsonl"), F.col("conv_id"), F.concat(F.lit('{"sessionId":"'), "id", F.lit('","display":"Shown '), "id", F.lit('"}')))
    return shown(coding.claude_sessions(lines(m, path, F.col("turn"), text), history), F.col("parent_id"))


@query(f"""{_SAID},
kept AS (SELECT * FROM said WHERE role IN ('user', 'assistant') AND t <> ''),
edge AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS e FROM kept),
isle AS (SELECT *, sum(e) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM edge),
merged AS (SELECT conv_id, id, role, min(turn) AS turn, string_agg(text, chr(10) ORDER BY turn) AS text, count_if(role = 'assistant') AS tools FROM isle GROUP BY conv_id, id, i, role),
top AS (SELECT conv_id, {_CUT} AS opening FROM (SELECT conv_id, {_TRIM} AS t FROM (SELECT conv_id, arg_min(text, turn) AS text FROM merged GROUP BY conv_id)))
SELECT id AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || id ELSE any_value(top.opening) END AS title, count(*) AS n_messages, CAST(sum(tools) AS BIGINT) AS n_tools,
    {_DIGEST}, any_value(created) AS created, any_value(updated) AS updated
FROM merged JOIN top USING (conv_id) JOIN span USING (conv_id) GROUP BY id, conv_id""")
def source_rollouts(spark, sf_dir):
    """Every fourth file has response items in place of events; every third was archived with its first line only; every answer called a tool."""
    m = said(spark, sf_dir)
    wrap = lambda kind, payload: F.concat(F.lit('{"timestamp":"'), "at", F.lit(f'","type":"{kind}","payload":'), payload, F.lit("}"))
    path = F.concat(F.lit("/sessions/2024/"), "id", F.lit(".jsonl"))
    items = F.col("conv_id") % 4 == 1
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    event = F.concat(F.lit('{"type":"'), kind, F.lit('","message":'), quoted("text"), F.lit("}"))
    item = F.concat(F.lit('{"type":"message","role":"'), "role", F.lit('","content":[{"type":"'), F.when(F.col("role") == "user", "input_text").otherwise("output_text"), F.lit('","text":'), quoted("text"), F.lit("}]}"))
    spoken = m.filter("role IN ('user', 'assistant')")
    told = lines(spoken, path, F.col("turn") * 4 + 2, F.when(items, wrap("response_item", item)).otherwise(wrap("event_msg", event)))
    bots = spoken.filter("role = 'assistant'")
    call = lines(bots, path, F.col("turn") * 4 + 3, wrap("response_item", F.concat(F.lit('{"type":"function_call","name":"run","call_id":"c'), text_of("turn"), F.lit('","arguments":"{}"}'))))
    done = lines(bots, path, F.col("turn") * 4 + 4, wrap("response_item", F.concat(F.lit('{"type":"function_call_output","call_id":"c'), text_of("turn"), F.lit('","output":"ok"}'))))
    ends = m.groupBy("conv_id", "id").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    meta = F.concat(F.lit('{"id":"'), "id", F.lit('","cwd":"/w"}'))
    heads = lines(ends, path, F.lit(0), wrap("session_meta", meta))
    tail = lines(ends.withColumn("at", F.col("last")), path, F.lit(1 << 40), wrap("turn_context", F.lit('{"model":"m"}')))
    old = ends.filter("conv_id % 3 = 0")
    archive = F.concat(F.lit("/archived_sessions/"), "id", F.lit(".jsonl"))
    archived = lines(old, archive, F.lit(0), wrap("session_meta", meta)).unionByName(lines(old, archive, F.lit(1), wrap("event_msg", F.lit('{"type":"user_message","message":"old"}'))))
    named = ends.filter("conv_id % 2 = 0")
    index = lines(named, F.lit("/session_index.jsonl"), F.col("conv_id"), F.concat(F.lit('{"id":"'), "id", F.lit('","thread_name":"Thread '), "id", F.lit('"}')))
    every = told
    for more in (call, done, heads, tail, archived, index):
        every = every.unionByName(more)
    return shown(coding.codex_sessions(every))


@query(f"""{_SAID}
SELECT id AS conversation_id, 'Title ' || id AS title, count(*) AS n_messages, CAST(count_if(turn % 3 = 0) AS BIGINT) AS n_tools, md5(string_agg(role || ': ' || text || chr(10) || 'end', chr(10) ORDER BY turn)) AS digest,
    any_value(created) AS created, any_value(updated) AS updated, CASE WHEN conv_id % 5 = 4 THEN CAST(conv_id - 4 AS VARCHAR) END AS parent_id, 'p' || (conv_id % 3) AS project
FROM said JOIN span USING (conv_id) GROUP BY id, conv_id""")
def source_session_tables(spark, sf_dir):
    """Rows of sessions, messages and parts: two parts of text, and a tool every third turn."""
    m = said(spark, sf_dir)
    s = m.groupBy("conv_id", "id").agg(F.min("ms").alias("created"), F.max("ms").alias("updated"))
    parent = F.when(F.col("conv_id") % 5 == 4, (F.col("conv_id") - 4).cast("string"))
    s = s.select(F.col("id").alias("conversation_id"), F.concat(F.lit("Title "), "id").alias("title"), parent.alias("parent_id"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), "created", "updated")
    mid = F.concat_ws("-", "id", text_of("turn"))
    messages = m.select(mid.alias("mid"), F.col("id").alias("conversation_id"), F.concat(F.lit('{"role":"'), "role", F.lit('","modelID":"m"}')).alias("data"), F.col("ms").alias("at"))
    part = lambda rows, n, data: rows.select(F.concat_ws("-", "id", text_of("turn"), F.lit(str(n))).alias("pid"), mid.alias("message_id"), data.alias("data"), (F.col("ms") + n).alias("pat"))
    parts = part(m, 1, F.concat(F.lit('{"type":"text","text":'), quoted("text"), F.lit("}"))).unionByName(part(m, 2, F.lit('{"type":"text","text":"end"}')))
    parts = parts.unionByName(part(m.filter("turn % 3 = 0"), 3, F.lit('{"type":"tool","tool":"run","state":{"input":{},"output":"ok"}}')))
    return shown(sqlite.opencode_sessions(s, messages, parts), F.col("parent_id"), F.col("project"))


@query(f"""{_SAID}, kept AS (SELECT * FROM said WHERE role IN ('user', 'assistant') AND text <> ''),
first AS (SELECT conv_id, {_CUT} AS opening FROM (SELECT conv_id, arg_min(t, turn) AS t FROM kept WHERE role = 'user' GROUP BY conv_id))
SELECT id AS conversation_id, coalesce(any_value(opening), '') AS title, count(*) AS n_messages, CAST(count_if(role = 'assistant' AND turn % 2 = 0) AS BIGINT) AS n_tools, {_DIGEST}, any_value(created) AS created, any_value(updated) AS updated
FROM kept LEFT JOIN first USING (conv_id) JOIN span USING (conv_id) GROUP BY id, conv_id""")
def source_history_table(spark, sf_dir):
    """Values of prompts and answers, a pair's side each; assistant messages of even turns used a tool; every message has a row of history."""
    m = said(spark, sf_dir)
    user = F.concat(F.lit('{"user":{"content":{"Prompt":{"prompt":'), quoted("text"), F.lit("}}}}"))
    tool = F.concat(F.lit('{"assistant":{"ToolUse":{"content":'), quoted("text"), F.lit(',"tool_uses":[{"id":"1","name":"run","orig_args":{}}]}}}'))
    answer = F.concat(F.lit('{"assistant":{"Response":{"content":'), quoted("text"), F.lit("}}}"))
    entry = F.when(F.col("role") == "user", user).when(F.col("turn") % 2 == 0, tool).otherwise(answer)
    spoken = F.when(F.col("role").isin("user", "assistant"), F.struct("turn", entry.alias("e")))
    c = m.groupBy("id").agg(F.array_sort(F.collect_list(spoken)).alias("h"), F.min("ms").alias("created"), F.max("ms").alias("updated"))
    c = c.select(F.lit("/w").alias("project"), F.col("id").alias("conversation_id"), F.concat(F.lit('{"history":['), F.array_join(F.transform("h", lambda x: x["e"]), ","), F.lit("]}")).alias("value"), "created", "updated")
    return shown(sqlite.kiro_cli_sessions(c))


@query(f"""{_SAID}, kept AS (SELECT * FROM said WHERE role IN ('user', 'assistant') AND t <> ''),
runs AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM kept),
chat AS (SELECT conv_id, id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side, seg, role, min(turn) AS turn, string_agg(t, chr(10) ORDER BY turn) AS text FROM runs WHERE conv_id % 3 <> 0 GROUP BY ALL),
own AS (SELECT conv_id, id, 0 AS side, 0 AS seg, role, turn, text FROM kept WHERE conv_id % 3 = 0),
both_ AS (SELECT * FROM chat UNION ALL SELECT * FROM own)
SELECT id AS conversation_id, 'Title ' || id AS title, count(*) AS n_messages, 0::BIGINT AS n_tools, {_DIGEST}, any_value(created) AS created, any_value(CASE WHEN conv_id % 3 <> 0 THEN updated ELSE created END) AS updated
FROM both_ JOIN span USING (conv_id) GROUP BY id, conv_id""")
def source_chat_files(spark, sf_dir):
    """Every third session holds its messages; the others name two executions, of which the last one's chat is whole."""
    m = said(spark, sf_dir).filter("role IN ('user', 'assistant')")
    ends = said(spark, sf_dir).groupBy("conv_id", "id").agg(F.min("ms").alias("created"), F.max("ms").alias("updated"))
    row = F.concat(F.lit('{"sessionId":"'), "id", F.lit('","title":"Title '), "id", F.lit('","dateCreated":"'), text_of("created"), F.lit('","workspaceDirectory":"/w"}'))
    listed = ends.select(F.concat(F.lit("/workspace-sessions/w"), (F.col("conv_id") % 4).cast("string"), F.lit("/sessions.json")).alias("path"), row.alias("row"))
    listed = listed.groupBy("path").agg(F.try_parse_json(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]"))).alias("v"))
    joined = lambda rows, e: rows.groupBy("conv_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", e.alias("e")))), lambda x: x["e"]), ",").alias("all"))
    own = joined(m.filter("conv_id % 3 = 0"), F.concat(F.lit('{"message":{"role":"'), "role", F.lit('","content":'), quoted("text"), F.lit("}}")))
    named = ends.filter("conv_id % 3 <> 0").select("conv_id", "id", F.concat(F.lit('{"executionId":"a'), "id", F.lit('"},{"executionId":"b'), "id", F.lit('"}')).alias("all"))
    sessions = own.unionByName(named).select(F.concat(F.lit("/workspace-sessions/w/"), "id", F.lit(".json")).alias("path"), F.try_parse_json(F.concat(F.lit('{"history":['), "all", F.lit("]}"))).alias("v"))
    told = F.when(F.col("role") == "user", F.concat(F.lit("<EnvironmentContext>x</EnvironmentContext>\n"), "text")).otherwise(F.col("text"))
    spoken = joined(m.filter("conv_id % 3 <> 0"), F.concat(F.lit('{"role":"'), F.when(F.col("role") == "user", "human").otherwise("bot"), F.lit('","content":'), quoted(told), F.lit("}")))
    system = F.lit('{"role":"human","content":"# Identity"},{"role":"bot","content":"I will follow these instructions."},{"role":"tool","content":"t"},')
    meta = F.concat(F.lit(',"metadata":{"modelId":"m","endTime":'), text_of("updated"), F.lit("}}"))
    spoken = spoken.join(ends, ["conv_id", "id"])
    whole = spoken.select(F.concat(F.lit("/h/"), "id", F.lit(".chat")).alias("path"), F.try_parse_json(F.concat(F.lit('{"executionId":"b'), "id", F.lit('","chat":['), system, "all", F.lit("]"), meta)).alias("v"))
    part = spoken.select(F.concat(F.lit("/h/a"), "id", F.lit(".chat")).alias("path"), F.try_parse_json(F.concat(F.lit('{"executionId":"a'), "id", F.lit('","chat":[{"role":"human","content":"early"}]'), meta)).alias("v"))
    return shown(coding.kiro_sessions(listed, sessions, whole.unionByName(part)))


_THREADS = f"""{_SAID}, m AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'deploy[bot]' WHEN role = 'user' THEN 'Owner' ELSE 'dev' END AS author FROM said),
body AS (SELECT conv_id, id, -1 AS turn, CASE WHEN conv_id % 4 < 2 THEN 'Owner' ELSE 'dev' END AS author, 'About ' || id AS text, 1700000000 + conv_id * 1000 AS secs FROM (SELECT DISTINCT conv_id, id FROM said)),
notes AS (SELECT conv_id, id, turn, author, text, secs FROM m WHERE author <> 'deploy[bot]'),
counted AS (SELECT * FROM notes UNION ALL SELECT * FROM body WHERE conv_id % 2 = 0),
owned AS (SELECT conv_id FROM counted WHERE author = 'Owner' GROUP BY conv_id HAVING count(*) >= 2),
everything AS (SELECT *, CASE WHEN conv_id % 2 = 1 AND turn = -1 THEN 0 WHEN conv_id % 2 = 1 THEN 1 ELSE 0 END AS later FROM (SELECT * FROM notes UNION ALL SELECT * FROM body) WHERE conv_id IN (SELECT conv_id FROM owned)),
shown AS (SELECT conv_id, id, later, secs, turn, CASE WHEN author = 'Owner' THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN conv_id % 2 = 1 AND turn = -1 THEN '[Auto-generated PR description — not authored by the user]' || chr(10) ELSE '' END || CASE WHEN author = 'Owner' THEN text ELSE '[GitHub comment by @' || author || ']' || chr(10) || text END AS text FROM everything)
SELECT 'o/r/' || CASE WHEN conv_id % 2 = 1 THEN 'pull/' ELSE 'issues/' END || id AS conversation_id, 'Thread ' || id AS title, count(*) AS n_messages, 0::BIGINT AS n_tools,
    md5(string_agg(role || ': ' || text, chr(10) ORDER BY later, secs, turn)) AS digest, 1700000000 + conv_id * 1000 AS created, 1700000000 + conv_id * 1000 + 60 AS updated, CASE WHEN conv_id % 2 = 1 THEN 'github-prs' ELSE 'github-issues' END AS source
FROM shown GROUP BY conv_id, id"""


@query(_THREADS)
def source_threads(spark, sf_dir):
    """Odd numbers are pull requests, whose description is shown but not counted; every fifth message is a bot's."""
    m = said(spark, sf_dir)
    author = F.when(F.col("turn") % 5 == 4, "deploy[bot]").when(F.col("role") == "user", "Owner").otherwise("dev")
    none = F.lit(None).cast("string")
    message = F.struct(author.alias("author"), F.col("text").alias("body"), F.timestamp_millis("ms").alias("created_at"), none.alias("path"), none.alias("diff_hunk"), none.alias("review_state"))
    t = m.groupBy("conv_id", "id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000)
    files = t.select(
        F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("conv_id").cast("int").alias("number"), (F.col("conv_id") % 2 == 1).alias("is_pr"), F.concat(F.lit("Thread "), "id").alias("title"), F.concat(F.lit("About "), "id").alias("body"),
        F.when(F.col("conv_id") % 4 < 2, "Owner").otherwise("dev").alias("author"), start.alias("created_at"), (start + F.expr("INTERVAL 60 SECONDS")).alias("updated_at"), F.transform("l", lambda x: x["m"]).alias("messages"),
    )
    out = people.threads(files, "owner", False).unionByName(people.threads(files, "owner", True))
    return shown(out, F.col("source"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id % 7 <> 3 AS good, CASE WHEN conv_id % 7 <> 3 THEN n END AS n_messages FROM c""")
def source_plugin_rows(spark, sf_dir):
    """Every seventh row has no id of its own, or an old name for it."""
    m = X.table(spark, sf_dir, "conversations").withColumn("id", text_of("conv_id"))
    none = F.lit(None).cast("string")
    message = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("timestamp"), none.alias("model"))
    c = m.groupBy("conv_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    k = F.col("conv_id") % 7
    raw = c.select("id", F.when(k.isin(3, 5), "").otherwise(F.col("id")).alias("conversation_id"), F.when(k == 5, F.col("id")).alias("session_id"), F.lit("p").alias("project"), F.lit("t").alias("title"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), none.alias("parent_id"), "messages", none.alias("_corrupt_record"))
    good, bad = people.plugin_rows(raw, "mine")
    return good.select("conversation_id", F.lit(True).alias("good"), F.size("messages").cast("long").alias("n_messages")).unionByName(bad.select(F.col("id").alias("conversation_id"), F.lit(False).alias("good"), F.lit(None).cast("long").alias("n_messages")))
