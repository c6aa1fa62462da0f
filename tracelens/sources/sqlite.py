"""SQLite files as tables (a Python data source), and the two agents that keep their sessions in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import COLUMNS, NO_TOOLS, gathered, get, title_from


#: Ranges of row ids that a table is read in, if a reader names no other number.
PARTS = 16


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    """Row ids from lo to hi; None: the whole query."""

    def __init__(self, lo: int | None = None, hi: int | None = None):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.names = options["path"], schema.names
        self.table, self.parts = options.get("table"), int(options.get("parts", PARTS))
        self.columns = ", ".join(quoted(c) for c in options.get("columns", "").split(",")) if options.get("columns") else ", ".join(map(quoted, self.names))
        self.query = options["query"] if not self.table else f"SELECT {self.columns} FROM {quoted(self.table)}"

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        """Ranges of row ids, cut from the smallest and the largest, which the file's index tells; queries, and tables without row ids, are one."""
        import sqlite3

        if not self.table:
            return [RowRange()]
        con = self._open()
        try:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:
            return [RowRange()]
        finally:
            con.close()
        if lo is None or not isinstance(lo, int) or not isinstance(hi, int):
            return [RowRange()]
        cuts = sorted({lo + (hi + 1 - lo) * i // self.parts for i in range(self.parts)})
        return [RowRange(a, b - 1) for a, b in zip(cuts, [*cuts[1:], hi + 1])]

    def read(self, partition):
        con = self._open()
        try:
            if partition.lo is None:
                yield from con.execute(self.query)
            else:
                yield from con.execute(f"{self.query} WHERE rowid BETWEEN ? AND ?", (partition.lo, partition.hi))
        finally:
            con.close()


class SqliteSource(DataSource):
    """spark.read.format("sqlite").schema(...).load(path): rows of option "table", with its "columns", in "parts" ranges of row ids, or of option "query" in one task.

    The file must be where all executors can open it.
    """

    @classmethod
    def name(cls):
        return "sqlite"

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query, in one task."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("query", query).load()


def table(spark: SparkSession, path: str, name: str, columns: str, schema: str, parts: int = PARTS) -> DataFrame:
    """The columns of a table, as the schema names them, in ranges of its row ids."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", name).option("columns", columns).option("parts", parts).load()


def opencode(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with their project, messages by time and parts by time; texts joined, tools with input and output."""
    s = table(spark, path, "session", "id,title,parent_id,project_id,time_created,time_updated", "conversation_id string, title string, parent_id string, project_id string, created long, updated long")
    s = s.join(table(spark, path, "project", "id,worktree", "project_id string, project string"), "project_id").drop("project_id")
    m = table(spark, path, "message", "id,session_id,data,time_created", "mid string, conversation_id string, data string, at long")
    p = table(spark, path, "part", "id,message_id,data,time_created", "pid string, message_id string, data string, pat long")
    return opencode_sessions(s, m, p)


def opencode_sessions(s: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    """opencode() of the rows of sessions with their project, messages and parts."""
    m, p = m.withColumn("v", F.try_parse_json("data")), p.withColumn("w", F.try_parse_json("data"))
    tool = F.struct(get("w", "$.tool").alias("name"), F.to_json(get("w", "$.state.input", "variant")).alias("input"), F.to_json(get("w", "$.state.output", "variant")).alias("output"))
    parts = p.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("pat", "pid", get("w", "$.type").alias("kind"), get("w", "$.text").alias("text"), tool.alias("tool")))).alias("l"))
    text = F.array_join(F.transform(F.filter("l", lambda x: (x["kind"] == "text") & (F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"]), "\n")
    parts = parts.select("message_id", text.alias("content"), F.transform(F.filter("l", lambda x: x["kind"] == "tool"), lambda x: x["tool"]).alias("tools"))
    told = m.join(parts, F.col("mid") == F.col("message_id")).filter("content <> '' OR size(tools) > 0")
    told = told.select("conversation_id", "at", "mid", get("v", "$.role").alias("role"), "content", F.timestamp_millis("at").alias("timestamp"), get("v", "$.modelID").alias("model"), "tools")
    out = s.join(gathered(told, "conversation_id", ["at", "mid"]), "conversation_id")
    return out.withColumn("created_at", F.timestamp_millis("created")).withColumn("updated_at", F.timestamp_millis("updated")).withColumn("source", F.lit("opencode")).select(*COLUMNS)


def kiro_cli(spark: SparkSession, path: str) -> DataFrame:
    """Conversations whose value is a history of prompts and responses; values that are no JSON are left out, all bad is an error."""
    c = table(spark, path, "conversations_v2", "key,conversation_id,value,created_at,updated_at", "project string, conversation_id string, value string, created long, updated long")
    return kiro_cli_sessions(c)


def kiro_cli_sessions(c: DataFrame) -> DataFrame:
    """kiro_cli() of the table's rows."""
    c = c.withColumn("v", F.try_parse_json("value"))
    total, bad = c.agg(F.count("*"), F.count_if(F.col("v").isNull())).first()
    if total and total == bad:
        raise ValueError("no conversation could be read")
    h = c.select("conversation_id", F.posexplode(F.try_variant_get("v", "$.history", "array<variant>")).alias("pos", "h"))
    user = h.select("conversation_id", "pos", F.lit(0).alias("side"), F.lit("user").alias("role"), get("h", "$.user.content.Prompt.prompt").alias("content"), get("h", "$.user.timestamp", "timestamp").alias("timestamp"), F.lit(None).cast("string").alias("model"), F.expr(NO_TOOLS).alias("tools"))
    uses = F.transform(F.try_variant_get("h", "$.assistant.ToolUse.tool_uses", "array<variant>"), lambda t: F.struct(F.try_variant_get(t, "$.name", "string").alias("name"), F.to_json(F.try_variant_get(t, "$.orig_args", "variant")).alias("input"), F.lit(None).cast("string").alias("output")))
    other = h.select("conversation_id", "pos", F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.coalesce(get("h", "$.assistant.Response.content"), get("h", "$.assistant.ToolUse.content"), F.lit("")).alias("content"), F.lit(None).cast("timestamp").alias("timestamp"), get("h", "$.request_metadata.model_id").alias("model"), F.coalesce(uses, F.expr(NO_TOOLS)).alias("tools"))
    m = user.unionByName(other).filter("coalesce(content, '') <> '' OR size(tools) > 0")
    out = c.drop("v").join(gathered(m, "conversation_id", ["pos", "side"]), "conversation_id")
    opening = F.try_element_at(F.filter("messages", lambda x: x["role"] == "user"), F.lit(1))["content"]
    return out.withColumn("title", title_from(F.coalesce(opening, F.lit("")))).withColumn("created_at", F.timestamp_millis("created")).withColumn("updated_at", F.timestamp_millis("updated")).withColumn("parent_id", F.lit(None).cast("string")).withColumn("source", F.lit("kiro-cli")).select(*COLUMNS)
