"""Threads and channels of people, from cached JSON, and directories that plugins write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chat_time
from ..operators import chat as H
from ..operators.incremental import first_of
from ..operators.turns import CHANNEL_BYTES, fill_ordered
from .common import COLUMNS, NO_TOOLS, gathered

THREAD = "owner string, repo string, number int, is_pr boolean, title string, body string, author string, created_at timestamp, updated_at timestamp, messages array<struct<author:string,body:string,created_at:timestamp,path:string,diff_hunk:string,review_state:string>>"
CHANNEL = "team_id string, team_name string, channel_id string, channel_name string, owner_id string, messages array<struct<user:string,text:string,ts:string,thread_ts:string,subtype:string,bot_id:string>>, users map<string,string>, updated_at timestamp"


def threads(files: DataFrame, user: str, pulls: bool) -> DataFrame:
    """Issues or pull requests of cached threads (THREAD) in which the user wrote twice; bots and commands go, others are named."""
    t = files.filter(F.col("is_pr") == pulls).withColumn("conversation_id", F.concat_ws("/", "owner", "repo", F.when(F.col("is_pr"), "pull").otherwise("issues"), F.col("number").cast("string")))
    own = F.lower("author") == user.lower()
    m = t.select("conversation_id", F.posexplode("messages").alias("pos", "m")).select("conversation_id", "pos", F.col("m.author").alias("author"), H.review_state("m.review_state", H.review_comment("m.path", "m.diff_hunk", "m.body")).alias("body"), F.col("m.body").alias("raw"), F.col("m.created_at").alias("timestamp"))
    body = t.select("conversation_id", F.lit(-1).alias("pos"), "author", "body", F.col("body").alias("raw"), F.col("created_at").alias("timestamp"))
    m = m.unionByName(body if not pulls else body.limit(0)).filter(~H.is_bot("author") & ~H.command_noise("raw"))
    kept = H.owned_threads(m, ["conversation_id"], own)
    if pulls:
        described = body.filter("coalesce(trim(body), '') <> ''").join(kept.select("conversation_id").distinct(), "conversation_id", "left_semi")
        kept = kept.unionByName(described)
    text = H.attributed("author", F.lit(user), "body")
    text = F.when((F.col("pos") == -1) & F.lit(pulls), F.concat(F.lit(H.GENERATED), text)).otherwise(text)
    kept = kept.select("conversation_id", (F.col("pos") >= 0).alias("later"), "timestamp", "pos", F.when(own, "user").otherwise("assistant").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("model"), F.expr(NO_TOOLS).alias("tools"))
    kept = kept.withColumn("at", F.coalesce("timestamp", F.lit(0).cast("timestamp")))
    order = ["later", "at", "pos"] if pulls else ["at", "pos"]
    out = gathered(kept, "conversation_id", order).join(t.select("conversation_id", "title", F.concat_ws("/", "owner", "repo").alias("project"), "created_at", "updated_at"), "conversation_id")
    return out.withColumn("source", F.lit("github-prs" if pulls else "github-issues")).withColumn("parent_id", F.lit(None).cast("string")).select(*COLUMNS)


def channels(files: DataFrame, limit: int = CHANNEL_BYTES) -> DataFrame:
    """Cached channels (CHANNEL) as conversations of at most `limit` bytes of content; channels their owner is silent in give none."""
    key = F.concat_ws(":", "team_id", "channel_id")
    m = files.select(key.alias("channel"), "channel_name", "team_name", "owner_id", "users", F.explode("messages").alias("m"))
    m = m.select("channel", "channel_name", "team_name", F.col("m.ts").alias("ts"), F.col("m.text").alias("raw"), H.chat_noise("m.text", "m.subtype", "m.bot_id").alias("noise"), F.when(F.col("m.user") == F.col("owner_id"), "user").otherwise("assistant").alias("role"), F.concat(F.lit("@"), F.coalesce(F.try_element_at("users", F.col("m.user")), F.col("m.user"), F.lit("")), F.lit(": "), F.col("m.text")).alias("content"))
    m = first_of(m, ["channel", "ts"], [F.col("noise")])
    owned = m.filter("NOT noise AND role = 'user'").select("channel").distinct()
    titles = m.filter("trim(raw) <> ''").groupBy("channel").agg(F.min_by("raw", "ts").alias("first"))
    kept = m.filter("NOT noise").join(owned, "channel", "left_semi")
    placed = fill_ordered(kept.select("channel", "ts", F.octet_length("content").cast("long").alias("bytes")), ["channel"], ["ts"], "bytes", limit).drop("bytes")
    rows = kept.join(placed, ["channel", "ts"]).withColumn("conversation_id", F.concat_ws(":", "channel", F.col("chunk").cast("string")))
    rows = rows.withColumn("timestamp", chat_time("ts")).withColumn("model", F.lit(None).cast("string")).withColumn("tools", F.expr(NO_TOOLS))
    heads = rows.groupBy("conversation_id", "channel", "chunk").agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.first("channel_name").alias("project")).join(titles, "channel")
    title = F.concat(F.when(F.col("chunk") > 0, F.format_string("[part %d] ", F.col("chunk") + 1)).otherwise(""), F.col("first"))
    out = gathered(rows, "conversation_id", ["ts"]).join(heads, "conversation_id")
    return out.withColumn("title", title).withColumn("source", F.lit("slack")).withColumn("parent_id", F.lit(None).cast("string")).select(*COLUMNS)


PLUGIN = "schema_version int, conversation_id string, session_id string, project string, title string, created_at timestamp, updated_at timestamp, parent_id string, messages array<struct<role:string,content:string,timestamp:timestamp,model:string>>, _corrupt_record string"


def plugin(spark: SparkSession, folder: str, name: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) conversations of the JSON files a plugin wrote; the source is its name, kind says human or ai."""
    if kind not in ("human", "ai"):
        raise ValueError(f"{name}: the type must be human or ai, not {kind!r}")
    raw = spark.read.schema(PLUGIN).option("multiLine", True).option("mode", "PERMISSIVE").json(folder, pathGlobFilter="*.json").withColumn("path", F.col("_metadata.file_path"))
    good, bad = plugin_rows(raw, name)
    return good, bad.select("path", "_corrupt_record")


def plugin_rows(raw: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of rows as plugins write them; an id may go by its old name, an empty one is none."""
    raw = raw.withColumn("conversation_id", F.coalesce(F.nullif("conversation_id", F.lit("")), "session_id"))
    good = F.col("_corrupt_record").isNull() & (F.coalesce("conversation_id", F.lit("")) != "")
    msgs = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp"), m["model"].alias("model"), F.expr(NO_TOOLS).alias("tools")))
    return raw.filter(good).withColumn("source", F.lit(name)).withColumn("messages", msgs).select(*COLUMNS), raw.filter(~good)
