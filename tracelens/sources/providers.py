"""Providers of conversations, and the upload of what they have that a home does not.

A provider reads a root folder (or file) into the common schema.  upload() reads all wanted ones side by side, each into a table of its own,
so that one that fails takes no other with it; compares what they have with what is stored, and merges what is new or was updated since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.stage import written
from ..operators.incremental import changed_since, table_rows, upload_totals, upsert
from . import coding, people, sqlite
from .common import COLUMNS

#: Messages of stored conversations; last_modified is the conversation's, in milliseconds.
MESSAGES = "source string, conv_id string, turn long, role string, text string, last_modified long"
CONVERSATION = ["source", "conv_id"]
#: Sources that are read at once.
SIDE_BY_SIDE = 8


class Provider(NamedTuple):
    """A source of conversations: read(spark, root) gives rows of COLUMNS; slow ones begin first; opt-in ones are read only when named."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    human: bool = False
    opt_in: bool = False
    slow: bool = False


def _cached(pulls: bool):
    def read(spark: SparkSession, root: str) -> DataFrame:
        """Threads under root/threads, and the user whose they are in root/user.json."""
        user = spark.read.schema("login string").json(f"{root}/user.json").first()
        if user is None or not user["login"]:
            raise ValueError(f"{root}/user.json names no user")
        return people.threads(spark.read.schema(people.THREAD).option("recursiveFileLookup", True).json(f"{root}/threads"), user["login"], pulls)

    return read


def _channels(spark: SparkSession, root: str) -> DataFrame:
    return people.channels(spark.read.schema(people.CHANNEL).option("recursiveFileLookup", True).json(f"{root}/channels"))


BUILTIN = (
    Provider("claude-code", coding.claude_code), Provider("codex", coding.codex), Provider("kiro", coding.kiro), Provider("kiro-cli", sqlite.kiro_cli), Provider("opencode", sqlite.opencode),
    Provider("github-issues", _cached(False), True, True, True), Provider("github-prs", _cached(True), True, True, True), Provider("slack", _channels, True, True, True),
)


def wanted(providers: tuple[Provider, ...], names: list[str]) -> list[Provider]:
    """The named providers, or those that need not be named; slow ones first, else in their order.  Unknown names are left out."""
    return sorted([p for p in providers if (p.name in names if names else not p.opt_in)], key=lambda p: not p.slow)


def messages_of(conversations: DataFrame) -> DataFrame:
    """MESSAGES of conversations (COLUMNS): a row each, in their order; a conversation without a time counts as never updated."""
    at = F.coalesce(F.unix_millis("updated_at"), F.lit(0))
    rows = conversations.select("source", F.col("conversation_id").alias("conv_id"), at.alias("last_modified"), F.posexplode("messages").alias("turn", "m"))
    return rows.select("source", "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"), "last_modified")


def compared(conversations: DataFrame, stored: DataFrame) -> DataFrame:
    """source, conv_id, updated_at, size_bytes, status (new, changed, same) of conversations (COLUMNS) against stored MESSAGES.

    Of a conversation that is found twice the newer counts, then the longer.
    """
    size = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.octet_length(m["content"]), F.lit(0)))
    found = conversations.select("source", F.col("conversation_id").alias("conv_id"), F.coalesce(F.unix_millis("updated_at"), F.lit(0)).alias("updated_at"), size.alias("size_bytes"))
    old = stored.groupBy(*CONVERSATION).agg(F.max("last_modified").alias("last_modified"))
    return changed_since(found, old, CONVERSATION)


def single(conversations: DataFrame) -> DataFrame:
    """Conversations one an id: the newer, then the one of more messages, then the first by title."""
    best = F.max_by(F.struct(*conversations.columns), F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(0)), F.size("messages"), "title"))
    return conversations.groupBy("source", "conversation_id").agg(best.alias("r")).select("r.*")


def discover(spark: SparkSession, roots: dict[str, str], folder: str, names: list[str] = [], providers: tuple[Provider, ...] = BUILTIN) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(conversations of the wanted sources that have a root, their (source, status, detail)), each source read into a table under folder.

    A source that can't be read has the status `failed`; if it was named, that is an error.
    """
    chosen = [p for p in wanted(providers, names) if p.name in roots]

    def read(p: Provider):
        try:
            return p, written(p.read(spark, roots[p.name]).select(*COLUMNS).filter(F.col("source") == p.name), f"{folder}/{p.name}"), ""
        except Exception as e:  # one source's failure is its own
            return p, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        done = list(pool.map(read, chosen))
    for p, _, failed in done:
        if failed and names:
            raise RuntimeError(f"{p.name}: {failed}")
    tables = [t for _, t, _ in done if t is not None]
    every = tables[0] if tables else spark.createDataFrame([], "source string, conversation_id string, project string, title string, created_at timestamp, updated_at timestamp, parent_id string, messages array<struct<role:string,content:string,timestamp:timestamp,model:string,tools:array<struct<name:string,input:string,output:string>>>>")
    for t in tables[1:]:
        every = every.unionByName(t)
    return every, [(p.name, "failed" if failed else "read", failed) for p, _, failed in done]


def store(spark: SparkSession, path: str, conversations: DataFrame) -> DataFrame:
    """Merges what is new or was updated into the table of MESSAGES at path: a conversation's rows are replaced whole.  upload_totals() by source."""
    own = single(conversations)
    diff = compared(own, table_rows(spark, path, MESSAGES))
    diff = written(diff, f"{path.rstrip('/')}__diff/{uuid.uuid4().hex}")
    todo = diff.filter("status <> 'same'").select("source", F.col("conv_id").alias("conversation_id"))
    if not todo.isEmpty():
        upsert(path, messages_of(own.join(todo, ["source", "conversation_id"], "left_semi")), CONVERSATION)
    return upload_totals(diff)


def upload(spark: SparkSession, home: str, roots: dict[str, str], names: list[str] = [], providers: tuple[Provider, ...] = BUILTIN) -> dict:
    """Reads the wanted sources, stores what is new; `totals` has a row for each source with conversations, `warnings` the sources that failed."""
    found, status = discover(spark, roots, f"{home.rstrip('/')}/work/read-{uuid.uuid4().hex[:8]}", names, providers)
    totals = store(spark, f"{home.rstrip('/')}/conversations", found).collect()  # a row for each source
    out = {c: sum(r[c] for r in totals) for c in ("discovered", "uploaded", "skipped", "bytes")}
    return out | {"totals": {r["source"]: r.asDict() for r in totals}, "warnings": [f"{s}: {detail}" for s, state, detail in status if state == "failed"]}
