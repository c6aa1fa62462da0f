"""Questions to a document in sessions, source activation, a response cache, and storage keys."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import col
from ..model.client import Client, streamed
from .incremental import exists

#: Built-in sources, and whether one has to ask for them.
BUILTIN = [("claude-code", False), ("codex", False), ("kiro", False), ("kiro-cli", False), ("opencode", False), ("github-issues", True), ("github-prs", True), ("slack", True)]


def default_sources() -> list[str]:
    return [n for n, opt_in in BUILTIN if not opt_in]


def sources_for(names: list[str]) -> list[str]:
    """The named built-in sources in their order, unknown names left out; none named: the defaults."""
    return [n for n, _ in BUILTIN if n in names] if names else default_sources()


def active_sources(state: DataFrame) -> list[str]:
    """Sources with state(source), or the defaults where there is none; one row a source comes to the driver."""
    found = sorted(r[0] for r in state.select("source").distinct().collect())
    return found or default_sources()


def registry(spark: SparkSession) -> DataFrame:
    """source, opt_in, place of the built-in sources."""
    return spark.createDataFrame([(n, o, i) for i, (n, o) in enumerate(BUILTIN)], "source string, opt_in boolean, place int")


def active(state: DataFrame) -> DataFrame:
    """source: those of state(source), or the defaults where there is none."""
    return state.sparkSession.createDataFrame([(n,) for n in active_sources(state)], "source string")


def of_sources(rows: DataFrame, names: list[str], source: str = "source") -> DataFrame:
    """Rows of the named sources; none named: all."""
    return rows.filter(F.col(source).isin(names)) if names else rows


def imported(rows: DataFrame, source: str = "source") -> DataFrame:
    """source: the sources of rows that are not built in."""
    return rows.select(F.col(source).alias("source")).distinct().join(registry(rows.sparkSession).select("source"), "source", "left_anti")


def storage_key(source, conversation) -> Column:
    return F.concat(F.lit("conversations/"), col(source), F.lit("/"), col(conversation), F.lit(".json"))


def parsed_key(key) -> Column:
    """source and conversation_id of a storage key; ids may hold slashes.  Null for keys without both, and for ids that begin with a dot."""
    parts = F.split(F.regexp_replace(col(key), r"^conversations/", ""), "/", 2)
    source, conversation = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.json$", "")
    good = (F.size(parts) == 2) & (source != "") & (conversation != "") & ~F.startswith(conversation, F.lit("."))
    return F.when(good, F.struct(source.alias("source"), conversation.alias("conversation_id")))


def artifact_key(kind, source, conversation) -> Column:
    """Where an artifact of a conversation is kept: observations by themselves, those of a method under its name."""
    folder = F.when(col(kind) == "observations", F.lit("observations/")).otherwise(F.concat(F.lit("compose/"), col(kind), F.lit("/")))
    return F.concat(folder, col(source), F.lit("/"), col(conversation), F.lit(".json"))


def version_key(ts, part: str = "document") -> Column:
    return F.concat(F.lit("versions/"), col(ts), F.lit(f"/{part}.md"))


def thread_key(owner, repo, is_pull, number) -> Column:
    return F.concat_ws("/", F.lit("threads"), col(owner), col(repo), F.when(col(is_pull), "pull").otherwise("issues"), F.concat(col(number).cast("string"), F.lit(".json")))


def cache_key(url, accept) -> Column:
    """32 hex digits of the SHA-256 of URL and Accept with a NUL between."""
    return F.left(F.sha2(F.concat_ws("\0", col(url), F.coalesce(col(accept), F.lit(""))), 256), F.lit(32))


#: Headers of a response that are kept with it.
KEPT_HEADERS = ["Link", "Content-Type"]


def revalidated(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds `if_none_match` to requests(key): the cached tag, or null.  The cache has a row a key."""
    return requests.join(cache.select(F.col("key").alias("__k"), F.col("etag").alias("if_none_match")), F.col("key") == F.col("__k"), "left").drop("__k")


def answered(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """responses(key, etag, status, headers, body) as they are used: one that says nothing has changed (304) is the cached one, where there is one.

    Each response stays a row with its other columns, so responses of one key need no join to be told apart.  The cache has a row a key.
    """
    old = cache.select(F.col("key").alias("__k"), F.struct("etag", "status", "headers", "body").alias("__old"))
    joined = responses.join(old, F.col("key") == F.col("__k"), "left")
    kept = (F.col("status") == 304) & F.col("__old").isNotNull()
    return joined.withColumns({c: F.when(kept, F.col("__old")[c]).otherwise(F.col(c)) for c in ("etag", "status", "headers", "body")}).drop("__k", "__old")


def cacheable(responses: DataFrame) -> DataFrame:
    """The responses to keep: those of status 200 with a tag, with KEPT_HEADERS."""
    kept = responses.filter((F.col("status") == 200) & (F.coalesce("etag", F.lit("")) != ""))
    return kept.withColumn("headers", F.map_filter("headers", lambda k, v: k.isin(KEPT_HEADERS) & (F.coalesce(v, F.lit("")) != "")))


def newest_kept(cache: DataFrame, most: int, modified: str = "modified", key: str = "key") -> DataFrame:
    """The cache without its oldest entries above `most`."""
    return cache.orderBy(F.desc(modified), key).limit(most)


def with_children(conversations: DataFrame, key: str = "conversation_id", parent: str = "parent_id") -> DataFrame:
    """Adds `subagent_ids`: the sorted ids of the conversations whose parent a row is; none: an empty array."""
    own = conversations.filter(F.coalesce(F.col(parent).cast("string"), F.lit("")) != "").groupBy(F.col(parent).alias("__parent")).agg(F.sort_array(F.collect_set(key)).alias("subagent_ids"))
    none = F.array().cast(own.schema["subagent_ids"].dataType)
    joined = conversations.join(own, F.col(key) == F.col("__parent"), "left").drop("__parent")
    return joined.withColumn("subagent_ids", F.coalesce("subagent_ids", none))


def transfer_group(domain) -> Column:
    return F.when(col(domain).isin("in-domain", "adjacent", "out-of-domain"), "domain").otherwise("universal")


class Sessions:
    """Sessions in a folder of Parquet: a row a turn, appended only after the answer came, with its time, so that the latest session is the one asked last."""

    SCHEMA = "id string, seq long, role string, content string, at long"

    def __init__(self, spark: SparkSession, folder: str, client: Client, clock=time.time_ns):
        self.spark, self.folder, self.client, self.clock = spark, folder, client, clock

    def rows(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def turns(self, session: str) -> list[tuple[str, str]]:
        rows = self.rows().filter(F.col("id") == session).orderBy("seq").collect()
        return [(r["role"], r["content"]) for r in rows]

    def latest(self) -> str | None:
        """The session that was asked last by someone who resumes; null times don't count."""
        return self.rows().agg(F.max_by("id", "at")).first()[0]

    def ask(self, question: str, document: str, session: str | None = None, resume: bool = False, new: bool = False, tell=None) -> tuple[str, str]:
        """(session, answer); an unknown session is an error; the system text is made of the document each time; tell gets the answer's pieces as they come.

        Without a session: the latest, if `resume` and there is one, else, or if `new`, a new one.  Only those who resume move the latest.
        """
        if session is not None:
            past = self.turns(session)
            if not past:
                raise KeyError(f"no session {session}")
        else:
            session = self.latest() if resume and not new else None
            past = self.turns(session) if session else []
            session = session or str(uuid.uuid4())
        text = json.dumps([*past, ("user", question)], ensure_ascii=False)
        answer = (streamed(self.client, "ask", document, text, 4096, tell) if tell else self.client.answer("ask", document, text, 4096)).text
        at = self.clock() if resume else None
        rows = [(session, len(past), "user", question, at), (session, len(past) + 1, "assistant", answer, at)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return session, answer


def first_diff(previous: str | None, text: str, client: Client) -> str:
    """What changed since the previous document; the first one needs no call."""
    return client.answer("diff", previous, text, 4096).text if previous else "Initial version."


def document_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def response_hits(requests: DataFrame, cache: DataFrame, key: str = "key", fp: str = "fp") -> DataFrame:
    """Adds `response` where the cache has the key under the same fingerprint, else null."""
    known = cache.select(F.col(key).alias("__k"), F.col(fp).alias("__f"), "response")
    return requests.join(known, (F.col(key) == F.col("__k")) & (F.col(fp) == F.col("__f")), "left").drop("__k", "__f")


def latest_per_key(versions: DataFrame, key: list[str], at: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(at)))
    return versions.withColumn("__n", n).filter("__n = 1").drop("__n")
