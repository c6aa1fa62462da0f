"""Chats and code-review threads: noise, bots, attribution, thresholds and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, trim_space
from .incremental import first_of

#: Message subtypes, accounts and commands that carry nothing.
NOISE_SUBTYPES = ["channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "group_join", "group_leave", "group_topic", "group_purpose"]
BOTS = ["k8s-ci-robot", "googlebot", "codecov", "coveralls", "netlify", "sonarcloud"]
COMMANDS = [
    "/retest", "/test", "/lgtm", "/approve", "/hold", "/unhold", "/assign", "/unassign", "/kind", "/area", "/priority", "/remove-kind",
    "/remove-area", "/remove-priority", "/cc", "/uncc", "/close", "/reopen", "/lifecycle", "/remove-lifecycle", "/milestone", "/retitle", "/cherry-pick", "/ok-to-test",
]
ONLY_URL = r"^\s*<https?://[^>]+>\s*$"
HUNK_LINES, OWNER_MESSAGES = 8, 2


def chat_noise(text, subtype, bot_id) -> Column:
    """Bots, joins and topics, and messages that are one link."""
    sub = F.coalesce(col(subtype), F.lit(""))
    return (F.coalesce(col(bot_id), F.lit("")) != "") | (sub == "bot_message") | sub.isin(NOISE_SUBTYPES) | F.coalesce(col(text), F.lit("")).rlike(ONLY_URL)


def is_bot(author) -> Column:
    return F.endswith(col(author), F.lit("[bot]")) | F.lower(col(author)).isin(BOTS)


def command_noise(body) -> Column:
    """Blank, or one line that is a command to a bot."""
    t = trim_space(F.coalesce(col(body), F.lit("")))
    return (t == "") | (~F.contains(t, F.lit("\n")) & F.get(F.split(t, r"\s+"), F.lit(0)).isin(COMMANDS))


def review_comment(path, hunk, body) -> Column:
    """[path], the last lines of the hunk and a blank line, the body; parts that are missing are left out."""
    h = F.split(F.coalesce(col(hunk), F.lit("")), "\n")
    tail = F.array_join(F.slice(h, F.greatest(F.size(h) - HUNK_LINES + 1, F.lit(1)), F.lit(HUNK_LINES)), "\n")
    return F.concat(
        F.when(F.coalesce(col(path), F.lit("")) != "", F.concat(F.lit("["), col(path), F.lit("]\n"))).otherwise(""),
        F.when(F.coalesce(col(hunk), F.lit("")) != "", F.concat(tail, F.lit("\n\n"))).otherwise(""), col(body),
    )


def review_state(state, body) -> Column:
    return F.when(F.coalesce(col(state), F.lit("")) != "", F.concat(F.lit("[review: "), F.lower(col(state)), F.lit("]\n"), col(body))).otherwise(col(body))


def attributed(author, owner, body, kind: str = "GitHub comment") -> Column:
    """The body; of others, under a line that names them."""
    return F.when(F.lower(col(author)) == F.lower(col(owner)), col(body)).otherwise(F.concat(F.lit(f"[{kind} by @"), col(author), F.lit("]\n"), col(body)))


#: Fixed value: what stands above the text of a pull request, which often no person wrote.
GENERATED = "[Auto-generated PR description — not authored by the user]\n"


def described(author, owner, body) -> Column:
    """A pull request's own text, marked as generated, and attributed to others."""
    return attributed(author, owner, F.concat(F.lit(GENERATED), col(body)))


def chat_line(name, text) -> Column:
    return F.concat(F.lit("@"), col(name), F.lit(": "), F.coalesce(col(text), F.lit("")))


def owned_threads(messages: DataFrame, key: list[str], owner: Column, least: int = OWNER_MESSAGES) -> DataFrame:
    """Messages of threads with `least` messages of the owner."""
    kept = messages.groupBy(*key).agg(F.count_if(owner).alias("__n")).filter(F.col("__n") >= least).select(*key)
    return messages.join(kept, key, "left_semi")


def display_name(*names) -> Column:
    """The first name that is not empty."""
    return F.coalesce(*[F.nullif(col(n), F.lit("")) for n in names])


def channel_activity(found: DataFrame) -> DataFrame:
    """channel, first_ts, last_ts, threads (sorted) of found(channel, ts, thread_ts)."""
    return found.groupBy("channel").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_set("thread_ts")).alias("threads"))


def with_replies(history: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """History and thread replies, one row a key; history wins."""
    both = history.withColumn("__rank", F.lit(0)).unionByName(replies.withColumn("__rank", F.lit(1)))
    return first_of(both, key, [F.col("__rank")]).drop("__rank")


def in_activity(messages: DataFrame, activity: DataFrame, around: int) -> DataFrame:
    """Messages of a channel within `around` of its first and last activity."""
    a = activity.select(F.col("channel").alias("__c"), "first_ts", "last_ts")
    near = (F.col("channel") == F.col("__c")) & F.col("ts").between(F.col("first_ts") - around, F.col("last_ts") + around)
    return messages.join(a, near).drop("__c", "first_ts", "last_ts")
