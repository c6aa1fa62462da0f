"""Conversations to turns, and turns to chunks of bounded size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import byte_cut, compress_assistant, trim_space, turn_line
from .spread import fill_spread

#: Sources in which the other side are people.
HUMAN_SOURCES = ["slack", "github-issues", "github-prs"]
CHUNK_BYTES, CHANNEL_BYTES = 200_000, 20_000


def is_human_source(source, declared: Column | None = None) -> Column:
    """Built-in human sources, or what an imported source declares."""
    s = F.col(source) if isinstance(source, str) else source
    return s.isin(HUMAN_SOURCES) | F.coalesce(declared, F.lit(False)) if declared is not None else s.isin(HUMAN_SOURCES)


def turn_pairs(messages: DataFrame, key: list[str] = ["conv_id"], human: Column | None = None) -> DataFrame:
    """key, turn, assistant, human: every owner message with text, and the last assistant text since the one before.

    messages(key, turn, role, text).  Conversations with fewer than two owner messages (one in human sources) give
    none; roles other than user and assistant, and messages without text, do not count.
    """
    spoken = messages.filter(F.col("role").isin("user", "assistant") & (trim_space("text") != ""))
    owner = F.col("role") == "user"
    by, all_of = W.partitionBy(*key).orderBy("turn"), W.partitionBy(*key)
    segment = F.coalesce(F.sum(owner.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = F.when(human, 1).otherwise(2) if human is not None else F.lit(2)
    marked = spoken.withColumn("segment", segment).withColumn("owners", F.count_if(owner).over(all_of)).withColumn("least", least)
    reply = F.last(F.when(~owner, F.col("text")), ignorenulls=True).over(W.partitionBy(*key, "segment").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    told = marked.withColumn("assistant", F.coalesce(reply, F.lit(""))).filter(owner & (F.col("owners") >= F.col("least")))
    return told.select(*key, "turn", "assistant", F.col("text").alias("human"))


#: An owner's message of fewer words is taken for a correction of what it answers, of which so many bytes are kept then.
CORRECTION_WORDS, CONTEXT_BYTES = 50, 4000


def turn_lines(turns: DataFrame, human: Column, preserve: bool = False, context: int = CONTEXT_BYTES) -> DataFrame:
    """Adds `line`: each turn as the model reads it, the assistant's text compressed; preserve: what a short message answers stays with its code, up to `context` bytes."""
    told = compress_assistant("assistant")
    if preserve:
        short = F.size(F.regexp_extract_all("human", F.lit(r"\S+"), F.lit(0))) < CORRECTION_WORDS
        told = F.when(short, byte_cut(trim_space("assistant"), context)).otherwise(told)
    return turns.withColumn("line", turn_line(told, "human", human))


def chunks(lines: DataFrame, key: list[str] = ["conv_id"], limit: int = CHUNK_BYTES) -> DataFrame:
    """key, chunk, n, n_bytes, text: the lines (key, turn, line) of each conversation in chunks of at most `limit` bytes.

    A line that is larger is a chunk of its own.
    """
    sized = lines.select(*key, "turn", "line", F.octet_length("line").cast("long").alias("bytes"))
    each = fill_ordered(sized, key, ["turn"], "bytes", limit)
    out = each.groupBy(*key, "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "")
    return out.select(*key, "chunk", "n", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def fill_ordered(rows: DataFrame, key: list[str], order: list[str], size: str, limit: int = CHANNEL_BYTES) -> DataFrame:
    """Adds `chunk` to rows: a chunk of a key ends before its sizes would pass the limit.

    One pass over sorted rows that keeps two numbers, for keys of any number of rows: each key is one task's stream, never one batch.
    The rows are numbered by a window, as a plan keeps a key's rows together for that.  It does not for repartition(): where rows come from
    a join by the key the shuffle is left out, and adaptive execution may then read the join's partitions in pieces.
    """
    sorted_rows = rows.withColumn("__row", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    names = rows.columns
    n = names.index(size)

    def run(parts):
        used, chunk = 0, 0
        for part in parts:
            out = []
            for row, m in zip(part.column(len(names)).to_pylist(), part.column(n).to_pylist()):
                if row == 1:
                    used, chunk = 0, 0
                elif used + m > limit:
                    used, chunk = 0, chunk + 1
                used += m
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.int32())], names=[*names, "chunk"])

    return sorted_rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())]))


def channel_chunks(messages: DataFrame, limit: int = CHANNEL_BYTES, spread: bool = False) -> DataFrame:
    """channel, chunk, title, n, n_bytes, created, updated of messages(channel, pos, ts, role, noise, content, raw).

    Noise is no content, but the title is the first raw text that is not blank, noise too; from the second chunk on
    it says its part.  Channels without a message of their owner give none.  spread: a channel may be larger than one task takes (fill_spread()).
    """
    owned = messages.filter(~F.col("noise")).groupBy("channel").agg(F.max((F.col("role") == "user").cast("int")).alias("owned")).filter("owned = 1")
    titles = messages.filter(trim_space("raw") != "").groupBy("channel").agg(F.min_by("raw", "pos").alias("title"))
    kept = messages.filter(~F.col("noise")).join(owned.select("channel"), "channel", "left_semi")
    sized = kept.select("channel", "pos", "ts", F.octet_length("content").cast("long").alias("bytes"))
    placed = (fill_spread if spread else fill_ordered)(sized, ["channel"], ["pos"], "bytes", limit)
    out = placed.groupBy("channel", "chunk").agg(F.count("*").alias("n"), F.sum("bytes").alias("n_bytes"), F.min("ts").alias("created"), F.max("ts").alias("updated"))
    title = F.concat(F.when(F.col("chunk") > 0, F.format_string("[part %d] ", F.col("chunk") + 1)).otherwise(""), F.col("title"))
    return out.join(titles, "channel").select("channel", "chunk", title.alias("title"), "n", "n_bytes", "created", "updated")
