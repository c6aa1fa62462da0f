"""The incremental method: observations are folded into the document in order, some at a time, each time by one call.

What is folded is kept with the document that came of it, so a run that is cut off goes on where it was, and a later run folds only
what is new.  A batch is smaller the fuller the document is.  As each call needs the document of the one before, calls are made one after
another: a stretch of them by one task, which reads what is pending in order and ends after STRETCH_SECONDS, so a slow model's every call is kept
at once and a fast one's calls don't wait for Spark.
"""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unfenced
from ..model.client import Client, Limiter, with_retry
from ..model.stage import RATE_A_SECOND, RESPONSE, written
from ..operators.incremental import stale, upsert
from ..operators.ordered import ranked

#: Bytes that the document should not pass, and observations of a batch for an empty document, and at least.
BUDGET_BYTES, FIRST_BATCH, LEAST_BATCH = 8000, 200, 10
KEY = ["source", "conv_id"]
STATE = "source string, seq long, content string"
#: Tokens of an answer at most.
MOST_TOKENS = 4096


def batch_size(document: str, budget: int = BUDGET_BYTES, first: int | None = None) -> int:
    """FIRST_BATCH for an empty document, half of it for a half full one, LEAST_BATCH for a full one."""
    full = min(1.0, len(document.encode()) / budget)
    return max(LEAST_BATCH, round((first or FIRST_BATCH) * (1 - full)))


def pending(entries: DataFrame, times: DataFrame, folded: DataFrame) -> DataFrame:
    """entries(source, conv_id, idx, text) whose text was not folded, with `place`, from 1 in the order of their conversation's time (source, conv_id, last_modified), then key and idx."""
    marked = entries.withColumn("fp", F.md5("text")).filter("trim(text) <> ''")
    new = stale(marked, folded.select(*KEY, "idx", "fp"), [*KEY, "idx"]).join(times, KEY)
    # oldest first: ranked() puts the largest first
    return ranked(new.withColumn("__back", -F.col("last_modified")), "__back", [*KEY, "idx"], "place").drop("__back")


#: Observations that a stretch reads at most, and seconds after which it begins no further call.
STRETCH_ROWS, STRETCH_SECONDS = 20_000, 10.0
CALLS = RESPONSE + ", upto long, bytes_in long, ms long"


def stretch(todo: DataFrame, client: Client, prompt: str, document: str, at: int, n: int, budget: int, most: int) -> DataFrame:
    """A row a call (CALLS, req_id its number from 0): the calls that fold the rows of todo(place, text) after place `at`, of n in all.

    It ends with a call that failed or was cut short, after STRETCH_SECONDS, and where the rows of the next batch are not whole.
    """
    schema = pa.schema([("req_id", pa.string()), ("text", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("truncated", pa.bool_()), ("error", pa.string()), ("upto", pa.int64()), ("bytes_in", pa.int64()), ("ms", pa.int64())])
    last = min(n, at + STRETCH_ROWS)
    seconds, first = STRETCH_SECONDS, FIRST_BATCH

    def run(parts):
        limiter = Limiter(RATE_A_SECOND, 1.0, RATE_A_SECOND * 2.5) if client.model != "stub" else None
        began, told, held, done, call, ended = time.monotonic(), document, [], at, 0, False
        for part in parts:
            held += part.column("text").to_pylist()
            rows = []
            while held and not ended:
                size = min(batch_size(told, budget, first), n - done)
                if len(held) < size:
                    break
                text = f"DOCUMENT:\n{told}\n\nOBSERVATIONS:\n" + "\n".join(held[:size])
                since = time.monotonic()
                try:
                    ask = lambda t=text: client.answer("update", prompt, t, most)
                    a = with_retry(ask, limiter) if limiter else ask()
                    out = (a.text, a.input_tokens, a.output_tokens, a.truncated, None)
                except Exception as e:
                    out = (None, 0, 0, False, f"{type(e).__name__}: {e}")
                told, done, held = unfenced(out[0] or ""), done + size, held[size:]
                rows.append((str(call), *out, done, len(text.encode()), round(1000 * (time.monotonic() - since))))
                call += 1
                ended = out[4] is not None or out[3] or time.monotonic() - began > seconds
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            if ended:
                return

    some = todo.filter(F.col("block").between(at // STRETCH_ROWS, (last - 1) // STRETCH_ROWS) & F.col("place").between(at + 1, last))
    return some.select("place", "text").repartition(1).sortWithinPartitions("place").mapInArrow(run, CALLS)


def fold(profile, messages: DataFrame, prompt: str, budget: int = BUDGET_BYTES) -> tuple[str, int]:
    """Folds what is pending into the document of the profile's folder; the document, and how many batches it took."""
    folded_schema = f"source string, conv_id {profile.ids}, idx int, fp string, seq long"
    state = profile.table("fold", STATE)
    last = state.agg(F.max_by(F.struct("seq", "content"), "seq").alias("s")).first()["s"]
    seq, document = (last["seq"], last["content"]) if last else (0, "")
    # what was marked before a document was kept for it is not folded
    done = profile.table("folded", folded_schema).filter(F.col("seq") <= seq)
    times = messages.groupBy(*KEY).agg(F.max("last_modified").alias("last_modified"))
    rows = pending(profile.entries(), times, done).withColumn("block", F.floor((F.col("place") - 1) / STRETCH_ROWS).cast("int"))
    path = f"{profile.folder}/work/fold-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("block").parquet(path)  # a stretch reads one or two blocks
    todo = profile.spark.read.schema(rows.schema).parquet(path)
    n, at, calls = todo.count(), 0, 0
    while at < n:
        made = written(stretch(todo, profile.client, prompt, document, at, n, budget, MOST_TOKENS), f"{profile.folder}/calls/update-{uuid.uuid4().hex[:8]}")
        told = made.withColumn("bytes_out", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text").orderBy("upto").collect()  # a row a call
        good = [r for r in told if r["error"] is None and not r["truncated"]]
        if good:
            upto = good[-1]["upto"]
            document = unfenced(made.filter((F.col("upto") == upto) & F.col("error").isNull()).first()["text"])
            seq, calls = seq + 1, calls + len(good)
            batch = todo.filter(F.col("block").between(at // STRETCH_ROWS, (upto - 1) // STRETCH_ROWS) & F.col("place").between(at + 1, upto))
            upsert(f"{profile.folder}/folded", batch.select(*KEY, "idx", "fp", F.lit(seq).cast("long").alias("seq")), [*KEY, "idx"])
            upsert(f"{profile.folder}/fold", profile.spark.createDataFrame([("document", seq, document)], STATE), ["source"], buckets=1)
            at = upto
        profile.asked_in_turn("update", told, MOST_TOKENS)
    return document, calls
