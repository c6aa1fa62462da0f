"""Requests in, responses out: a table each, so that no model call is made twice for one plan."""

from __future__ import annotations

import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .client import Client, Limiter, Throttled, with_retry

REQUEST = "req_id string, stage string, system string, input string, max_tokens int"
RESPONSE = "req_id string, text string, input_tokens long, output_tokens long, truncated boolean, error string"
#: Requests a second of a stage, to begin with.
RATE_A_SECOND = 20.0
_own: list[str] = []


def work_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; an own one where none is set and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tracelens-"))
        root = _own[0]
    return root


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def asked() -> list[Column]:
    """What is observed of requests as they are sent."""
    return [F.count("*").alias("requests"), F.coalesce(F.sum(F.octet_length("input")), F.lit(0)).cast("long").alias("bytes_in")]


def told() -> list[Column]:
    """What is observed of responses as they are written."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("truncated").alias("cut"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        total(F.octet_length("text")).alias("bytes_out"), F.min("error").alias("error"),
    ]


def respond(requests: DataFrame, client: Client, tasks: int, rate: float = RATE_A_SECOND, path: str | None = None, metrics: dict | None = None) -> DataFrame:
    """Answers each request (REQUEST) once and writes the answers; errors are a column, successes stay.

    Largest first over `tasks` partitions; the rate is divided by them, as each has a limiter of its own.  metrics is filled with what
    asked() and told() observe while the answers are written, and the milliseconds that it took.
    """
    spark = requests.sparkSession
    schema = pa.schema([("req_id", pa.string()), ("text", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("truncated", pa.bool_()), ("error", pa.string())])

    def run(parts):
        limiter = Limiter(rate / tasks, min(1.0, rate / tasks), rate / tasks * 2.5) if client.model != "stub" else None
        for part in parts:
            rows = []
            for req, stage, system, text, most in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    call = lambda s=stage, y=system, t=text, m=most: client.answer(s, y, t, m)
                    a = with_retry(call, limiter) if limiter else call()
                    rows.append((req, a.text, a.input_tokens, a.output_tokens, a.truncated, None))
                except Exception as e:  # one request's failure is its own
                    rows.append((req, None, 0, 0, False, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    dealt = requests.select("req_id", "stage", "system", "input", "max_tokens").repartition(tasks, "req_id").sortWithinPartitions(F.desc(F.length("input")))
    before, after, began = Observation(), Observation(), time.monotonic()
    out = written(dealt.observe(before, *asked()).mapInArrow(run, RESPONSE).observe(after, *told()), path or f"{work_root(spark)}/responses-{uuid.uuid4().hex[:12]}")
    if metrics is not None:
        metrics.update(before.get | after.get | {"ms": round(1000 * (time.monotonic() - began))})
    return out


#: Seconds of requests that a wave sends.
WAVE_SECONDS = 30.0
RATE = "wave int, rate double, sent long, answered long, throttled long"


def next_rate(rate: float, answered: int, throttled: int, least: float = 1.0, most: float = 50.0) -> float:
    """The rate after a wave: half if the service throttled, else one more for each ten answers."""
    return max(least, rate / 2) if throttled else min(most, rate + answered // 10)


def respond_in_waves(requests: DataFrame, client: Client, tasks: int, path: str, seed: float = 20.0, least: float = 1.0, most: float = 50.0, seconds: float = WAVE_SECONDS, sleep=time.sleep) -> DataFrame:
    """Answers requests (REQUEST) at one rate for all tasks together, which every wave's outcome moves; answers and rates are tables under path.

    A wave is as many requests as the rate allows in `seconds`, dealt over `tasks` tasks that each send at their share of it.  A task that is
    throttled sends nothing more in its wave; what was not answered comes again in a later one.  A run that is started again goes on with
    the last wave's rate and with what has no answer yet.
    """
    from ..operators.incremental import exists, subfolders
    from ..operators.ordered import ranked

    spark = requests.sparkSession
    schema = pa.schema([("req_id", pa.string()), ("text", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("truncated", pa.bool_()), ("error", pa.string()), ("state", pa.string())])

    def run(pause: float):
        def send(parts):
            held, due = False, time.monotonic()
            for part in parts:
                rows = []
                for req, stage, system, text, most_tokens in zip(*(part.column(c).to_pylist() for c in ("req_id", "stage", "system", "input", "max_tokens"))):
                    if held:
                        rows.append((req, None, 0, 0, False, None, "held"))
                        continue
                    sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + pause
                    try:
                        a = client.answer(stage, system, text, most_tokens)
                        rows.append((req, a.text, a.input_tokens, a.output_tokens, a.truncated, None, "answered"))
                    except Throttled:
                        held = True
                        rows.append((req, None, 0, 0, False, None, "throttled"))
                    except Exception as e:  # one request's failure is its own
                        rows.append((req, None, 0, 0, False, f"{type(e).__name__}: {e}", "answered"))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        return send

    def waves() -> list[int]:
        return sorted(int(n.removeprefix("wave-")) for n in subfolders(spark, path) if n.startswith("wave-") and exists(spark, f"{path}/{n}/_SUCCESS"))

    def answered() -> DataFrame:
        done = [spark.read.parquet(f"{path}/wave-{w}") for w in waves()]
        out = done[0] if done else spark.createDataFrame([], RESPONSE + ", state string")
        for d in done[1:]:
            out = out.unionByName(d)
        return out.filter("state = 'answered'").drop("state")

    wave = max(waves(), default=0)
    rate = seed
    if wave:
        last = spark.read.schema(RATE).parquet(f"{path}/rate").filter(F.col("wave") == wave).first()
        rate = next_rate(last["rate"], last["answered"], last["throttled"], least, most) if last else seed
    while True:
        left = requests.select("req_id", "stage", "system", "input", "max_tokens").join(answered().select("req_id"), "req_id", "left_anti")
        left = written(ranked(left.withColumn("spread", F.xxhash64("req_id")), "spread", ["req_id"], "place"), f"{path}/left-{wave}")
        n, at = left.count(), 0
        if not n:
            return answered()
        while at < n:
            size = max(1, int(rate * seconds))
            wave += 1
            some = left.filter(F.col("place").between(at + 1, at + size)).repartition(tasks, "place")
            seen = Observation()
            sent = some.mapInArrow(run(tasks / rate), RESPONSE + ", state string").observe(seen, F.count_if(F.col("state") != "held").alias("sent"), F.count_if((F.col("state") == "answered") & F.col("error").isNull()).alias("answered"), F.count_if(F.col("state") == "throttled").alias("throttled"))
            sent.write.mode("overwrite").parquet(f"{path}/wave-{wave}")
            got = seen.get
            spark.createDataFrame([(wave, float(rate), got["sent"], got["answered"], got["throttled"])], RATE).coalesce(1).write.mode("append").parquet(f"{path}/rate")
            rate, at = next_rate(rate, got["answered"], got["throttled"], least, most), at + size
            if got["throttled"]:
                sleep(min(seconds, 5.0))
