"""What shows only in larger tables: keys that repeat, plans that adaptive execution changes, and work that grows faster than the rows."""

import pytest
from pyspark.sql import functions as F

from test_queries import plain

from tracelens.operators import sessions as S
from tracelens.operators import turns as U
from tracelens.plans import QUERIES, SQL


def against_sql(spark, folder, name, tables):
    """The rows of a query and of its SQL over tables of the folder."""
    con = pytest.importorskip("duckdb").connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()), sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall())


@pytest.fixture(scope="module")
def shared_urls(spark, tmp_path_factory):
    """Pages of which three share each URL."""
    folder = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([(i, f"https://a.example/{i % 14}", "<p>x</p>") for i in range(42)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_requests_of_pages_that_share_a_url(spark, shared_urls):
    got, want = against_sql(spark, shared_urls, "etag_requests", ["pages"])
    assert len(want) == 42 and got == want


def test_answers_of_pages_that_share_a_url(spark, shared_urls):
    got, want = against_sql(spark, shared_urls, "etag_answers", ["pages"])
    assert len(want) == 42 and got == want


def test_responses_of_one_key_stay_apart(spark):
    headers = F.create_map(F.lit("Link"), F.lit("x"))
    cache = spark.createDataFrame([("k", "t", 200, "old")], "key string, etag string, status int, body string").withColumn("headers", headers)
    said = spark.createDataFrame([("k", None, 304, "a", 1), ("k", "n", 200, "b", 2), ("other", None, 304, "c", 3)], "key string, etag string, status int, body string, request int").withColumn("headers", headers)
    got = {r.request: (r.key, r.etag, r.status, r.body) for r in S.answered(said, cache).collect()}
    assert got == {1: ("k", "t", 200, "old"), 2: ("k", "n", 200, "b"), 3: ("other", None, 304, "c")}


@pytest.mark.parametrize("small", ["-1", "20k"])
def test_chunks_of_a_channel_whose_join_is_planned_anew(spark, small):
    """Where adaptive execution makes a broadcast join of the join with the owned channels, or splits a skewed one, a channel stays one stream."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": small, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        m = spark.range(0, 4000, 1, 8).select(F.when(i % 10 < 8, "hot").otherwise(F.concat(F.lit("c"), (i % 10).cast("string"))).alias("channel"), i.alias("pos"), i.alias("ts"), F.lit("user").alias("role"), F.lit(False).alias("noise"), F.repeat(F.lit("x"), (i % 37).cast("int")).alias("content"), F.lit("t").alias("raw"))
        got = {(r.channel, r.chunk): (r.n, r.n_bytes, r.created) for r in U.channel_chunks(m, 500).collect()}
        rows = U.channel_chunks(m, 500).count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want: dict = {}
    for channel in ("hot", "c8", "c9"):
        chunk = used = 0
        for x in range(4000):
            if ("hot" if x % 10 < 8 else f"c{x % 10}") == channel:
                if used + x % 37 > 500:
                    used, chunk = 0, chunk + 1
                n, b, first = want.get((channel, chunk), (0, 0, x))
                want[channel, chunk], used = (n + 1, b + x % 37, first), used + x % 37
    assert got == want and rows == len(want)


def test_pages_of_recorded_hits_are_read_once(spark, tmp_path, monkeypatch):
    """A day's pages and a month's counts take one read each, and only of the month's files; the hits come in the service's order."""
    import datetime as dt

    import pyarrow.dataset as ds

    from tracelens.sources import network as N

    day = F.date_add(F.lit("2020-01-30").cast("date"), (F.col("id") % 5).cast("int"))
    hits = spark.range(1000).select(F.lit("issues").alias("kind"), F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("id").cast("int").alias("number"), F.lit("t").alias("title"), F.lit("me").alias("author"), day.cast("timestamp").alias("updated_at"), day.alias("day"))
    N.record_hits(hits, f"file://{tmp_path}/hits")
    hits.write.parquet(f"file://{tmp_path}/plain")
    asked = []
    real = ds.FileSystemDataset.to_table

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def to_table(self, **how):
            asked.append(sorted({f.path.split("month=")[1][:7] for f in self.inner.get_fragments(how["filter"]) if "month=" in f.path}))
            return real(self.inner, **how)

        def count_rows(self, **how):
            return self.inner.count_rows(**how)

    for name in ("hits", "plain"):
        asked.clear()
        r = N.RecordedHits(f"file://{tmp_path}/{name}")
        opened = ds.dataset
        monkeypatch.setattr(ds, "dataset", lambda *a, opened=opened, **b: Watched(opened(*a, **b)))
        found = N.segments(lambda a, b, r=r: r.count("issues", "me", a, b), dt.date(2020, 1, 1), dt.date(2020, 12, 31), 50)
        rows = [x for s in found for k in range(1, 6) for x in r.page("issues", "me", s.first, s.last, k, 50)]
        monkeypatch.setattr(ds, "dataset", opened)
        assert [s.hits for s in found] == [200] * 5 and [x[3] for x in rows] == sorted(range(1000), key=lambda i: (-(i % 5), i))
        assert len(asked) == 12 + 5  # each month's days, five days' pages
        assert name == "plain" or all(len(m) <= 1 for m in asked)


def test_segments_are_read_together():
    import datetime as dt

    from tracelens.sources import network as N

    day = dt.date(2020, 1, 1)
    found = [N.Segment(day, day, 1 + i % 7) for i in range(3000)]
    parts = N.together(found, 64, 100)
    assert [s for p in parts for s in p.segments] == found and 64 < len(parts) < 200 and all(p.share == len(parts) for p in parts)
    assert all(sum(s.hits for s in p.segments) <= 100 for p in parts) and len(N.together(found[:5], 64)) == 5 and N.together([]) == []


def test_replies_of_a_channel_are_read_once(spark, tmp_path, monkeypatch):
    """The replies of all threads of a channel take one read, and a reader of another channel does not see them."""
    from tracelens.sources import network as N

    schema = "channel string, ts string, thread_ts string, user string, text string, subtype string, bot_id string, reply_count long"
    rows = [(c, f"{100 * t + k}.5", f"{100 * t}.0" if k else None, "u", f"{c}{t}-{k}", None, None, 0 if k else 3) for c in "ab" for t in range(50) for k in range(4)]
    N.record_messages(spark.createDataFrame(rows, schema), f"file://{tmp_path}/recorded")
    r, read = N.RecordedChannels(f"file://{tmp_path}/recorded"), []
    real = N.RecordedChannels._rows
    monkeypatch.setattr(N.RecordedChannels, "_rows", lambda self, *a: read.append(a) or real(self, *a))
    assert r.latest() == {"a": "4903.5", "b": "4903.5"}
    for c in "ab":
        read.clear()
        threads = r.threads(c, "0", "99999")
        got = [x[3] for t in sorted(set(threads), key=float) for x in r.replies(c, t)]
        assert got == [f"{c}{t}-{k}" for t in range(50) for k in range(1, 4)] and len(threads) == 150 and len(read) == 1
        assert list(r.replies(c, "7.0")) == [] and r.threads(c, "4901", "4902.5") == ["4900.0"] * 2
        assert sorted(x[3] for x in r.history(c, "0", "99999")) == sorted(f"{c}{t}-0" for t in range(50))


def test_fold_makes_calls_in_stretches(spark, tmp_path, monkeypatch):
    """What Spark writes for a fold does not grow with its calls; a call that fails keeps those before it, and its metrics."""
    from tracelens.model.client import StubClient
    from tracelens.plans import fold
    from tracelens.plans.profile import Profile

    rows = [("codex", c, t, "user" if t % 2 == 0 else "assistant", f"message {t} of conversation {c}, long enough to say something", c) for c in range(40) for t in range(8)]
    m = spark.createDataFrame(rows, "source string, conv_id long, turn long, role string, text string, last_modified long")
    want = [f"message {t} of conversation {c}, long enough to say something" for c in range(40) for t in range(0, 8, 2)]
    monkeypatch.setattr(fold, "FIRST_BATCH", 10)
    kept = []
    real = fold.upsert
    monkeypatch.setattr(fold, "upsert", lambda *a, **b: kept.append(a[0]) or real(*a, **b))

    class Failing(StubClient):
        def _update(self, text):
            if "message 0 of conversation 30," in text.partition("OBSERVATIONS:")[2]:
                raise OSError("cut off")
            return "```\n" + super()._update(text) + "\n```"

    p = Profile(spark, f"file://{tmp_path}/p", Failing())
    with pytest.raises(RuntimeError, match="cut off"):
        p.incremental(m, 1)
    assert len(kept) == 2 and p.table("folded", "source string").count() == 120
    found = p.run_metrics().filter("stage = 'update'").agg(F.sum("requests"), F.sum("failed"), F.sum("bytes_in") > 0).first()
    assert tuple(found) == (13, 1, True)
    kept.clear()
    monkeypatch.setattr(fold, "STRETCH_ROWS", 25)  # the rest in two stretches
    last = Profile(spark, f"file://{tmp_path}/p")
    assert last.incremental(m, 2)["updates"] == 4 and last.show().splitlines() == want[-40:] and len(kept) == 4


def test_fences_of_one_text(spark):
    from tracelens.functions.text import strip_code_fence, unfenced

    texts = ["a", " a\n", "```", "```x\nb\n```", "\u3000```\nb\n\n``` \n", "```b```", "``` b", "a\n```", "```\n```\nb", "\x1fa", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_code_fence("t").alias("s")).collect()
    assert all(unfenced(r.t) == r.s for r in rows)
