"""Sources behind an interface that answers in pages: a search that shows only so many hits, and channels that grow.

Both are Python data sources over a transport, which is pickled to the tasks: a client of a service, or what was recorded of one.
The search is cut in ranges of days that show all their hits, of which each task reads some.  Channels are a stream whose offsets are
the last message of each, so Spark's checkpoint is the state of the sync.
"""

from __future__ import annotations

import calendar
import datetime as dt
import time
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model.client import Limiter
from ..operators.incremental import first_of, upsert

#: Hits that a search shows at most, and hits of a page.
MOST_HITS, PAGE = 1000, 100
#: Hits of an Arrow batch, at least.
BATCH = 1000
#: Tasks that a search is read by at least, if it has as many segments, and hits of a task of several segments at most.
TASKS, TASK_HITS = 64, 50_000
#: Seconds before the last known message from which a channel is read again, and seconds to wait where a service doesn't say how many.
OVERLAP, WAIT = 300, 5.0
HIT = "kind string, owner string, repo string, number int, title string, author string, updated_at timestamp"
MESSAGE = "channel string, ts string, thread_ts string, user string, text string, subtype string, bot_id string, reply boolean"


class Busy(Exception):
    """The service asks to wait; `after`: for how many seconds, if it says so."""

    def __init__(self, after: float | None = None):
        super().__init__("busy")
        self.after = after


def patient(call, limiter: Limiter | None = None, sleep=time.sleep):
    """The call's result; a busy service is asked once more, after the time it names."""
    if limiter:
        limiter.acquire()
    try:
        return call()
    except Busy as e:
        sleep(WAIT if e.after is None else e.after)
        return call()


class Search(Protocol):
    """count(): how many hits from the first day to the last; page(): those of one page, numbered from 1, as tuples of HIT."""

    def count(self, kind: str, user: str, first: dt.date, last: dt.date) -> int: ...

    def page(self, kind: str, user: str, first: dt.date, last: dt.date, page: int, size: int) -> list[tuple]: ...


class Segment(InputPartition):
    """Days from first to last with their number of hits; cut: a day that has more than the search shows."""

    def __init__(self, first: dt.date, last: dt.date, hits: int, cut: bool = False):
        self.first, self.last, self.hits, self.cut = first, last, hits, cut


def calendar_parts(first: dt.date, last: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The years of a range, newest first; the months of one within a year; the days of one within a month."""
    day = dt.timedelta(days=1)
    if first.year < last.year:
        begin = [dt.date(y, 1, 1) for y in range(first.year, last.year + 1)]
    elif first.month < last.month:
        begin = [dt.date(first.year, m, 1) for m in range(first.month, last.month + 1)]
    else:
        begin = [first + i * day for i in range((last - first).days + 1)]
    begin[0] = first
    return [(a, b) for a, b in zip(begin, [*(x - day for x in begin[1:]), last])][::-1]


def segments(count, first: dt.date, last: dt.date, most: int = MOST_HITS) -> list[Segment]:
    """Ranges that together hold all hits, each of `most` at most unless it is a day; ranges without hits are left out."""
    hits = count(first, last)
    if not hits:
        return []
    if hits <= most or first == last:
        return [Segment(first, last, hits, hits > most)]
    return [s for a, b in calendar_parts(first, last) for s in segments(count, a, b, most)]


class Segments(InputPartition):
    """What one task reads, of so many tasks."""

    def __init__(self, segments: list[Segment]):
        self.segments, self.share = segments, 1


def together(found: list[Segment], tasks: int = TASKS, most: int = TASK_HITS) -> list[Segments]:
    """Segments side by side as one task each, as long as they have at most a share of `tasks` in all hits, and at most `most`."""
    out, held, room = [], 0, min(most, sum(s.hits for s in found) / tasks)
    for s in found:
        if not out or held + s.hits > room:
            out, held = [*out, Segments([])], 0
        out[-1].segments.append(s)
        held += s.hits
    for part in out:
        part.share = len(out)
    return out


class SearchReader(DataSourceReader):
    def __init__(self, transport, options):
        self.transport, self.kind, self.user = transport, options["kind"], options["user"]
        self.first, self.last = dt.date.fromisoformat(options["first"]), dt.date.fromisoformat(options["last"])
        self.most, self.size = int(options.get("most", MOST_HITS)), int(options.get("page", PAGE))
        self.rate = float(options["rate"]) if "rate" in options else None

    def partitions(self) -> list[Segments]:
        limiter = Limiter(self.rate, min(1.0, self.rate), self.rate) if self.rate else None
        count = lambda a, b: patient(lambda: self.transport.count(self.kind, self.user, a, b), limiter)
        return together(segments(count, self.first, self.last, self.most))

    def read(self, part: Segments) -> Iterator:
        """The segments' hits as Arrow batches; each task has its share of the rate."""
        rate = self.rate / part.share if self.rate else None
        limiter = Limiter(rate, min(1.0, rate), rate) if rate else None
        for segment in part.segments:
            yield from self._pages(segment, limiter)

    def _pages(self, segment: Segment, limiter: Limiter | None) -> Iterator:
        """Pages until one is not full."""
        import pyarrow as pa

        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2 + [pa.timestamp("us", "UTC")]
        names = [c.split()[0] for c in HIT.split(", ")]
        own = [("first", segment.first, pa.date32()), ("last", segment.last, pa.date32()), ("cut", segment.cut, pa.bool_())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            *plain, at = zip(*rows)
            at = [t if t is None or t.tzinfo else t.astimezone() for t in at]
            found = [pa.array(c, k) for c, k in zip([*plain, at], kinds)] + [pa.repeat(pa.scalar(v, k), len(rows)) for _, v, k in own]
            return pa.RecordBatch.from_arrays(found, names=[*names, *(n for n, *_ in own)])

        page, held = 0, []
        while page * self.size < segment.hits:
            page += 1
            rows = patient(lambda: self.transport.page(self.kind, self.user, segment.first, segment.last, page, self.size), limiter)  # noqa: B023
            held += rows
            if len(held) >= BATCH:
                yield batch(held)
                held = []
            if len(rows) < self.size:
                break
        if held:
            yield batch(held)


class SearchSource(DataSource):
    """Hits of a search; `transport` is set by search()."""

    transport: Search

    @classmethod
    def name(cls):
        return "thread_search"

    def schema(self):
        return HIT + ", first date, last date, cut boolean"

    def reader(self, schema):
        return SearchReader(self.transport, self.options)


def search(spark: SparkSession, transport: Search, kind: str, user: str, first: str, last: str, **options) -> DataFrame:
    """HIT, first, last, cut: all hits from one day to another, with the range that found them.  options: most, page, rate (requests a second, of all tasks)."""
    spark.dataSource.register(type("BoundSearch", (SearchSource,), {"transport": transport}))
    made = {"kind": kind, "user": user, "first": first, "last": last} | {k: str(v) for k, v in options.items()}
    return spark.read.format("thread_search").options(**made).load()


class Channels(Protocol):
    """latest(): the last message's ts of each channel; threads(): those with replies in a span, wherever they began; history() and replies(): messages as tuples
    (ts, thread_ts, user, text, subtype, bot_id, reply_count)."""

    def latest(self) -> dict[str, str]: ...

    def threads(self, channel: str, oldest: str, latest: str) -> list[str]: ...

    def history(self, channel: str, oldest: str, latest: str) -> Iterator[tuple]: ...

    def replies(self, channel: str, thread_ts: str) -> Iterator[tuple]: ...


class Span(InputPartition):
    def __init__(self, channel: str, oldest: str, latest: str):
        self.channel, self.oldest, self.latest = channel, oldest, latest


def earlier(ts: str, seconds: int = OVERLAP) -> str:
    """A ts so many seconds before; the fraction stays."""
    whole, dot, rest = ts.partition(".")
    return f"{max(0, int(whole) - seconds)}{dot}{rest}"


def seconds_of(ts: str) -> tuple[int, str]:
    whole, _, rest = ts.partition(".")
    return int(whole), rest


class ChannelReader(DataSourceStreamReader):
    def __init__(self, transport, options):
        self.transport = transport

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return patient(self.transport.latest)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """A channel a task, from OVERLAP before its last known message; channels without news none."""
        moved = [c for c in sorted(end) if c not in start or seconds_of(start[c]) < seconds_of(end[c])]
        return [Span(c, earlier(start[c]) if c in start else "0", end[c]) for c in moved]

    def read(self, span: Span) -> Iterator[tuple]:
        """The channel's messages of the span, and all replies of the threads that began or went on in it."""
        threads = patient(lambda: list(self.transport.threads(span.channel, span.oldest, span.latest)))
        for ts, thread, user, text, subtype, bot, replies in patient(lambda: list(self.transport.history(span.channel, span.oldest, span.latest))):
            if replies:
                threads.append(ts)
            yield (span.channel, ts, thread, user, text, subtype, bot, False)
        for thread in sorted(set(threads)):
            for ts, _, user, text, subtype, bot, _ in patient(lambda: list(self.transport.replies(span.channel, thread))):  # noqa: B023
                if seconds_of(ts) <= seconds_of(span.latest):
                    yield (span.channel, ts, thread, user, text, subtype, bot, True)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the checkpoint."""


class ChannelSource(DataSource):
    """Messages of channels as a stream; `transport` is set by follow()."""

    transport: Channels

    @classmethod
    def name(cls):
        return "channel_messages"

    def schema(self):
        return MESSAGE

    def streamReader(self, schema):
        return ChannelReader(self.transport, self.options)


def follow(spark: SparkSession, transport: Channels, path: str, checkpoint: str) -> None:
    """Merges the messages that have come since the checkpoint into the table at path, by channel and ts; a message of a channel's history counts before the same as a reply."""
    spark.dataSource.register(type("BoundChannels", (ChannelSource,), {"transport": transport}))

    def merge(batch: DataFrame, _: int) -> None:
        rows = first_of(batch, ["channel", "ts"], [F.col("reply"), F.col("thread_ts").asc_nulls_last()])
        if not rows.isEmpty():
            upsert(path, rows, ["channel", "ts"], "channel")

    stream = spark.readStream.format("channel_messages").load().writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()


def plain_path(path: str) -> str:
    """A path as Arrow takes it: file URIs as local paths, others as they are."""
    return urlparse(path).path if path.startswith("file:") else path


def record_hits(hits: DataFrame, path: str) -> None:
    """Writes hits (HIT, day) for RecordedHits: a folder a month, files sorted by day, so that a range of days is found without the others."""
    parts = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), hits.sparkSession.sparkContext.defaultParallelism)
    dated = hits.withColumn("month", F.date_format("day", "yyyy-MM")).repartitionByRange(parts, "month", "day", F.xxhash64("number"))
    dated.sortWithinPartitions("month", "day").write.partitionBy("month").parquet(path)


class RecordedHits:
    """Hits that were recorded in Parquet at a path that Arrow can open: HIT, and the day of each; in folders by month (record_hits()) or as they come.

    The files are listed once, the days of a month are counted together, and the hits of the range that was asked last are kept in their
    order, so its pages are read and sorted once.
    """

    def __init__(self, path: str):
        self.path = plain_path(path)
        self._open()

    def _open(self):
        self._set, self._asked, self._hits, self._days = None, None, None, {}

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.path = state["path"]
        self._open()

    def _found(self, kind, user, first, last):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if self._set is None:
            self._set = ds.dataset(self.path, format="parquet", partitioning=ds.partitioning(pa.schema([("month", pa.string())]), flavor="hive"))
        day, month = pc.field("day"), pc.field("month")
        asked = (pc.field("kind") == kind) & (pc.field("author") == user) & (day >= first) & (day <= last)
        dated = month.is_null() | (month >= f"{first:%Y-%m}") & (month <= f"{last:%Y-%m}")  # files outside of a month's folder have none
        return self._set, asked & dated

    def count(self, kind: str, user: str, first: dt.date, last: dt.date) -> int:
        if (first.year, first.month) != (last.year, last.month):
            hits, asked = self._found(kind, user, first, last)
            return hits.count_rows(filter=asked)
        month = (kind, user, first.year, first.month)
        if month not in self._days:
            end = first.replace(day=calendar.monthrange(first.year, first.month)[1])
            hits, asked = self._found(kind, user, first.replace(day=1), end)
            self._days[month] = {d["values"]: d["counts"] for d in hits.to_table(columns=["day"], filter=asked).column("day").value_counts().to_pylist()}
        return sum(n for day, n in self._days[month].items() if first <= day <= last)

    def page(self, kind: str, user: str, first: dt.date, last: dt.date, page: int, size: int) -> list[tuple]:
        import pyarrow as pa

        names = [c.split()[0] for c in HIT.split(", ")]
        if self._asked != (kind, user, first, last):
            hits, asked = self._found(kind, user, first, last)
            found = hits.to_table(columns=names, filter=asked).sort_by([("updated_at", "descending"), ("number", "ascending")])
            at = names.index("updated_at")
            self._hits = found.set_column(at, "updated_at", found.column(at).cast(pa.timestamp("us"), safe=False)).combine_chunks()
            self._asked = (kind, user, first, last)
        some = self._hits.slice((page - 1) * size, size)
        *plain, at = (some.column(n).to_pylist() for n in names)
        return list(zip(*plain, [t and t.replace(tzinfo=dt.timezone.utc) for t in at]))


def record_messages(messages: DataFrame, path: str) -> None:
    """Adds messages for RecordedChannels: files sorted by channel and thread, so that few hold a channel."""
    parts = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), messages.sparkSession.sparkContext.defaultParallelism)
    messages.repartitionByRange(parts, "channel", "thread_ts", "ts").sortWithinPartitions("channel", "thread_ts", "ts").write.mode("append").parquet(path)


class RecordedChannels:
    """Messages that were recorded in Parquet at a path that Arrow can open: channel, ts, thread_ts, user, text, subtype, bot_id, reply_count; rows with a thread_ts are replies.

    A task's channel is read once: its replies are kept sorted by thread, so that those of a thread are a slice.
    """

    def __init__(self, path: str):
        self.path = plain_path(path)
        self._of, self._replies, self._threads = None, None, {}

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(state["path"])

    def _rows(self, columns: list[str], asked=None):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet").scanner(columns=columns, filter=asked).to_batches()

    def latest(self) -> dict[str, str]:
        """Of each file's batch and channel the last whole second, and of its messages the last; one message a channel is kept."""
        import pyarrow.compute as pc

        out: dict[str, str] = {}
        for b in self._rows(["channel", "ts"]):
            for channel in pc.unique(b.column("channel")).drop_null().to_pylist():
                ts = b.column("ts").filter(pc.equal(b.column("channel"), channel)).drop_null()
                whole = pc.cast(pc.replace_substring_regex(ts, r"\..*", ""), "int64")
                last = max(ts.filter(pc.equal(whole, pc.max(whole))).to_pylist(), key=seconds_of, default=None)
                if last is not None and (channel not in out or seconds_of(out[channel]) < seconds_of(last)):
                    out[channel] = last
        return out

    COLUMNS = ["ts", "thread_ts", "user", "text", "subtype", "bot_id", "reply_count"]

    def _kept(self, channel: str):
        """The channel's replies by thread, and where each thread's begin and end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self._of != channel:
            asked = (pc.field("channel") == channel) & pc.field("thread_ts").is_valid()
            batches = list(self._rows(self.COLUMNS, asked))
            self._replies = pa.Table.from_batches(batches).sort_by([("thread_ts", "ascending"), ("ts", "ascending")]).combine_chunks() if batches else None
            runs = pc.run_end_encode(self._replies.column("thread_ts").combine_chunks()) if batches and self._replies.num_rows else None
            runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
            ends = runs.run_ends.to_pylist() if runs is not None else []
            self._threads = dict(zip(runs.values.to_pylist() if runs is not None else [], zip([0, *ends], ends)))
            self._of = channel
        return self._replies, self._threads

    def threads(self, channel: str, oldest: str, latest: str) -> list[str]:
        replies, threads = self._kept(channel)
        if not threads:
            return []
        low, high = seconds_of(oldest), seconds_of(latest)
        return [t for ts, t in zip(replies.column("ts").to_pylist(), replies.column("thread_ts").to_pylist()) if low <= seconds_of(ts) <= high]

    def history(self, channel: str, oldest: str, latest: str) -> Iterator[tuple]:
        import pyarrow.compute as pc

        low, high = seconds_of(oldest), seconds_of(latest)
        for b in self._rows(self.COLUMNS, (pc.field("channel") == channel) & pc.field("thread_ts").is_null()):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if low <= seconds_of(row[0]) <= high:
                    yield row

    def replies(self, channel: str, thread_ts: str) -> Iterator[tuple]:
        replies, threads = self._kept(channel)
        begin, end = threads.get(thread_ts, (0, 0))
        if end > begin:
            some = replies.slice(begin, end - begin)
            yield from zip(*(some.column(c).to_pylist() for c in self.COLUMNS))
