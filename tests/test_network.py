"""Searches in ranges, channels as a stream, one rate for all tasks, what stages observe, and the fold."""

import datetime as dt
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracelens.model.client import StubClient, Throttled
from tracelens.model.stage import RATE, next_rate, respond_in_waves
from tracelens.operators.incremental import table_rows
from tracelens.plans import fold
from tracelens.plans.profile import Profile
from tracelens.sources import network as N

DAY = dt.timedelta(days=1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_segments_hold_all_hits_and_are_small():
    rng = random.Random(1)
    first, last = dt.date(2019, 3, 5), dt.date(2023, 8, 20)
    days = [first + rng.randrange((last - first).days + 1) * DAY for _ in range(900)] + [dt.date(2022, 2, 28)] * 150
    asked = []

    def count(a, b):
        asked.append((a, b))
        return sum(a <= d <= b for d in days)

    found = N.segments(count, first, last, 100)
    assert [s.first for s in found] == sorted((s.first for s in found), reverse=True)
    assert all(s.hits == count(s.first, s.last) and (s.hits <= 100 or (s.cut and s.first == s.last)) for s in found)
    assert sum(s.hits for s in found) == len(days) and sum(s.cut for s in found) == 1
    whole = [d for s in found for d in days if s.first <= d <= s.last]
    assert sorted(whole) == sorted(days)
    assert N.segments(lambda a, b: 0, first, last) == [] and len(N.segments(lambda a, b: 5, first, last)) == 1
    assert N.calendar_parts(dt.date(2020, 2, 27), dt.date(2020, 2, 29))[0] == (dt.date(2020, 2, 29), dt.date(2020, 2, 29))


class Busying:
    """A search over a list of days that is busy each third time it is asked."""

    def __init__(self, days):
        self.days, self.asked = days, 0

    def _turn(self):
        self.asked += 1
        if self.asked % 3 == 0:
            raise N.Busy(0.01)

    def count(self, kind, user, first, last):
        self._turn()
        return sum(first <= d <= last for d in self.days)

    def page(self, kind, user, first, last, page, size):
        self._turn()
        found = [i for i, d in enumerate(self.days) if first <= d <= last][(page - 1) * size : page * size]
        return [(kind, "o", "r", i, "t", user, dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)) for i in found]


def test_search_reads_every_hit_once(spark):
    rng = random.Random(2)
    days = [dt.date(2020, 1, 1) + rng.randrange(900) * DAY for _ in range(400)] + [dt.date(2021, 5, 5)] * 60
    rows = N.search(spark, Busying(days), "issues", "me", "2020-01-01", "2022-12-31", most=50, page=7)
    got = rows.collect()
    assert rows.rdd.getNumPartitions() > 8
    assert sorted(r.number for r in got) == list(range(460))
    assert all(r.first <= days[r.number] <= r.last for r in got) and sum(r.cut for r in got) >= 60


def test_patience_ends_after_one_more_try():
    waited = []

    def busy():
        raise N.Busy()

    with pytest.raises(N.Busy):
        N.patient(busy, sleep=waited.append)
    assert waited == [N.WAIT]


def test_channels_in_two_runs_equal_one(spark, tmp_path):
    rows = []
    for c in ("c1", "c2"):
        for i in range(40):
            ts = f"{1000 + 100 * i}.{i:06d}"
            rows.append((c, ts, None, "u", f"{c} message {i}", None, None, 1 if i % 5 == 0 else 0))
            if i % 5 == 0:  # a reply soon after, and one much later
                rows.append((c, f"{1000 + 100 * i + 7}.5", ts, "v", f"{c} reply {i}", None, None, 0))
                rows.append((c, f"{1000 + 100 * i + 2000}.7", ts, "v", f"{c} late {i}", None, None, 0))
    schema = "channel string, ts string, thread_ts string, user string, text string, subtype string, bot_id string, reply_count long"
    at = lambda r: float(r[1])

    def run(name, parts):
        for part in parts:
            spark.createDataFrame(part, schema).write.mode("append").parquet(f"file://{tmp_path}/{name}/recorded")
            N.follow(spark, N.RecordedChannels(f"file://{tmp_path}/{name}/recorded"), f"file://{tmp_path}/{name}/messages", f"file://{tmp_path}/{name}/checkpoint")
        return sorted(map(tuple, table_rows(spark, f"file://{tmp_path}/{name}/messages", N.MESSAGE).select("channel", "ts", "thread_ts", "text").collect()), key=repr)

    rows.sort(key=at)
    half = len(rows) // 2
    whole = run("one", [rows])
    # a message that comes late, but within the overlap, is found by the next run
    late = [[r for r in rows[:half] if r[0] == c and r[2] is None][-2] for c in ("c1", "c2")]
    twice = run("two", [[r for r in rows[:half] if r not in late], rows[half:] + late])
    assert whole == twice == sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=repr)


def test_rate_moves_as_waves_go():
    assert next_rate(20, 55, 0) == 25 and next_rate(49, 300, 0) == 50 and next_rate(20, 90, 3) == 10 and next_rate(1.5, 0, 1) == 1


class Timed(StubClient):
    """Answers that say when they were made; one request is throttled until a file is there."""

    model = "timed"

    def __init__(self, folder):
        self.folder = folder

    def answer(self, stage, system, text, max_tokens):
        import os
        import uuid

        if text == "request 7" and not os.path.exists(f"{self.folder}/seen"):
            open(f"{self.folder}/seen", "w").close()
            raise Throttled
        if text == "request 9":
            raise ValueError("no answer")
        open(f"{self.folder}/{time.time()}-{uuid.uuid4().hex[:6]}", "w").close()
        return super().answer(stage, system, text, max_tokens)


@pytest.mark.parametrize("tasks", [1, 4])
def test_one_rate_for_all_tasks(spark, tmp_path, tasks):
    import os

    (tmp_path / "log").mkdir()
    requests = spark.createDataFrame([(str(i), "summarize", "", f"request {i}", 10) for i in range(60)], "req_id string, stage string, system string, input string, max_tokens int")
    path = f"file://{tmp_path}/waves"
    out = respond_in_waves(requests, Timed(str(tmp_path / "log")), tasks, path, seed=20, most=24, seconds=1.0)
    rows = {r.req_id: r for r in out.collect()}
    assert len(rows) == out.count() == 60 and rows["9"].error == "ValueError: no answer" and all(r.text for i, r in rows.items() if i != "9")
    times = sorted(float(n.split("-")[0]) for n in os.listdir(tmp_path / "log") if n != "seen")
    # within any second no more than the rate allows, and one a task that may begin at once
    assert max(sum(t <= u < t + 1 for u in times) for t in times) <= 24 + tasks
    rates = spark.read.schema(RATE).parquet(f"{path}/rate").orderBy("wave").collect()
    assert sum(r.throttled for r in rates) == 1 and rates[0].rate == 20 and any(b.rate == a.rate / 2 for a, b in zip(rates, rates[1:]) if a.throttled)
    # a run that is started again sends nothing
    again = respond_in_waves(requests, Timed(str(tmp_path / "log")), tasks, path, seed=20, most=24, seconds=1.0)
    assert again.count() == 60 and len(os.listdir(tmp_path / "log")) == len(times) + 1


def test_fold_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    rows = [("codex", c, t, "user" if t % 2 == 0 else "assistant", f"message {t} of conversation {c}, long enough to say something", 100 - c) for c in range(12) for t in range(8)]
    m = spark.createDataFrame(rows, "source string, conv_id long, turn long, role string, text string, last_modified long")
    monkeypatch.setattr(fold, "FIRST_BATCH", 12)

    class Failing(StubClient):
        def _update(self, text):
            if text.count("\n") > 30:
                raise OSError("cut off")
            return super()._update(text)

    p = Profile(spark, f"file://{tmp_path}/p", Failing())
    with pytest.raises(RuntimeError, match="cut off"):
        p.incremental(m, 1)
    q = Profile(spark, f"file://{tmp_path}/p")
    assert q.incremental(m, 2)["updates"] >= 1
    # a plain loop: oldest conversations first, the stand-in keeps the last forty lines
    want = [f"message {t} of conversation {c}, long enough to say something" for c in sorted(range(12), reverse=True) for t in range(0, 8, 2)]
    assert q.show().splitlines() == want[-40:]
    assert q.incremental(m, 3)["updates"] == 0
    stages = [(r.source, r.stage, r.requests, r.failed) for r in q.run_metrics().filter("stage = 'update'").collect()]
    assert ("incremental", "update", 1, 1) in stages and sum(f for *_, f in stages) == 1
    assert [fold.batch_size("x" * n, 100) for n in (0, 50, 100, 900)] == [12, 10, 10, 10]
