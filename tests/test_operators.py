import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracelens.functions import parse, text
from tracelens.model.client import Limiter, StubClient, Throttled, with_retry
from tracelens.operators import incremental, ordered, turns
from tracelens.plans.profile import Profile


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s,want", [("", True), ("  \n", True), ("None", True), ("NONE.", True), ("n/a", True), ("(empty response)", True), ("none of it", False), ("Real text", False), (None, True)])
def test_is_empty(spark, s, want):
    assert one(spark, text.is_empty("s"), s=s) is want


@pytest.mark.parametrize("s,want", [("Prefers small, reviewable changes", True), ("too short", False), ("(no observations were found in this)", False), ("[an observation in brackets]", False), ("I don't see anything distinctive", False), (None, False)])
def test_is_relevant(spark, s, want):
    assert one(spark, text.is_relevant("s"), s=s) is want


@pytest.mark.parametrize("s,want", [
    ("Observation: a", [(None, "a")]), ("Quote: \"q\"\nObservation: a", [("q", "a")]), ("Quote: q\n\nObservation: a", [("q", "a")]), ("Quote: q\ntalk\nObservation: a", [(None, "a")]),
    ("- Observation: a\n2. Observation: b", [(None, "a"), (None, "b")]), ("-- Observation: a", []), ("Observation:", []), ("Quote: x\nQuote: y\nObservation: a", [("y", "a")]), ("Quote: “q”\nObservation: a", [("q", "a")]), ("", []),
])
def test_observations(spark, s, want):
    assert [(r["quote"], r["observation"]) for r in one(spark, parse.observations("s"), s=s)] == want


def test_byte_cut_keeps_characters(spark):
    rng = random.Random(1)
    for _ in range(12):
        s = "".join(rng.choice("aé→😀") for _ in range(rng.randint(0, 20)))
        n = rng.randint(4, 30)
        raw = s.encode()
        want = s if len(raw) <= n else raw[:n].decode(errors="ignore") + "..."
        assert one(spark, text.byte_cut("s", n), s=s) == want


def test_code_blocks(spark):
    assert one(spark, text.strip_code_blocks("s"), s="a\n```py\nx\n```\nb") == "a\n[code block]\nb\n"
    assert one(spark, text.strip_code_blocks("s"), s="a\n```\nrest") == "a\n[code block]\n"


def test_fill_matches_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 3)}", i, rng.randint(0, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, n long")
    want = {}
    for key in {r[0] for r in rows}:
        used = chunk = 0
        for i, (_, pos, n) in enumerate(sorted(r for r in rows if r[0] == key)):
            if i and used + n > 100:
                used, chunk = 0, chunk + 1
            used += n
            want[key, pos] = chunk
    got = {(r.k, r.pos): r.chunk for r in turns.fill_ordered(df, ["k"], ["pos"], "n", 100).collect()}
    assert got == want


def test_upsert_merges_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    mk = lambda rows: spark.createDataFrame(rows, "source string, id int, v string")
    incremental.upsert(path, mk([("a", 1, "x"), ("b", 1, "x")]), ["source", "id"])
    incremental.upsert(path, mk([("a", 1, "y"), ("a", 2, "z")]), ["source", "id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("source", "id", "v").collect()) == [("a", 1, "y"), ("a", 2, "z"), ("b", 1, "x")]


def test_limiter_and_retry():
    now = [0.0]
    limiter = Limiter(4, 1, 5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(10):
        limiter.success()
    assert limiter.rate == 5
    limiter.throttled()
    limiter.throttled()
    assert limiter.rate == 2.5
    now[0] += 31
    limiter.acquire()
    assert limiter.rate == 4
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Throttled
        return "ok"

    assert with_retry(flaky, limiter) == "ok" and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        with_retry(lambda: 1 / 0, limiter)


def test_profile_reuses_what_is_done_and_reports_failures(spark, tmp_path):
    class Failing(StubClient):
        def _observe(self, text):
            raise ValueError("no")

    rows = [(s, c, t, "user" if t % 2 else "assistant", f"message {t} of conversation {c} says enough", 5) for s, c in (("codex", 1), ("slack", 2)) for t in range(1, 6)]
    m = spark.createDataFrame(rows, "source string, conv_id long, turn long, role string, text string, last_modified long")
    p = Profile(spark, f"file://{tmp_path}/p")
    assert p.observe(m, limit=1) == {"processed": 1, "remaining": 1}
    assert p.observe(m) == {"processed": 1, "remaining": 0}
    p.usage.clear()
    assert p.observe(m) == {"processed": 0, "remaining": 0} and sum(u[1] for u in p.usage) == 0
    assert p.clustered(m, 7, least=1)["clusters"] >= 1
    assert p.versions().first()["content"].startswith("# Profile")
    with pytest.raises(RuntimeError, match="no"):
        Profile(spark, f"file://{tmp_path}/q", Failing()).observe(m)


def test_many_labels_are_mapped_to_themes(spark, tmp_path):
    class Partly(StubClient):
        def _theme_map(self, text):  # sixty labels a call, and never those that end in 9
            labels = [x.removeprefix("- ") for x in text.partition("LABELS:\n")[2].splitlines()]
            return "\n".join(f'- "{x.upper()}" → Theme {x[-1]} ' for x in [x for x in labels if x[-1] != "9"][:60])

    p = Profile(spark, f"file://{tmp_path}/p", Partly())
    rows = [("codex", i, "f", 0, f"label {i}") for i in range(130)]
    spark.createDataFrame(rows[:50], p.LABELS).write.parquet(f"{p.folder}/labels")
    assert p.theme() is None
    spark.createDataFrame(rows, p.LABELS).write.mode("overwrite").parquet(f"{p.folder}/labels")
    got = {r.label: r.theme for r in p.theme().collect()}
    assert got == {f"label {i}": f"label {i}" if i % 10 == 9 else f"theme {i % 10}" for i in range(130)}
    assert [u[:2] for u in p.usage] == [("theme_identify", 1), ("theme_map", 2), ("theme_map", 1), ("theme_map", 1)]
    p.usage.clear()
    assert {r.label: r.theme for r in p.theme().collect()} == got and not p.usage


def test_sources(spark, tmp_path):
    from tracelens.sources import coding, people, sqlite

    root = tmp_path / "claude"
    (root / "projects/p/s1/subagents").mkdir(parents=True)
    (root / "history.jsonl").write_text(json.dumps({"display": "Named", "sessionId": "s1"}) + "\n")
    ev = lambda t, role, content, **k: json.dumps({"type": role, "timestamp": f"2024-01-01T00:00:0{t}Z", "cwd": "/w", "message": {"role": role, "content": content, **k}})
    (root / "projects/p/s1.jsonl").write_text("\n".join([ev(1, "user", "hello"), "not json", ev(2, "assistant", [{"type": "text", "text": "part"}]), ev(3, "assistant", [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"a": 1}}], stop_reason="end", model="m")]))
    (root / "projects/p/s1/subagents/c1.jsonl").write_text(ev(4, "user", "child"))
    got = {r.conversation_id: r for r in coding.claude_code(spark, str(root)).collect()}
    assert got["s1"].title == "Named" and [(m.role, m.content) for m in got["s1"].messages] == [("user", "hello"), ("assistant", "hi")]
    assert got["s1"].messages[1].tools[0].name == "ls" and got["c1"].parent_id == "s1" and got["s1"].project == "/w"

    root = tmp_path / "codex"
    (root / "sessions").mkdir(parents=True)
    (root / "session_index.jsonl").write_text(json.dumps({"id": "x", "thread_name": "T", "updated_at": "2024-01-02T00:00:00Z"}))
    row = lambda t, kind, **p: json.dumps({"timestamp": f"2024-01-01T00:00:0{t}Z", "type": kind, "payload": p})
    (root / "sessions/a.jsonl").write_text("\n".join([row(0, "session_meta", id="x", cwd="/c"), row(1, "event_msg", type="user_message", message="u"), row(2, "event_msg", type="agent_message", message="a"), row(3, "event_msg", type="agent_message", message="b"), row(4, "response_item", type="function_call", name="f", call_id="1", arguments="{}"), row(5, "response_item", type="function_call_output", call_id="1", output="text")]))
    r = coding.codex(spark, str(root)).first()
    assert (r.conversation_id, r.title) == ("x", "T") and [(m.role, m.content) for m in r.messages] == [("user", "u"), ("assistant", "a\nb")]
    assert (r.messages[1].tools[0].name, r.messages[1].tools[0].output) == ("f", '"text"')

    db = str(tmp_path / "o.db")
    con = sqlite3.connect(db)
    con.executescript("CREATE TABLE project(id, worktree); CREATE TABLE session(id, title, parent_id, project_id, time_created, time_updated); CREATE TABLE message(id, session_id, data, time_created); CREATE TABLE part(id, message_id, data, time_created);")
    con.execute("INSERT INTO project VALUES ('p', '/w')")
    con.execute("INSERT INTO session VALUES ('s', 'T', NULL, 'p', 1000, 2000)")
    con.execute("INSERT INTO message VALUES ('m', 's', '{\"role\": \"user\"}', 1000)")
    con.execute("INSERT INTO part VALUES ('q', 'm', '{\"type\": \"text\", \"text\": \"hi\"}', 1000)")
    con.commit()
    r = sqlite.opencode(spark, db).first()
    assert (r.conversation_id, r.project, r.messages[0].content) == ("s", "/w", "hi")

    thread = {"owner": "o", "repo": "r", "number": 1, "is_pr": True, "title": "t", "body": "desc", "author": "Me", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "messages": [{"author": "me", "body": "one", "created_at": "2024-01-01T01:00:00Z"}, {"author": "x[bot]", "body": "beep", "created_at": "2024-01-01T02:00:00Z"}, {"author": "you", "body": "/lgtm", "created_at": "2024-01-01T02:00:00Z"}, {"author": "you", "body": "why", "created_at": "2024-01-01T03:00:00Z", "path": "f.py", "diff_hunk": "@@"}, {"author": "ME", "body": "two", "created_at": "2024-01-01T04:00:00Z", "review_state": "APPROVED"}]}
    files = spark.createDataFrame([(json.dumps(thread),)], "j string").select(F.from_json("j", people.THREAD).alias("t")).select("t.*")
    r = people.threads(files, "me", True).first()
    assert r.conversation_id == "o/r/pull/1" and [m.role for m in r.messages] == ["user", "user", "assistant", "user"]
    assert r.messages[0].content.startswith(people.H.GENERATED) and r.messages[2].content == "[GitHub comment by @you]\n[f.py]\n@@\n\nwhy" and r.messages[3].content == "[review: approved]\ntwo"

    channel = {"team_id": "T", "channel_id": "C", "channel_name": "general", "owner_id": "U1", "users": {"U1": "Me"}, "messages": [{"user": "U1", "text": "x" * 30, "ts": f"{i}.0"} for i in range(10)] + [{"user": "U2", "text": "joined", "ts": "0.5", "subtype": "channel_join"}]}
    files = spark.createDataFrame([(json.dumps(channel),)], "j string").select(F.from_json("j", people.CHANNEL).alias("t")).select("t.*")
    got = sorted(people.channels(files, 100).collect(), key=lambda r: r.conversation_id)
    assert [r.conversation_id for r in got][:2] == ["T:C:0", "T:C:1"] and got[1].title.startswith("[part 2] ") and sum(len(r.messages) for r in got) == 10

    folder = tmp_path / "plugin"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"session_id": "z", "title": "t", "messages": [{"role": "user", "content": "c"}]}))
    (folder / "b.json").write_text("{broken")
    good, bad = people.plugin(spark, str(folder), "mine", "human")
    assert good.first()["conversation_id"] == "z" and good.first()["source"] == "mine" and bad.count() == 1
    with pytest.raises(ValueError):
        people.plugin(spark, str(folder), "mine", "robot")


def test_stream_ingest(spark, tmp_path):
    from tracelens.streaming.ingest import ingest

    schema = "source string, conversation_id string, updated_at long, title string"
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for rows in ([("a", "1", 1, "old"), ("a", "2", 1, "x")], [("a", "1", 2, "new"), ("a", "2", 1, "same")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        ingest(spark, src, schema, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.conversation_id, r.title) for r in spark.read.parquet(out).collect()) == [("1", "new"), ("2", "x")]


def test_sessions(spark, tmp_path):
    from tracelens.operators.sessions import Sessions, active_sources, default_sources, first_diff, sources_for

    s = Sessions(spark, f"file://{tmp_path}/sessions", StubClient())
    a, _ = s.ask("one?", "doc")
    s.ask("two?", "doc", a)
    b, _ = s.ask("other?", "doc")
    assert [r for r, _ in s.turns(a)] == ["user", "assistant"] * 2 and len(s.turns(b)) == 2
    with pytest.raises(KeyError):
        s.ask("x", "doc", "unknown")
    assert first_diff(None, "x", StubClient()) == "Initial version." and len(default_sources()) == 5
    assert sources_for(["slack", "nope", "codex"]) == ["codex", "slack"]
    assert active_sources(spark.createDataFrame([], "source string")) == default_sources()


def test_blind_evaluation(spark, tmp_path):
    from tracelens.operators.evaluate import dimension_means, preferences
    from tracelens.plans.evaluation import evaluate

    class Counting(StubClient):
        def _answer(self, text):
            if "broken" in text:
                raise ValueError("no answer")
            return f"about {text}"

    q = spark.createDataFrame([(i, "meta", "broken" if i == 3 else f"question {i}") for i in range(6)], "id long, category string, prompt string")
    got = evaluate(Profile(spark, f"file://{tmp_path}/e", Counting()), q, "the document").persist()
    rows = {r.id: r for r in got.collect()}
    assert rows[3].error and all(rows[i].error is None and set(rows[i].base) == {"reasoning", "voice", "awareness"} for i in rows if i != 3)
    p = preferences(got.filter("error IS NULL")).first()
    assert p.n_ours + p.n_base == 5 and {r.dimension: r.n for r in dimension_means(got.filter("error IS NULL")).collect()} == {"reasoning": 5, "voice": 5, "awareness": 5}


def test_ranks_and_budgets_match_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 5, 5, rng.randint(0, 90)]), rng.choice([0, 3, 9, 40])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, k int, tok long")
    got = {r.id: r["place"] for r in ordered.ranked(df, "k", ["id"], "place").collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))] == list(range(1, 601))
    assert ordered.ranked(df.limit(0), "k", ["id"], "place").count() == 0
    for by, budget, least in ((["g"], 100, True), (["g"], 2, True), ([], 150, False)):
        kept = ordered.budget_prefix(df, by, [F.col("id")], "tok", budget, least, F.floor(F.col("id") / 50))
        want, used = set(), {}
        for i, g, _, tok in rows:
            group = g if by else 0
            first = group not in used
            used[group] = used.get(group, 0) + tok
            if used[group] <= budget or (first and least):
                want.add(i)
        assert {r.id for r in kept.collect()} == want and kept.columns == df.columns


def test_service_answers_and_forms(spark):
    assert one(spark, text.html_unescape("s"), s="&amp;lt;&quot;&apos;") == "<\"'"
    assert [one(spark, text.word_wrap("s", 9), s=s) for s in ("", "  ", "aa bb cc dd", "abcdefghijkl a")] == ["", "", "aa bb cc\ndd", "abcdefghijkl\na"]
    assert [one(spark, text.format_tokens(F.col("s").cast("long")), s=s) for s in ("0", "999", "1999")] == ["—", "999", "1k"]
    assert [one(spark, text.retry_after("s", F.lit("40"), F.lit(10)), s=s) for s in ("7", "x", None)] == [7, 30, 30]


def test_commands(spark, tmp_path, capsys):
    from tracelens import cli

    home, other = f"file://{tmp_path}/home", f"file://{tmp_path}/other"
    rows = [(s, str(c), t, "user" if t % 2 == 0 else "assistant", f"{s} message {t} of conversation {c}, long enough to say something", c) for s in ("codex", "slack") for c in range(4) for t in range(6)]
    incremental.upsert(f"{home}/conversations", spark.createDataFrame(rows, cli.MESSAGES), ["source", "conv_id"])
    run = lambda *a: (cli.main(["--home", home, *a], spark), capsys.readouterr().out)[1]
    assert "slack" not in run("sources") and "slack" in run("add", "slack")
    with pytest.raises(KeyError):
        run("add", "no-such-source")
    assert run("show") == "There is no document yet.\n"
    assert "'processed': 8" in run("compose", "--method", "map-reduce")
    assert "'processed': 0" in run("compose", "--method", "map-reduce")
    assert run("show").startswith("# Profile") and run("show", "--diff").strip().endswith("lines")
    assert "'processed': 8" in run("compose", "--reobserve", "--relabel")
    first = run("ask", "why?")
    assert first and run("ask", "and then?") and run("ask", "again?", "--new")
    from tracelens.operators.sessions import Sessions

    kept = Sessions(spark, f"{home}/sessions", None).rows().groupBy("id").count().collect()
    assert sorted(r["count"] for r in kept) == [2, 4]
    assert run("questions").count("\n") > 22
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "mine.md").write_text("What now?")
    assert run("questions", "--dir", f"file://{tmp_path}/own") == "mine\tcustom\tWhat now?\n"
    run("sync", other, "conversations", "observations")
    assert spark.read.parquet(f"{other}/conversations").count() == len(rows)
    assert run("remove", "slack") == "removed\n" and "slack" not in run("sources")
    assert set(r.source for r in spark.read.parquet(f"{home}/profile/observations").collect()) == {"codex"}
    (tmp_path / "plug").mkdir()
    (tmp_path / "plug" / "a.json").write_text('{"conversation_id": "x", "messages": [{"role": "user", "content": "hello"}]}')
    (tmp_path / "plug" / "b.json").write_text("{")
    assert run("import", f"file://{tmp_path}/plug", "mine", "--type", "human") == "{'imported': 1, 'skipped': 0, 'rejected': 1}\n"
    assert "mine" in run("add", "mine")


def test_answers_that_were_cut_short(spark, tmp_path):
    from tracelens.model.client import Answer, StubClient
    from tracelens.plans.profile import Profile

    class Short(StubClient):
        def answer(self, stage, system, text, max_tokens):
            return Answer("x", 1, max_tokens, True)

    p = Profile(spark, f"file://{tmp_path}/p", Short())
    asked = spark.createDataFrame([("a", "s", "t")], "req_id string, system string, input string")
    with pytest.raises(RuntimeError, match="cut short"):
        p._ask("label", asked)
    assert p._ask("theme_map", asked, cut=True).count() == 1


def test_long_texts_take_time_in_proportion(spark):
    import time

    from tracelens.functions import text as T

    df = spark.createDataFrame([("line\n" * 200_000,), ("```\na\n```\n" * 60_000,), ("x" * 1_000_000,), ("/a" * 400_000,), ("a.b-" * 250_000,), ("\n   " * 250_000,)], "t string")
    began = time.time()
    got = df.select(F.length(T.strip_code_blocks("t")).alias("n"), F.length(T.scrub("t")).alias("m")).collect()
    assert got[0].n == 1_000_001 and got[1].n == 60_000 * 13 + 1
    assert time.time() - began < 60
