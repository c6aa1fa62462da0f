"""Uploads, keyed tables, SQLite in parts, chunks of large keys, maps of model output, and the verbs that use them."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracelens import cli
from tracelens.functions import parse
from tracelens.operators import incremental as I
from tracelens.operators.spread import fill_spread
from tracelens.sources import providers as P
from tracelens.sources import sqlite


def chunked(rows, limit):
    """(key, pos): chunk, in one loop; the order of keys does not matter."""
    out = {}
    for key in {r[0] for r in rows}:
        used = chunk = 0
        for i, (_, pos, n) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])):
            if i and used + n > limit:
                used, chunk = 0, chunk + 1
            used += n
            out[key, pos] = chunk
    return out


@pytest.mark.parametrize(("sizes", "ranges"), [([0, 0, 1, 5, 30, 99, 100], 9), ([0, 101, 350, 1, 100], 6)])
def test_chunks_of_a_large_key_in_ranges(spark, sizes, ranges):
    rng = random.Random(len(sizes))
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), i, rng.choice(sizes)) for i in range(1500)] + [("zero", 9000 + i, 0) for i in range(40)] + [("big", 9500 + i, 500) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, pos long, n long")
    got = fill_spread(df, ["k"], ["pos"], "n", 100, ranges=ranges)
    assert got.columns == ["k", "pos", "n", "chunk"]
    assert {(r.k, r.pos): r.chunk for r in got.collect()} == chunked(rows, 100)
    assert fill_spread(df.limit(0), ["k"], ["pos"], "n", 100, ranges=3).collect() == []


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    mk = lambda rows: spark.createDataFrame(rows, "source string, id string, part int, v string")
    I.upsert(path, mk([(s, str(i), p, "old") for s in "ab" for i in range(40) for p in range(2)]), ["source", "id"], buckets=8)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    I.upsert(path, mk([("a", "7", 0, "new")]), ["source", "id"], buckets=99)
    kept = set(before.items()) & set(files().items())
    assert len(before) == 16 and len(kept) == 15 and I.buckets_of(spark, path) == 8
    rows = {tuple(r) for r in I.table_rows(spark, path, "source string, id string, part int, v string").collect()}
    # all rows of a key are replaced
    assert len(rows) == 159 and ("a", "7", 0, "new") in rows and not any(r[:3] == ("a", "7", 1) for r in rows)
    I.staged(path, mk([("a", "7", 0, "newer")]), ["source", "id"])
    assert ("a", "7", 0, "newer") in {tuple(r) for r in I.table_rows(spark, path, "source string, id string, part int, v string").collect()}
    assert I.delete(spark, path, "a") and not I.delete(spark, path, "a")
    assert I.table_rows(spark, f"{path}-none", "source string").columns == ["source"]


def test_sqlite_in_ranges_of_row_ids(spark, tmp_path):
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id TEXT, n INTEGER)")
    con.execute("CREATE TABLE w (id TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    con.execute('CREATE TABLE "empty one" (id TEXT)')
    ids = [1, 2, 3, *range(1000, 1500), 10**9]
    con.executemany("INSERT INTO t (rowid, id, n) VALUES (?, ?, ?)", [(i, f"r{i}", i % 7) for i in ids])
    con.executemany("INSERT INTO w VALUES (?, ?)", [("a", 1), ("b", 2)])
    con.commit()
    con.close()
    got = sqlite.table(spark, path, "t", "id,n", "name string, n long", parts=12)
    assert got.rdd.getNumPartitions() == 12 and sorted(r.name for r in got.collect()) == sorted(f"r{i}" for i in ids)
    assert sorted(tuple(r) for r in sqlite.table(spark, path, "w", "", "id string, n long").collect()) == [("a", 1), ("b", 2)]
    assert sqlite.table(spark, path, "empty one", "id", "id string").collect() == []
    assert sqlite.rows(spark, path, "SELECT count(*) FROM t", "n long").first()["n"] == len(ids)


def test_maps_of_model_output_without_a_session_setting(spark):
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        df = spark.createDataFrame([("1. a\n2. b\n1. c",), ("x -> y\nX -> z",), ("RESPONSE_A: voice=1 voice=3 reasoning=2",), (None,)], "t string")
        got = df.select(parse.numbered_labels("t", F.lit(2)).alias("n"), parse.theme_map("t").alias("m"), parse.scores("t", "A").alias("s")).collect()
        assert got[0]["n"] == {1: "c", 2: "b"} and got[1]["m"] == {"x": "z"} and got[2]["s"] == {"voice": 3, "reasoning": 2} and got[3]["n"] == {}
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", before)


def plugin_file(folder, name, texts, at, **more):
    folder.mkdir(exist_ok=True)
    turns = [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]
    (folder / f"{abs(hash(name))}.json").write_text(json.dumps({"conversation_id": name, "updated_at": at, "messages": turns} | more))


def test_import_keeps_kinds_and_skips_what_is_stored(spark, tmp_path):
    app = cli.App(spark, f"file://{tmp_path}/home")
    folder = tmp_path / "made"
    plugin_file(folder, "a|b", ["I prefer small changes", "fine", "and tests"], "2024-05-01T00:00:00Z")
    plugin_file(folder, "only one", ["I ask for one reason only"], "2024-05-01T00:00:00Z")
    (folder / "bad.json").write_text("{")
    assert app.import_folder(f"file://{folder}", "reviews", "human") == {"imported": 2, "skipped": 0, "rejected": 1}
    assert app.import_folder(f"file://{folder}", "reviews", "human") == {"imported": 0, "skipped": 2, "rejected": 1}
    plugin_file(folder, "a|b", ["I prefer smaller changes", "fine"], "2024-05-02T00:00:00Z")
    assert app.import_again({"reviews": f"file://{folder}", "never": "x"}) == {"reviews": {"imported": 1, "skipped": 1, "rejected": 1}}
    rows = {(r.conv_id, r.turn): r.text for r in app.messages().collect()}
    assert rows == {("a|b", 0): "I prefer smaller changes", ("a|b", 1): "fine", ("only one", 0): "I ask for one reason only"}
    assert app.human_sources() == ["reviews"] and "reviews" in app.sources()
    # people's sources are asked otherwise, and one message of the owner is enough
    done = app.compose("map-reduce", at=1)
    assert done == {"processed": 2, "remaining": 0}
    assert {r.conv_id for r in app.profile.entries().collect()} == {"a|b", "only one"}
    with pytest.raises(ValueError):
        app.import_folder(f"file://{folder}", "reviews", "robot")


def test_upload_of_a_source_that_fails(spark, tmp_path):
    def broken(spark, root):
        raise OSError("no disk")

    empty = lambda spark, root: P.discover(spark, {}, "")[0]
    made = (P.Provider("good", empty), P.Provider("bad", broken), P.Provider("asked", broken, opt_in=True))
    roots = {p.name: "x" for p in made}
    got = P.upload(spark, f"file://{tmp_path}/h", roots, providers=made)
    assert got == {"discovered": 0, "uploaded": 0, "skipped": 0, "bytes": 0, "totals": {}, "warnings": ["bad: OSError: no disk"]}
    with pytest.raises(RuntimeError, match="asked: OSError"):
        P.upload(spark, f"file://{tmp_path}/h", roots, ["asked"], made)
    assert [p.name for p in P.wanted(P.BUILTIN, ["codex", "slack", "nope"])] == ["slack", "codex"]


def test_upload_from_files_and_evaluation_by_verbs(spark, tmp_path, capsys):
    root, home = tmp_path / "agent", f"file://{tmp_path}/home"
    (root / "projects" / "p").mkdir(parents=True)
    said = [("user", "Why is this so slow?"), ("assistant", "It reads twice."), ("user", "Then read it once, and measure.")]
    lines = [{"type": r, "cwd": "/w", "timestamp": f"2024-05-01T00:00:0{i}Z", "message": {"content": t, "stop_reason": "end"}} for i, (r, t) in enumerate(said)]
    (root / "projects" / "p" / "one.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main(["--home", home, "upload", "--root", f"claude-code=file://{root}"], spark) == 0
    assert "'uploaded': 1" in capsys.readouterr().out
    cli.main(["--home", home, "upload", "claude-code", "--root", f"claude-code=file://{root}"], spark)
    assert "'skipped': 1" in capsys.readouterr().out
    app = cli.App(spark, home)
    with pytest.raises(ValueError):
        app.evaluate()
    app.compose("map-reduce", at=5)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "mine.md").write_text("What would you measure first?")
    cli.main(["--home", home, "eval", "--dir", f"file://{tmp_path}/q", "--detail"], spark)
    shown = capsys.readouterr().out
    assert "preferred: ours" in shown and "reasoning" in shown and "mine" in shown
    n = I.table_rows(spark, f"{home}/answers", "source string, key string, fp string, response string").count()
    asked = app.questions().count() + 1
    assert n == 2 * asked


def test_sync_by_categories(spark, tmp_path):
    app = cli.App(spark, f"file://{tmp_path}/a")
    plugin_file(tmp_path / "made", "one", ["I prefer small changes", "fine", "and tests for all of them"], "2024-05-01T00:00:00Z")
    app.import_folder(f"file://{tmp_path}/made", "reviews", "human")
    app.compose("map-reduce", at=7)
    with pytest.raises(KeyError):
        app.sync(f"file://{tmp_path}/b", ["nothing"])
    assert app.sync(f"file://{tmp_path}/b", ["conversations"]) == {"conversations": 1}
    other = cli.App(spark, f"file://{tmp_path}/b")
    assert other.human_sources() == ["reviews"] and other.show() is None and other.profile.entries().count() == 0
    for _ in range(2):
        assert app.sync(f"file://{tmp_path}/b") == {"conversations": 1, "observations": 1, "versions": 1}
    assert other.show() == app.show() and other.profile.entries().count() == app.profile.entries().count() == 2
    new = cli.App(spark, f"file://{tmp_path}/c")
    assert new.sync(f"file://{tmp_path}/none", back=True) == {"conversations": 0, "observations": 0, "versions": 0}
    assert new.sync(f"file://{tmp_path}/b", ["versions"], back=True) == {"versions": 1} and new.show() == app.show()


def test_answers_in_pieces(spark, tmp_path):
    from tracelens.model.client import Answer, StubClient, streamed
    from tracelens.operators.sessions import Sessions

    class Telling(StubClient):
        def stream(self, stage, system, text, max_tokens, thinking):
            assert (max_tokens, thinking) == (4096 + 16_000, 16_000)
            yield "let me see", True
            yield "It ", False
            yield "depends.", False
            yield Answer("", 3, 2)

    told = []
    s = Sessions(spark, f"file://{tmp_path}/s", Telling())
    session, answer = s.ask("Well?", "doc", tell=lambda t, thought: told.append((t, thought)))
    assert answer == "It depends." and told == [("let me see", True), ("It ", False), ("depends.", False)]
    assert s.turns(session) == [("user", "Well?"), ("assistant", "It depends.")]
    whole = []
    assert streamed(StubClient(), "ask", "", "x", 10, lambda t, thought: whole.append((t, thought))).text == "1 lines" and whole == [("1 lines", False)]


def test_two_documents_compared_blind(spark, tmp_path):
    from tracelens.plans.evaluation import COMPARED, compare
    from tracelens.plans.profile import Profile

    p = Profile(spark, f"file://{tmp_path}/p")
    seen = spark.createDataFrame([(i, f"observation {i}") for i in range(90)], "id long, text string")
    one, two = (compare(p, a, b, seen, ["id"]) for a, b in (("first document", "second document"), ("second document", "first document")))
    assert set(one["scores"]) == set(COMPARED) and one["differences"] and one["input_tokens"] == 200
    # the same judgement whichever is ours
    assert {d: (y, x) for d, (x, y) in one["scores"].items()} == two["scores"]
    assert {compare(p, f"{i}", "x", seen, ["id"])["ours_is_a"] for i in range(6)} == {True, False}


def test_context_of_corrections(spark):
    from tracelens.operators.turns import turn_lines

    code = "See:\n```py\nx = 1\n```\n" + "word " * 300
    df = spark.createDataFrame([(code, "no, use y"), (code, "why " * 60)], "assistant string, human string")
    kept, cut = [r.line for r in turn_lines(df, F.lit(False), preserve=True).collect()]
    assert "x = 1" in kept and len(kept) > 1500 and "x = 1" not in cut and len(cut) < 900
    assert "x = 1" not in turn_lines(df, F.lit(False)).first().line
