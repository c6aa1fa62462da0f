"""The verbs on the command line: python -m tracelens.cli --home FOLDER VERB ...; conversations are the Parquet table FOLDER/conversations.

Its rows are messages: source, conv_id, turn, role, text, last_modified; FOLDER/kinds says which imported sources are people's.  A client is named as module:factory; without one, answers are made by rule.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model.client import StubClient
from .operators import sessions as S
from .operators.incremental import BUCKETS, buckets_of, exists, settle, table_rows, upsert
from .plans.evaluation import evaluate, report
from .plans.profile import Profile
from .plans.questions import custom, universal
from .session import build
from .sources.people import plugin
from .sources.providers import BUILTIN, MESSAGES, store, upload

KINDS = "source string, kind string"


class App:
    """What each verb does, over a folder."""

    def __init__(self, spark: SparkSession, home: str, client=None):
        self.spark, self.home = spark, home.rstrip("/")
        self.profile = Profile(spark, f"{self.home}/profile", client, ids="string", human=self.human_sources())

    def human_sources(self) -> list[str]:
        """Imported sources that were declared to be people's; a row a source."""
        return [r["source"] for r in table_rows(self.spark, f"{self.home}/kinds", KINDS).filter("kind = 'human'").collect()]

    def upload(self, roots: dict[str, str], names: list[str] = []) -> dict:
        """Reads sources from their roots and stores what is new; named ones must be readable."""
        return upload(self.spark, self.home, roots, names)

    def _state(self) -> DataFrame:
        path = f"{self.home}/sources"
        return self.spark.read.schema("source string").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], "source string")

    def _keep(self, names: list[str]) -> list[str]:
        names = sorted(set(names))
        self.spark.createDataFrame([(n,) for n in names], "source string").coalesce(1).write.mode("overwrite").parquet(f"{self.home}/sources")
        return names

    def messages(self) -> DataFrame:
        return S.of_sources(table_rows(self.spark, f"{self.home}/conversations", MESSAGES), self.sources())

    def sources(self) -> list[str]:
        return S.active_sources(self._state())

    def add(self, *names: str) -> list[str]:
        """Activates sources; unknown ones are an error unless they were imported."""
        stored = [r[0] for r in S.imported(self.spark.read.parquet(f"{self.home}/conversations")).collect()] if exists(self.spark, f"{self.home}/conversations") else []
        for n in names:
            if n not in [b.name for b in BUILTIN] + stored:
                raise KeyError(f"no source {n}")
        return self._keep([*self.sources(), *names])

    def remove(self, name: str) -> bool:
        """Deactivates a source and deletes what was observed of it."""
        self._keep([n for n in self.sources() if n != name])
        return self.profile.remove(name)

    def compose(self, method: str = "clustering", limit: int = 0, reobserve: bool = False, relabel: bool = False, learn: bool = False, at: int | None = None) -> dict:
        at = time.time_ns() // 1_000_000 if at is None else at
        if method == "map-reduce":
            return self.profile.map_reduce(self.messages(), at, limit, reobserve, learn)
        if method == "incremental":
            return self.profile.incremental(self.messages(), at, limit, reobserve)
        if method != "clustering":
            raise ValueError(f"no method {method}")
        return self.profile.clustered(self.messages(), at, limit, reobserve=reobserve, relabel=relabel)

    def ask(self, question: str, new: bool = False, tell=None) -> str:
        """The answer; tell, if given, gets its pieces as they come."""
        return S.Sessions(self.spark, f"{self.home}/sessions", self.profile.client).ask(question, self.show() or "", resume=True, new=new, tell=tell)[1]

    def show(self, diff: bool = False, ts: int | None = None) -> str | None:
        return self.profile.diff(ts) if diff else self.profile.show(ts)

    def import_folder(self, folder: str, name: str, kind: str) -> dict:
        """Stores the conversations that a plugin has written, as far as they are new or were updated, keeps their kind, and activates the source."""
        good, bad = plugin(self.spark, folder, name, kind)
        totals = store(self.spark, f"{self.home}/conversations", good).first()
        upsert(f"{self.home}/kinds", self.spark.createDataFrame([(name, kind)], KINDS), ["source"], buckets=1)
        self._keep([*self.sources(), name])
        self.profile = Profile(self.spark, f"{self.home}/profile", self.profile.client, ids="string", human=self.human_sources())
        return {"imported": totals["uploaded"] if totals else 0, "skipped": totals["skipped"] if totals else 0, "rejected": bad.count()}

    def import_again(self, folders: dict[str, str]) -> dict[str, dict]:
        """import_folder() of every source that was imported before and has a folder."""
        known = {r["source"]: r["kind"] for r in table_rows(self.spark, f"{self.home}/kinds", KINDS).collect()}
        return {name: self.import_folder(folder, name, known[name]) for name, folder in folders.items() if name in known}

    def evaluate(self, folder: str | None = None, seed: int = 42) -> DataFrame:
        """evaluate() of the document over the built-in questions, those about it, and a folder's own; answers are kept and used again."""
        document = self.show()
        if not document:
            raise ValueError("there is no document yet")
        asked = self.questions().select("id", "category", "prompt")
        asked = asked.unionByName(custom(self.spark, folder).select("id", "category", "prompt")) if folder else asked
        return evaluate(self.profile, asked, document, seed=seed, answers=f"{self.home}/answers")

    #: Tables of each category that sync() knows, with their keys; the first is the one that is counted.
    CATEGORIES = {
        "conversations": [("conversations", ["source", "conv_id"]), ("kinds", ["source"])],
        "observations": [("profile/observations", ["source", "conv_id"]), ("profile/labels", ["source", "conv_id", "idx"])],
        "versions": [("profile/versions", ["source", "ts"])],
    }

    def sync(self, other: str, names: list[str] = [], back: bool = False) -> dict[str, int]:
        """Merges the named categories (none: all) of this home into another, or, back, of the other into this one; what both have is taken from
        where it comes, nothing is deleted.  How many conversations, observed conversations and versions there were."""
        for name in names:
            if name not in self.CATEGORIES:
                raise KeyError(f"no category {name}")
        here, there = (other.rstrip("/"), self.home) if back else (self.home, other.rstrip("/"))
        out = {}
        for name in names or self.CATEGORIES:
            for i, (table, key) in enumerate(self.CATEGORIES[name]):
                settle(self.spark, f"{here}/{table}")
                rows = self.spark.read.parquet(f"{here}/{table}").drop("bucket") if exists(self.spark, f"{here}/{table}") else None
                if i == 0:
                    out[name] = rows.select(*key).distinct().count() if rows is not None else 0
                if rows is not None and not rows.isEmpty():
                    upsert(f"{there}/{table}", rows, key, buckets=buckets_of(self.spark, f"{here}/{table}") or BUCKETS)
        return out

    def questions(self, folder: str | None = None) -> DataFrame:
        """The questions of an evaluation: a folder's own, or the built-in ones and those about the document."""
        if folder:
            return custom(self.spark, folder)
        document = self.show()
        return universal(self.spark).unionByName(self.profile.questions(document)) if document else universal(self.spark)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelens", description=__doc__)
    p.add_argument("--home", required=True)
    p.add_argument("--client")
    v = p.add_subparsers(dest="verb", required=True)
    c = v.add_parser("compose")
    c.add_argument("--method", default="clustering", choices=["clustering", "map-reduce", "incremental"])
    c.add_argument("--limit", type=int, default=0)
    for flag in ("reobserve", "relabel", "learn", "preserve-context"):
        c.add_argument(f"--{flag}", action="store_true")
    c = v.add_parser("ask")
    c.add_argument("question")
    c.add_argument("--new", action="store_true")
    c = v.add_parser("show")
    c.add_argument("--diff", action="store_true")
    c.add_argument("-o", "--output")
    v.add_parser("sources")
    v.add_parser("add").add_argument("names", nargs="+")
    v.add_parser("remove").add_argument("name")
    c = v.add_parser("import")
    c.add_argument("folder")
    c.add_argument("name")
    c.add_argument("--type", dest="kind", default="ai")
    c = v.add_parser("sync")
    c.add_argument("other")
    c.add_argument("names", nargs="*")
    c.add_argument("--back", action="store_true", help="from the other home into this one")
    v.add_parser("questions").add_argument("--dir")
    c = v.add_parser("upload")
    c.add_argument("names", nargs="*")
    c.add_argument("--root", action="append", default=[], metavar="SOURCE=PATH")
    c = v.add_parser("eval")
    c.add_argument("--dir")
    c.add_argument("--detail", action="store_true")
    a = p.parse_args(argv)
    client = None
    if a.client:
        module, _, name = a.client.partition(":")
        client = getattr(importlib.import_module(module), name)()
    app = App(spark or build("tracelens"), a.home, client or StubClient())
    if a.verb == "compose":
        app.profile.preserve = a.preserve_context
        print(app.compose(a.method, a.limit, a.reobserve, a.relabel, a.learn))
    elif a.verb == "ask":
        app.ask(a.question, a.new, lambda piece, thinking: None if thinking else print(piece, end="", flush=True))
        print()
    elif a.verb == "show":
        text = app.show(a.diff) or "There is no document yet."
        if a.output:
            with open(a.output, "w") as f:
                f.write(text)
        else:
            print(text)
    elif a.verb == "sources":
        print("\n".join(app.sources()))
    elif a.verb == "add":
        print("\n".join(app.add(*a.names)))
    elif a.verb == "remove":
        print("removed" if app.remove(a.name) else "nothing was observed")
    elif a.verb == "import":
        print(app.import_folder(a.folder, a.name, a.kind))
    elif a.verb == "sync":
        print("\n".join(f"{n} {name}" for name, n in app.sync(a.other, a.names, a.back).items()))
    elif a.verb == "upload":
        print(app.upload(dict(r.split("=", 1) for r in a.root), a.names))
    elif a.verb == "eval":
        print("\n".join(report(app.evaluate(a.dir), a.detail)))
    else:
        for r in app.questions(a.dir).orderBy("category", "id").toLocalIterator():
            print(f"{r['id']}\t{r['category']}\t{r['prompt']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
