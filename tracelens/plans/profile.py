"""The two pipelines from conversations to one document, over a folder of Parquet tables.

observations, labels and versions are kept in the folder and reused while their fingerprints match.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import json_array, numbered_labels, observations, theme_map
from ..functions.parse import themes as theme_lines
from ..functions.text import fingerprint, is_empty, is_relevant, normal_label, observation_format, strip_code_fence, token_estimate, trim_space
from ..model.client import Client, StubClient
from ..model.stage import respond, work_root, written
from ..operators import clusters as K
from ..operators.incremental import delete, newest, stale, table_rows, upsert, without
from ..operators.ordered import budget_prefix, range_bounds, range_of
from ..operators.sessions import first_diff
from ..operators.turns import HUMAN_SOURCES, chunks, is_human_source, turn_lines, turn_pairs

KEY = ["source", "conv_id"]
PROMPTS = {"observe": "List observations about how the owner thinks.", "observe_human": "List observations about the owner among peers.", "refine": "Keep what is distinctive.", "label": "Label each observation.", "theme_identify": "Name 15 to 25 themes that the labels share, each on a line after THEME: .", "theme_map": "Assign each label to one of the themes: label -> theme.", "summarize": "Summarise the cluster.", "thesis": "Outline every cluster.", "compose": "Write the document.", "learn": "Write the document.", "update": "Change the document only where the observations give reason to, and keep it short.", "questions": "Ask ten questions that the document should help to answer, as a JSON array of objects with id, category and prompt."}
LABELS_A_CALL = 10
#: More distinct labels than this are mapped to themes, in calls of so many.
THEMED_FROM, THEMED_A_CALL = 50, 100
#: Bytes that one call takes in at most; more is an error, as the methods that gather everything need one call.
ONE_CALL_BYTES = 64 << 20


class Profile:
    """The pipelines' verbs over one folder."""

    def __init__(self, spark: SparkSession, folder: str, client: Client | None = None, tasks: int | None = None, ids: str = "long", human: list[str] = [], preserve: bool = False):
        """ids: the type of conv_id; human: imported sources whose other side are people, besides the built-in ones; preserve: as in turn_lines()."""
        self.spark, self.folder, self.client, self.ids = spark, folder, client or StubClient(), ids
        self.preserve = preserve
        self.human = is_human_source("source", F.col("source").isin(list(human)) if human else None)
        self.OBSERVATIONS, self.LABELS = (s.replace("conv_id long", f"conv_id {ids}") for s in (self.OBSERVATIONS, self.LABELS))
        self.tasks = tasks or spark.sparkContext.defaultParallelism
        self.usage: list[tuple] = []
        self.run, self.metrics = ("", ""), []

    def table(self, name: str, schema: str) -> DataFrame:
        return table_rows(self.spark, f"{self.folder}/{name}", schema)

    def _ask(self, stage: str, requests: DataFrame, most: int = 4096, cut: bool = False) -> DataFrame:
        """Responses of requests(req_id, system, input); a failed one, or one that was cut short unless `cut` allows it, fails the stage after the others are written."""
        asked = requests.select("req_id", F.lit(stage).alias("stage"), "system", "input", F.lit(most).alias("max_tokens"))
        seen: dict = {}
        out = respond(asked, self.client, self.tasks, path=f"{self.folder}/calls/{stage}-{uuid.uuid4().hex[:8]}", metrics=seen)
        self.usage.append((stage, seen["requests"], seen["input_tokens"], seen["output_tokens"]))
        self.metrics.append((self.run[0], self.run[1], len(self.metrics), stage, *(seen[c] for c in ("requests", "bytes_in", "failed", "cut", "input_tokens", "output_tokens", "bytes_out", "ms"))))
        if seen["error"]:
            raise RuntimeError(f"{stage}: {seen['error']}")
        if seen["cut"] and not cut:
            raise RuntimeError(f"{stage}: {seen['cut']} answers were cut short at {most} tokens")
        return out

    def asked_in_turn(self, stage: str, calls: list, most: int) -> None:
        """Keeps what was observed of calls that one task made in turn, a row each (fold.CALLS); fails as _ask() does."""
        for c in calls:
            failed, cut = int(c["error"] is not None), int(c["truncated"])
            self.usage.append((stage, 1, c["input_tokens"], c["output_tokens"]))
            self.metrics.append((self.run[0], self.run[1], len(self.metrics), stage, 1, c["bytes_in"], failed, cut, c["input_tokens"], c["output_tokens"], c["bytes_out"], c["ms"]))
            if failed:
                raise RuntimeError(f"{stage}: {c['error']}")
            if cut:
                raise RuntimeError(f"{stage}: 1 answers were cut short at {most} tokens")

    METRICS = "source string, run string, seq int, stage string, requests long, bytes_in long, failed long, cut long, input_tokens long, output_tokens long, bytes_out long, ms long"

    @contextmanager
    def _told(self, verb: str):
        """Keeps what the stages of a run observed in the table run_metrics, of failed runs too; source is the verb."""
        self.run, self.metrics = (verb, uuid.uuid4().hex[:12]), []
        try:
            yield
        finally:
            if self.metrics:
                upsert(f"{self.folder}/run_metrics", self.spark.createDataFrame(self.metrics, self.METRICS).coalesce(1), ["source", "run"], buckets=1)  # a row a stage
                self.metrics = []

    def run_metrics(self) -> DataFrame:
        """source (the verb), run, seq, stage, and what was observed of each stage of all runs."""
        return self.table("run_metrics", self.METRICS)

    @staticmethod
    def _bounded(rows: DataFrame, text: str) -> DataFrame:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        if size > ONE_CALL_BYTES:
            raise ValueError(f"{size} bytes are more than one call takes in")
        return rows

    def _who(self, pattern: str) -> list:
        """source and conv_id of a request's id; ids may hold bars, names of sources don't."""
        return [F.regexp_extract("req_id", "(?s)" + pattern, 1).alias("source"), F.regexp_extract("req_id", "(?s)" + pattern, 2).cast(self.ids).alias("conv_id")]

    OBSERVATIONS = "source string, conv_id long, fp string, items array<struct<quote:string,observation:string>>"

    def observe(self, messages: DataFrame, limit: int = 0, again: bool = False, relevant: bool = True, by_state: bool = True) -> dict:
        """Observations of new and changed conversations (source, conv_id, turn, role, text, last_modified); a conversation without any keeps an empty row.

        by_state=False: of those that have no row, whatever it was made under.
        """
        seen = messages.groupBy(*KEY).agg(F.max("last_modified").alias("last_modified"))
        entries = seen.withColumn("fp", fingerprint("last_modified", F.lit(PROMPTS["observe"]), F.lit(PROMPTS["observe_human"]), F.lit(PROMPTS["refine"])))
        done = self.table("observations", self.OBSERVATIONS)
        pending = entries if again else stale(entries, done, KEY) if by_state else without(entries, done, KEY)
        total = pending.count()
        pending = written(newest(pending, limit, "last_modified", KEY), f"{self.folder}/work/pending-{uuid.uuid4().hex[:8]}")
        human = self.human
        turns = turn_lines(turn_pairs(messages.join(pending.select(*KEY), KEY, "left_semi"), KEY, human), human, self.preserve)
        asked = chunks(turns, KEY).withColumn("req_id", F.concat_ws("|", "source", F.col("conv_id").cast("string"), F.col("chunk").cast("string")))
        asked = asked.withColumn("system", F.when(human, PROMPTS["observe_human"]).otherwise(PROMPTS["observe"])).withColumnRenamed("text", "input")
        found = self._ask("observe", asked).filter(~is_empty("text"))
        per = found.groupBy(*self._who(r"^([^|]*)\|(.*)\|[^|]*$")).agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract("req_id", r"\|([^|]*)$", 1).cast("int").alias("c"), "text"))).alias("t"))
        refine = per.select(F.concat_ws("|", "source", F.col("conv_id").cast("string")).alias("req_id"), F.lit(PROMPTS["refine"]).alias("system"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("input"))
        kept = self._ask("refine", refine)
        items = observations("text")
        items = F.filter(items, lambda o: is_relevant(o["observation"])) if relevant else items
        kept = kept.select(*self._who(r"^([^|]*)\|(.*)$"), items.alias("items"))
        new = pending.join(kept, KEY, "left").select(*KEY, "fp", F.coalesce("items", F.expr("cast(array() AS array<struct<quote:string,observation:string>>)")).alias("items"))
        n = pending.count()
        if n:
            upsert(f"{self.folder}/observations", new, KEY)
        return {"processed": n, "remaining": total - n}

    def entries(self) -> DataFrame:
        """source, conv_id, idx, quote, text: observations one a row."""
        return self.table("observations", self.OBSERVATIONS).select(*KEY, F.posexplode("items").alias("idx", "o")).select(*KEY, "idx", F.col("o.quote").alias("quote"), F.col("o.observation").alias("text"))

    LABELS = "source string, conv_id long, fp string, idx int, label string"

    def label(self, again: bool = False) -> DataFrame:
        """Labels of conversations whose observations changed (all of them, if `again`), in calls of LABELS_A_CALL that are told the labels in use."""
        if again:
            delete(self.spark, f"{self.folder}/labels")
        # every call is told the labels in use, so together they must fit in one
        system = K.label_prompt(PROMPTS["label"], self._bounded(K.vocabulary(self.table("labels", self.LABELS)), "label"))
        own = self.entries()
        per = own.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("o"))
        per = per.withColumn("fp", fingerprint(F.array_join(F.transform("o", lambda x: x["text"]), "\0"), F.lit(PROMPTS["label"])))
        done = self.table("labels", self.LABELS).select(*KEY, "fp").distinct()
        todo = stale(per, done, KEY)
        batch = todo.select(*KEY, "fp", F.posexplode("o").alias("i", "x")).withColumn("b", F.floor(F.col("i") / LABELS_A_CALL))
        calls = batch.groupBy(*KEY, "fp", "b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
        calls = calls.select(*KEY, "fp", "b", F.size("l").alias("n"), F.concat_ws("|", "source", F.col("conv_id").cast("string"), F.col("b").cast("string")).alias("req_id"), F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["x"]["text"])), "\n").alias("input"))
        calls = calls.join(F.broadcast(system))  # one row
        calls = written(calls, f"{self.folder}/work/calls-{uuid.uuid4().hex[:8]}")
        if calls.isEmpty():
            return self.table("labels", self.LABELS)
        got = self._ask("label", calls, 1024).join(calls, "req_id")
        named = got.withColumn("m", numbered_labels("text", F.col("n"))).select(*KEY, "fp", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "b", "m")
        rows = named.select(*KEY, "fp", (F.col("b") * LABELS_A_CALL + F.col("k") - 1).cast("int").alias("idx"), F.coalesce(F.try_element_at("m", "k"), F.lit("uncategorized")).alias("label"))
        upsert(f"{self.folder}/labels", rows, [*KEY, "idx"])
        return self.table("labels", self.LABELS)

    THEMES = "fp string, label string, theme string"

    def theme(self) -> DataFrame | None:
        """label, theme of lower-cased labels, if there are more than THEMED_FROM; labels that no round maps are themes themselves."""
        known = self._bounded(self.table("labels", self.LABELS).filter("label != ''").select("label").distinct(), "label").agg(F.array_sort(F.collect_set("label")).alias("l"))
        known = known.select("l", fingerprint(F.array_join("l", "\0"), F.lit(PROMPTS["theme_identify"]), F.lit(PROMPTS["theme_map"])).alias("fp"))
        known = written(known, f"{self.folder}/work/known-{uuid.uuid4().hex[:8]}")
        n, fp = known.select(F.size("l"), "fp").first()
        if n <= THEMED_FROM:
            return None
        done = self.table("themes", self.THEMES).filter(F.col("fp") == fp)
        if not done.isEmpty():
            return done.select("label", "theme")
        listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
        named = self._ask("theme_identify", known.select(F.lit("themes").alias("req_id"), F.lit(PROMPTS["theme_identify"]).alias("system"), listed("l").alias("input")))
        named = named.select(theme_lines("text").alias("themes"))
        if not named.first()["themes"]:
            raise RuntimeError("theme_identify: no themes found")
        left, mapped, turn = known.select("l"), None, 0
        while n:
            turn += 1
            batch = left.select(F.posexplode("l").alias("i", "label")).groupBy(F.floor(F.col("i") / THEMED_A_CALL).alias("b")).agg(F.array_sort(F.collect_list("label")).alias("l"))
            text = F.concat(F.lit("THEMES:\n"), F.array_join("themes", "\n"), F.lit("\n\nLABELS:\n"), listed("l"))
            asked = batch.crossJoin(named).select(F.concat(F.lit(f"{turn}|"), F.col("b").cast("string")).alias("req_id"), F.lit(PROMPTS["theme_map"]).alias("system"), text.alias("input"))
            got = self._ask("theme_map", asked, cut=True).select(F.lit(turn).alias("turn"), "req_id", F.explode(theme_map("text")).alias("label", "theme"))
            mapped = written(got if mapped is None else mapped.unionByName(got), f"{self.folder}/work/mapped-{uuid.uuid4().hex[:8]}")
            rest = left.select(F.explode("l").alias("raw")).join(mapped.select("label").distinct(), F.lower("raw") == F.col("label"), "left_anti")
            left = written(rest.agg(F.array_sort(F.collect_list("raw")).alias("l")), f"{self.folder}/work/left-{uuid.uuid4().hex[:8]}")
            before, n = n, left.select(F.size("l")).first()[0]
            if n == before:
                break
        last = mapped.groupBy("label").agg(F.max_by("theme", F.struct("turn", "req_id")).alias("theme"))
        own = left.select(F.explode("l").alias("theme")).groupBy(F.lower("theme").alias("label")).agg(F.max("theme").alias("theme"))
        rows = last.unionByName(own).select(F.lit(fp).alias("fp"), "label", F.lower(trim_space("theme")).alias("theme"))
        return written(rows, f"{self.folder}/themes").select("label", "theme")

    VERSIONS = "source string, ts long, content string, diff string"

    def _version(self, ts: int, text: DataFrame) -> None:
        row = text.select(F.lit("document").alias("source"), F.lit(ts).cast("long").alias("ts"), strip_code_fence("text").alias("content"), F.lit(None).cast("string").alias("diff"))
        upsert(f"{self.folder}/versions", row, ["source", "ts"])

    def show(self, ts: int | None = None) -> str | None:
        """The document of a version, or of the latest that has one; none: None."""
        found = self.versions().filter(F.coalesce("content", F.lit("")) != "")
        found = found.filter(F.col("ts") == ts) if ts is not None else found
        return found.agg(F.max_by("content", "ts")).first()[0]

    def diff(self, ts: int | None = None) -> str | None:
        """What a version (the latest) changed, asked for once and kept with it; the first needs no call; no version: None."""
        rows = {r["ts"]: r for r in self.versions().orderBy(F.desc("ts")).filter(F.lit(ts is None) | (F.col("ts") <= F.lit(ts))).limit(2).collect()}
        if not rows or (ts is not None and ts not in rows):
            return None
        last = max(rows)
        if rows[last]["diff"] is None:
            previous = rows[min(rows)]["content"] if len(rows) > 1 else None
            told = first_diff(previous, rows[last]["content"], self.client).strip()
            row = self.spark.createDataFrame([("document", last, rows[last]["content"], told)], self.VERSIONS)
            upsert(f"{self.folder}/versions", row, ["source", "ts"])
            return told
        return rows[last]["diff"]

    def remove(self, source: str) -> bool:
        """Deletes the observations and labels of a source; says whether there were any."""
        found = [delete(self.spark, f"{self.folder}/{name}", source) for name in ("observations", "labels")]
        return any(found)

    QUESTIONS = "source string, id string, category string, prompt string"

    def questions(self, document: str) -> DataFrame:
        """id, category, prompt of questions about a document, asked for once a document; none is an error."""
        digest = self.spark.range(1).select(F.left(fingerprint(F.lit(document)), F.lit(16))).first()[0]
        kept = self.table("questions", self.QUESTIONS).filter(F.col("source") == digest)
        if kept.isEmpty():
            got = self._ask("questions", self.spark.createDataFrame([("questions", PROMPTS["questions"], document)], "req_id string, system string, input string"))
            rows = got.select(F.inline(F.from_json(json_array("text"), "array<struct<id:string,category:string,prompt:string>>"))).withColumn("source", F.lit(digest))
            rows = written(rows.select("source", "id", "category", "prompt"), f"{self.folder}/work/questions-{uuid.uuid4().hex[:8]}")
            if rows.isEmpty():
                raise RuntimeError("questions: none were found in the answer")
            upsert(f"{self.folder}/questions", rows, ["source", "id"])
            kept = self.table("questions", self.QUESTIONS).filter(F.col("source") == digest)
        return kept.drop("source")

    def map_reduce(self, messages: DataFrame, ts: int, limit: int = 0, reobserve: bool = False, learn: bool = False) -> dict:
        """Observe without the relevance filter, then one call over all observations; `learn`: only that call, over what there is."""
        with self._told("map_reduce"):
            return self._map_reduce(messages, ts, limit, reobserve, learn)

    def _map_reduce(self, messages: DataFrame, ts: int, limit: int, reobserve: bool, learn: bool) -> dict:
        done = {"processed": 0, "remaining": 0} if learn else self.observe(messages, limit, reobserve, relevant=False, by_state=False)
        shown = self.entries().select(*KEY, "idx", observation_format(F.lit(None).cast("string"), "quote", "text").alias("x"))
        whole = self._bounded(shown, "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*KEY, "idx", "x"))), lambda r: r["x"]), "\n\n---\n\n").alias("input"))
        self._version(ts, self._ask("compose", whole.select(F.lit("learn").alias("req_id"), F.lit(PROMPTS["learn"]).alias("system"), "input")))
        return done

    def clustered(self, messages: DataFrame, ts: int, limit: int = 0, least: int = K.LEAST_MEMBERS, reobserve: bool = False, relabel: bool = False) -> dict:
        """Observe, label, map labels to themes if there are many, group, sample, summarise, outline, compose."""
        with self._told("clustered"):
            return self._clustered(messages, ts, limit, least, reobserve, relabel)

    def _clustered(self, messages: DataFrame, ts: int, limit: int, least: int, reobserve: bool, relabel: bool) -> dict:
        done = self.observe(messages, limit, reobserve)
        labels = self.label(relabel).select(*KEY, "idx", normal_label("label").alias("label"))
        rows = K.clustered(K.themed(self.entries(), labels, self.theme(), [*KEY, "idx"]), least).withColumn("tok", token_estimate("text"))
        rows = written(rows, f"{self.folder}/work/rows-{uuid.uuid4().hex[:8]}")
        sample = K.sampled(rows, [*KEY, "idx"], "tok")
        order = K.numbered(sample)
        inputs = K.summary_inputs(sample).select(F.col("cluster").alias("req_id"), F.lit(PROMPTS["summarize"]).alias("system"), "input")
        summaries = self._ask("summarize", inputs).join(order, F.col("req_id") == F.col("cluster"))
        outline = summaries.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda r: F.concat(F.lit("### Cluster "), r["number"].cast("string"), F.lit("\n"), r["text"])), "\n\n").alias("input"))
        n = outline.first()["n"]
        if n:
            thesis = self._ask("thesis", outline.select(F.lit("thesis").alias("req_id"), F.lit(PROMPTS["thesis"]).alias("system"), "input"))
            gap = K.missing_from(thesis, n).first()["missing"]
            if gap:
                raise RuntimeError(f"the outline lacks Cluster {gap}")
            rest = rows.filter("cluster IS NULL")
            # a number that never falls along the ids: texts by their first bytes
            along = F.col(KEY[1]) if self.ids == "long" else F.conv(F.rpad(F.hex(F.left(KEY[1], F.lit(6))), F.lit(12), F.lit("0")).substr(1, 12), 16, 10).cast("long")
            rest = rest.withColumn("along", along)
            coarse = F.struct(F.col(KEY[0]), range_of(F.col("along"), range_bounds(rest, "along")).alias("range"))
            noise = budget_prefix(rest, [], [F.col(c) for c in (*KEY, "idx")], "tok", K.NOISE_TOKENS, False, coarse)
            left = noise.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*KEY, "idx", "text"))), lambda r: r["text"]), "\n").alias("noise"))
            text = thesis.select(F.col("text").alias("thesis")).join(outline.select("input")).join(left)
            self._version(ts, self._ask("compose", text.select(F.lit("compose").alias("req_id"), F.lit(PROMPTS["compose"]).alias("system"), F.concat_ws("\n\n", "thesis", "input", "noise").alias("input"))))
        return {**done, "clusters": n}

    def incremental(self, messages: DataFrame, ts: int, limit: int = 0, reobserve: bool = False) -> dict:
        """Observe, then fold the observations that are new into the document, in order and some at a time."""
        from .fold import fold

        with self._told("incremental"):
            done = self.observe(messages, limit, reobserve)
            document, calls = fold(self, messages, PROMPTS["update"])
            if calls:
                self._version(ts, self.spark.createDataFrame([(document,)], "text string"))
            return {**done, "updates": calls}

    def versions(self) -> DataFrame:
        return self.table("versions", self.VERSIONS)


def human_sources() -> list[str]:
    return list(HUMAN_SOURCES)


def fresh_folder(spark: SparkSession) -> str:
    return f"{work_root(spark)}/profile-{uuid.uuid4().hex[:12]}"
