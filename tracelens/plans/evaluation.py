"""Blind evaluation of a document: answers with and without it, judged by a model that does not know which is which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import preference, scores
from ..functions.text import fingerprint
from ..model.stage import respond
from ..operators.evaluate import DIMENSIONS, blinded, dimension_means, preferences, summary_grid, transfer
from ..operators.incremental import table_rows, upsert
from ..operators.sessions import response_hits, transfer_group
from .profile import Profile

JUDGE, PREFER = "Score both responses by dimension.", "Say which response you prefer, and why."


#: Answers that are kept: source is the same for all of them.
ANSWERS = "source string, key string, fp string, response string"


def evaluate(profile: Profile, questions: DataFrame, document: str, cache: DataFrame | None = None, seed: int = 42, answers: str | None = None) -> DataFrame:
    """id, category, base, ours (maps of scores), preferred, ours_is_a, rationale, error of questions(id, category, prompt).

    Answers that the cache (key, fp, response), or the table at the path `answers`, has under the same fingerprint are not asked
    for again; new ones are kept there.  Judges always are asked.
    An error of any call marks the question's row; the others stay.
    """
    spark, client, tasks = profile.spark, profile.client, profile.tasks
    both = F.explode(F.array(F.struct(F.lit("base").alias("side"), F.lit("").alias("system")), F.struct(F.lit("ours").alias("side"), F.lit(document).alias("system"))))
    asked = questions.withColumn("s", both).select("id", "prompt", "s.side", "s.system")
    asked = asked.withColumn("key", F.concat_ws("|", F.col("id").cast("string"), "side")).withColumn("fp", fingerprint("prompt", "system", F.lit(client.model)))
    known = cache if cache is not None else spark.createDataFrame([], "key string, fp string, response string")
    known = known.unionByName(table_rows(spark, answers, ANSWERS).drop("source")) if answers else known
    asked = response_hits(asked, known)

    def call(rows: DataFrame, stage: str, system, text) -> DataFrame:
        made = rows.select(F.col("key").alias("req_id"), F.lit(stage).alias("stage"), system.alias("system"), text.alias("input"), F.lit(4096).alias("max_tokens"))
        return respond(made, client, tasks).select(F.col("req_id").alias("k"), "text", "error")

    new = call(asked.filter("response IS NULL"), "answer", F.col("system"), F.col("prompt"))
    told = asked.join(new, F.col("key") == F.col("k"), "left").withColumn("answer", F.coalesce("response", "text"))
    if answers:
        fresh = told.filter("response IS NULL AND error IS NULL AND answer IS NOT NULL").select(F.lit("answers").alias("source"), "key", "fp", F.col("answer").alias("response"))
        if not fresh.isEmpty():
            upsert(answers, fresh, ["source", "key"])
    pair = told.groupBy("id").agg(F.max(F.when(F.col("side") == "base", F.col("answer"))).alias("b"), F.max(F.when(F.col("side") == "ours", F.col("answer"))).alias("o"), F.max("error").alias("e1"))
    pair = blinded(pair.join(questions, "id"), "id", seed).withColumn("key", F.col("id").cast("string"))
    a, b = F.when(F.col("ours_is_a"), F.col("o")).otherwise(F.col("b")), F.when(F.col("ours_is_a"), F.col("b")).otherwise(F.col("o"))
    shown = F.concat(F.lit("QUESTION: "), F.col("prompt"), F.lit("\n\nRESPONSE A:\n"), F.coalesce(a, F.lit("")), F.lit("\n\nRESPONSE B:\n"), F.coalesce(b, F.lit("")))
    judged = call(pair.filter("e1 IS NULL"), "judge", F.lit(JUDGE), shown).select(F.col("k").alias("jk"), F.col("text").alias("judged"), F.col("error").alias("e2"))
    preferred = call(pair.filter("e1 IS NULL"), "prefer", F.lit(PREFER), shown).select(F.col("k").alias("pk"), F.col("text").alias("said"), F.col("error").alias("e3"))
    out = pair.join(judged, F.col("key") == F.col("jk"), "left").join(preferred, F.col("key") == F.col("pk"), "left")
    sa, sb, p = scores("judged", "A"), scores("judged", "B"), preference("said")
    return out.select(
        "id", "category", F.when(F.col("ours_is_a"), sb).otherwise(sa).alias("base"), F.when(F.col("ours_is_a"), sa).otherwise(sb).alias("ours"),
        p["preferred"].alias("preferred"), "ours_is_a", p["rationale"].alias("rationale"), F.coalesce("e1", "e2", "e3").alias("error"),
    )


def report(results: DataFrame, detail: bool = False) -> list[str]:
    """Lines that show an evaluation: a grid of the questions, means by dimension and by group, preferences; detail: why, for each question.

    A row a question comes to the driver.
    """
    good = results.filter("error IS NULL")
    rows = summary_grid(results).orderBy("place").collect()
    width = max([len(r["id"]) for r in rows], default=0)
    out = [f"  {r['mark']} {r['id']:<{width}}  {r['scores'] + '  ' if r['scores'] else ''}{r['verdict']}" for r in rows]
    means = {r["dimension"]: r for r in dimension_means(good).collect()}
    out += ["", *[f"  {d:<12} {means[d]['base']:.1f} {means[d]['ours']:.1f} {means[d]['delta']:+.1f}" for d in DIMENSIONS if d in means]]
    groups = transfer(good.withColumn("group", transfer_group("category")), "id", "group").collect()
    out += ["", *[f"  {r['group']:<12} {r['n']} {r['delta']:+.1f}" for r in sorted(groups, key=lambda r: r["group"])]]
    p = preferences(good).first()
    out += ["", f"preferred: ours {p['n_ours']}, base {p['n_base']}, neither {p['n_neither']}"]
    if detail:
        out += [line for r in good.orderBy("id").select("id", "category", "rationale").collect() for line in ("", f"{r['id']} ({r['category']})", f"  {r['rationale']}")]
    return out


#: Dimensions of a comparison of two documents, and observations that ground it.
COMPARED, GROUNDS = ["coverage", "accuracy", "density", "voice", "actionability"], 50
COMPARE, DIFFER = "Score both documents by dimension, by the observations.", "Say which claims one document makes and the other does not."


def compare(profile: Profile, ours: str, other: str, observations: DataFrame, key: list[str], seed: int = 42, most: int = GROUNDS) -> dict:
    """Two documents, of two methods, judged blind: `scores` (dimension: (ours, other)), `differences` in words, `ours_is_a`, and the tokens that it took.

    The judge sees `most` of observations(*key, text), those of least hash, so reruns see the same.
    """
    spark = profile.spark
    some = observations.withColumn("mixed", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))).orderBy("mixed", *key).limit(most)
    grounds = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mixed", "text"))), lambda x: x["text"]), "\n").alias("grounds"))
    case = blinded(grounds.withColumn("id", F.md5(F.concat(F.lit(ours), F.lit("\0"), F.lit(other)))), "id", seed)
    shown = F.concat(F.lit("RESPONSE A:\n"), F.when(F.col("ours_is_a"), F.lit(ours)).otherwise(F.lit(other)), F.lit("\n\nRESPONSE B:\n"), F.when(F.col("ours_is_a"), F.lit(other)).otherwise(F.lit(ours)), F.lit("\n\nOBSERVATIONS:\n"), "grounds")
    stages = F.explode(F.array(F.struct(F.lit("compare").alias("stage"), F.lit(COMPARE).alias("system")), F.struct(F.lit("differ").alias("stage"), F.lit(DIFFER).alias("system"))))
    asked = case.select("ours_is_a", shown.alias("input"), stages.alias("s")).select(F.col("s.stage").alias("req_id"), "s.stage", "s.system", "input", F.lit(4096).alias("max_tokens"))
    metrics: dict = {}
    said = {r["req_id"]: r for r in respond(asked, profile.client, profile.tasks, metrics=metrics).withColumn("a", scores("text", "A")).withColumn("b", scores("text", "B")).collect()}  # two rows
    failed = [r["error"] for r in said.values() if r["error"]]
    if failed:
        raise RuntimeError(f"compare: {failed[0]}")
    first = case.first()["ours_is_a"]
    a, b = said["compare"]["a"], said["compare"]["b"]
    mine, theirs = (a, b) if first else (b, a)
    return {"scores": {d: (mine.get(d), theirs.get(d)) for d in COMPARED if d in mine and d in theirs}, "differences": said["differ"]["text"], "ours_is_a": first, "input_tokens": metrics["input_tokens"], "output_tokens": metrics["output_tokens"]}
