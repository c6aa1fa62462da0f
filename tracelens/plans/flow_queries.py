"""Turns, chunks, incremental state, clusters, chats and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat as H
from ..operators import clusters as C
from ..operators import evaluate as E
from ..operators import incremental as I
from ..operators import ordered as O
from ..operators import sessions as S
from ..operators import turns as U
from . import fixtures as X
from .registry import query

V = X.VIEWS


@query(V + "SELECT source, conv_id, turn, assistant, human FROM turns")
def turn_pairs(spark, sf_dir):
    return X.turns(spark, sf_dir)


_LINE = "CASE WHEN assistant <> '' THEN CASE WHEN source IN ('slack', 'github-prs') THEN '[peer]: ' ELSE '[assistant]: ' END || a || chr(10) ELSE '' END || '[owner]: ' || human || chr(10) || chr(10)"
_LINES = f""", cuts AS (SELECT *, regexp_replace(assistant, '^\\s+|\\s+$', '', 'g') AS t FROM turns),
fits AS (SELECT *, CASE WHEN strlen(t) <= 500 THEN t ELSE left(t, list_max(list_filter(range(125, 501), lambda k: strlen(left(t, k)) <= 500))) || '...' END AS a FROM cuts),
lines AS (SELECT source, conv_id, turn, {_LINE} AS line FROM fits)"""


def _lines(spark, sf_dir):
    t = X.turns(spark, sf_dir)
    return U.turn_lines(t, U.is_human_source("source"))


_CONTEXT = _LINES.replace("CASE WHEN strlen(t) <= 500", "CASE WHEN len(regexp_extract_all(human, '\\S+')) < 50 THEN CASE WHEN strlen(t) <= 1200 THEN t ELSE left(t, list_max(list_filter(range(300, 1201), lambda k: strlen(left(t, k)) <= 1200))) || '...' END WHEN strlen(t) <= 500")


@query(V + _CONTEXT + " SELECT source, conv_id, turn, line FROM lines")
def turn_lines_in_context(spark, sf_dir):
    """What a message of fewer than fifty words answers is kept up to 1,200 bytes."""
    return U.turn_lines(X.turns(spark, sf_dir), U.is_human_source("source"), True, 1200).select("source", "conv_id", "turn", "line")


@query(V + _LINES + " SELECT source, conv_id, turn, line FROM lines")
def turn_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("source", "conv_id", "turn", "line")


def _fill_sql(rows: str, key: str, limit: int) -> str:
    """A recursive walk over rows(key, rn, n): the running chunk of each."""
    return f"""walk AS (SELECT {key}, rn, n AS used, 0 AS chunk FROM {rows} WHERE rn = 1
    UNION ALL SELECT r.{key}, r.rn, CASE WHEN w.used + r.n > {limit} THEN r.n ELSE w.used + r.n END, w.chunk + CASE WHEN w.used + r.n > {limit} THEN 1 ELSE 0 END
    FROM walk w JOIN {rows} r ON r.{key} = w.{key} AND r.rn = w.rn + 1)"""


_CHUNKS = V.replace("WITH", "WITH RECURSIVE", 1) + _LINES + f""", fl AS (SELECT conv_id, line, source, strlen(line) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM lines),
{_fill_sql('fl', 'conv_id', 2000)}
SELECT f.source, f.conv_id, CAST(w.chunk AS INTEGER) AS chunk, count(*) AS n, CAST(sum(f.n) AS BIGINT) AS n_bytes, string_agg(f.line, '' ORDER BY f.rn) AS text FROM walk w JOIN fl f USING (conv_id, rn) GROUP BY ALL"""


@query(_CHUNKS)
def observe_chunks(spark, sf_dir):
    return U.chunks(_lines(spark, sf_dir), ["source", "conv_id"], 2000)


_CHANNEL = f"""WITH RECURSIVE m AS (SELECT 'c' || (conv_id % 12) AS channel, conv_id * 1000 + turn AS pos, conv_id * 1000 + turn AS ts, role, (turn % 7 = 3) AS noise, '@' || role || ': ' || text AS content, text AS raw FROM conversations),
owned AS (SELECT channel FROM m WHERE NOT noise AND role = 'user' GROUP BY channel),
titles AS (SELECT channel, arg_min(raw, pos) AS title FROM m WHERE trim(raw) <> '' GROUP BY channel),
kept AS (SELECT channel, ts, strlen(content) AS n, row_number() OVER (PARTITION BY channel ORDER BY pos) AS rn FROM m WHERE NOT noise AND channel IN (SELECT channel FROM owned)),
{_fill_sql('kept', 'channel', 20000)}
SELECT k.channel, CAST(w.chunk AS INTEGER) AS chunk, CASE WHEN w.chunk > 0 THEN '[part ' || (w.chunk + 1) || '] ' ELSE '' END || t.title AS title, count(*) AS n, CAST(sum(k.n) AS BIGINT) AS n_bytes, min(k.ts) AS created, max(k.ts) AS updated
FROM walk w JOIN kept k USING (channel, rn) JOIN titles t USING (channel) GROUP BY k.channel, w.chunk, t.title"""


@query(_CHANNEL)
def channel_chunks(spark, sf_dir):
    m = X.table(spark, sf_dir, "conversations")
    at = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    m = m.select(F.concat(F.lit("c"), (F.col("conv_id") % 12).cast("string")).alias("channel"), at.alias("pos"), at.alias("ts"), "role", (F.col("turn") % 7 == 3).alias("noise"), F.concat(F.lit("@"), "role", F.lit(": "), "text").alias("content"), F.col("text").alias("raw"))
    return U.channel_chunks(m)


@query(V + "SELECT e.* FROM entries e LEFT JOIN stored s USING (source, conv_id) WHERE s.conv_id IS NULL")
def pending_by_existence(spark, sf_dir):
    return I.without(X.entries(spark, sf_dir), X.stored(spark, sf_dir), ["source", "conv_id"])


@query(V + "SELECT e.* FROM entries e LEFT JOIN stored s USING (source, conv_id) WHERE s.last_modified IS DISTINCT FROM e.last_modified")
def pending_by_fingerprint(spark, sf_dir):
    e = X.entries(spark, sf_dir).withColumn("fp", F.col("last_modified"))
    return I.stale(e, X.stored(spark, sf_dir).withColumnRenamed("last_modified", "fp"), ["source", "conv_id"]).drop("fp")


@query(V + "SELECT e.source, e.conv_id, CASE WHEN s.conv_id IS NULL THEN 'new' WHEN e.last_modified > s.last_modified THEN 'changed' ELSE 'same' END AS status FROM entries e LEFT JOIN stored s USING (source, conv_id)")
def upload_diff(spark, sf_dir):
    e = X.entries(spark, sf_dir).withColumnRenamed("last_modified", "updated_at")
    return I.changed_since(e, X.stored(spark, sf_dir), ["source", "conv_id"]).select("source", "conv_id", "status")


@query(V + "SELECT * FROM entries ORDER BY last_modified DESC, source, conv_id LIMIT 25")
def newest_n(spark, sf_dir):
    return I.newest(X.entries(spark, sf_dir), 25, "last_modified", ["source", "conv_id"])


@query(V + "SELECT source, conv_id, CAST((row_number() OVER (ORDER BY size_bytes DESC, source, conv_id) - 1) % 8 AS INTEGER) AS bucket FROM entries")
def dispatch_buckets(spark, sf_dir):
    return I.dispatch(X.entries(spark, sf_dir), 8, "size_bytes", ["source", "conv_id"]).select("source", "conv_id", "bucket")


@query(V + "SELECT count(*) AS total, least(25, count(*)) AS processed, greatest(count(*) - 25, 0) AS remaining FROM entries e ANTI JOIN stored s USING (source, conv_id)")
def remaining_counts(spark, sf_dir):
    return I.remaining(I.without(X.entries(spark, sf_dir), X.stored(spark, sf_dir), ["source", "conv_id"]), 25)


@query("WITH v AS (SELECT conv_id * 1000 + turn AS ts, CASE WHEN conv_id % 5 = 4 THEN '' ELSE text END AS content FROM conversations) SELECT max(ts) AS ts, arg_max(content, ts) AS content FROM v WHERE content <> ''")
def latest_version(spark, sf_dir):
    v = X.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.when(F.col("conv_id") % 5 == 4, "").otherwise(F.col("text")).alias("content"))
    return I.latest(v)


@query(V + "SELECT source, conv_id, CASE WHEN conv_id % 3 = 0 THEN size_bytes ELSE size_bytes + 1 END AS size_bytes FROM entries")
def sync_merge(spark, sf_dir):
    """A third is ours alone, a third theirs, and of what both have theirs counts."""
    e = X.entries(spark, sf_dir).select("source", "conv_id", "size_bytes")
    return I.merged(e.filter("conv_id % 3 <> 1"), e.filter("conv_id % 3 <> 0").withColumn("size_bytes", F.col("size_bytes") + 1), ["source", "conv_id"])


@query("SELECT id, conv_id, turn FROM (SELECT conv_id % 40 AS id, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY turn DESC, strlen(text) DESC, conv_id) AS n FROM conversations) WHERE n = 1")
def dedup_sessions(spark, sf_dir):
    m = X.table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") % 40)
    return I.first_of(m, ["id"], [F.desc("turn"), F.desc(F.octet_length("text")), F.col("conv_id")]).select("id", "conv_id", "turn")


@query(V + "SELECT DISTINCT label FROM obs")
def label_vocabulary(spark, sf_dir):
    return C.vocabulary(X.observations(spark, sf_dir))


@query(V + "SELECT source, conv_id, CAST((row_number() OVER (PARTITION BY source, conv_id ORDER BY idx) - 1) // 3 AS INTEGER) AS batch, count(*) OVER (PARTITION BY source, conv_id) AS n, idx FROM obs")
def label_batches(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("source", "conv_id")
    return X.observations(spark, sf_dir).select("source", "conv_id", F.floor((F.row_number().over(w.orderBy("idx")) - 1) / 3).cast("int").alias("batch"), F.count("*").over(w).alias("n"), "idx")


@query(V + "SELECT DISTINCT label FROM obs WHERE number >= 60")
def theme_unmapped(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    mapped = o.filter("number < 60").select("label").distinct()
    return I.without(o.select("label").distinct(), mapped, ["label"])


def _clustered(spark, sf_dir):
    o = X.observations(spark, sf_dir).withColumn("theme", F.coalesce(X.theme_of(), "label"))
    return C.clustered(o)


@query(V + "SELECT cluster, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM clustered WHERE cluster IS NOT NULL GROUP BY cluster")
def clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query(V + "SELECT source, conv_id, idx, label FROM clustered WHERE cluster IS NULL")
def noise(spark, sf_dir):
    return _clustered(spark, sf_dir).filter("cluster IS NULL").select("source", "conv_id", "idx", "label")


_SAMPLED = ", mixed AS (SELECT *, strlen(text) * 2 // 9 AS tok, md5('42:' || conv_id || ':' || idx) AS mx FROM clustered), run AS (SELECT *, sum(tok) OVER w AS total, row_number() OVER w AS rn FROM mixed WHERE cluster IS NOT NULL WINDOW w AS (PARTITION BY cluster ORDER BY mx, conv_id, idx ROWS UNBOUNDED PRECEDING)), sampled AS (SELECT * FROM run WHERE total <= 100 OR rn = 1)"


def _sampled(spark, sf_dir):
    c = _clustered(spark, sf_dir).withColumn("tok", F.floor(F.octet_length("text") * 2 / 9))
    return C.sampled(c, ["conv_id", "idx"], "tok", 42, 100)


@query(V + _SAMPLED + " SELECT cluster, conv_id, idx FROM sampled")
def cluster_samples(spark, sf_dir):
    return _sampled(spark, sf_dir).select("cluster", "conv_id", "idx")


@query(V + ", r AS (SELECT *, sum(strlen(text) * 2 // 9) OVER (ORDER BY conv_id, idx ROWS UNBOUNDED PRECEDING) AS total FROM clustered WHERE cluster IS NULL) SELECT conv_id, idx FROM r WHERE total <= 300")
def noise_budget(spark, sf_dir):
    n = _clustered(spark, sf_dir).filter("cluster IS NULL").withColumn("tok", F.floor(F.octet_length("text") * 2 / 9))
    coarse = O.range_of(F.col("conv_id"), O.range_bounds(n, "conv_id"))
    return O.budget_prefix(n, [], [F.col("conv_id"), F.col("idx")], "tok", 300, False, coarse).select("conv_id", "idx")


@query(V + _SAMPLED + ", n AS (SELECT cluster, count(*) AS n FROM sampled GROUP BY cluster) SELECT cluster, n, CAST(row_number() OVER (ORDER BY n DESC, cluster) AS INTEGER) AS number FROM n")
def cluster_numbering(spark, sf_dir):
    return C.numbered(_sampled(spark, sf_dir))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE CAST(conv_id % 4 AS INTEGER) END AS missing FROM (SELECT DISTINCT conv_id FROM conversations)")
def thesis_missing(spark, sf_dir):
    gap = (F.col("conv_id") % 4).cast("int")
    text = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i != gap), lambda i: F.concat(F.lit("Cluster "), i.cast("string"), F.lit(": x"))), "\n")
    return C.missing_from(X.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("text", text), 4).select("conv_id", "missing")


@query(V + _SAMPLED + " SELECT cluster, 'Cluster theme: ' || cluster || chr(10) || chr(10) || 'Observations:' || chr(10) || string_agg('---' || chr(10) || text, chr(10) ORDER BY mx) AS input FROM sampled GROUP BY cluster")
def summary_inputs(spark, sf_dir):
    return C.summary_inputs(_sampled(spark, sf_dir))


@query(V + "SELECT source, count(*) AS conversations, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM entries GROUP BY source")
def source_breakdown(spark, sf_dir):
    return I.per_source(X.entries(spark, sf_dir), "conversations", "size_bytes")


@query(V + "SELECT source, count(*) AS observations FROM obs GROUP BY source")
def obs_per_source(spark, sf_dir):
    return I.per_source(X.observations(spark, sf_dir), "observations")


@query("WITH u AS (SELECT role AS stage, strlen(text) AS i, turn * 7 AS o FROM conversations) SELECT stage, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(round(sum(i * 3e-6 + o * 1.5e-5), 6) AS DOUBLE) AS cost FROM u GROUP BY ROLLUP (stage)")
def usage_rollup(spark, sf_dir):
    u = X.table(spark, sf_dir, "conversations").select(F.col("role").alias("stage"), F.octet_length("text").cast("long").alias("input_tokens"), (F.col("turn") * 7).alias("output_tokens"))
    return E.usage_totals(u.withColumn("cost", F.col("input_tokens") * 3e-6 + F.col("output_tokens") * 1.5e-5)).withColumn("cost", F.round("cost", 6))


@query(V + "SELECT CAST(count_if(s.last_modified = e.last_modified) AS BIGINT) AS hit, CAST(count_if(s.last_modified IS DISTINCT FROM e.last_modified) AS BIGINT) AS miss FROM entries e LEFT JOIN stored s USING (source, conv_id)")
def cache_hit_miss(spark, sf_dir):
    return I.hits(X.entries(spark, sf_dir), X.stored(spark, sf_dir), ["source", "conv_id"], "last_modified")


@query(V + ", d AS (SELECT e.*, s.last_modified AS old FROM entries e LEFT JOIN stored s USING (source, conv_id)) SELECT source, count(*) AS discovered, CAST(count_if(old IS NULL OR last_modified > old) AS BIGINT) AS uploaded, CAST(count_if(NOT (old IS NULL OR last_modified > old)) AS BIGINT) AS skipped, CAST(coalesce(sum(size_bytes) FILTER (old IS NULL OR last_modified > old), 0) AS BIGINT) AS n_bytes FROM d GROUP BY source")
def import_counts(spark, sf_dir):
    e = X.entries(spark, sf_dir).withColumnRenamed("last_modified", "updated_at")
    d = I.changed_since(e, X.stored(spark, sf_dir), ["source", "conv_id"])
    return I.upload_totals(d).withColumnRenamed("bytes", "n_bytes")


@query(V + "SELECT DISTINCT source FROM stored")
def active_sources(spark, sf_dir):
    return S.active(X.stored(spark, sf_dir))


_CHAT = "SELECT conv_id, turn, role, CASE turn % 6 WHEN 0 THEN '' WHEN 1 THEN 'channel_join' WHEN 2 THEN 'bot_message' WHEN 3 THEN 'group_topic' ELSE 'thread_broadcast' END AS subtype, CASE WHEN conv_id % 9 = 0 THEN 'B1' ELSE '' END AS bot_id, CASE WHEN conv_id % 5 = 1 THEN ' <https://x.example.com/' || turn || '> ' ELSE text END AS text FROM conversations"


@query(f"SELECT conv_id, turn FROM ({_CHAT}) WHERE NOT (bot_id <> '' OR subtype IN ('bot_message', 'channel_join', 'group_topic') OR regexp_matches(text, '^\\s*<https?://[^>]+>\\s*$'))")
def chat_noise_filter(spark, sf_dir):
    k = F.col("turn") % 6
    sub = F.when(k == 0, "").when(k == 1, "channel_join").when(k == 2, "bot_message").when(k == 3, "group_topic").otherwise("thread_broadcast")
    text = F.when(F.col("conv_id") % 5 == 1, F.concat(F.lit(" <https://x.example.com/"), F.col("turn").cast("string"), F.lit("> "))).otherwise(F.col("text"))
    return X.table(spark, sf_dir, "conversations").filter(~H.chat_noise(text, sub, F.when(F.col("conv_id") % 9 == 0, "B1"))).select("conv_id", "turn")


_AUTHORS = ["octo", "deploy[bot]", "GoogleBot", "codecov", "Owner"]
_AUTHOR_SQL = "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AUTHORS)) + " END"


def _author():
    return F.element_at(F.array(*[F.lit(a) for a in _AUTHORS]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))


@query(f"SELECT conv_id, turn, {_AUTHOR_SQL} AS author FROM conversations WHERE (conv_id + turn) % 5 IN (0, 4)")
def bot_filter(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations").filter(~H.is_bot(_author())).select("conv_id", "turn", _author().alias("author"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 4 NOT IN (0, 2)")
def command_noise_filter(spark, sf_dir):
    k, t = F.col("turn") % 4, F.col("text")
    body = F.when(k == 0, " /lgtm  now ").when(k == 1, F.concat(F.lit("/test\n"), t)).when(k == 2, "  \n ").otherwise(F.concat(F.lit("/unknown "), t))
    return X.table(spark, sf_dir, "conversations").filter(~H.command_noise(body)).select("conv_id", "turn")


@query(f"WITH m AS (SELECT conv_id, turn, {_AUTHOR_SQL} AS author, text FROM conversations) SELECT conv_id, turn, CASE WHEN author = 'Owner' THEN text ELSE '[GitHub comment by @' || author || ']' || chr(10) || text END AS body FROM m WHERE conv_id IN (SELECT conv_id FROM m WHERE author = 'Owner' GROUP BY conv_id HAVING count(*) >= 2)")
def thread_threshold(spark, sf_dir):
    m = X.table(spark, sf_dir, "conversations").withColumn("author", _author())
    kept = H.owned_threads(m, ["conv_id"], F.lower("author") == "owner")
    return kept.select("conv_id", "turn", H.attributed("author", F.lit("owner"), "text").alias("body"))


@query("SELECT conv_id, turn, '[src/' || conv_id || '.py]' || chr(10) || array_to_string(list_transform(range(greatest(turn * 2 - 8, 0), turn * 2 + 1)[-8:], lambda i: 'line ' || i), chr(10)) || chr(10) || chr(10) || '[review: approved]' || chr(10) || text AS body FROM conversations")
def review_comment_format(spark, sf_dir):
    hunk = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") * 2), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    body = H.review_comment(F.concat(F.lit("src/"), F.col("conv_id").cast("string"), F.lit(".py")), hunk, H.review_state(F.lit("APPROVED"), "text"))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


@query("SELECT event_type AS channel, min(event_id) AS first_ts, max(event_id) AS last_ts, list_sort(list(DISTINCT user_id)) AS threads FROM events GROUP BY event_type")
def channel_activity(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return H.channel_activity(e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("ts"), F.col("user_id").alias("thread_ts")))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'reply' ELSE 'history' END AS kind FROM conversations")
def thread_reply_merge(spark, sf_dir):
    """A third is history alone, a third replies, and what is both counts as history."""
    m = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return H.with_replies(m.filter("turn % 3 <> 1").withColumn("kind", F.lit("history")), m.filter("turn % 3 <> 0").withColumn("kind", F.lit("reply")), ["conv_id", "turn"])


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CAST(c_custkey AS VARCHAR)) AS name FROM customer")
def display_names(spark, sf_dir):
    k = F.col("c_custkey")
    return X.table(spark, sf_dir, "customer").select("c_custkey", H.display_name(F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 0, F.col("c_mktsegment")), k.cast("string")).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (1700000000 + event_id) * 1000000 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 1000000 END END AS micros FROM events")
def ts_parse(spark, sf_dir):
    from ..functions.text import chat_time

    i = F.col("event_id")
    tail = F.when(i % 2 == 0, F.lit(".x")).otherwise(F.concat(F.lit("."), (i % 1000000).cast("string")))
    ts = F.when(i % 5 == 0, F.lit("abc.1")).otherwise(F.concat((i + 1700000000).cast("string"), tail))
    return X.table(spark, sf_dir, "events").select("event_id", F.unix_micros(chat_time(ts)).alias("micros"))


_MODELS = ["us.claude-opus-4-1", "claude-sonnet-4-5", "gpt-4.1-mini-2025", "gpt-4o-mini", "gpt-4.1", "o3-pro", "unknown"]
_PRICE = [5.0, 3.0, 0.4, 0.15, 2.0, 2.0, 0.0]
_OUT = [25.0, 15.0, 1.6, 0.6, 8.0, 8.0, 0.0]


@query("SELECT DISTINCT conv_id, CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PRICE)) + " END::DOUBLE AS input_price, CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_OUT)) + " END::DOUBLE AS output_price FROM conversations")
def price_lookup(spark, sf_dir):
    m = X.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("model", F.element_at(F.array(*[F.lit(x) for x in _MODELS]), (F.col("conv_id") % 7 + 1).cast("int")))
    return E.priced(m).drop("model")


@query("SELECT DISTINCT conv_id, substr(md5('42:' || conv_id), 1, 1) < '8' AS ours_is_a FROM conversations")
def eval_blinding(spark, sf_dir):
    return E.blinded(X.table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id")


_CASES = """WITH q AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN 'universal' ELSE 'domain' END AS grp, d, (conv_id + i) % 6 AS b, CASE WHEN d = 'awareness' AND conv_id % 3 = 0 THEN NULL ELSE (conv_id * 3 + i) % 6 END AS o
      FROM q, (VALUES ('reasoning', 0), ('voice', 1), ('awareness', 2)) AS v(d, i)) """


def _cases(spark, sf_dir):
    q = X.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.array(F.lit("reasoning"), F.lit("voice"), F.lit("awareness"))
    value = lambda k: F.array(*[((F.col("conv_id") * k + i) % 6) for i in range(3)])
    ours = F.map_filter(F.map_from_arrays(name, value(3)), lambda d, _: ~((d == "awareness") & (F.col("conv_id") % 3 == 0)))
    return q.select("conv_id", F.when(F.col("conv_id") % 4 == 3, "universal").otherwise("domain").alias("grp"), F.map_from_arrays(name, value(1)).alias("base"), ours.alias("ours"))


@query(_CASES + "SELECT d AS dimension, round(avg(b), 6) AS base, round(avg(o), 6) AS ours, round(avg(o) - avg(b), 6) AS delta, count(*) AS n FROM s WHERE o IS NOT NULL GROUP BY d")
def eval_dimension_means(spark, sf_dir):
    return E.dimension_means(_cases(spark, sf_dir)).select("dimension", *[F.round(c, 6).alias(c) for c in ("base", "ours", "delta")], "n")


@query(_CASES + ", e AS (SELECT conv_id, grp, avg(o - b) AS d FROM s WHERE o IS NOT NULL GROUP BY conv_id, grp) SELECT grp, round(avg(d), 6) AS delta, count(*) AS n FROM e GROUP BY grp")
def eval_transferability(spark, sf_dir):
    return E.transfer(_cases(spark, sf_dir), "conv_id", "grp").select("grp", F.round("delta", 6).alias("delta"), "n")


_PREFERRED = "SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'neither' END AS preferred, substr(md5('42:' || conv_id), 1, 1) < '8' AS ours_is_a FROM conversations"


def _preferred(spark, sf_dir):
    k = F.col("conv_id") % 3
    q = X.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return E.blinded(q.withColumn("preferred", F.when(k == 0, "A").when(k == 1, "B").otherwise("neither")), "conv_id")


@query(f"SELECT CAST(count_if((preferred = 'A') = ours_is_a AND preferred <> 'neither') AS BIGINT) AS n_ours, CAST(count_if((preferred = 'A') <> ours_is_a AND preferred <> 'neither') AS BIGINT) AS n_base, CAST(count_if(preferred = 'neither') AS BIGINT) AS n_neither FROM ({_PREFERRED})")
def eval_preferences(spark, sf_dir):
    return E.preferences(_preferred(spark, sf_dir))


@query(f"WITH p AS (SELECT conv_id, CASE WHEN preferred = 'neither' THEN 1 WHEN (preferred = 'A') = ours_is_a THEN 0 ELSE 2 END AS outcome FROM ({_PREFERRED})) SELECT conv_id, outcome, CAST(row_number() OVER (ORDER BY outcome, conv_id) AS INTEGER) AS place FROM p")
def eval_summary_order(spark, sf_dir):
    return E.summary_order(_preferred(spark, sf_dir), "conv_id")
